"""Text, label, split, metric and similarity queries (SURVEY 2.J, F4-F6, B33,
B34, A6) bound to the test tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contingo.functions.columns import TEXT_RULES, clean_text, sigmoid, softmax
from contingo.operators.joint import classify_joint, fit_joint, load_model, save_model
from contingo.operators.text import (classify_batch, classify_naive_bayes, fit_multilabel_classifier, fit_naive_bayes,
                                     hash_split, label_explode,
                                     label_list, multi_hot, multilabel_metrics, split_subset, top_k_classes)
from contingo.plans.common import query, scratch, tbl

LABELS = ["quality", "toxic"]
TEST_FRACTION = 0.1
SPLIT_SEED = 42
SUBSET_FRACTION = 0.05

# White space in the oracle's regex dialect.
_WS_RE2 = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
def _re2(pattern: str) -> str:
    """A normalisation rule's pattern as SQL text for the oracle's regex dialect."""
    return (pattern.replace("'", "''").replace(".*?", "[^\n]*?").replace("[\\s]", _WS_RE2)
            .replace("\n", "\\n").replace("\u00a0", "\\x{A0}"))


_SQL_RULES = [(_re2(pattern), replacement) for pattern, replacement in TEXT_RULES]


def _sql_clean(expr: str) -> str:
    out = f"lower({expr})"
    for pat, rep in _SQL_RULES:
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    out = f"regexp_replace({out}, '{_WS_RE2}+', ' ', 'g')"
    return f"trim({out})"


@query("text_clean", f"SELECT doc_id, {_sql_clean('text')} AS clean FROM documents")
def q_text_clean(spark, d):
    """Lower case, the ordered replacement rules, whitespace collapse,
    trim -- over every whole document."""
    return tbl(spark, d, "documents").select("doc_id", clean_text("text").alias("clean"))


@query("conversation_clean", f"SELECT conv_id, turn, role, {_sql_clean('text')} AS clean FROM conversations")
def q_conversation_clean(spark, d):
    """B33 on every conversation turn."""
    return tbl(spark, d, "conversations").select("conv_id", "turn", "role", clean_text("text").alias("clean"))


_RULE_TEXT = "concat('What''s ', p_name, ' I''m sure it''s - won''t can''t don''t we''ve you''re he''d she''ll &amp; @user x  ', p_type, ' ')"


@query("text_rules", f"SELECT p_partkey, {_sql_clean(_RULE_TEXT)} AS clean FROM part")
def q_text_rules(spark, d):
    """B33 on texts in which the rules for apostrophes, dashes, ampersands and names apply."""
    return tbl(spark, d, "part").select("p_partkey", clean_text(F.expr(_RULE_TEXT.replace("''", "\\'"))).alias("clean"))


def _class_logits(spark, d):
    e = tbl(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))


_SQL_SCORES = f"""
logits AS (SELECT vec_id, pos - 1 AS class, CAST(v AS DOUBLE) AS logit
           FROM (SELECT vec_id, unnest(embedding) AS v,
                        unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)),
sm AS (SELECT vec_id, class, logit, 1.0 / (1.0 + exp(-logit)) AS sig,
              exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS ex FROM logits),
probs AS (SELECT vec_id, class, logit, sig, ex / sum(ex) OVER (PARTITION BY vec_id) AS prob FROM sm)"""


def _scores(spark, d):
    lg = _class_logits(spark, d).withColumn("probs", softmax("logits"))
    return lg.select("vec_id", F.posexplode(F.arrays_zip("logits", "probs")).alias("class", "z")).select(
        "vec_id", "class", F.col("z.logits").alias("logit"), sigmoid(F.col("z.logits")).alias("sig"),
        F.col("z.probs").alias("prob"))


@query("class_scores", f"""WITH {_SQL_SCORES}
SELECT vec_id, CAST(class AS INTEGER) AS class, round(logit, 6) AS logit, round(sig, 6) AS sig,
       round(prob, 6) AS prob FROM probs""")
def q_class_scores(spark, d):
    """Sigmoid and softmax of per-row score vectors."""
    s = _scores(spark, d)
    return s.select("vec_id", "class", F.round("logit", 6).alias("logit"), F.round("sig", 6).alias("sig"),
                    F.round("prob", 6).alias("prob"))


@query("top_classes", f"""WITH {_SQL_SCORES},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, class) AS INTEGER) AS rank FROM probs)
SELECT vec_id, CAST(class AS INTEGER) AS class, round(prob, 6) AS prob, rank FROM r WHERE rank <= 3""")
def q_top_classes(spark, d):
    """the three most probable classes of each row (a top-k report)."""
    t = top_k_classes(_scores(spark, d), "vec_id", "class", "prob", 3)
    return t.select("vec_id", "class", F.round("prob", 6).alias("prob"), "rank")


def _labelled(spark, d):
    return label_list(tbl(spark, d, "labels"), LABELS)


@query("label_explode", """
SELECT doc_id, 'quality' AS label_description, 0 AS label FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, 'toxic', 1 FROM labels WHERE toxic = 1""")
def q_label_explode(spark, d):
    """One row per (text, label) with the label id."""
    ids = {lab: i for i, lab in enumerate(LABELS)}
    return label_explode(_labelled(spark, d), ["doc_id"], "label_descriptions", ids)


@query("label_index", """
WITH l AS (SELECT DISTINCT 'quality' AS label FROM labels WHERE quality = 1
           UNION SELECT DISTINCT 'toxic' FROM labels WHERE toxic = 1)
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS id FROM l""")
def q_label_index(spark, d):
    """The labels present and their ids in a fixed (sorted) order; the
    window runs over the distinct labels only."""
    lab = _labelled(spark, d).select(F.explode("label_descriptions").alias("label")).distinct()
    return lab.withColumn("id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


@query("multi_hot", """
SELECT doc_id, [CAST(quality = 1 AS INTEGER)::DOUBLE, CAST(toxic = 1 AS INTEGER)::DOUBLE] AS labels FROM labels""")
def q_multi_hot(spark, d):
    """Multi-hot label vector per text."""
    return multi_hot(_labelled(spark, d), "label_descriptions", LABELS).select("doc_id", "labels")


_SQL_SPLIT = f"""
sp AS (SELECT doc_id, ('0x' || substr(md5(concat_ws('|', doc_id, {SPLIT_SEED})), 1, 8))::BIGINT AS h FROM documents),
splits AS (SELECT doc_id, h, CASE WHEN h::DOUBLE < {TEST_FRACTION * 4294967296.0} THEN 'test' ELSE 'train' END AS split
           FROM sp)"""


@query("train_test_split", f"WITH {_SQL_SPLIT} SELECT doc_id, split FROM splits")
def q_train_test_split(spark, d):
    """repeatable 90/10 split by a seeded hash of the key."""
    return hash_split(tbl(spark, d, "documents").select("doc_id"), ["doc_id"], TEST_FRACTION, SPLIT_SEED)


@query("split_subset", f"""WITH {_SQL_SPLIT},
r AS (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY h, doc_id) AS rn,
             count(*) OVER (PARTITION BY split) AS n FROM splits)
SELECT doc_id, split FROM r WHERE rn <= floor(n * {SUBSET_FRACTION})""")
def q_split_subset(spark, d):
    """seeded shuffle of each split, keep its first int(n * 5%) rows
    (a sampling operator: the limit is the feature)."""
    s = hash_split(tbl(spark, d, "documents").select("doc_id"), ["doc_id"], TEST_FRACTION, SPLIT_SEED)
    return split_subset(s, "split", ["doc_id"], SUBSET_FRACTION, SPLIT_SEED).select("doc_id", "split")


def _rule_scores(spark, d):
    """A fixed rule score per (document, label) -- the 'model output'."""
    docs = tbl(spark, d, "documents").select("doc_id", "n_chars", "lang")
    lab = tbl(spark, d, "labels")
    j = lab.join(docs, "doc_id", "inner")
    q = (F.col("n_chars") - F.lit(2000.0)) / F.lit(1000.0)
    t = F.when(F.col("lang") == "en", F.lit(0.4)).otherwise(F.lit(-1.0)) + F.log1p(F.col("n_chars")) / F.lit(10.0)
    return j.select("doc_id", F.inline(F.array(
        F.struct(F.lit("quality").alias("label_name"), q.alias("score"), F.col("quality").alias("y")),
        F.struct(F.lit("toxic").alias("label_name"), t.alias("score"), F.col("toxic").alias("y")))))


@query("multilabel_metrics", """
WITH j AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id)),
cells AS (
  SELECT 'quality' AS label_name, (n_chars - 2000.0) / 1000.0 AS score, quality AS y FROM j
  UNION ALL
  SELECT 'toxic', CASE WHEN lang = 'en' THEN 0.4 ELSE -1.0 END + ln(1 + n_chars) / 10.0, toxic FROM j),
pl AS (
  SELECT label_name,
    sum(CASE WHEN score > 0.3 AND y = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN score > 0.3 AND y <> 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN score <= 0.3 AND y = 1 THEN 1 ELSE 0 END) AS fn,
    sum(CASE WHEN (1.0 / (1.0 + exp(-score)) > 0.3) = (y = 1) THEN 1 ELSE 0 END) AS acc_hits,
    count(*) AS cells,
    sum(CASE WHEN score <= 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS c_tn,
    sum(CASE WHEN score > 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS c_fp,
    sum(CASE WHEN score <= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS c_fn,
    sum(CASE WHEN score > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS c_tp
  FROM cells GROUP BY label_name)
SELECT sum(acc_hits) / sum(cells) AS accuracy_thresh,
  CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0 ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END
    AS f1_micro,
  avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS f1_macro,
  CAST(sum(c_tn) AS BIGINT) AS tn, CAST(sum(c_fp) AS BIGINT) AS fp, CAST(sum(c_fn) AS BIGINT) AS fn,
  CAST(sum(c_tp) AS BIGINT) AS tp
FROM pl""")
def q_multilabel_metrics(spark, d):
    """Thresholded accuracy, micro / macro F1 and the flattened confusion
    counts of a rule score against the labels."""
    return multilabel_metrics(_rule_scores(spark, d), "score", "y", "label_name")


@query("classify_batch")
def q_classify_batch(spark, d):
    """J5 + J6: fit one logistic regression per label on the labelled texts
    (TF-IDF features), classify every document, one row per predicted label.
    Iterative model fitting: rows-only check."""
    docs = tbl(spark, d, "documents").select("doc_id", "text")
    train = docs.join(tbl(spark, d, "labels"), "doc_id", "inner")
    model = fit_multilabel_classifier(train, "text", LABELS, num_features=1 << 16, max_iter=10)
    return classify_batch(model, docs, ["doc_id"], "text", LABELS)


@query("classify_naive_bayes", """
WITH tok AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 4096 AS bucket
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL)),
cells AS (SELECT l.doc_id, 'quality' AS label, quality AS y FROM labels l JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL
          UNION ALL SELECT l.doc_id, 'toxic', toxic FROM labels l JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL),
size AS (SELECT label, sum(y) AS n1, sum(1 - y) AS n0 FROM cells GROUP BY label),
hits AS (SELECT label, bucket, sum(y) AS h1, sum(1 - y) AS h0 FROM tok JOIN cells USING (doc_id) GROUP BY ALL),
weights AS (SELECT label, bucket, ln((h1 + 1.0::DOUBLE) / (n1 + 2.0)) - ln((h0 + 1.0::DOUBLE) / (n0 + 2.0)) AS w FROM hits JOIN size USING (label)),
own AS (SELECT doc_id, label, sum(w) AS s FROM tok JOIN weights USING (bucket) GROUP BY ALL),
sc AS (SELECT d.doc_id, b.label, ln((n1 + 1.0::DOUBLE) / (n0 + 1.0)) + coalesce(s, 0.0) AS score
       FROM documents d CROSS JOIN size b LEFT JOIN own ON own.doc_id = d.doc_id AND own.label = b.label
       WHERE d.text IS NOT NULL)
SELECT doc_id, label, round(score, 5) AS score FROM sc WHERE score > 0""")
def q_classify_naive_bayes(spark, d):
    """J5 + J6 with a closed-form fit, so that SQL can compute the weights and labels too."""
    docs = tbl(spark, d, "documents").select("doc_id", "text")
    train = docs.join(tbl(spark, d, "labels"), "doc_id", "inner")
    weights, bias = fit_naive_bayes(train, ["doc_id"], "text", LABELS)
    return classify_naive_bayes(weights, bias, docs, ["doc_id"], "text") \
        .withColumn("score", F.round("score", 5))


JOINT_STEPS, JOINT_L2, JOINT_BUCKETS = 4, 0.001, 4096


def _sql_joint() -> str:
    """Full gradient steps for all labels, one after the other; bucket -1 is the bias."""
    rate = 1.0 / (0.5 + JOINT_L2)
    ctes = [f"""tok AS MATERIALIZED (SELECT DISTINCT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {JOINT_BUCKETS} AS bucket
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL)),
x AS MATERIALIZED (SELECT doc_id, bucket, 1.0::DOUBLE / sqrt(count(*) OVER (PARTITION BY doc_id)) AS v FROM tok
  UNION ALL SELECT doc_id, -1, 1.0::DOUBLE FROM documents WHERE text IS NOT NULL),
cells AS MATERIALIZED (SELECT l.doc_id, label, y FROM (SELECT doc_id, 'quality' AS label, quality AS y FROM labels
                                          UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l
          JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL AND y IS NOT NULL),
size AS (SELECT label, count(*)::DOUBLE AS n FROM cells GROUP BY label),
w0 AS (SELECT DISTINCT label, bucket, 0.0::DOUBLE AS w FROM cells JOIN x USING (doc_id))"""]
    for t in range(JOINT_STEPS):
        ctes.append(f"""off{t} AS MATERIALIZED (SELECT doc_id, label, y, 1 / (1 + exp(-sum(w * v))) - y AS o
  FROM cells JOIN x USING (doc_id) JOIN w{t} USING (label, bucket) GROUP BY doc_id, label, y),
g{t} AS (SELECT label, bucket, sum(o * v) AS g FROM off{t} JOIN x USING (doc_id) GROUP BY label, bucket),
w{t + 1} AS MATERIALIZED (SELECT label, bucket, w - {rate!r}::DOUBLE * (g / n + CASE WHEN bucket >= 0 THEN {JOINT_L2} * w ELSE 0 END) AS w
  FROM w{t} JOIN g{t} USING (label, bucket) JOIN size USING (label))""")
    return f"""WITH {", ".join(ctes)},
s AS (SELECT doc_id, label, 1 / (1 + exp(-sum(w * v))) AS p FROM x JOIN w{JOINT_STEPS} USING (bucket) GROUP BY doc_id, label)
SELECT doc_id, label, round(p, 5) AS score FROM s WHERE p > 0.5"""


@query("classify_joint", _sql_joint())
def q_classify_joint(spark, d):
    """J5 + J6: one sigmoid a label, all labels fitted together by full gradient steps; the model is written, read
    and scores every document."""
    docs = tbl(spark, d, "documents").select("doc_id", "text")
    train = docs.join(tbl(spark, d, "labels"), "doc_id", "inner")
    path = scratch(spark, "joint-model")
    save_model(fit_joint(train, "text", LABELS, JOINT_BUCKETS, JOINT_STEPS, JOINT_L2), path)
    return classify_joint(load_model(spark, path), docs, ["doc_id"], "text", JOINT_BUCKETS) \
        .withColumn("score", F.round("score", 5))


def _label_means(spark, d):
    e = tbl(spark, d, "embeddings")
    return (e.select("label", F.posexplode("embedding").alias("pos", "v"))
            .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m")))


_SQL_SIM = """
ex AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos
       FROM embeddings),
means AS (SELECT label, pos, avg(v) AS m FROM ex GROUP BY label, pos),
norms AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM means GROUP BY label),
dots AS (SELECT x.label AS row_label, y.label AS col_label, sum(x.m * y.m) AS dot
         FROM means x JOIN means y ON x.pos = y.pos GROUP BY x.label, y.label),
sim AS (SELECT row_label, col_label, dot / (nx.nrm * ny.nrm) AS similarity
        FROM dots JOIN norms nx ON nx.label = row_label JOIN norms ny ON ny.label = col_label)"""


def similarity_long(spark, d):
    """Cosine similarity between the mean vectors of every pair of classes
    (the square class matrix, in long form)."""
    m = _label_means(spark, d)
    norms = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("nrm"))
    x = m.select(F.col("label").alias("row_label"), "pos", F.col("m").alias("mx"))
    y = m.select(F.col("label").alias("col_label"), "pos", F.col("m").alias("my"))
    dots = x.join(y, "pos").groupBy("row_label", "col_label").agg(F.sum(F.col("mx") * F.col("my")).alias("dot"))
    nx = norms.select(F.col("label").alias("row_label"), F.col("nrm").alias("nx"))
    ny = norms.select(F.col("label").alias("col_label"), F.col("nrm").alias("ny"))
    return (dots.join(nx, "row_label").join(ny, "col_label")
            .select("row_label", "col_label", (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("similarity")))


@query("similarity_edges", f"""WITH {_SQL_SIM},
d AS (SELECT row_label, col_label, similarity, 1 - similarity AS distance FROM sim),
nn AS (SELECT row_label, col_label, row_number() OVER (PARTITION BY row_label ORDER BY distance, col_label) AS r
       FROM d WHERE row_label <> col_label)
SELECT d.row_label, d.col_label, round(d.similarity, 6) AS similarity, round(d.distance, 6) AS distance,
  coalesce(nn.r = 1, false) AS is_nearest
FROM d LEFT JOIN nn ON nn.row_label = d.row_label AND nn.col_label = d.col_label""")
def q_similarity_edges(spark, d):
    """distance = 1 - similarity between classes; the nearest other class
    of each class is flagged."""
    s = similarity_long(spark, d).withColumn("distance", F.lit(1.0) - F.col("similarity"))
    w = Window.partitionBy("row_label").orderBy("distance", "col_label")
    nn = (s.where(F.col("row_label") != F.col("col_label")).withColumn("r", F.row_number().over(w))
          .where(F.col("r") == 1).select("row_label", "col_label", F.lit(True).alias("is_nearest")))
    return (s.join(nn, ["row_label", "col_label"], "left")
            .select("row_label", "col_label", F.round("similarity", 6).alias("similarity"),
                    F.round("distance", 6).alias("distance"),
                    F.coalesce(F.col("is_nearest"), F.lit(False)).alias("is_nearest")))
