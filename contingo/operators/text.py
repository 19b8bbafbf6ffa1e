"""Labels, splits, metrics and a multi-label classifier as Spark jobs
(SURVEY 2.J, F4-F6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contingo.functions.columns import md5_unit_hash, sigmoid

_TWO_32 = 4294967296.0


def label_list(df: DataFrame, label_cols: Sequence[str], out: str = "label_descriptions") -> DataFrame:
    """The label names whose 0/1 column is 1, as an array (fixed label order)."""
    arr = F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in label_cols])
    return df.withColumn(out, F.filter(arr, lambda x: x.isNotNull()))


def label_index(labels: Sequence[str]) -> dict[str, int]:
    """Label -> id in the given order (id2label is its inverse)."""
    return {lab: i for i, lab in enumerate(labels)}


def label_explode(df: DataFrame, keys: Sequence[str], list_col: str, label_ids: dict[str, int],
                  out_desc: str = "label_description", out_id: str = "label") -> DataFrame:
    """One row per (text, label) with the label id; an empty list gives
    no row."""
    lut = F.create_map(*[x for k, v in label_ids.items() for x in (F.lit(k), F.lit(v))])
    return (df.select(*keys, F.explode(list_col).alias(out_desc))
            .withColumn(out_id, F.element_at(lut, F.col(out_desc))))


def multi_hot(df: DataFrame, list_col: str, labels: Sequence[str], out: str = "labels") -> DataFrame:
    """A 0/1 double vector over the ordered labels (per row, no grouping)."""
    vec = F.array(*[F.when(F.array_contains(F.col(list_col), lab), F.lit(1.0)).otherwise(F.lit(0.0))
                    for lab in labels])
    return df.withColumn(out, vec)


def hash_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float = 0.1, seed: int = 42,
               out: str = "split") -> DataFrame:
    """repeatable train / test split by a hash of the key and the seed
    (independent of partitioning, unlike ``randomSplit``)."""
    h = md5_unit_hash(*key_cols, F.lit(seed))
    return df.withColumn(out, F.when(h.cast("double") < F.lit(test_fraction * _TWO_32), F.lit("test"))
                         .otherwise(F.lit("train")))


def split_subset(df: DataFrame, split_col: str, key_cols: Sequence[str], fraction: float,
                 seed: int = 42, buckets: int = 65536) -> DataFrame:
    """shuffle each split by a seeded hash and keep its first
    int(n * fraction) rows -- exactly, without a global sort in one task.

    Rows are bucketed by the top bits of the hash; bucket counts (a tiny
    table) locate the bucket holding the cut; rows below it are kept whole and
    only the cut bucket (about n / buckets rows) is ranked.
    """
    h = md5_unit_hash(*key_cols, F.lit(seed))
    shift = 32 - (buckets.bit_length() - 1)
    base = df.withColumn("_h", h).withColumn("_bucket", F.shiftright(F.col("_h"), shift))
    per_bucket = base.groupBy(split_col, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(split_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = (per_bucket.withColumn("_cum", F.sum("_cnt").over(w))
                  .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(split_col)))
                  .withColumn("_keep", F.floor(F.col("_n") * F.lit(fraction)).cast("long"))
                  .withColumn("_before", F.col("_cum") - F.col("_cnt")))
    # whole buckets below the cut, and the single bucket that straddles it
    full = per_bucket.where(F.col("_cum") <= F.col("_keep")).select(split_col, "_bucket")
    cut = (per_bucket.where((F.col("_before") < F.col("_keep")) & (F.col("_cum") > F.col("_keep")))
           .select(split_col, "_bucket", (F.col("_keep") - F.col("_before")).alias("_take")))
    kept_full = base.join(full, [split_col, "_bucket"], "left_semi")
    in_cut = base.join(cut, [split_col, "_bucket"], "inner")
    rank_w = Window.partitionBy(split_col, "_bucket").orderBy("_h", *key_cols)
    kept_cut = (in_cut.withColumn("_r", F.row_number().over(rank_w))
                .where(F.col("_r") <= F.col("_take")).drop("_r", "_take"))
    return kept_full.unionByName(kept_cut).drop("_h", "_bucket")


def top_k_classes(scores: DataFrame, key: str, class_col: str, prob_col: str, k: int = 3,
                  out: str = "rank") -> DataFrame:
    """top-k classes per key by probability (ties by class)."""
    w = Window.partitionBy(key).orderBy(F.col(prob_col).desc(), F.col(class_col).asc())
    return scores.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def multilabel_metrics(df: DataFrame, score_col: str, label_col: str, label_name_col: str,
                       threshold: float = 0.3, confusion_threshold: float = 0.5,
                       sigmoid_for_accuracy: bool = True) -> DataFrame:
    """One row of metrics over (item, label) cells.

    * accuracy_thresh: mean over all cells of ((sigmoid(score) > t) == label)
    * f1_micro / f1_macro: raw score > t (as the reference does)
    * tn, fp, fn, tp: raw score > confusion threshold, all cells flattened
    Per-label sums are partial aggregates; the macro mean runs over labels.
    """
    s, y = F.col(score_col), F.col(label_col) == 1
    acc_pred = (sigmoid(s) if sigmoid_for_accuracy else s) > threshold
    pred = s > threshold
    cpred = s > confusion_threshold
    as_l = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    per_label = df.groupBy(label_name_col).agg(
        as_l(pred & y).alias("tp"), as_l(pred & ~y).alias("fp"), as_l(~pred & y).alias("fn"),
        as_l(acc_pred == y).alias("acc_hits"), F.count(F.lit(1)).alias("cells"),
        as_l(~cpred & ~y).alias("c_tn"), as_l(cpred & ~y).alias("c_fp"),
        as_l(~cpred & y).alias("c_fn"), as_l(cpred & y).alias("c_tp"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    per_label = per_label.withColumn("f1", f1)
    tot = lambda c: F.sum(c)
    return per_label.agg(
        (tot("acc_hits") / tot("cells")).alias("accuracy_thresh"),
        F.when(2 * tot("tp") + tot("fp") + tot("fn") == 0, F.lit(0.0)).otherwise(
            2.0 * tot("tp") / (2 * tot("tp") + tot("fp") + tot("fn"))).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        tot("c_tn").cast("long").alias("tn"), tot("c_fp").cast("long").alias("fp"),
        tot("c_fn").cast("long").alias("fn"), tot("c_tp").cast("long").alias("tp"))


def fit_multilabel_classifier(train: DataFrame, text_col: str, labels: Sequence[str],
                              num_features: int = 1 << 18, max_iter: int = 20):
    """Tokenise -> hashed term frequencies -> IDF -> one logistic
    regression per label (independent sigmoids).  Model fitting is the one
    driver-coordinated step; every pass over the data runs on executors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\W+", toLowercase=True),
              HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_features")]
    for lab in labels:
        stages.append(LogisticRegression(featuresCol="_features", labelCol=lab, maxIter=max_iter,
                                         predictionCol=f"pred_{lab}", probabilityCol=f"prob_{lab}",
                                         rawPredictionCol=f"raw_{lab}"))
    return Pipeline(stages=stages).fit(train.select(text_col, *[F.col(l).cast("double").alias(l) for l in labels]))


def classify_batch(model, df: DataFrame, key_cols: Sequence[str], text_col: str,
                   labels: Sequence[str], out: str = "label") -> DataFrame:
    """Not-null filter, transform, one row per predicted label."""
    scored = model.transform(df.where(F.col(text_col).isNotNull()).select(*key_cols, text_col))
    arr = F.array(*[F.when(F.col(f"pred_{lab}") == 1.0, F.lit(lab)) for lab in labels])
    return (scored.select(*key_cols, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias(out)))


# --------------------------------------------------------------------------- classifier with a closed-form fit

HASH_BUCKETS = 4096


def token_buckets(df: DataFrame, key_cols: Sequence[str], text_col: str, buckets: int = HASH_BUCKETS) -> DataFrame:
    """One row for each distinct hashed token (lower-cased ASCII letters and digits) of each text."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    word = df.where(F.col(text_col).isNotNull()).select(*key_cols, F.explode(words).alias("_w"))
    return word.select(*key_cols, (md5_unit_hash("_w") % buckets).alias("bucket")).distinct()


def fit_naive_bayes(train: DataFrame, key_cols: Sequence[str], text_col: str, labels: Sequence[str],
                    buckets: int = HASH_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """J6 without iterations: (label, bucket, weight) and (label, bias) of a multi-label naive Bayes classifier
    over token presence.  Every figure is a sum, so one partially aggregated pass fits all labels."""
    seen = F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(lab).cast("long").alias("y")) for lab in labels]))
    cells = train.where(F.col(text_col).isNotNull()).select(*key_cols, text_col, seen.alias("_l")) \
        .select(*key_cols, text_col, "_l.*").where(F.col("y").isin(0, 1))
    ones, zeros = F.sum("y"), F.sum(1 - F.col("y"))
    size = cells.groupBy("label").agg(ones.alias("n1"), zeros.alias("n0"))
    hits = token_buckets(train, key_cols, text_col, buckets).join(
        cells.drop(text_col), list(key_cols)).groupBy("label", "bucket").agg(ones.alias("h1"), zeros.alias("h0"))
    odds = lambda h, n: F.log((F.col(h) + 1.0) / (F.col(n) + 2.0))
    weights = hits.join(size, "label").select("label", "bucket", (odds("h1", "n1") - odds("h0", "n0")).alias("weight"))
    return weights, size.select("label", F.log((F.col("n1") + 1.0) / (F.col("n0") + 1.0)).alias("bias"))


def classify_naive_bayes(weights: DataFrame, bias: DataFrame, df: DataFrame, key_cols: Sequence[str], text_col: str,
                         buckets: int = HASH_BUCKETS) -> DataFrame:
    """One row for each text and label with a positive score (bias and the weights of its tokens)."""
    known = df.where(F.col(text_col).isNotNull())
    own = token_buckets(known, key_cols, text_col, buckets).join(weights, "bucket") \
        .groupBy(*key_cols, "label").agg(F.sum("weight").alias("_s"))
    # every text starts with the biases; the few labels ride along as one array
    every = bias.agg(F.collect_list(F.struct("label", "bias"))).scalar()
    base = known.select(*key_cols, F.explode(every).alias("_b")).select(*key_cols, "_b.*")
    return base.join(own, [*key_cols, "label"], "left") \
        .withColumn("score", F.col("bias") + F.coalesce(F.col("_s"), F.lit(0.0))).where("score > 0") \
        .select(*key_cols, "label", "score")
