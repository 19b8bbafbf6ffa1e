"""Enrichment queries bound to the test tables.

Analogue used throughout: an order line is a piece of evidence; the entity
counted is the combination (order, part, supplier), so that every comparison
is an attribute of the counted entity; the order priority is
the predicted "reason"; line status and line number give the remaining
predictions; part, supplier and customer features give the comparison
categories, three of them with several values for an entity; and the best
priority of the ordering customer gives the two strata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contingo.functions.columns import (at_least_labels, collapse_to_default, keep_if_in, label_if_in, left_closed_bins,
                                        two_sided_bin)
from contingo.operators.baseline import baseline_pairs, listed_universe, member_bits, null_baseline, sql_shuffled
from contingo.operators.cohort import (ancestor_closure, assemble_cohort, best_category, max_score_tiers,
                                       neighbour_degree, propagate, values_per_key)
from contingo.operators.counts import (OUTPUT_COLUMNS, contingency_counts, contingency_sweep, contingency_sweep_by_id,
                                       distinct_count_by)
from contingo.operators.skew import HotKeys
from contingo.operators.stats import bh_adjust, bh_adjust_large, with_fisher_and_or, with_significance_labels
from contingo.plans.common import (query, round_stats, sql_fisher_ctes, sql_round_stats,
                                   sql_with_stats, tbl)
from contingo.sources.io import literal_table, read_parquet, write_parquet

# Fixed values of the analogue (parameters of the bound queries).
DONE = ["F"]
KEEP_REASONS = ["1-URGENT", "2-HIGH"]
DISCOUNT_CUTOFFS = [0.08, 0.06, 0.04, 0.02]
DISCOUNT_LABELS = ["disc_0.08", "disc_0.06", "disc_0.04", "disc_0.02"]
DISCOUNT_COLS = ["disc_008", "disc_006", "disc_004", "disc_002"]
PRIORITY_PRECEDENCE = [
    ("1-URGENT", "urgent", "Urgent"),
    ("2-HIGH", "high", "Other"),
    ("3-MEDIUM", "medium", "Other"),
    ("4-NOT SPECIFIED", "not specified", "Other"),
    ("5-LOW", "low", "Other"),
]
PRICE_HIGH, PRICE_LOW = 990.0, 910.0
EDGE_MIN_DISCOUNT = 0.04
SIZE_BREAKS, SIZE_LABELS = [1, 15, 35], ["small", "middle", "large"]
N_SEEDS = 100
ID = ["l_orderkey", "l_partkey", "l_suppkey"]
LINE_RULES = [("line_last", "==", 7, "line 7"), ("line_late", ">=", 5, "line 5 or later"),
              ("line_second", ">=", 2, "line 2 or later")]

#: Columns whose entity has several values (arrays in the one-row-per-entity form).
MULTI = ["brandNodes", "returnFlags", "shipYears"]
COMPARISONS = [("p_brand", "brand"), ("brandNodes", "brandNode"), ("priceTolerance", "priceTolerance"),
               ("sizeBin", "size"), ("partnersBin", "interactions")] + \
    [(c, "discountTier") for c in DISCOUNT_COLS] + \
    [("prioLabelSimple", "customerPriority"), ("returnFlags", "returnFlag"), ("shipYears", "shipYear"),
     ("supplierNation", "supplierNation")]
PREDICTIONS = [("reason", "reason"), ("metareason", "metareason"), ("doneStatus", "doneStatus"), ("isDone", "isDone")] + \
    [(name, "linePosition") for name, _o, _b, _l in LINE_RULES]
STAT_COLS = OUTPUT_COLUMNS + ["or_result", "lower_ci", "upper_ci", "pvalue"]

PREC_SCHEMA = T.StructType([T.StructField("prioId", T.StringType()), T.StructField("prioLabel", T.StringType()),
                            T.StructField("prioLabelSimple", T.StringType())])


# --------------------------------------------------------------------------- feature tables

def precedence(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PRIORITY_PRECEDENCE, PREC_SCHEMA, rank_col="prioRank")


def customer_best_priority(spark, d) -> DataFrame:
    pairs = tbl(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return best_category(pairs, "o_custkey", "o_orderpriority", precedence(spark), "prioId", "prioRank")


def discount_tiers(spark, d) -> DataFrame:
    li = tbl(spark, d, "lineitem").where(F.col("l_returnflag") == "N")
    return max_score_tiers(li, ["l_partkey", "l_suppkey"], "l_discount", DISCOUNT_CUTOFFS,
                           DISCOUNT_LABELS, DISCOUNT_COLS).drop("max_score")


def interaction_edges(spark, d) -> DataFrame:
    return (tbl(spark, d, "lineitem")
            .where((F.col("l_returnflag") == "N") & (F.col("l_discount") > EDGE_MIN_DISCOUNT)
                   & F.col("l_suppkey").isNotNull())
            .select("l_partkey", "l_suppkey"))


def part_partners(spark, d) -> DataFrame:
    degrees = neighbour_degree(interaction_edges(spark, d), "l_partkey", "l_suppkey", node_out="l_partkey")
    return degrees.select("l_partkey", "partnersBin")


def part_features(spark, d) -> DataFrame:
    return tbl(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand",
        two_sided_bin("p_retailprice", PRICE_HIGH, PRICE_LOW, "high price", "low price").alias("priceTolerance"),
        left_closed_bins("p_size", SIZE_BREAKS, SIZE_LABELS).alias("sizeBin"))


def brand_nodes(spark, d) -> DataFrame:
    """Each part's brand and the brand's family (its text less the last digit), several rows a part."""
    part = tbl(spark, d, "part").where(F.col("p_brand").isNotNull())
    brands = part.select("p_brand", F.array(F.regexp_replace("p_brand", "[0-9]$", "")).alias("above")).distinct()
    return propagate(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brandNodes")),
                     "brandNodes", ancestor_closure(brands, "p_brand", "above"))


def part_flags(spark, d) -> DataFrame:
    """The return flags of a part's lines, several rows a part."""
    return tbl(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("returnFlags")).distinct()


def part_line_values(spark, d) -> DataFrame:
    """The return flags and ship years of a part's lines as lists, from one scan."""
    seen = tbl(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.year("l_shipdate").cast("string").alias("year"))
    return seen.distinct().groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("returnFlags"),
                                                    F.array_sort(F.collect_set("year")).alias("shipYears"))


def supplier_nations(spark, d) -> DataFrame:
    return tbl(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                            F.col("s_nationkey").cast("string").alias("supplierNation"))


def order_predictions(spark, d) -> DataFrame:
    return tbl(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("reason"),
        collapse_to_default("o_orderpriority", KEEP_REASONS, "Neutral").alias("metareason"), "o_custkey")


def evidence(spark, d) -> DataFrame:
    """Lines with a nested list of links, of which only those to orders name an entity."""
    link = lambda kind, path, key: F.struct(F.lit(kind).alias("kind"),
                                            F.concat(F.lit(f"https://data.example/{path}"), F.col(key)).alias("url"))
    return tbl(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_quantity",
        F.array(link("order", "orders/O", "l_orderkey"), link("part", "parts/P", "l_partkey")).alias("links"))


def _assembled(spark, d, features, one_row: bool = False, hot=None) -> DataFrame:
    positions = at_least_labels("l_linenumber", [(op, bound, label) for _n, op, bound, label in LINE_RULES])
    flags = {"doneStatus": keep_if_in("l_linestatus", DONE), "isDone": label_if_in("l_linestatus", DONE, "finished")}
    flags |= {name: c for (name, _o, _b, _l), c in zip(LINE_RULES, positions)}
    values = {"doneStatus": DONE, "isDone": ["finished"], **{name: [label] for name, _o, _b, label in LINE_RULES}}
    best = customer_best_priority(spark, d).select("o_custkey", "prioLabel", "prioLabelSimple")
    # orders are fewer than lines: the customer's priority comes to them before they meet the lines
    orders = order_predictions(spark, d)
    orders = orders.join(best, "o_custkey", "left").select(*orders.columns, "prioLabel", "prioLabelSimple")
    out = assemble_cohort(
        evidence(spark, d), ID,
        [(orders, ["l_orderkey"]), (discount_tiers(spark, d), ["l_partkey", "l_suppkey"]), (part_features(spark, d), ["l_partkey"]), (part_partners(spark, d), ["l_partkey"]),
         (supplier_nations(spark, d), ["l_suppkey"]), *features],
        where=F.col("l_quantity") > 0, nested="links",
        captured={"l_orderkey": (lambda link: F.regexp_extract(link["url"], "/orders/O([0-9]+)$", 1), "long")},
        flags=flags, flag_values=values, one_row=one_row, hot=hot)
    return out.withColumn("partnersBin", F.coalesce(F.col("partnersBin"), F.lit("none")))


def build_cohort(spark: SparkSession, d: str, hot=None) -> DataFrame:
    """C3, row form: seven left joins, the last with several rows for a key, so rows multiply."""
    return _assembled(spark, d, [(part_flags(spark, d), ["l_partkey"])], hot=hot)


def build_entities(spark: SparkSession, d: str) -> DataFrame:
    """C3, one row for each entity: multi-valued features as arrays."""
    many = [(values_per_key(brand_nodes(spark, d), ["l_partkey"], "brandNodes", "brandNodes"), ["l_partkey"]),
            (part_line_values(spark, d), ["l_partkey"])]
    return _assembled(spark, d, many, one_row=True)


def strata_column() -> F.Column:
    """H5: all / urgent / non_urgent; a null label is in neither subgroup."""
    lab = F.col("prioLabelSimple")
    listed = lambda *names: F.array(*[F.lit(n) for n in names])
    return F.when(lab == "Urgent", listed("all", "urgent")).when(lab != "Urgent", listed("all", "non_urgent")) \
        .otherwise(listed("all"))


COHORT_COLS = [*ID, "doneStatus", "isDone", *[n for n, *_ in LINE_RULES], "reason", "metareason", "o_custkey"] + \
    DISCOUNT_COLS + ["prioLabel", "prioLabelSimple", "p_brand", "priceTolerance", "sizeBin", "partnersBin",
                     "supplierNation", "returnFlags"]


def _sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


SQL_PREC = f"prec AS (SELECT * FROM (VALUES {_sql_values([r + (i,) for i, r in enumerate(PRIORITY_PRECEDENCE)])}) " \
           f"t(prioId, prioLabel, prioLabelSimple, prioRank))"

SQL_UND = f"""
edges AS (
  SELECT DISTINCT l_partkey AS na, l_suppkey AS nb FROM lineitem
  WHERE l_returnflag = 'N' AND l_discount > {EDGE_MIN_DISCOUNT} AND l_suppkey IS NOT NULL),
und AS (SELECT na, nb FROM edges UNION SELECT nb, na FROM edges)"""

SQL_COHORT_CTES = f"""
base AS (
  SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus FROM lineitem WHERE l_quantity > 0),
preds AS (
  SELECT o_orderkey AS l_orderkey, o_orderpriority AS reason,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'Neutral' END AS metareason,
    o_custkey
  FROM orders),
tiers AS (
  SELECT l_partkey, l_suppkey,
    CASE WHEN max(l_discount) > 0.08 THEN 'disc_0.08' END AS disc_008,
    CASE WHEN max(l_discount) > 0.06 THEN 'disc_0.06' END AS disc_006,
    CASE WHEN max(l_discount) > 0.04 THEN 'disc_0.04' END AS disc_004,
    CASE WHEN max(l_discount) > 0.02 THEN 'disc_0.02' END AS disc_002
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey, l_suppkey),
{SQL_PREC},
best AS (
  SELECT b.o_custkey, p.prioId, p.prioLabel, p.prioLabelSimple
  FROM (SELECT o_custkey, min(prioRank) AS r FROM orders JOIN prec ON o_orderpriority = prioId GROUP BY o_custkey) b
  JOIN prec p ON p.prioRank = b.r),
partf AS (
  SELECT p_partkey AS l_partkey, p_brand,
    CASE WHEN p_retailprice > {PRICE_HIGH} THEN 'high price' WHEN p_retailprice < {PRICE_LOW} THEN 'low price' END AS priceTolerance,
    CASE WHEN p_size >= 35 THEN 'large' WHEN p_size >= 15 THEN 'middle' WHEN p_size >= 1 THEN 'small' END AS sizeBin,
    CASE WHEN p_brand IS NULL THEN NULL ELSE list_distinct([p_brand, regexp_replace(p_brand, '[0-9]$', '')]) END AS brandNodes
  FROM part),
{SQL_UND},
partners AS (
  SELECT na AS l_partkey,
    CASE WHEN count(nb) >= 21 THEN 'greaterThan20' WHEN count(nb) >= 11 THEN 'from11to20' ELSE 'from1to10' END AS partnersBin
  FROM und GROUP BY na),
many AS (
  SELECT l_partkey, list(DISTINCT l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL) AS returnFlags,
    list(DISTINCT CAST(year(l_shipdate) AS VARCHAR)) FILTER (WHERE l_shipdate IS NOT NULL) AS shipYears
  FROM lineitem GROUP BY l_partkey),
entities AS (
  SELECT e.l_orderkey, e.l_partkey, e.l_suppkey, concat_ws('|', e.l_orderkey, e.l_partkey, e.l_suppkey) AS id,
    CASE WHEN l_linestatus IN ('F') THEN l_linestatus END AS doneStatus,
    CASE WHEN l_linestatus IN ('F') THEN 'finished' END AS isDone,
    CASE WHEN l_linenumber = 7 THEN 'line 7' END AS line_last,
    CASE WHEN l_linenumber >= 5 THEN 'line 5 or later' END AS line_late,
    CASE WHEN l_linenumber >= 2 THEN 'line 2 or later' END AS line_second,
    p.reason, p.metareason, p.o_custkey, t.disc_008, t.disc_006, t.disc_004, t.disc_002,
    b.prioLabel, b.prioLabelSimple, f.p_brand, f.priceTolerance, f.sizeBin, f.brandNodes,
    coalesce(pa.partnersBin, 'none') AS partnersBin, CAST(s.s_nationkey AS VARCHAR) AS supplierNation,
    m.returnFlags, m.shipYears
  FROM base e
  LEFT JOIN preds p ON e.l_orderkey = p.l_orderkey
  LEFT JOIN tiers t ON e.l_partkey = t.l_partkey AND e.l_suppkey = t.l_suppkey
  LEFT JOIN best b ON p.o_custkey = b.o_custkey
  LEFT JOIN partf f ON e.l_partkey = f.l_partkey
  LEFT JOIN partners pa ON e.l_partkey = pa.l_partkey
  LEFT JOIN supplier s ON e.l_suppkey = s.s_suppkey
  LEFT JOIN many m ON e.l_partkey = m.l_partkey)"""


def sql_sweep(source: str, id_col: str, comparisons, predictions, stratified: bool) -> str:
    """Oracle form of the sweep: every distinct (id, comparison) meets every distinct (id, prediction)."""
    s = "stratum, " if stratified else ""

    def long(specs, k, v):
        one = lambda i, c: (f"SELECT DISTINCT {s}id, {i} AS {k}, {v} FROM (SELECT {s}{id_col} AS id, "
                            + (f"unnest({c})" if c in MULTI else f"CAST({c} AS VARCHAR)") + f" AS {v} FROM {source}) WHERE {v} IS NOT NULL")
        return " UNION ALL ".join(one(i, c) for i, (c, _t) in enumerate(specs))

    label = lambda specs, k: "CASE " + k + " " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_c, t) in enumerate(specs)) + " END"
    return f"""
SELECT *, predictionTotal - a AS b, comparisonTotal - a AS c, total - predictionTotal - comparisonTotal + a AS d FROM (
SELECT {s}pv AS prediction, cv AS comparison, {label(comparisons, 'ck')} AS comparisonType,
  {label(predictions, 'pk')} AS predictionType, a, predictionTotal, comparisonTotal, total
FROM (SELECT {s}ck, cv, pk, pv, count(*) AS a FROM ({long(comparisons, 'ck', 'cv')}) c
      JOIN ({long(predictions, 'pk', 'pv')}) p USING ({s}id) GROUP BY ALL) x
JOIN (SELECT {s}ck, cv, count(*) AS comparisonTotal FROM ({long(comparisons, 'ck', 'cv')}) GROUP BY ALL) USING ({s}ck, cv)
JOIN (SELECT {s}pk, pv, count(*) AS predictionTotal FROM ({long(predictions, 'pk', 'pv')}) GROUP BY ALL) USING ({s}pk, pv)
JOIN (SELECT {s}count(DISTINCT {id_col}) AS total FROM {source} GROUP BY ALL) tt {'USING (stratum)' if stratified else 'ON TRUE'})"""


SQL_STRATA = """
entities_s AS (
  SELECT *, unnest(list_filter(['all',
      CASE WHEN prioLabelSimple = 'Urgent' THEN 'urgent' END,
      CASE WHEN prioLabelSimple <> 'Urgent' THEN 'non_urgent' END], lambda s: s IS NOT NULL)) AS stratum
  FROM entities)"""


# --------------------------------------------------------------------------- queries

@query("cohort_build", f"""WITH {SQL_COHORT_CTES}
SELECT DISTINCT * FROM (
  SELECT {', '.join(c for c in COHORT_COLS if c != 'returnFlags')}, unnest(returnFlags) AS returnFlags FROM entities)""")
def q_cohort_build(spark, d):
    return build_cohort(spark, d).select(*COHORT_COLS)


_EC_SQL = f"""
WITH base AS (
  SELECT l.l_orderkey, l.l_returnflag, o.o_orderpriority
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey),
counts AS ({sql_sweep('base', 'l_orderkey', [('l_returnflag', 'returnFlag')], [('o_orderpriority', 'reason')], False)})
SELECT * FROM counts"""


def _lineitem_orders(spark, d) -> DataFrame:
    # dealt by a stated number of partitions, which isn't coalesced: the lines are small, their events are not
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_returnflag").repartition(parts, "l_orderkey")
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return li.join(o.repartition(parts, "l_orderkey"), "l_orderkey", "left")


@query("enrichment_counts", _EC_SQL)
def q_enrichment_counts(spark, d):
    """One pair -- is the return flag associated with order priority?"""
    return contingency_counts(_lineitem_orders(spark, d), ["l_orderkey"], "l_returnflag", "returnFlag",
                              "o_orderpriority", "reason")


FISHER_RAW_SQL = f"""
WITH base AS (
  SELECT l.l_orderkey, l.l_returnflag, o.o_orderpriority
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey),
counts AS ({sql_sweep('base', 'l_orderkey', [('l_returnflag', 'returnFlag')], [('o_orderpriority', 'reason')], False)}),
{sql_fisher_ctes('counts')}
{sql_with_stats('counts', OUTPUT_COLUMNS)}"""


@query("fisher_or", f"SELECT {sql_round_stats(STAT_COLS)} FROM ({FISHER_RAW_SQL})")
def q_fisher_or(spark, d):
    """D8 + H1-H3 + B22: the flagship query."""
    return round_stats(with_fisher_and_or(q_enrichment_counts(spark, d))).select(*STAT_COLS)


@query("marginal_counts", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_ids FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def q_marginal_counts(spark, d):
    """D3."""
    return distinct_count_by(tbl(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey"],
                             drop_null_groups=True)


@query("enrichment_sweep", f"WITH {SQL_COHORT_CTES} {sql_sweep('entities', 'id', COMPARISONS, PREDICTIONS, False)}")
def q_enrichment_sweep(spark, d):
    """Every (comparison, prediction) pair of the cohort in one pass."""
    return contingency_sweep_by_id(build_entities(spark, d), COMPARISONS, PREDICTIONS)


@query("enrichment_stratified", f"""WITH {SQL_COHORT_CTES}, {SQL_STRATA}
{sql_sweep('entities_s', 'id', COMPARISONS, PREDICTIONS, True)}""")
def q_enrichment_stratified(spark, d):
    """H5: the sweep for all / urgent / non_urgent in the same pass."""
    return contingency_sweep_by_id(build_entities(spark, d), COMPARISONS, PREDICTIONS, strata=strata_column())


SWEEP_STATS_SQL = f"""WITH {SQL_COHORT_CTES},
counts AS ({sql_sweep('entities', 'id', COMPARISONS, PREDICTIONS, False)}),
{sql_fisher_ctes('counts')},
stats AS ({sql_with_stats('counts', OUTPUT_COLUMNS)})"""

SQL_LABELS = """CASE WHEN pvalue < 0.05 AND pvalue_corrected >= 0.05 THEN 'No Longer Significant'
       WHEN pvalue >= 0.05 AND pvalue_corrected < 0.05 THEN 'Now Significant'
       WHEN pvalue >= 0.05 AND pvalue_corrected >= 0.05 THEN 'Never Significant'
       WHEN pvalue < 0.05 AND pvalue_corrected < 0.05 THEN 'Remains Significant' END"""

SQL_BH = """
bh AS (
  SELECT *, least(min(raw) OVER (PARTITION BY predictionType, comparisonType ORDER BY pvalue NULLS LAST, prediction NULLS LAST, comparison NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS pvalue_corrected
  FROM (SELECT *, pvalue * count(pvalue) OVER (PARTITION BY predictionType, comparisonType)
              / row_number() OVER (PARTITION BY predictionType, comparisonType ORDER BY pvalue NULLS LAST, prediction NULLS LAST, comparison NULLS LAST) AS raw
        FROM stats) r)"""


def sweep_with_stats(spark, d) -> DataFrame:
    return with_fisher_and_or(q_enrichment_sweep(spark, d))


@query("sweep_stats", f"{SWEEP_STATS_SQL} SELECT {sql_round_stats(STAT_COLS)} FROM stats")
def q_sweep_stats(spark, d):
    """D9 + H1-H3 over every pair."""
    return round_stats(sweep_with_stats(spark, d)).select(*STAT_COLS)


@query("fdr_bh", f"""{SWEEP_STATS_SQL}, {SQL_BH}
SELECT {sql_round_stats(STAT_COLS + ['pvalue_corrected'])} FROM bh""")
def q_fdr_bh(spark, d):
    """Benjamini-Hochberg per (predictionType, comparisonType)."""
    out = bh_adjust(sweep_with_stats(spark, d), tiebreak=["prediction", "comparison"])
    return round_stats(out).select(*STAT_COLS, "pvalue_corrected")


@query("fdr_labels", f"""{SWEEP_STATS_SQL}, {SQL_BH}
SELECT prediction, comparison, comparisonType, predictionType, {sql_round_stats(['pvalue', 'pvalue_corrected'])},
  {SQL_LABELS} AS significance
FROM bh""")
def q_fdr_labels(spark, d):
    """B32 on the corrected sweep."""
    out = with_significance_labels(bh_adjust(sweep_with_stats(spark, d), tiebreak=["prediction", "comparison"]))
    return round_stats(out).select("prediction", "comparison", "comparisonType", "predictionType",
                                   "pvalue", "pvalue_corrected", "significance")


#: One p-value for each order line, with ties and nulls, in families of a third of the lines each.
SQL_LINE_P = "CASE WHEN l_linenumber < 7 THEN CAST((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey) % 100003 AS DOUBLE) / 100003 END"


@query("fdr_bh_large", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST({SQL_LINE_P} AS DOUBLE) AS p FROM lineitem),
r AS (SELECT *, p * count(p) OVER (PARTITION BY l_returnflag)
          / row_number() OVER (PARTITION BY l_returnflag ORDER BY p NULLS LAST) AS raw FROM x),
q AS (SELECT *, least(min(raw) OVER (PARTITION BY l_returnflag ORDER BY p NULLS LAST
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS corrected FROM r)
SELECT l_orderkey, l_linenumber, l_returnflag, round(CASE WHEN p IS NOT NULL THEN
  min(corrected) OVER (PARTITION BY l_returnflag, p) END, 9) AS pvalue_corrected FROM q""")
def q_fdr_bh_large(spark, d):
    """E3 over families that grow with the table."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                          F.expr(SQL_LINE_P).cast("double").alias("p"))
    return bh_adjust_large(li, "p", ["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.round("pvalue_corrected", 9).alias("pvalue_corrected"))


@query("hot_key_join", """
SELECT l_orderkey, l_linenumber, l_returnflag, n, total FROM lineitem
LEFT JOIN (SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY ALL)
  ON l_returnflag = flag""")
def q_hot_key_join(spark, d):
    """Lines meet a table by their return flag, each value of which holds about a third of all lines."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    flags = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("total"))
    hot = HotKeys(li, ["l_returnflag"], share=0.1, ways=8)
    return hot.join(li, flags, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_returnflag", "n", "total")


# --------------------------------------------------------------------------- reason x phase

PHASES = [("1-URGENT", "phase_urgent", "Urgent"), ("2-HIGH", "phase_high", "High"),
          ("3-MEDIUM", "phase_medium", "Medium"), ("4-NOT SPECIFIED", "phase_unspecified", "Unspecified"),
          ("5-LOW", "phase_low", "Low"), ("nan", "phase_other", "Other")]


#: A third of the unspecified priorities are missing, written as the text 'nan'.
SQL_PHASE = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0 THEN 'nan' ELSE o_orderpriority END"


def _phase_studies(spark, d) -> DataFrame:
    """B11 + D6: stopped 'studies' (orders with a price), one exact-match
    indicator column per phase text; the text 'nan' means Other."""
    o = tbl(spark, d, "orders").where(F.col("o_totalprice").isNotNull())
    phase = F.expr(SQL_PHASE)
    cols = {name: F.when(phase == F.lit(text), F.lit(label)) for text, name, label in PHASES}
    return o.select("o_orderkey", F.col("o_orderstatus").alias("reason"), *[v.alias(k) for k, v in cols.items()])


_PHASE_PRED = [(name, "clinical") for _t, name, _l in PHASES]


def _phase_sql_source() -> str:
    flags = ",\n    ".join(f"CASE WHEN {SQL_PHASE} = '{t}' THEN '{lab}' END AS {n}" for t, n, lab in PHASES)
    return f"""studies AS (
  SELECT o_orderkey, o_orderstatus AS reason,
    {flags}
  FROM orders WHERE o_totalprice IS NOT NULL)"""


@query("reason_by_phase", f"""WITH {_phase_sql_source()},
counts AS ({sql_sweep('studies', 'o_orderkey', [('reason', 'reason')], _PHASE_PRED, False)}),
{sql_fisher_ctes('counts')}
SELECT {sql_round_stats(STAT_COLS)} FROM ({sql_with_stats('counts', OUTPUT_COLUMNS)})""")
def q_reason_by_phase(spark, d):
    """The reason x phase enrichment: one comparison, indicator predictions,
    the total is the number of studies (ids are unique keys)."""
    return round_stats(reason_by_phase_stats(spark, d)).select(*STAT_COLS)


def reason_by_phase_stats(spark, d) -> DataFrame:
    """The same with plain statistics."""
    out = contingency_sweep(_phase_studies(spark, d), ["o_orderkey"], [("reason", "reason")], _PHASE_PRED)
    return with_fisher_and_or(out)


# --------------------------------------------------------------------------- baseline

PAIR = ["l_partkey", "l_suppkey"]
LISTED_SEEDS = 10


def _universe(spark, d):
    """Observed pairs and the two entity tables."""
    return (tbl(spark, d, "lineitem").select(*PAIR), tbl(spark, d, "part").select("p_partkey"),
            tbl(spark, d, "supplier").select("s_suppkey"))


_SQL_INDEX = "SELECT {k}, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 1024, {k}) - 1 AS {i} FROM {t}"
SQL_MEMBERS = f"""
sizes AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS n,
                 (SELECT count(*) FROM part) AS t, (SELECT count(*) FROM supplier) AS u),
li AS ({_SQL_INDEX.format(k='p_partkey', i='i', t='part')}),
ri AS ({_SQL_INDEX.format(k='s_suppkey', i='j', t='supplier')}),
seeded AS (SELECT l_partkey, l_suppkey, i, j, s AS seed, n, t, u
           FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) p JOIN li ON l_partkey = p_partkey
           JOIN ri ON l_suppkey = s_suppkey, (SELECT unnest(range(0, {N_SEEDS}))::INTEGER AS s) x, sizes),
members AS (SELECT l_partkey, l_suppkey, seed FROM ({sql_shuffled('seeded', 'i', 'j', 't', 'u', 'seed', 'image')}) WHERE image < n)"""


@query("universe_sample", f"""WITH {SQL_MEMBERS}
SELECT seed, count(*) AS n_members, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey,
  CAST(sum(l_suppkey) AS BIGINT) AS sum_suppkey
FROM members GROUP BY seed""")
def q_universe_sample(spark, d):
    """C7 + F2 + F3: the seeded universes of exactly n pairs, restricted to observed pairs and summarised per seed
    (size and key sums pin the member set)."""
    m = baseline_pairs(*_universe(spark, d), PAIR, N_SEEDS)
    return m.groupBy("seed").agg(F.count(F.lit(1)).alias("n_members"), F.sum("l_partkey").alias("sum_partkey"),
                                 F.sum("l_suppkey").alias("sum_suppkey"))


@query("universe_listed", f"""WITH {SQL_MEMBERS.split('seeded AS')[0].rstrip().rstrip(',')},
grid AS (SELECT p_partkey AS l_partkey, s_suppkey AS l_suppkey, i, j, s AS seed, n, t, u
         FROM li, ri, (SELECT unnest(range(0, {LISTED_SEEDS}))::INTEGER AS s) x, sizes),
members AS (SELECT l_partkey, l_suppkey, seed FROM ({sql_shuffled('grid', 'i', 'j', 't', 'u', 'seed', 'image')}) WHERE image < n)
SELECT seed, count(*) AS n_members, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey, CAST(sum(l_suppkey) AS BIGINT) AS sum_suppkey,
  CAST(sum(l_partkey * l_suppkey) AS BIGINT) AS sum_product
FROM members GROUP BY seed""")
def q_universe_listed(spark, d):
    """F2 + F3: each seed's universe listed pair by pair, backwards from the images; the oracle shuffles the grid."""
    pairs, left, right = _universe(spark, d)
    m = listed_universe(left, right, PAIR, LISTED_SEEDS, pairs.distinct().count())
    return m.groupBy("seed").agg(F.count(F.lit(1)).alias("n_members"), F.sum("l_partkey").alias("sum_partkey"),
                                 F.sum("l_suppkey").alias("sum_suppkey"),
                                 F.sum(F.col("l_partkey") * F.col("l_suppkey")).alias("sum_product"))


BASELINE_COLS = ["stratum", "seed"] + STAT_COLS
SQL_BASELINE_COUNTS = f"""{SQL_COHORT_CTES}, {SQL_STRATA}, {SQL_MEMBERS},
mc AS (SELECT e.stratum, e.id, e.reason, m.seed FROM entities_s e
       JOIN members m ON e.l_partkey = m.l_partkey AND e.l_suppkey = m.l_suppkey),
aa AS (SELECT stratum, seed, reason, count(DISTINCT id) AS a FROM mc WHERE reason IS NOT NULL GROUP BY ALL),
ct AS (SELECT stratum, seed, count(DISTINCT id) AS comparisonTotal FROM mc GROUP BY ALL),
pt AS (SELECT stratum, reason, count(DISTINCT id) AS predictionTotal FROM entities_s WHERE reason IS NOT NULL GROUP BY ALL),
tt AS (SELECT stratum, count(DISTINCT id) AS total FROM entities_s GROUP BY ALL),
counts AS (
  SELECT stratum, seed, reason AS prediction, 'random' AS comparison, 'byDatatype' AS comparisonType,
    'reason' AS predictionType, a, predictionTotal, comparisonTotal, total,
    predictionTotal - a AS b, comparisonTotal - a AS c, total - predictionTotal - comparisonTotal + a AS d
  FROM aa JOIN ct USING (stratum, seed) JOIN pt USING (stratum, reason) JOIN tt USING (stratum))"""


def _baseline_counts(spark, d):
    members = member_bits(*_universe(spark, d), PAIR, N_SEEDS)
    return null_baseline(_assembled(spark, d, []), ID, PAIR, "reason", "reason", members, strata=strata_column())


@query("null_baseline", f"""WITH {SQL_BASELINE_COUNTS},
{sql_fisher_ctes('counts')}
SELECT {sql_round_stats(BASELINE_COLS)} FROM ({sql_with_stats('counts', ['stratum', 'seed'] + OUTPUT_COLUMNS)})""")
def q_null_baseline(spark, d):
    """H4: 100 seeded random universes and three strata in one job."""
    return round_stats(with_fisher_and_or(_baseline_counts(spark, d))).select(*BASELINE_COLS)


@query("baseline_sink", f"""WITH {SQL_BASELINE_COUNTS}
SELECT stratum, seed, prediction, a, b, c, d FROM counts""")
def q_baseline_sink(spark, d):
    """The baseline's tables written with a directory for each stratum and seed, and read back."""
    from contingo.plans.io_q import scratch
    path = scratch(spark, "baseline")
    cols = ["stratum", "seed", "prediction", "a", "b", "c", "d"]
    write_parquet(_baseline_counts(spark, d).select(*cols), path, partition_by=["stratum", "seed"])
    return read_parquet(spark, path).select(*cols)


@query("enrichment_corrected", f"""WITH {SQL_COHORT_CTES}, {SQL_STRATA},
counts AS ({sql_sweep('entities_s', 'id', COMPARISONS, PREDICTIONS, True)}),
{sql_fisher_ctes('counts')},
stats AS ({sql_with_stats('counts', ['stratum'] + OUTPUT_COLUMNS)}),
bh AS (
  SELECT *, least(min(raw) OVER (PARTITION BY stratum, predictionType, comparisonType
                                 ORDER BY pvalue NULLS LAST, prediction NULLS LAST, comparison NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS pvalue_corrected
  FROM (SELECT *, pvalue * count(pvalue) OVER (PARTITION BY stratum, predictionType, comparisonType)
              / row_number() OVER (PARTITION BY stratum, predictionType, comparisonType
                                   ORDER BY pvalue NULLS LAST, prediction NULLS LAST, comparison NULLS LAST) AS raw
        FROM stats) r)
SELECT {sql_round_stats(['stratum'] + STAT_COLS + ['pvalue_corrected'])},
  {SQL_LABELS} AS significance
FROM bh""")
def q_enrichment_corrected(spark, d):
    """H5 + H1-H3 + E3 + B32 end to end: the stratified sweep, statistics,
    correction per (stratum, predictionType, comparisonType), labels."""
    from contingo.operators.enrich import enrich
    out = enrich(build_entities(spark, d), ["id"], COMPARISONS, PREDICTIONS, strata=strata_column(), one_row_per_id=True)
    return round_stats(out).select("stratum", *STAT_COLS, "pvalue_corrected", "significance")
