"""Report tables bound to the test tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contingo.functions.columns import fill_default, lump_other, replace_first, sentence_case, year_or_other
from contingo.operators.cohort import complete_grid, stack_tagged
from contingo.operators.counts import share_within
from contingo.operators.report import (count_bins, rank_by_frequency, rank_by_value,
                                       unpivot_stats, with_effect_columns)
from contingo.plans.common import query, round_stats, sql_round_stats, tbl
from contingo.plans.enrichment import (STAT_COLS, SWEEP_STATS_SQL, q_fisher_or, q_reason_by_phase, reason_by_phase_stats,
                                       sweep_with_stats)

# Fixed values of the bound report queries.
YEAR_FIRST, YEAR_LAST = 1995, 1999
AREA_KEEP = ["BUILDING", "MACHINERY", "AUTOMOBILE", "CARDIOVASCULAR"]
SHARE_KEEP = ["1-URGENT", "2-HIGH", "5-LOW"]
PHASE_UNKNOWN = "P"
REPORT_PRED = ["1-URGENT", "2-HIGH", "5-LOW"]
REPORT_BRANDS = ["Brand#11", "Brand#12", "Brand#21"]
PRED_TYPE_RECODE = {"linePosition": "All lines", "doneStatus": "Finished lines", "reason": "Priority"}
DROP_REASONS = ["P"]
UNPIVOT_KEYS = {"n": "n", "oddsinterval": "OR (95% CI)", "significance": "P-value"}

SQL_BINS = """CASE WHEN cnt >= 500 THEN '500+' WHEN cnt >= 250 THEN '250-499' WHEN cnt >= 100 THEN '100-249'
  WHEN cnt >= 25 THEN '25-99' WHEN cnt >= 10 THEN '10-24' WHEN cnt >= 5 THEN '5-9' WHEN cnt >= 1 THEN '1-4' END"""


def _bins(col: str) -> str:
    return SQL_BINS.replace("cnt", col)


def _data_to_plot(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = tbl(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey", "left").select(
        F.col("o_orderpriority").alias("nicename"),
        year_or_other("o_orderdate", YEAR_FIRST, YEAR_LAST).alias("year"),
        F.col("o_orderstatus").alias("phase"),
        lump_other(fill_default("c_mktsegment", "Other"), AREA_KEEP).alias("area"))


SQL_DATA_TO_PLOT = f"""
dtp AS (
  SELECT o.o_orderpriority AS nicename,
    CASE WHEN year(o.o_orderdate) BETWEEN {YEAR_FIRST} AND {YEAR_LAST} THEN CAST(year(o.o_orderdate) AS VARCHAR)
         ELSE 'Other' END AS year,
    o.o_orderstatus AS phase,
    CASE WHEN coalesce(c.c_mktsegment, 'Other') IN ({", ".join(f"'{x}'" for x in AREA_KEEP)})
         THEN coalesce(c.c_mktsegment, 'Other') ELSE 'Other' END AS area
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _sql_grid(col: str, label: str) -> str:
    return f"""
SELECT g.grouping, n.nicename, x.cnt AS count, '{label}' AS comparison
FROM (SELECT DISTINCT {col} AS grouping FROM dtp) g CROSS JOIN (SELECT DISTINCT nicename FROM dtp) n
LEFT JOIN (SELECT {col} AS grouping, nicename, count(*) AS cnt FROM dtp GROUP BY ALL) x
  ON x.grouping = g.grouping AND x.nicename = n.nicename"""


@query("reason_grid", f"""WITH {SQL_DATA_TO_PLOT},
grids AS ({_sql_grid('year', 'Study start date')} UNION ALL {_sql_grid('phase', 'Phase')}
          UNION ALL {_sql_grid('area', 'Therapeutic area')})
SELECT grouping, nicename, count, comparison, {_bins('count')} AS interval FROM grids""")
def q_reason_grid(spark, d):
    """I1 (+ B25, B26, B28, D2, D12, G4): reason counts by year / phase /
    area, each densified, stacked and binned."""
    views = F.array(*[F.struct(F.lit(label).alias("comparison"), F.col(c).alias("grouping"))
                      for c, label in (("year", "Study start date"), ("phase", "Phase"), ("area", "Therapeutic area"))])
    counts = _data_to_plot(spark, d).groupBy("year", "phase", "area", "nicename").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.inline(views), "nicename", "n").groupBy(F.struct("comparison", "grouping").alias("view"), "nicename") \
        .agg(F.sum("n").alias("count"))
    out = complete_grid(counts, "view", "nicename").select("view.*", "nicename", "count")
    return count_bins(out).select("grouping", "nicename", "count", "comparison", "interval")


@query("count_bins", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS count, {_bins('count(*)')} AS interval
FROM orders GROUP BY ALL""")
def q_count_bins(spark, d):
    """B26 + D2: counts per (year, status) in left-closed bins."""
    o = tbl(spark, d, "orders")
    counts = o.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count(F.lit(1)).alias("count"))
    return count_bins(counts)


@query("complete_grid", """
WITH pt AS (SELECT nullif(p_brand, 'Brand#11') AS p_brand, CASE WHEN p_size > 45 THEN NULL ELSE p_size END AS p_size
            FROM part)
SELECT b.p_brand, s.p_size, x.n
FROM (SELECT DISTINCT p_brand FROM pt) b CROSS JOIN (SELECT DISTINCT p_size FROM pt) s
LEFT JOIN (SELECT p_brand, p_size, count(*) AS n FROM pt GROUP BY ALL) x
  ON x.p_brand IS NOT DISTINCT FROM b.p_brand AND x.p_size IS NOT DISTINCT FROM s.p_size""")
def q_complete_grid(spark, d):
    """Every (brand, size) combination, absent counts null; one brand and the largest sizes are made null, so
    that null is a value on both sides."""
    part = tbl(spark, d, "part").select(
        F.expr("nullif(p_brand, 'Brand#11')").alias("p_brand"), F.when(F.col("p_size") <= 45, F.col("p_size")).alias("p_size"))
    counts = part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return complete_grid(counts, "p_brand", "p_size")


@query("share_by_phase", f"""
WITH x AS (SELECT o_orderstatus AS phase, o_orderpriority AS prediction FROM orders WHERE o_orderstatus <> '{PHASE_UNKNOWN}'),
c AS (SELECT phase, prediction, count(*) AS count FROM x GROUP BY ALL),
g AS (SELECT phase, count(*) AS stoppedByPhase FROM x GROUP BY ALL)
SELECT phase, prediction, count, stoppedByPhase, count / stoppedByPhase AS stopRatio
FROM c JOIN g USING (phase) WHERE prediction IN ({", ".join(f"'{x}'" for x in SHARE_KEEP)})""")
def q_share_by_phase(spark, d):
    """I2 + C5 + D7: reason share within phase, unknown phase excluded, three
    reasons kept after the ratio."""
    x = tbl(spark, d, "orders").where(F.col("o_orderstatus") != PHASE_UNKNOWN).select(
        F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("prediction"))
    out = share_within(x, ["phase"], "prediction", "count", "stoppedByPhase", "stopRatio")
    return out.where(F.col("prediction").isin(SHARE_KEEP)).select(
        "phase", "prediction", "count", "stoppedByPhase", "stopRatio")


@query("share_by_area", f"""WITH {SQL_DATA_TO_PLOT},
y AS (SELECT area AS grouping, CASE WHEN nicename IN ({", ".join(f"'{x}'" for x in SHARE_KEEP)}) THEN nicename
                                    ELSE 'Other' END AS nicename FROM dtp),
c AS (SELECT grouping, nicename, count(*) AS groupingClassCount FROM y GROUP BY ALL),
g AS (SELECT grouping, count(*) AS groupingCount FROM y GROUP BY ALL)
SELECT grouping, nicename, groupingClassCount, groupingCount, groupingClassCount / groupingCount AS ratio
FROM c JOIN g USING (grouping)""")
def q_share_by_area(spark, d):
    """I3 + D7: reason share within area after lumping both sides."""
    y = _data_to_plot(spark, d).select(F.col("area").alias("grouping"),
                                       lump_other("nicename", SHARE_KEEP).alias("nicename"))
    return share_within(y, ["grouping"], "nicename", "groupingClassCount", "groupingCount", "ratio")


@query("area_reason_matrix", f"""WITH {SQL_DATA_TO_PLOT},
x AS (SELECT area AS grouping, nicename, count(*) AS cnt FROM dtp GROUP BY ALL),
grid AS (SELECT g.grouping, n.nicename, x.cnt AS count
         FROM (SELECT DISTINCT grouping FROM x) g CROSS JOIN (SELECT DISTINCT nicename FROM x) n
         LEFT JOIN x ON x.grouping = g.grouping AND x.nicename = n.nicename),
tot AS (SELECT grouping, CAST(sum(cnt) AS BIGINT) AS total FROM x GROUP BY grouping),
rk AS (SELECT grouping, total, CAST(row_number() OVER (ORDER BY total DESC, grouping) AS INTEGER) AS rank FROM tot)
SELECT grid.grouping, nicename, count, {_bins('count')} AS interval, total, rank
FROM grid JOIN rk USING (grouping)""")
def q_area_reason_matrix(spark, d):
    """I4 (+ D2, D12, B26, D11): area x reason counts, densified, binned, areas
    ordered by their total."""
    x = _data_to_plot(spark, d).groupBy(F.col("area").alias("grouping"), "nicename").agg(
        F.count(F.lit(1)).alias("count"))
    grid = count_bins(complete_grid(x, "grouping", "nicename"))
    tot = x.groupBy("grouping").agg(F.sum("count").alias("total"))
    rk = tot.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), F.col("grouping"))))
    return grid.join(rk, "grouping").select("grouping", "nicename", "count", "interval", "total", "rank")


@query("category_rank", """
SELECT p_brand, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rank
FROM part GROUP BY p_brand""")
def q_category_rank(spark, d):
    """Categories ordered by frequency."""
    return rank_by_frequency(tbl(spark, d, "part"), "p_brand")


@query("category_rank_value", """
SELECT p_brand, median(p_retailprice) AS score,
  CAST(row_number() OVER (ORDER BY median(p_retailprice), p_brand) AS INTEGER) AS rank
FROM part GROUP BY p_brand""")
def q_category_rank_value(spark, d):
    """Categories ordered by the median of a value (exact median)."""
    return rank_by_value(tbl(spark, d, "part"), "p_brand", "p_retailprice", "median")


SQL_NUM_TEXT = "regexp_replace(regexp_replace(printf('%.{k}f', round({x}, {k})), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def _sql_num(x: str, k: int = 2) -> str:
    return SQL_NUM_TEXT.replace("{x}", x).replace("{k}", str(k))


def _sql_effect(prefix: str = "") -> str:
    p = prefix
    return f"""{_sql_num(p + 'or_result')} || ' (' || {_sql_num(p + 'lower_ci')} || '-' || {_sql_num(p + 'upper_ci')} || ')' AS oddsinterval,
  CASE WHEN {p}pvalue IS NULL THEN NULL WHEN {p}pvalue < 1e-40 THEN '<1e-40'
       WHEN {p}pvalue < 0.001 THEN printf('%.1e', {p}pvalue)
       WHEN {p}pvalue >= 0.1 THEN {_sql_num(p + 'pvalue', 2)}
       WHEN {p}pvalue >= 0.01 THEN {_sql_num(p + 'pvalue', 3)}
       ELSE {_sql_num(p + 'pvalue', 4)} END AS significance,
  format('{{:,}}', {p}a) AS n"""


def _fisher_or_sql() -> str:
    from contingo.plans.common import REGISTRY
    return REGISTRY["fisher_or"][1]


def _fisher_raw_sql() -> str:
    from contingo.plans.enrichment import FISHER_RAW_SQL
    return FISHER_RAW_SQL


@query("effect_text", f"""WITH fo AS ({_fisher_raw_sql()})
SELECT prediction, comparison, a, {_sql_effect()} FROM fo""")
def q_effect_text(spark, d):
    """Effect text, p-value text and thousands separators (formatted
    from the unrounded statistics)."""
    from contingo.operators.stats import with_fisher_and_or
    from contingo.plans.enrichment import q_enrichment_counts
    return with_effect_columns(with_fisher_and_or(q_enrichment_counts(spark, d))).select(
        "prediction", "comparison", "a", "oddsinterval", "significance", "n")


def _report_rows(spark, d):
    st = sweep_with_stats(spark, d)
    keep = ((F.col("predictionType").isin("linePosition", "doneStatus") | F.col("prediction").isin(REPORT_PRED))
            & (F.col("predictionType") != "metareason") & F.col("comparison").isin(REPORT_BRANDS)
            & (F.col("comparisonType") == "brand"))
    from contingo.functions.columns import recode
    out = round_stats(with_effect_columns(st.where(keep)))
    return out.withColumn("predictionType", recode("predictionType", PRED_TYPE_RECODE))


_SQL_REPORT_ROWS = f"""{SWEEP_STATS_SQL},
rep AS (
  SELECT CASE predictionType WHEN 'linePosition' THEN 'All lines' WHEN 'doneStatus' THEN 'Finished lines'
                             WHEN 'reason' THEN 'Priority' ELSE predictionType END AS predictionType,
    prediction, comparison, a, {_sql_effect()}
  FROM stats
  WHERE (predictionType IN ('linePosition', 'doneStatus') OR prediction IN ({", ".join(f"'{x}'" for x in REPORT_PRED)}))
    AND predictionType <> 'metareason' AND comparison IN ({", ".join(f"'{x}'" for x in REPORT_BRANDS)})
    AND comparisonType = 'brand')"""


@query("report_filter", f"{_SQL_REPORT_ROWS} SELECT predictionType, prediction, comparison, a, oddsinterval, significance, n FROM rep")
def q_report_filter(spark, d):
    """Compound OR/AND filter, recode, effect text."""
    return _report_rows(spark, d).select("predictionType", "prediction", "comparison", "a", "oddsinterval",
                                         "significance", "n")


@query("unpivot_stats", f"""{_SQL_REPORT_ROWS}
SELECT predictionType, prediction, comparison, 'n' AS key, n AS value FROM rep
UNION ALL SELECT predictionType, prediction, comparison, 'OR (95% CI)', oddsinterval FROM rep
UNION ALL SELECT predictionType, prediction, comparison, 'P-value', significance FROM rep""")
def q_unpivot_stats(spark, d):
    """I15 + G6: the report rows in long form."""
    return unpivot_stats(_report_rows(spark, d), ["predictionType", "prediction", "comparison"], UNPIVOT_KEYS)


def _reason_by_phase_sql() -> str:
    from contingo.plans.common import REGISTRY
    return REGISTRY["reason_by_phase"][1]


def _significant_sql() -> str:
    """The reason x phase query with a flag from its plain p-value, which rounding would make null or flip."""
    stats = f"SELECT {sql_round_stats(STAT_COLS)} FROM ("
    return _reason_by_phase_sql().replace(stats, stats.replace("SELECT ", "SELECT pvalue < 0.05 AS is_significant, ", 1))


@query("stack_tagged", f"""
SELECT *, 'lines' AS tag FROM ({_fisher_or_sql()})
UNION ALL SELECT *, 'orders' AS tag FROM ({_reason_by_phase_sql()})""")
def q_stack_tagged(spark, d):
    """G3 + G4 + I10: result tables stacked with a tag column, by name."""
    return stack_tagged({"lines": q_fisher_or(spark, d), "orders": q_reason_by_phase(spark, d)})


@query("phase_reason_table", f"""WITH rp AS ({_significant_sql()}),
k AS (SELECT * FROM rp WHERE comparison NOT IN ({", ".join(f"'{x}'" for x in DROP_REASONS)}) AND prediction <> 'Other'),
r AS (SELECT comparison, CAST(dense_rank() OVER (ORDER BY comparisonTotal DESC, comparison) AS INTEGER) AS comparisonRank
      FROM (SELECT DISTINCT comparison, comparisonTotal FROM k))
SELECT prediction, k.comparison, replace(k.comparison, '_', ' ') AS comparisonLabel, or_result, lower_ci, upper_ci,
  pvalue, is_significant, comparisonRank
FROM k JOIN r ON k.comparison = r.comparison""")
def q_phase_reason_table(spark, d):
    """I14 + B31: drop some reasons and Other, flag significance, order
    reasons by their total."""
    rp = round_stats(reason_by_phase_stats(spark, d).withColumn("is_significant", F.col("pvalue") < 0.05))
    k = rp.where(~F.col("comparison").isin(DROP_REASONS) & (F.col("prediction") != "Other"))
    r = (k.select("comparison", "comparisonTotal").distinct()
         .withColumn("comparisonRank", F.dense_rank().over(
             Window.orderBy(F.col("comparisonTotal").desc(), F.col("comparison")))).drop("comparisonTotal"))
    return k.join(r, "comparison").select(
        "prediction", "comparison", F.regexp_replace("comparison", "_", " ").alias("comparisonLabel"),
        "or_result", "lower_ci", "upper_ci", "pvalue", "is_significant",
        "comparisonRank")


@query("label_clean", """
SELECT p_partkey,
  upper(left(replace(p_type || '_' || p_name, '_', ' '), 1)) || lower(substr(replace(p_type || '_' || p_name, '_', ' '), 2))
    AS nicename,
  regexp_replace(p_name, 'l', 'L') AS first_replaced
FROM part""")
def q_label_clean(spark, d):
    """B23 + I9: replace all, sentence case, replace the first match only."""
    p = tbl(spark, d, "part")
    raw = F.concat_ws("_", "p_type", "p_name")
    return p.select("p_partkey", sentence_case(F.regexp_replace(raw, "_", " ")).alias("nicename"),
                    replace_first("p_name", "l", "L").alias("first_replaced"))


# --------------------------------------------------------------------------- safety / distinct trials

SAFETY_TYPES = ["priceTolerance", "interactions", "discountTier", "customerPriority", "brand"]
SAFETY_DROP = ["none"]
SAFETY_RECODE = {"from1to10": "1-10 partners", "from11to20": "11-20 partners", "greaterThan20": ">20 partners",
                 "high price": "High price", "low price": "Low price"}


def _sql_list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _sql_safety() -> str:
    from contingo.operators.counts import OUTPUT_COLUMNS
    from contingo.plans.common import sql_fisher_ctes, sql_with_stats
    from contingo.plans.enrichment import COMPARISONS, PREDICTIONS, SQL_COHORT_CTES, SQL_STRATA, sql_sweep
    rec = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAFETY_RECODE.items())
    return f"""WITH {SQL_COHORT_CTES}, {SQL_STRATA},
counts AS ({sql_sweep('entities_s', 'id', COMPARISONS, PREDICTIONS, True)}),
{sql_fisher_ctes('counts')},
stats AS ({sql_with_stats('counts', ['stratum'] + OUTPUT_COLUMNS)}),
sel AS (
  SELECT stratum, comparisonType, CASE comparison {rec} ELSE comparison END AS comparison, prediction, a,
    round(or_result, 6) AS or_result, round(lower_ci, 6) AS lower_ci, round(upper_ci, 6) AS upper_ci,
    CASE WHEN pvalue > 0 THEN round(-log10(pvalue), 4) + 0.0 END AS pvalue, {_sql_effect()}
  FROM stats
  WHERE comparisonType IN ({_sql_list(SAFETY_TYPES)}) AND comparison NOT IN ({_sql_list(SAFETY_DROP)})
    AND predictionType IN ('linePosition', 'doneStatus'))
SELECT stratum, comparisonType, comparison, prediction, a, or_result, lower_ci, upper_ci, pvalue, oddsinterval,
  significance, CAST(row_number() OVER (PARTITION BY stratum, comparisonType
                                   ORDER BY or_result DESC NULLS LAST, comparison, prediction) AS INTEGER) AS rank
FROM sel"""


@query("safety_table", _sql_safety())
def q_safety_table(spark, d):
    """I11 + I12 + I13: five comparison types per stratum, the 'none'
    category removed, categories recoded, effect texts, rows ranked by odds
    ratio within each (stratum, comparison type)."""
    from contingo.functions.columns import recode
    from contingo.operators.stats import with_fisher_and_or
    from contingo.plans.enrichment import q_enrichment_stratified
    st = with_fisher_and_or(q_enrichment_stratified(spark, d))
    keep = (F.col("comparisonType").isin(SAFETY_TYPES) & ~F.col("comparison").isin(SAFETY_DROP)
            & F.col("predictionType").isin("linePosition", "doneStatus"))
    out = round_stats(with_effect_columns(st.where(keep))).withColumn(
        "comparison", recode("comparison", SAFETY_RECODE))
    w = Window.partitionBy("stratum", "comparisonType").orderBy(
        F.col("or_result").desc_nulls_last(), F.col("comparison"), F.col("prediction"))
    return out.withColumn("rank", F.row_number().over(w)).select(
        "stratum", "comparisonType", "comparison", "prediction", "a", "or_result", "lower_ci", "upper_ci",
        "pvalue", "oddsinterval", "significance", "rank")


@query("trial_area_distinct", """
WITH prec AS (SELECT * FROM (VALUES ('1-URGENT', 'urgent', 0), ('2-HIGH', 'high', 1), ('3-MEDIUM', 'medium', 2),
                             ('4-NOT SPECIFIED', 'not specified', 3), ('5-LOW', 'low', 4)) t(prioId, prioLabel, prioRank)),
best AS (SELECT b.o_custkey, p.prioLabel
         FROM (SELECT o_custkey, min(prioRank) AS r FROM orders JOIN prec ON o_orderpriority = prioId GROUP BY o_custkey) b
         JOIN prec p ON p.prioRank = b.r)
SELECT DISTINCT l.l_suppkey, l.l_partkey, l.l_orderkey, b.prioLabel
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN best b ON o.o_custkey = b.o_custkey
WHERE o.o_orderpriority IS NOT NULL""")
def q_trial_area_distinct(spark, d):
    """Distinct (entity, item, trial, area) of classified trials: a
    left lookup join of each trial's best area, then ``distinct``."""
    from contingo.plans.enrichment import customer_best_priority
    li = tbl(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    o = tbl(spark, d, "orders").where(F.col("o_orderpriority").isNotNull()).select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    best = customer_best_priority(spark, d).select("o_custkey", "prioLabel")
    return (li.join(o, "l_orderkey").join(best, "o_custkey", "left")
            .select("l_suppkey", "l_partkey", "l_orderkey", "prioLabel").distinct())


# --------------------------------------------------------------------------- ordered report tables

def _value_rank_sql(fn: str) -> str:
    return f"""
SELECT p_brand, {fn}(p_retailprice) AS score,
  CAST(row_number() OVER (ORDER BY {fn}(p_retailprice), p_brand) AS INTEGER) AS rank FROM part GROUP BY p_brand"""


@query("category_rank_max", _value_rank_sql("max"))
def q_category_rank_max(spark, d):
    """Categories ordered by the maximum of a value."""
    return rank_by_value(tbl(spark, d, "part"), "p_brand", "p_retailprice", "max")


@query("category_rank_sum", """
SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS score,
  CAST(row_number() OVER (ORDER BY sum(p_size), p_brand) AS INTEGER) AS rank FROM part GROUP BY p_brand""")
def q_category_rank_sum(spark, d):
    """Categories ordered by the sum of a value."""
    return rank_by_value(tbl(spark, d, "part"), "p_brand", "p_size", "sum")


@query("category_order", """
SELECT o_orderpriority, count(*) AS n, CAST(row_number() OVER (ORDER BY
  CASE o_orderpriority WHEN '5-LOW' THEN -2 WHEN '1-URGENT' THEN -1 WHEN '3-MEDIUM' THEN 1 ELSE 0 END,
  count(*) DESC, o_orderpriority) AS INTEGER) AS rank
FROM orders GROUP BY o_orderpriority""")
def q_category_order(spark, d):
    """Order by frequency with chosen values first and last."""
    return rank_by_frequency(tbl(spark, d, "orders"), "o_orderpriority", first=["5-LOW", "1-URGENT"], last=["3-MEDIUM"])


EFFECT_COLS = ["a", "or_result", "lower_ci", "upper_ci", "pvalue"]
_SQL_EFFECTS = ("a, round(or_result, 6) AS or_result, round(lower_ci, 6) AS lower_ci, round(upper_ci, 6) AS upper_ci, "
                "CASE WHEN pvalue > 0 THEN round(-log10(pvalue), 4) + 0.0 END AS pvalue")


@query("efficacy_by_reason", f"""{SWEEP_STATS_SQL},
k AS (SELECT * FROM stats WHERE predictionType = 'reason' AND comparisonType IN ('brand', 'size')),
r AS (SELECT prediction, median(or_result) AS m FROM k GROUP BY prediction),
o AS (SELECT prediction, CAST(row_number() OVER (ORDER BY m, prediction) AS INTEGER) AS reasonRank FROM r)
SELECT k.prediction, comparisonType, comparison, {_SQL_EFFECTS}, reasonRank FROM k JOIN o ON k.prediction = o.prediction""")
def q_efficacy_by_reason(spark, d):
    """One table for each reason, reasons ordered by their median odds ratio."""
    k = sweep_with_stats(spark, d).where((F.col("predictionType") == "reason")
                                         & F.col("comparisonType").isin("brand", "size"))
    ranks = rank_by_value(k, "prediction", "or_result", "median", out="reasonRank").select("prediction", "reasonRank")
    return round_stats(k.join(ranks, "prediction")).select("prediction", "comparisonType", "comparison", *EFFECT_COLS,
                                                           "reasonRank")


SOURCE_LABELS = {"1": "Nation one", "2": "Nation two", "3": "Nation three"}


@query("efficacy_by_source", f"""{SWEEP_STATS_SQL},
k AS (SELECT *, CASE comparison WHEN '1' THEN 'Nation one' WHEN '2' THEN 'Nation two' WHEN '3' THEN 'Nation three' END AS source
      FROM stats WHERE comparisonType = 'supplierNation' AND comparison IN ('1', '2', '3') AND predictionType = 'doneStatus'),
o AS (SELECT source, CAST(row_number() OVER (ORDER BY max(or_result), source) AS INTEGER) AS sourceRank FROM k GROUP BY source)
SELECT k.source, prediction, {_SQL_EFFECTS}, sourceRank FROM k JOIN o ON k.source = o.source""")
def q_efficacy_by_source(spark, d):
    """I8: a list of sources, recoded, ordered by their largest odds ratio."""
    from contingo.functions.columns import recode
    k = sweep_with_stats(spark, d).where((F.col("comparisonType") == "supplierNation")
                                         & F.col("comparison").isin(*SOURCE_LABELS)
                                         & (F.col("predictionType") == "doneStatus")) \
        .withColumn("source", recode("comparison", SOURCE_LABELS))
    ranks = rank_by_value(k, "source", "or_result", "max", out="sourceRank").select("source", "sourceRank")
    return round_stats(k.join(ranks, "source")).select("source", "prediction", *EFFECT_COLS, "sourceRank")


@query("odds_by_cutoff", f"""{SWEEP_STATS_SQL}
SELECT prediction, CAST(replace(comparison, 'disc_', '') AS DOUBLE) AS cutoff, {_SQL_EFFECTS}
FROM stats WHERE comparisonType = 'discountTier' AND predictionType IN ('doneStatus', 'linePosition')""")
def q_odds_by_cutoff(spark, d):
    """Odds ratios along the score cut-offs."""
    k = sweep_with_stats(spark, d).where((F.col("comparisonType") == "discountTier")
                                         & F.col("predictionType").isin("doneStatus", "linePosition"))
    return round_stats(k).select("prediction", F.regexp_replace("comparison", "^disc_", "").cast("double").alias("cutoff"),
                                 *EFFECT_COLS)


def _strata_stats(where: str, out: str) -> str:
    from contingo.operators.counts import OUTPUT_COLUMNS
    from contingo.plans.common import sql_fisher_ctes, sql_with_stats
    from contingo.plans.enrichment import COMPARISONS, PREDICTIONS, SQL_COHORT_CTES, SQL_STRATA, sql_sweep
    return f"""WITH {SQL_COHORT_CTES}, {SQL_STRATA},
counts AS (SELECT * FROM ({sql_sweep('entities_s', 'id', COMPARISONS, PREDICTIONS, True)}) WHERE {where}),
{sql_fisher_ctes('counts')},
stats AS ({sql_with_stats('counts', ['stratum'] + OUTPUT_COLUMNS)})
SELECT {out} FROM stats"""


@query("strata_stacked", _strata_stats(
    "comparisonType = 'size' AND predictionType = 'reason'",
    f"CASE stratum WHEN 'all' THEN 'All orders' WHEN 'urgent' THEN 'Urgent customers' ELSE 'Other customers' END AS stratum, "
    f"comparison, prediction, {_SQL_EFFECTS}"))
def q_strata_stacked(spark, d):
    """The three strata of one analysis stacked, with readable names."""
    from contingo.functions.columns import recode
    from contingo.operators.stats import with_fisher_and_or
    from contingo.plans.enrichment import q_enrichment_stratified
    k = q_enrichment_stratified(spark, d).where((F.col("comparisonType") == "size") & (F.col("predictionType") == "reason"))
    names = {"all": "All orders", "urgent": "Urgent customers", "non_urgent": "Other customers"}
    return round_stats(with_fisher_and_or(k)).withColumn("stratum", recode("stratum", names)).select(
        "stratum", "comparison", "prediction", *EFFECT_COLS)


@query("safety_by_constraint", _strata_stats(
    "comparisonType IN ('priceTolerance', 'size') AND predictionType IN ('doneStatus', 'linePosition')",
    f"stratum, comparisonType, comparison, prediction, {_SQL_EFFECTS}, CAST(row_number() OVER (PARTITION BY stratum, "
    "comparisonType, prediction ORDER BY or_result DESC, comparison) AS INTEGER) AS rank"))
def q_safety_by_constraint(spark, d):
    """The bin comparisons of each stratum, ordered by odds ratio within (stratum, comparison type, prediction)."""
    from contingo.operators.stats import with_fisher_and_or
    from contingo.plans.enrichment import q_enrichment_stratified
    k = with_fisher_and_or(q_enrichment_stratified(spark, d).where(
        F.col("comparisonType").isin("priceTolerance", "size") & F.col("predictionType").isin("doneStatus", "linePosition")))
    w = Window.partitionBy("stratum", "comparisonType", "prediction").orderBy(F.col("or_result").desc(), F.col("comparison"))
    return round_stats(k.withColumn("rank", F.row_number().over(w))).select(
        "stratum", "comparisonType", "comparison", "prediction", *EFFECT_COLS, "rank")
