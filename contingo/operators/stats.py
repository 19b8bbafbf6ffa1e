"""Statistics over 2x2 tables and multiple-testing correction.

The odds ratio and its Wald interval are plain column expressions inside
whole-stage code generation, and the two-sided Fisher exact p-value is a JVM
higher-order ``aggregate`` over its two tails: no Python worker is involved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contingo.functions.columns import significance_change
from contingo.session import ensure_checkpoint_dir

Z_975 = 1.959963984540054          # standard normal 97.5% quantile
FISHER_LOG_TOL = 1e-7               # ties in log-probability (relative 1e-7)
# A log-probability is a difference of log-factorials of numbers up to n, each about n ln n and rounded to
# 2^-53 of itself, walked over up to 39 sqrt(n) ratio steps: its error stays below this many times n ln n.
FISHER_ULP = 8 * 2.0 ** -53
# A tail's terms are added until they are below exp(-46) = 1e-20 of its first one.
_TAIL_LOG = 46.0
#: Stirling's error log x! - log(sqrt(2 pi x) (x / e)^x) of 0 .. 15; its series from 16 on. (0 is never looked up.)
_STIRLING = [0.0] + [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16)]


def odds_ratio_columns(a: str, b: str, c: str, d: str, z: float = Z_975) -> tuple[Column, Column, Column]:
    """H1: odds ratio ad/(bc) and the 95% Wald interval
    exp(ln OR +- z*sqrt(1/a+1/b+1/c+1/d)); when any cell is zero, 0.5 is added
    to all four cells (the default zero shift of the statistics package)."""
    cells = [F.col(x).cast("double") for x in (a, b, c, d)]
    valid = F.least(*cells) >= 0          # a negative cell is not a 2x2 table
    shift = F.when((cells[0] == 0) | (cells[1] == 0) | (cells[2] == 0) | (cells[3] == 0),
                   F.lit(0.5)).otherwise(F.lit(0.0))
    A, B, C, D = [x + shift for x in cells]
    odds = F.try_divide(A * D, B * C)
    se = F.sqrt(F.lit(1.0) / A + F.lit(1.0) / B + F.lit(1.0) / C + F.lit(1.0) / D)
    log_or = F.log(odds)
    return (F.when(valid, odds), F.when(valid, F.exp(log_or - F.lit(z) * se)),
            F.when(valid, F.exp(log_or + F.lit(z) * se)))


def with_odds_ratio(df: DataFrame, a="a", b="b", c="c", d="d") -> DataFrame:
    odds, lo, hi = odds_ratio_columns(a, b, c, d)
    return df.withColumns({"or_result": odds, "lower_ci": lo, "upper_ci": hi})


def _sql_stirling(x: str) -> str:
    """Stirling's error of x > 0."""
    table = ", ".join(repr(v) + "D" for v in _STIRLING)
    y = f"(1D / ({x} * {x}))"
    return (f"(CASE WHEN {x} < 16 THEN get(array({table}), CAST({x} AS INT)) ELSE "
            f"({1 / 12!r}D - {y} * ({1 / 360!r}D - {y} * ({1 / 1260!r}D - {y} * ({1 / 1680!r}D - {y} * {1 / 1188!r}D)))) / {x} END)")


def _sql_deviance(x: str, mean: str) -> str:
    """x log(x / mean) + mean - x without cancellation where x is near the mean."""
    v = f"(({x} - {mean}) / ({x} + {mean}))"
    near = "0D"
    for j in range(6, 0, -1):
        near = f"(({near} + {1 / (2 * j + 1)!r}D) * {v} * {v})"
    return (f"(CASE WHEN abs({x} - {mean}) < 0.05D * ({x} + {mean}) THEN ({x} - {mean}) * {v} + 2D * {x} * {v} * {near} "
            f"ELSE {x} * ln({x} / {mean}) + {mean} - {x} END)")


def _sql_log_binomial(x: str, n: str) -> str:
    """Log-probability of x successes in n trials of probability _p (and _q = 1 - _p), by deviances: its error
    doesn't grow with n."""
    rest = f"({n} - {x})"
    return (f"(CASE WHEN {n} = 0 THEN 0D WHEN {x} = 0 THEN {n} * ln(_q) WHEN {rest} = 0 THEN {n} * ln(_p) ELSE "
            f"{_sql_stirling(n)} - {_sql_stirling(x)} - {_sql_stirling(rest)} - {_sql_deviance(x, f'({n} * _p)')} "
            f"- {_sql_deviance(rest, f'({n} * _q)')} - 0.5D * ln({2 * math.pi!r}D * {x} * ({rest} / {n})) END)")


#: Log-probability of the double _k in a table with the double margins _r, _s (rows) and _c (column) of _m: three
#: binomials with the same probability, the last of which has its mean as outcome.
_SQL_LOG_HYPERGEOMETRIC = (
    f"CASE WHEN _c = 0 OR _c = _m THEN 0D ELSE {_sql_log_binomial('_k', '_r')} + {_sql_log_binomial('_c_k', '_s')} - "
    f"({_sql_stirling('_m')} - {_sql_stirling('_c')} - {_sql_stirling('_m_c')} "
    f"- 0.5D * ln({2 * math.pi!r}D * _c * (_m_c / _m))) END")


def _with_log_probability(df: DataFrame, k: str, out: str) -> DataFrame:
    """The log-probability of the value in column k, null where that is null."""
    num = lambda c: F.col(c).cast("double")
    rows = df.withColumns({"_k": num(k), "_c_k": num("_c1") - num(k), "_r": num("_r1"), "_s": num("_n") - num("_r1"),
                           "_c": num("_c1"), "_m": num("_n"), "_m_c": num("_n") - num("_c1"),
                           "_p": num("_c1") / num("_n"), "_q": (num("_n") - num("_c1")) / num("_n")})
    return rows.withColumn(out, F.expr(f"CASE WHEN _k IS NOT NULL THEN {_SQL_LOG_HYPERGEOMETRIC} END"))


def _sql_log_factorial(x: str) -> str:
    table = ", ".join(repr(math.lgamma(v + 1)) + "D" for v in range(16))
    y = f"(1D / ({x} * {x}))"
    return (f"(CASE WHEN {x} < 16 THEN get(array({table}), CAST({x} AS INT)) ELSE ({x} + 0.5D) * ln({x}) - {x} + "
            f"{0.5 * math.log(2 * math.pi)!r}D + ({1 / 12!r}D - {y} * ({1 / 360!r}D - {y} * ({1 / 1260!r}D - {y} * "
            f"{1 / 1680!r}D))) / {x} END)")


def _sql_depth(k: str) -> str:
    """How much less likely the value k is than a constant: enough to compare by."""
    return "(" + " + ".join(_sql_log_factorial(f"CAST({x} AS DOUBLE)") for x in (k, f"(_r1 - {k})", f"(_c1 - {k})", f"(_o + {k})")) + ")"


def _bisect(low: str, high: str, upper: Callable[[str], str], end: str) -> Column:
    """The ``end`` (low or high) of the interval narrowed to neighbours; ``upper`` says of a value between them that
    high goes there. As text: the expressions are long, and a column tree of them is slow to build."""
    mid = "((_st.low + _st.high) div 2)"
    return F.expr(f"""aggregate(sequence(0, CAST(ceil(log2(CAST({high} - ({low}) + 1 AS DOUBLE))) AS INT)),
        named_struct('low', {low}, 'high', {high}),
        (_st, _i) -> CASE WHEN _st.high - _st.low <= 1 THEN _st
                          WHEN {upper(mid)} THEN named_struct('low', _st.low, 'high', {mid})
                          ELSE named_struct('low', {mid}, 'high', _st.high) END).{end}""")


def tie_tolerance(n: Column) -> Column:
    """Log-probabilities closer than this are ties: 1e-7, or the rounding error of log-factorials of n if larger."""
    x = n.cast("double") + 1
    return F.greatest(F.lit(FISHER_LOG_TOL), F.lit(FISHER_ULP) * x * F.log(x))


def with_fisher_pvalue(df: DataFrame, a="a", b="b", c="c", d="d", out: str = "pvalue",
                       partitions: int | None = None) -> DataFrame:
    """H2: two-sided Fisher exact p per row: the sum of the hypergeometric
    probabilities not above the observed one (ties: ``tie_tolerance``).

    Probabilities rise to the mode and fall after it, so those not above the
    observed one are two tails. Their inner ends are found by bisection on the
    closed-form log-probability, and so are the ends where terms fall below
    1e-20 of the tail's first one; between them each tail is summed outward by
    the ratio of neighbouring terms, an ``aggregate`` over a ``sequence``. A
    tail has about nine standard deviations of terms at most and few far from
    the mode, whatever the table's size. No term is ever a row, nothing is
    grouped and the input is read once. Tables are few and heavy, so they are
    first spread over an explicit number of partitions (the parameter
    ``partitions``, else ``spark.sql.shuffle.partitions``; AQE would otherwise
    fold the tiny rows into one task).
    Rows that are not valid tables (negative cells, empty) get null.
    """
    cols = df.columns
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    A, B, C, D = (F.col(x).cast("long") for x in (a, b, c, d))
    n, r1, c1, o = (F.col(x) for x in ("_n", "_r1", "_c1", "_o"))
    valid = (A + B + C + D > 0) & (F.least(A, B, C, D) >= 0)
    keep = lambda x: F.when(valid, x)
    low, high, mode, lim = F.col("_low"), F.col("_high"), F.col("_mode"), F.col("_lim")

    rows = df.repartition(n_parts, A, B, C, D).withColumns(
        {"_n": keep(A + B + C + D), "_r1": keep(A + B), "_c1": keep(A + C), "_o": keep(D - A),
         "_low": keep(F.greatest(F.lit(0).cast("long"), A - D)), "_high": keep(F.least(A + B, A + C))})
    rows = rows.withColumns({
        "_mode": F.least(high, F.greatest(low, F.floor((r1 + 1).cast("double") * (c1 + 1) / (n + 2)).cast("long"))),
        "_a": A})
    rows = rows.withColumn("_lim", F.when(n.isNotNull(), F.expr(_sql_depth("_a"))) - tie_tolerance(n))
    rows = rows.withColumns({
        "_whole": F.expr(f"_n IS NOT NULL AND {_sql_depth('_mode')} >= _lim"),    # as likely as any table
        "_first_l": _bisect("_low - 1", "_mode", lambda k: f"{_sql_depth(k)} < _lim", "low"),
        "_first_r": _bisect("_mode", "_high + 1", lambda k: f"{_sql_depth(k)} >= _lim", "high")})
    rows = rows.withColumns({"_first_l": F.when(F.col("_first_l") >= low, F.col("_first_l")),
                             "_first_r": F.when(F.col("_first_r") <= high, F.col("_first_r"))})
    left, right = F.col("_first_l"), F.col("_first_r")
    rows = rows.withColumns({f"_end_{s}": F.when(F.col(f"_first_{s}").isNotNull(), F.expr(_sql_depth(f"_first_{s}")) + _TAIL_LOG)
                             for s in "lr"})
    rows = rows.withColumns({
        "_last_l": F.when(left.isNotNull(), _bisect("_low - 1", "_first_l", lambda k: f"{_sql_depth(k)} <= _end_l", "high")),
        "_last_r": F.when(right.isNotNull(), _bisect("_first_r", "_high + 1", lambda k: f"{_sql_depth(k)} > _end_r", "low"))})
    rows = _with_log_probability(_with_log_probability(rows, "_first_l", "_lp_l"), "_first_r", "_lp_r")
    empty = F.array().cast("array<bigint>")

    def tail(first: Column, last: Column, log_first: Column, by: int, ratio: Callable[[Column], Column]) -> Column:
        steps = F.when((last - first) * by > 0, F.sequence(first, last - by, F.lit(by).cast("long"))).otherwise(empty)
        one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

        def step(acc, k):
            t = acc["t"] * ratio(k.cast("double"))
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        return F.when(log_first.isNull(), F.lit(0.0)).otherwise(
            F.exp(log_first + F.log(F.aggregate(steps, one, step, lambda acc: acc["s"]))))

    down = tail(left, F.col("_last_l"), F.col("_lp_l"), -1, lambda k: (k / (r1 - k + 1)) * ((o + k) / (c1 - k + 1)))
    up = tail(right, F.col("_last_r"), F.col("_lp_r"), 1, lambda k: ((r1 - k) / (k + 1)) * ((c1 - k) / (o + k + 1)))
    p = F.when(n.isNotNull(), F.when(F.col("_whole"), F.lit(1.0)).otherwise(F.least(down + up, F.lit(1.0))))
    # exploded from an array of one: a filter on p stays above that, and isn't rewritten in terms of the input's cells,
    # which would nest all of these expressions in one
    return rows.select(*cols, F.explode(F.array(p)).alias(out))


def fisher_exact_pvalues(tables: DataFrame, a="a", b="b", c="c", d="d", out: str = "pvalue") -> DataFrame:
    """H2 for the distinct tables of ``tables``: (a, b, c, d, pvalue)."""
    return with_fisher_pvalue(tables.select(a, b, c, d).distinct(), a, b, c, d, out)


def with_fisher_and_or(df: DataFrame, a="a", b="b", c="c", d="d") -> DataFrame:
    """H3 replacement: or_result, lower_ci, upper_ci, pvalue as native
    columns, in one pass over the input."""
    return with_odds_ratio(with_fisher_pvalue(df, a, b, c, d), a, b, c, d)


def bh_adjust(df: DataFrame, p_col: str = "pvalue", group_cols: Sequence[str] = (
        "predictionType", "comparisonType"), out: str = "pvalue_corrected",
        tiebreak: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg inside each group: p*m/rank, running minimum
    from the largest p down, capped at 1.  Tied p-values get the same value
    whatever the tie order.  A group is one family of tests (its rows are
    result rows, bounded by the category pairs), so one task per family."""
    g = list(group_cols)
    order = [F.col(p_col).asc_nulls_last()] + [F.col(x).asc_nulls_last() for x in tiebreak]
    w_rank = Window.partitionBy(*g).orderBy(*order)
    w_all = Window.partitionBy(*g)
    w_tail = w_rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # rows without a p-value take no part: m counts p-values, nulls rank last
    return (df.withColumn("_rank", F.row_number().over(w_rank))
              .withColumn("_m", F.count(p_col).over(w_all))
              .withColumn("_raw", F.col(p_col) * F.col("_m") / F.col("_rank"))
              .withColumn(out, F.least(F.min("_raw").over(w_tail), F.lit(1.0)))
              .drop("_rank", "_m", "_raw"))


def bh_adjust_large(df: DataFrame, p_col: str = "pvalue", group_cols: Sequence[str] = (),
                    out: str = "pvalue_corrected", partitions: int | None = None) -> DataFrame:
    """E3 for families of any size: the values of ``bh_adjust``, with no task that sees a whole family.

    Equal p-values of a family become one row with their count (map-side), so ties of any size are one row. These
    rows are range partitioned by (family, p) and written to the checkpoint folder, which fixes the ranges. Each
    range's count and least raw value form a table of one row for each range and family; a range's rank offset and
    the least raw value behind it come from that table alone. Windows run inside a range. Rows get their value back
    by (family, p). Nulls take no part.
    """
    spark, g = df.sparkSession, [f"_g{i}" for i in range(len(group_cols))]
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({k: F.col(c) for k, c in zip(g, group_cols)} | {"_p": F.col(p_col)})
    by_p = keyed.where(F.col("_p").isNotNull()).groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_n"))
    ranged = by_p.repartitionByRange(parts, *g, "_p").withColumn("_part", F.spark_partition_id()).checkpoint()
    family, here = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0)), Window.partitionBy("_part", *g)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each range and family from here ...
    ranges = ranged.groupBy("_part", *g).agg(F.sum("_n").alias("_in")) \
        .withColumn("_before", F.sum("_in").over(so_far(family.orderBy("_part"))) - F.col("_in")) \
        .withColumn("_m", F.sum("_in").over(family)).drop("_in")

    def attach(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
        named = table.withColumnsRenamed({k: f"{k}_r" for k in keys})
        on = reduce(lambda u, v: u & v, [rows[k].eqNullSafe(named[f"{k}_r"]) for k in keys])
        return rows.join(named, on, "left").drop(*[f"{k}_r" for k in keys])

    rank = F.col("_before") + F.sum("_n").over(so_far(here.orderBy("_p")))
    raw = attach(ranged, ranges, ["_part", *g]).withColumn("_raw", F.col("_p") * F.col("_m") / rank)
    behind = raw.groupBy("_part", *g).agg(F.min("_raw").alias("_least")) \
        .withColumn("_behind", F.min("_least").over(family.orderBy("_part").rowsBetween(1, Window.unboundedFollowing))) \
        .drop("_least")
    # ... to here
    after = F.min("_raw").over(here.orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fixed = attach(raw.withColumn("_after", after), behind, ["_part", *g]) \
        .select(*g, "_p", F.least("_after", "_behind", F.lit(1.0)).alias(out))
    return attach(keyed, fixed, [*g, "_p"]).drop(*g, "_p")


def with_significance_labels(df: DataFrame, p_col="pvalue", q_col="pvalue_corrected",
                             out="significance", alpha: float = 0.05) -> DataFrame:
    """B32."""
    return df.withColumn(out, significance_change(p_col, q_col, alpha))
