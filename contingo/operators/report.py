"""Report tables, rebuilt as DataFrame jobs instead of
collected-then-local table code.  Drawing is not built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contingo.functions.columns import effect_text, left_closed_bins, pvalue_text, thousands

# The count bins of the report (left-closed, last open).
COUNT_BREAKS = [1, 5, 10, 25, 100, 250, 500]
COUNT_LABELS = ["1-4", "5-9", "10-24", "25-99", "100-249", "250-499", "500+"]


def count_bins(df: DataFrame, count_col: str = "count", out: str = "interval") -> DataFrame:
    """B26."""
    return df.withColumn(out, left_closed_bins(count_col, COUNT_BREAKS, COUNT_LABELS))


def rank_by_frequency(df: DataFrame, category: str, out: str = "rank", desc: bool = True,
                      first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Categories ordered by frequency (ties by name), chosen values
    first or last whatever their frequency, in the order given.  The window
    runs in one task over the per-category counts, one row per category, so
    the column must be a category and not a key."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    place = F.lit(0)
    for i, v in enumerate(first):
        place = F.when(F.col(category) == v, i - len(first)).otherwise(place)
    for i, v in enumerate(last):
        place = F.when(F.col(category) == v, i + 1).otherwise(place)
    order = [place.asc(), F.col("n").desc() if desc else F.col("n").asc(), F.col(category).asc()]
    return counts.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def group_median(df: DataFrame, group_cols: Sequence[str], value: str, out: str = "median",
                 buckets: int = 64) -> DataFrame:
    """D11 helper: exact median per group (mean of the two middle values for
    an even count), nulls ignored, without putting a whole group in one task.

    1. values shrink to (group, value, multiplicity) -- a partial aggregate;
    2. each group is cut at approximate quantiles into ``buckets`` ranges of
       about equally many rows, whatever the values' tail; the ranges' counts
       (a small table) give every range's rank offset;
    3. only the ranges holding the two middle ranks are scanned in value
       order, one (group, range) per window partition.
    """
    g = list(group_cols)
    v = F.col(value)
    known = df.where(v.isNotNull())
    hist = known.groupBy(*g, value).agg(F.count(F.lit(1)).alias("_m"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    stats = known.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"),
                                  F.percentile_approx(value, shares, 10 * buckets).alias("_cuts"))
    hb = hist.join(stats, g).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < v)))
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_b = hb.groupBy(*g, "_b").agg(F.sum("_m").alias("_bc"), F.first("_n").alias("_n"))
    per_b = per_b.withColumn("_off", F.sum("_bc").over(wb) - F.col("_bc"))
    lo_rank = F.floor((F.col("_n") + 1) / 2)
    hi_rank = F.floor(F.col("_n") / 2) + 1
    in_b = lambda r: (F.col("_off") < r) & (r <= F.col("_off") + F.col("_bc"))
    target = per_b.where(in_b(lo_rank) | in_b(hi_rank)).select(*g, "_b", "_off", "_n")
    cand = hb.select(*g, value, "_m", "_b").join(target, g + ["_b"])
    wv = Window.partitionBy(*g, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cand = cand.withColumn("_cum", F.col("_off") + F.sum("_m").over(wv))
    first_at = lambda r: F.min(F.when(F.col("_cum") >= r, v))
    return cand.groupBy(*g).agg(((first_at(lo_rank) + first_at(hi_rank)) / 2.0).alias(out))


def rank_by_value(df: DataFrame, category: str, value: str, how: str = "median",
                  out: str = "rank") -> DataFrame:
    """Order categories by the median / max / sum of a value."""
    if how == "median":
        agg = group_median(df, [category], value, "score")
    else:
        fn = {"max": F.max, "sum": F.sum}[how]
        agg = df.groupBy(category).agg(fn(value).alias("score"))
    return agg.withColumn(out, F.row_number().over(Window.orderBy(F.col("score").asc(), F.col(category).asc())))


def with_effect_columns(df: DataFrame, or_col="or_result", lo_col="lower_ci", hi_col="upper_ci",
                        p_col="pvalue", n_col="a") -> DataFrame:
    """``OR (lo-hi)`` text, p-value text, thousands-separated n."""
    return df.withColumns({"oddsinterval": effect_text(or_col, lo_col, hi_col),
                           "significance": pvalue_text(p_col),
                           "n": thousands(n_col)})


def unpivot_stats(df: DataFrame, ids: Sequence[str], mapping: dict[str, str],
                  key: str = "key", value: str = "value") -> DataFrame:
    """Wide to long, keys renamed by ``mapping``."""
    long = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in mapping]).unpivot(
        list(ids), list(mapping), key, value)
    lut = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return long.withColumn(key, F.element_at(lut, F.col(key)))
