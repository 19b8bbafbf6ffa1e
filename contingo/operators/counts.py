"""Distinct-entity contingency counts.

Every pair, every marginal and the total come out of ONE pass over the cohort:

* with one row for each entity (``contingency_sweep_by_id``) a row's prediction
  values and strata are one tuple; rows are exploded by their comparison values
  only and counted map-side by (comparison, tuple), and tuples are opened on
  the table of counts, which is as small as the categories are few;
* where entities repeat (``contingency_sweep``) each row's (comparison,
  prediction) events are made distinct per entity and then counted;
* marginals and totals come from windows over the table of counts, keyed by
  comparison column, so nothing upstream is computed twice and nothing is
  gathered in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Spec = tuple[str, str]  # (column name, type label)

OUTPUT_COLUMNS = ["prediction", "comparison", "comparisonType", "predictionType", "a",
                  "predictionTotal", "comparisonTotal", "total", "b", "c", "d"]


def _type_map(specs: Sequence[Spec]) -> Column:
    return F.create_map(*[x for i, (_c, t) in enumerate(specs) for x in (F.lit(i), F.lit(t))])


def fill_two_by_two(df: DataFrame) -> DataFrame:
    """The other three cells of each table, from a and the totals."""
    only_pred, only_comp = (F.col(t) - F.col("a") for t in ("predictionTotal", "comparisonTotal"))
    neither = F.col("total") - F.col("predictionTotal") - only_comp
    return df.select("*", only_pred.alias("b"), only_comp.alias("c"), neither.alias("d"))


def _marked_array(specs: Sequence[Spec]) -> Column:
    """[none-marker, (0, value0), (1, value1), ...] as (k int, v string)."""
    items = [F.named_struct(F.lit("k"), F.lit(-1), F.lit("v"), F.lit(None).cast("string"))]
    for i, (c, _t) in enumerate(specs):
        value = F.col(c) if isinstance(c, str) else c
        items.append(F.named_struct(F.lit("k"), F.lit(i), F.lit("v"), value.cast("string")))
    return F.array(*items)


def contingency_sweep(df: DataFrame, id_cols: Sequence[str], comparisons: Sequence[Spec],
                      predictions: Sequence[Spec], strata: Column | None = None,
                      stratum_col: str = "stratum") -> DataFrame:
    """D8 + D9 + D10 (+ H5 when ``strata`` is given).

    ``strata`` is an ``array<string>`` column naming every stratum a row
    belongs to (e.g. ``all`` plus a subgroup); totals are recomputed per
    stratum.  Only observed pairs (a >= 1) are emitted, null categories are
    ignored, and ``total`` counts every distinct id of the stratum.

    Events come from crossing (comparisons + none) with (predictions + none)
    per row: (none, none) is the total, (c, none) a comparison, (none, p) a
    prediction, (c, p) a pair.  Two short explodes keep the generated code
    small; null category values are dropped right after each explode.
    """
    ids = [F.col(c) for c in id_cols]
    id_names = [f"_id{n}" for n in range(len(ids))]
    # without strata no stratum key is carried at all (one column fewer to
    # hash per event); with strata each row is exploded into its strata first
    st = [stratum_col] if strata is not None else []
    base = [F.explode(strata).alias(stratum_col)] if strata is not None else []
    c, p = F.col("_c"), F.col("_p")
    exploded = (df.select(*[i.alias(n) for n, i in zip(id_names, ids)], *base,
                          _marked_array(comparisons).alias("_ca"), _marked_array(predictions).alias("_pa"))
                  .select(*st, *id_names, F.explode("_ca").alias("_c"), "_pa")
                  .where((c["k"] < 0) | c["v"].isNotNull())
                  .select(*st, *id_names, "_c", F.explode("_pa").alias("_p"))
                  .where((p["k"] < 0) | p["v"].isNotNull())
                  .select(*st, *id_names,
                          F.when(c["k"] >= 0, c["k"]).alias("ck"), c["v"].alias("cv"),
                          F.when(p["k"] >= 0, p["k"]).alias("pk"), p["v"].alias("pv")))
    keys = st + ["ck", "cv", "pk", "pv"]
    counts = (exploded.distinct()                      # one row per (id, event)
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    return _two_by_two(counts, st, comparisons, predictions)


def _two_by_two(counts: DataFrame, st: list[str], comparisons: Sequence[Spec], predictions: Sequence[Spec]) -> DataFrame:
    """Pair rows with their marginals and totals from the table of event counts."""
    # Marginals and totals are windows over the table of counts (one row a category value or pair): a split and join
    # would let filters slide below the aggregate, and the pass would run once for each branch. Counts without a
    # comparison are repeated for each comparison column, so every window has that column in its key.
    n, ck, cv, pk = F.col("n"), F.col("ck"), F.col("cv"), F.col("pk")
    every = F.array(*[F.lit(i) for i in range(len(comparisons))])
    out = (counts
           .withColumn("ck", F.explode(F.when(ck.isNull(), every).otherwise(F.array(ck))))
           .withColumn("total", F.max(F.when(cv.isNull() & pk.isNull(), n)).over(Window.partitionBy(*st, "ck")))
           .withColumn("comparisonTotal", F.max(F.when(pk.isNull(), n)).over(
               Window.partitionBy(*st, "ck", "cv")))
           .withColumn("predictionTotal", F.max(F.when(cv.isNull(), n)).over(
               Window.partitionBy(*st, "ck", "pk", "pv")))
           .where(cv.isNotNull() & pk.isNotNull())
           .withColumnRenamed("n", "a"))
    out = out.select(
        *st,
        F.col("pv").alias("prediction"), F.col("cv").alias("comparison"),
        F.element_at(_type_map(comparisons), F.col("ck")).alias("comparisonType"),
        F.element_at(_type_map(predictions), F.col("pk")).alias("predictionType"),
        "a", "predictionTotal", "comparisonTotal", "total")
    return fill_two_by_two(out)


def _listed(df: DataFrame, names: Sequence[str]) -> Column:
    """One (k, values) for each column, after one that stands for none (null k): the distinct values of an array
    column, the value of another. Plain arrays, which are compiled; lambdas over them are not."""
    none = F.struct(F.lit(None).cast("int").alias("k"), F.array(F.lit(None).cast("string")).alias("vs"))
    of = lambda c: F.array_distinct(F.col(c).cast("array<string>")) if isinstance(df.schema[c].dataType, T.ArrayType) \
        else F.array(F.col(c).cast("string"))
    return F.array(none, *[F.struct(F.lit(i).alias("k"), of(c).alias("vs")) for i, c in enumerate(names)])


def _opened(df: DataFrame, keep: Sequence[str], listed: Column, k: str, v: str) -> DataFrame:
    """A row for each value of ``listed`` and one for none. The explodes are outer: for others a filter on the array
    is inferred, which would make every array a second time."""
    rows = df.select(*keep, F.explode_outer(listed).alias("_e"))
    rows = rows.select(*keep, F.col("_e.k").alias(k), F.explode_outer("_e.vs").alias(v))
    return rows.where(F.col(k).isNull() | F.col(v).isNotNull())


def contingency_sweep_by_id(df: DataFrame, comparisons: Sequence[Spec], predictions: Sequence[Spec],
                            strata: Column | None = None, stratum_col: str = "stratum") -> DataFrame:
    """The sweep over a frame with ONE row for each entity, multi-valued categories as array columns.

    An entity's values form a full product of its comparison and prediction values. Its prediction values and list
    of strata are one tuple, and the tuples that occur are few: a row is an event for each of its comparison values
    and one for none, counted map-side by (comparison, tuple), and the tuples are opened on the counts.
    """
    st = [stratum_col] if strata is not None else []
    listed = strata if strata is not None else F.lit(None).cast("array<string>")
    names = [f"p{i}" for i in range(len(predictions))]
    typed = lambda c: F.col(c).cast("array<string>" if isinstance(df.schema[c].dataType, T.ArrayType) else "string")
    keyed = df.select(F.struct(listed.alias("s"), *[typed(c).alias(n) for n, (c, _t) in zip(names, predictions)]).alias("t"),
                      *{c: F.col(c) for c, _t in comparisons}.values())
    events = _opened(keyed, ["t"], _listed(keyed, [c for c, _t in comparisons]), "ck", "cv")
    counted = events.groupBy("ck", "cv", "t").agg(F.count(F.lit(1)).alias("n"))
    tuples = counted.select("ck", "cv", "n", *([F.explode("t.s").alias(stratum_col)] if st else []),
                            *[F.col(f"t.{n}").alias(n) for n in names])
    opened = _opened(tuples, ["ck", "cv", "n", *st], _listed(tuples, names), "pk", "pv")
    counts = opened.groupBy(*st, "ck", "cv", "pk", "pv").agg(F.sum("n").alias("n"))
    return _two_by_two(counts, st, comparisons, predictions)


def contingency_counts(df: DataFrame, id_cols: Sequence[str], comparison: str, comparison_type: str,
                       prediction: str, prediction_type: str) -> DataFrame:
    """One (comparison, prediction) pair; the sweep with a single pair."""
    return contingency_sweep(df, id_cols, [(comparison, comparison_type)],
                             [(prediction, prediction_type)])


def distinct_count_by(df: DataFrame, group_cols: Sequence[str], id_cols: Sequence[str],
                      out: str = "n_ids", drop_null_groups: bool = False) -> DataFrame:
    """Distinct ids per group as ``distinct`` + ``count`` so both
    steps aggregate partially (no single-task distinct buffer)."""
    base = df.select(*group_cols, *id_cols)
    if drop_null_groups:
        for g in group_cols:
            base = base.where(F.col(g).isNotNull())
    return base.distinct().groupBy(*group_cols).agg(F.count(F.lit(1)).alias(out))


def share_within(df: DataFrame, group_cols: Sequence[str], class_col: str,
                 count_col: str = "count", group_count_col: str = "groupCount",
                 ratio_col: str = "ratio") -> DataFrame:
    """Class count per group, the group's count, and their ratio.  The
    group count is a second aggregate joined back on the group keys (inner)."""
    by_class = df.groupBy(*group_cols, class_col).agg(F.count(F.lit(1)).alias(count_col))
    by_group = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(group_count_col))
    return (by_class.join(by_group, list(group_cols), "inner")
            .withColumn(ratio_col, F.col(count_col) / F.col(group_count_col)))
