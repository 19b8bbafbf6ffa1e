"""Feature tables and cohort assembly.

Every feature table is deduplicated on (key, value) *before* it is joined to
the cohort, so a left join never multiplies rows by repeated feature rows.
Per-entity "best" selections are aggregates (partial aggregation, skew-safe)
instead of windows over the raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contingo.functions.columns import degree_bin, threshold_labels
from contingo.operators.skew import HotKeys


def ancestor_closure(nodes: DataFrame, id_col: str, ancestors_col: str,
                     node_out: str = "nodeId", ancestor_out: str = "propagatedId") -> DataFrame:
    """G1: every node paired with itself and each of its ancestors.  A null
    or empty ancestor list leaves only the self pair."""
    anc = F.coalesce(F.col(ancestors_col), F.array().cast("array<string>"))
    return (nodes.select(F.col(id_col).cast("string").alias(node_out),
                         F.explode(F.array_union(F.array(F.col(id_col).cast("string")), anc))
                         .alias(ancestor_out))
            .distinct())


def propagate(df: DataFrame, key: str, closure: DataFrame, node_col: str = "nodeId",
              ancestor_col: str = "propagatedId") -> DataFrame:
    """Replace the key by itself and all its ancestors (left join: a key
    missing from the closure becomes null, as in the reference), then
    ``distinct``."""
    joined = df.join(closure.withColumnRenamed(node_col, key), key, "left")
    return joined.drop(key).withColumnRenamed(ancestor_col, key).select(*df.columns).distinct()


def allowlist_keep(arr: str | Column, allowed: Sequence[str]) -> Column:
    """B4 + B5: keep a row when the array overlaps the allow-list or when the
    overlap is unknown (null array, or no match but a null element).  An
    empty array gives ``false`` and is dropped."""
    ov = F.arrays_overlap(F.array(*[F.lit(x) for x in allowed]),
                          F.col(arr) if isinstance(arr, str) else arr)
    return F.coalesce(ov, F.lit(True))


def max_score_tiers(df: DataFrame, keys: Sequence[str], score: str, cutoffs: Sequence[float],
                    labels: Sequence[str], tier_cols: Sequence[str], max_col: str = "max_score") -> DataFrame:
    """D1 + B6: max score per key, then one nullable label per cut-off."""
    out = df.groupBy(*keys).agg(F.max(score).alias(max_col))
    return out.withColumns(dict(zip(tier_cols, threshold_labels(max_col, cutoffs, labels))))


def undirected_edges(edges: DataFrame, a: str, b: str, a_out: str = "nodeA", b_out: str = "nodeB") -> DataFrame:
    """G2 + G5: edges plus their reverse, deduplicated.  Both directions come
    out of one explode, so the edge table is read once and one distinct
    (partially aggregated map-side) covers both the edge and the union
    deduplication of the reference."""
    e = edges.where(F.col(b).isNotNull())
    both = F.array(F.struct(F.col(a).alias(a_out), F.col(b).alias(b_out)),
                   F.struct(F.col(b).alias(a_out), F.col(a).alias(b_out)))
    return e.select(F.inline(both)).distinct()


def neighbour_degree(edges: DataFrame, a: str, b: str, node_out: str = "node",
                     count_out: str = "partners", bin_out: str = "partnersBin") -> DataFrame:
    """Undirected neighbour count per node (a self loop counts once)
    and its bin (B8)."""
    und = undirected_edges(edges, a, b)
    return (und.groupBy("nodeA").agg(F.count("nodeB").alias(count_out))
            .withColumn(bin_out, degree_bin(count_out))
            .withColumnRenamed("nodeA", node_out))


def best_category(pairs: DataFrame, entity: str, category: str, precedence: DataFrame,
                  prec_key: str, prec_rank: str) -> DataFrame:
    """The best-ranked category of each entity by a precedence table.
    Categories absent from the table have no rank; an entity with only such
    categories disappears.  The minimum rank is an aggregate (skew-safe) and
    the winning category comes back from the precedence table (ranks are
    unique per category); AQE broadcasts that table from its measured size."""
    ranked = pairs.join(precedence.select(
        F.col(prec_key).alias(category), F.col(prec_rank).alias("_rank")), category, "inner")
    best = ranked.groupBy(entity).agg(F.min("_rank").alias("_rank"))
    return best.join(precedence.withColumnRenamed(prec_rank, "_rank"), "_rank").drop("_rank")


def best_category_strict(pairs: DataFrame, entity: str, category: str, precedence: DataFrame,
                         prec_key: str, prec_rank: str) -> DataFrame:
    """Like E1, but an entity whose top rank is shared by more than one
    row (average rank above 1) is dropped."""
    ranked = pairs.join(precedence.select(
        F.col(prec_key).alias(category), F.col(prec_rank).alias("_rank")), category, "inner")
    per_rank = ranked.groupBy(entity, "_rank").agg(F.count(F.lit(1)).alias("_n"))
    top = per_rank.groupBy(entity).agg(F.min(F.struct("_rank", "_n")).alias("_top"))
    keep = top.where(F.col("_top._n") == 1).select(entity, F.col("_top._rank").alias("_rank"))
    return keep.join(precedence.withColumnRenamed(prec_rank, "_rank"), "_rank").drop("_rank")


def explode_field(df: DataFrame, keys: Sequence[str], array_col: str, field: str, out: str,
                  as_string: bool = True) -> DataFrame:
    """B18 + B19: project one field across an array of structs and explode
    it; null elements stay as rows (and are ignored by the counts later)."""
    v = F.explode(F.col(f"{array_col}.{field}"))
    out_df = df.select(*keys, v.alias(out))
    return out_df.withColumn(out, F.col(out).cast("string")) if as_string else out_df


def explode_structs(df: DataFrame, keys: Sequence[str], array_col: str) -> DataFrame:
    """One row per struct element, its fields as columns."""
    return df.select(*keys, F.inline(F.col(array_col)))


def lookup_join(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """C4: join a lookup table whose key has a different name.  AQE picks the strategy from the measured size
    (broadcast below its threshold, sort-merge beyond)."""
    return df.join(lookup, df[left_key] == lookup[right_key], how).drop(lookup[right_key])


def values_per_key(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """A multi-valued feature as one row for each key: its distinct values in order (bounded by the number of
    categories, not of rows)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.col(value).cast("string"))).alias(out))


def _flag_bits(flags: dict[str, Column], flag_values: dict[str, Sequence[str]]) -> tuple[Column, dict[str, dict[str, int]]]:
    """The flags whose possible values are given as bits of one integer, and the bit of each value."""
    bits: dict[str, dict[str, int]] = {}
    mask, n = F.lit(0).cast("long"), 0
    for name in flags:
        values = sorted(flag_values.get(name, ()))
        if values and n + len(values) <= 62:
            bits[name] = {v: n + i for i, v in enumerate(values)}
            n += len(values)
            for v, b in bits[name].items():
                mask = mask.bitwiseOR(F.when(flags[name] == v, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask, bits


def _open_flag(bits: dict[str, int], many: bool) -> Column:
    """The flag's value or, with ``many``, its sorted values as an array."""
    has = lambda b: F.col("_mask").bitwiseAND(F.lit(1 << b).cast("long")) != 0
    if not many:
        return F.coalesce(*[F.when(has(b), F.lit(v)) for v, b in bits.items()])
    return F.concat(*[F.when(has(b), F.array(F.lit(v))).otherwise(F.array().cast("array<string>")) for v, b in bits.items()])


def assemble_cohort(evidence: DataFrame, id_cols: Sequence[str], features: Sequence[tuple[DataFrame, Sequence[str]]], *,
                    where: Column | None = None, nested: str | None = None,
                    captured: dict[str, tuple[Callable[[Column], Column], str]] | None = None, flags: dict[str, Column] | None = None,
                    flag_values: dict[str, Sequence[str]] | None = None, one_row: bool = False, id_out: str = "id",
                    hot: HotKeys | None = None) -> DataFrame:
    """From evidence to the cohort.

    The source filter ``where`` applies first. ``captured`` are identifiers, each a text taken out of an element of
    the array column ``nested`` and its type; an element becomes a row if none is null or empty. ``flags`` are derived
    columns. Repeated rows collapse, the entity gets its ``xxhash64`` id (B20), and each feature table is joined from
    the left on its keys.  A feature with several rows for a key multiplies the rows, so entities are counted by id
    afterwards. With ``one_row`` an entity's flags are gathered into arrays of their distinct values instead (as many
    as there are flag values; ``flag_values`` names all values that a flag can have); together with features that
    have one row for a key each entity then has one row. With ``hot`` the joins on those keys split heavy keys.
    """
    rows = evidence if where is None else evidence.where(where)
    if nested and captured:
        # outer, so that no filter on the array is inferred, which would capture everything a second time
        found = F.transform(nested, lambda e: F.struct(*[f(e).alias(n) for n, (f, _t) in captured.items()]))
        rows = rows.select(*[c for c in rows.columns if c not in (nested, *captured)], F.inline_outer(found))
        for name in captured:
            rows = rows.where(F.col(name) != "")
        rows = rows.withColumns({n: F.col(n).cast(t) for n, (_f, t) in captured.items()})
    flags = flags or {}
    mask, bits = _flag_bits(flags, flag_values or {})
    rest = [n for n in flags if n not in bits]
    # dealt by the first feature's keys, so that neither the gathering nor that join deals the rows again; by a stated
    # number of partitions, which isn't coalesced, as rows are far smaller here than with their features
    parts = int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = next((list(k) for _t, k in features if set(k) <= set(id_cols)), None)
    if first and (hot is None or first != hot.keys):
        rows = rows.repartition(parts, *first)
    rows = rows.select(*id_cols, mask.alias("_mask"), *[flags[n].alias(n) for n in rest])
    rows = rows.groupBy(*id_cols).agg(F.bit_or("_mask").alias("_mask"), *[F.array_sort(F.collect_set(n)).alias(n) for n in rest]) \
        if one_row and flags else rows.distinct()
    rows = rows.withColumn(id_out, F.xxhash64(*id_cols))
    alone = [k[0] for _t, k in features if len(k) == 1 and list(k) != first]
    for table, keys in features:
        if hot is not None and list(keys) == hot.keys:
            rows = hot.join(rows, table, list(keys))
            continue
        shared = next((k for k in keys if k in alone), None) if len(keys) > 1 and hot is None else None
        if shared:                            # later features have this key alone: rows dealt by it meet them as they are
            rows, table = rows.repartition(parts, shared), table.repartition(parts, shared)
        rows = rows.join(table, list(keys), "left")
    opened = [_open_flag(bits[n], one_row).alias(n) if n in bits else F.col(n) for n in flags]
    return rows.select(*id_cols, *opened, *[c for c in rows.columns if c not in (*id_cols, *flags, "_mask")])


def stack_tagged(frames: dict[str, DataFrame], tag_col: str = "tag") -> DataFrame:
    """Stack tables with a tag column, matching columns by name."""
    out = None
    for tag, frame in frames.items():
        f = frame.withColumn(tag_col, F.lit(tag))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def complete_grid(counts: DataFrame, a: str, b: str, fill: dict | None = None) -> DataFrame:
    """All combinations of the observed values of two category columns (null is a value), absent
    combinations null (or ``fill``).

    Each value of ``a`` gathers its rows (at most one for each value of ``b``) and meets the set of values of
    ``b``, which is the one thing collected as a whole: one struct for each category.  The grid is built in as
    many tasks as there are values of ``a``."""
    rest = [c for c in counts.columns if c not in (a, b)]
    every = counts.select(b).distinct().agg(F.collect_set(F.struct(F.col(b)))).scalar()
    by_a = counts.groupBy(a).agg(F.collect_list(F.struct(b, *rest)).alias("_rows"))
    grid = by_a.select(a, "_rows", F.explode(every).alias("_b"))
    own = F.filter("_rows", lambda r: r[b].eqNullSafe(F.col(f"_b.{b}")))
    out = grid.select(a, F.col(f"_b.{b}").alias(b), F.try_element_at(own, F.lit(1)).alias("_own")) \
        .select(a, b, *[F.col(f"_own.{c}").alias(c) for c in rest])
    return out.fillna(fill) if fill else out
