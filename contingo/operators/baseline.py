"""Seeded random baseline.

The analysed workload lists targets x diseases, shuffles and keeps the first
n pairs, once per seed in a driver loop.  Here both sides get dense indexes
(i below T, j below D), and a seeded bijection of the T x D grid decides
membership: a pair belongs to seed s's universe when its image's number
i' * D + j' is below n.  A bijection sends exactly n pairs below n, so every
universe has exactly n members.  Two ways lead to them, without the grid:

* ``member_bits`` asks for the pairs of a table: a pair's seeds come out as a
  bit set, one row a pair, whatever the number of seeds;
* ``listed_universe`` runs the rounds backwards from the images 0 .. n - 1 and
  lists each seed's n pairs, observed or not, which is the cheaper way when n
  is smaller than the table that asks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contingo.functions.columns import md5_unit_hash
from contingo.operators.counts import fill_two_by_two

#: Primes below 2^31: products of residues and multipliers fit a 64-bit integer in every engine.
PRIMES = (2147483647, 2147483629, 2147483587)
MULTIPLIERS = (48271, 40014, 69621)
ROUNDS = 4
#: Seeds in one word of a bit set.
WORD = 62
INDEX_BUCKETS = 1024


def dense_index(keys: DataFrame, key: str, out: str, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Each distinct non-null key with a number from 0 up without gaps, ordered by (hash bucket, key).  Only the
    bucket counts (``buckets`` rows) are ordered as a whole; ranks are taken inside each bucket."""
    b = F.pmod(md5_unit_hash(key), F.lit(buckets))
    rows = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", b)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return ranked.join(offsets, "_b").select(key, (F.col("_off") + F.col("_r") - 1).alias(out))


def mixed(seed: Column, round_no: int, value: Column) -> Column:
    """A seeded residue in plain 64-bit arithmetic: linear steps modulo different primes. Each step uses the one
    before once, so the expression doesn't grow when rounds are nested."""
    for k, (prime, by) in enumerate(zip(PRIMES, MULTIPLIERS)):
        value = (value * by + seed.cast("long") * (16807 + 2 * k) + (round_no * 7919 + k)) % prime
    return value


def shuffled(df: DataFrame, i: str, j: str, size_i: Column, size_j: Column, seed: str, out: str) -> DataFrame:
    """``out``: the number of (i, j)'s image under the seed's bijection of the grid. Each round adds a residue of
    one index to the other, modulo its size, so it can be undone."""
    x, y = F.col("_x"), F.col("_y")
    rows = df.withColumns({"_x": F.col(i).cast("long"), "_y": F.col(j).cast("long")})
    for r in range(ROUNDS):
        rows = rows.withColumn("_x", (x + mixed(F.col(seed), 2 * r, y)) % size_i) if r % 2 == 0 else \
            rows.withColumn("_y", (y + mixed(F.col(seed), 2 * r, x)) % size_j)
    return rows.withColumn(out, x * size_j + y).drop("_x", "_y")


def sql_shuffled(source: str, i: str, j: str, size_i: str, size_j: str, seed: str, out: str) -> str:
    """``shuffled`` as SQL text, one nested SELECT a step."""
    q = f"SELECT *, CAST({i} AS BIGINT) AS _x, CAST({j} AS BIGINT) AS _y FROM {source}"
    for r in range(ROUNDS):
        to, by, size = ("_x", "_y", size_i) if r % 2 == 0 else ("_y", "_x", size_j)
        f = by
        for k, (prime, m) in enumerate(zip(PRIMES, MULTIPLIERS)):
            f = f"(({f}) * {m} + {seed} * {16807 + 2 * k} + {2 * r * 7919 + k}) % {prime}"
        q = f"SELECT * REPLACE (({to} + {f}) % {size} AS {to}) FROM ({q})"
    return f"SELECT * EXCLUDE (_x, _y), _x * {size_j} + _y AS {out} FROM ({q})"


def restored(df: DataFrame, image: str, size_i: Column, size_j: Column, seed: str, i: str, j: str) -> DataFrame:
    """The inverse of ``shuffled``: the indexes (i, j) whose image has the number ``image``. Rounds backwards, each
    residue taken off again. The indexes are marked as never null (-1 can't occur), so that no join puts a filter on
    them, which would slide below the rounds and repeat the arithmetic of all of them, nested in one expression."""
    x, y = F.col(i), F.col(j)
    rows = df.withColumns({i: F.floor(F.col(image) / size_j).cast("long"), j: F.pmod(F.col(image), size_j)})
    for r in reversed(range(ROUNDS)):
        rows = rows.withColumn(i, F.pmod(x - mixed(F.col(seed), 2 * r, y) % size_i, size_i)) if r % 2 == 0 else \
            rows.withColumn(j, F.pmod(y - mixed(F.col(seed), 2 * r, x) % size_j, size_j))
    return rows.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in (i, j)})


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _indexes(left: DataFrame, right: DataFrame, pair_cols: Sequence[str]) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Dense indexes of both sides (columns _i and _j) and their sizes."""
    a, b = pair_cols
    sides = [t.select(F.col(t.columns[0]).alias(k)) for t, k in ((left, a), (right, b))]
    sizes = [_count(t.where(F.col(k).isNotNull()).distinct()) for t, k in zip(sides, (a, b))]
    return dense_index(sides[0], a, "_i"), dense_index(sides[1], b, "_j"), *sizes


def member_bits(pairs: DataFrame, left: DataFrame, right: DataFrame, pair_cols: Sequence[str], n_seeds: int,
                n: int | None = None) -> DataFrame:
    """(pair, bits): for each distinct pair in a universe of some seed, the seeds as bits of an array of longs, WORD
    seeds a word. n is the size of a universe, by default the number of distinct pairs.

    The images of a pair under all seeds are made next to it and folded at once, so what is exchanged or joined is one
    row a pair. They are folded without a filter: a filter on the image would be pushed into its own definition and
    repeat the arithmetic of all rounds."""
    # dealt by a stated number of partitions, which isn't coalesced: the pairs are small, their images are not
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    observed = pairs.select(*pair_cols).repartition(parts, *pair_cols).distinct()
    li, ri, size_i, size_j = _indexes(left, right, pair_cols)
    size = F.lit(n) if n is not None else _count(observed)
    seeded = observed.join(li, pair_cols[0]).join(ri, pair_cols[1]).repartition(parts, *pair_cols) \
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))))
    image = shuffled(seeded, "_i", "_j", size_i, size_j, "seed", "_image")
    words = range(0, n_seeds, WORD)
    one = F.lit(1).cast("long")
    folded = image.withColumn("_in", F.col("_image") < size).groupBy(*pair_cols).agg(*[
        F.bit_or(F.when(F.col("_in") & F.col("seed").between(w, w + WORD - 1), F.call_function("shiftleft", one, F.col("seed") - w))
                 .otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in words])
    bits = F.array(*[F.col(f"_w{w}") for w in words])
    return folded.select(*pair_cols, bits.alias("bits")).where(F.exists("bits", lambda w: w != 0))


def seeds_of(bits: Column) -> Column:
    """The seeds of a bit set, ascending."""
    at = lambda s: F.get(bits, F.floor(s / WORD).cast("int"))
    n = F.size(bits) * WORD
    return F.filter(F.sequence(F.lit(0), n - 1), lambda s: F.getbit(at(s), F.pmod(s, F.lit(WORD))) == 1)


def baseline_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, pair_cols: Sequence[str],
                   n_seeds: int) -> DataFrame:
    """C7 + F2 + F3: (pair, seed) for the distinct observed pairs and the seeds whose universe of exactly n pairs
    holds them; n is the number of observed pairs, left and right the two entity tables (their first column)."""
    return member_bits(pairs, left, right, pair_cols, n_seeds) \
        .select(*pair_cols, F.explode(seeds_of(F.col("bits"))).alias("seed"))


def listed_universe(left: DataFrame, right: DataFrame, pair_cols: Sequence[str], n_seeds: int, n: int) -> DataFrame:
    """(pair, seed): all n pairs of each seed's universe (no more than the grid has), found backwards from their
    images. Rows are made where they are used, n a seed, and meet the two indexes; the grid is never made."""
    li, ri, size_i, size_j = _indexes(left, right, pair_cols)
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    images = spark.range(0, n * n_seeds, 1, parts).select(
        (F.col("id") % n_seeds).cast("int").alias("seed"), F.floor(F.col("id") / n_seeds).cast("long").alias("_image"))
    found = restored(images.where(F.col("_image") < size_i * size_j), "_image", size_i, size_j, "seed", "_i", "_j")
    # an index is far smaller than the images: hashed by partition, so the images are dealt but not sorted
    return found.join(li.hint("shuffle_hash"), "_i").join(ri, "_j").select(*pair_cols, "seed")


def null_baseline(cohort: DataFrame, id_cols: Sequence[str], pair_cols: Sequence[str], prediction: str,
                  prediction_type: str, members: DataFrame, strata: Column | None = None,
                  comparison_value: str = "random", comparison_type: str = "byDatatype") -> DataFrame:
    """H4: one prediction against membership in each seed's universe, for all seeds (and strata) in one job.

    The pair is part of the id, so ids of different pairs differ and counts add up: ids are counted once per
    (strata, pair, prediction), and only these counts meet the members, (pair, bits) or (pair, seed).  Totals and
    prediction totals don't depend on the seed; they come out of the same pass.  One row for each (stratum, seed,
    prediction), a >= 1.
    """
    if not set(pair_cols) <= set(id_cols):
        raise ValueError("the pair must be part of the id")
    st = ["stratum"] if strata is not None else []
    listed = [strata.alias("stratum")] if st else []
    ids = cohort.select(*listed, *id_cols, F.col(prediction).cast("string").alias("prediction")).distinct()
    per_pair = ids.groupBy(*st, *pair_cols, "prediction").agg(F.count(F.lit(1)).alias("n"))
    if "bits" in members.columns:
        seeds = members.select(*pair_cols, seeds_of(F.col("bits")).alias("_seeds"))
    else:
        seeds = members.groupBy(*pair_cols).agg(F.collect_list("seed").alias("_seeds"))
    # one pass: a pair counts for each of its seeds and, under a null seed, for the totals
    every = F.array(F.lit(None).cast("int"))
    met = per_pair.join(seeds, list(pair_cols), "left").select(
        *st, "prediction", "n", F.explode_outer(F.when(F.col("_seeds").isNull(), every).otherwise(
            F.concat(every, F.col("_seeds").cast("array<int>")))).alias("seed"))
    counted = met.groupBy(*st, "seed", "prediction").agg(F.sum("n").alias("a"))
    if st:
        counted = counted.withColumn("stratum", F.explode("stratum")).where(F.col("stratum").isNotNull()) \
            .groupBy(*st, "seed", "prediction").agg(F.sum("a").alias("a"))
    whole = F.when(F.col("seed").isNull(), F.col("a"))
    out = counted.withColumns({
        "predictionTotal": F.sum(whole).over(Window.partitionBy(*st, "prediction")),
        "total": F.sum(whole).over(Window.partitionBy(*st)),
        "comparisonTotal": F.sum("a").over(Window.partitionBy(*st, "seed"))}) \
        .where(F.col("seed").isNotNull() & F.col("prediction").isNotNull())
    out = out.select(
        *st, "seed", "prediction", F.lit(comparison_value).alias("comparison"),
        F.lit(comparison_type).alias("comparisonType"), F.lit(prediction_type).alias("predictionType"),
        "a", "predictionTotal", "comparisonTotal", "total")
    return fill_two_by_two(out)
