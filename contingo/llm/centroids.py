"""Centroid clustering (Lloyd's rounds) with geometric drift tightening.

Every vector carries its cluster, an upper bound of the distance to its
centroid and a lower bound of the distance to all others. When centroids move,
the lower bound of a vector in cluster i must shrink by the most by which any
other centroid can have come nearer. The full drift |c_j' - c_j| is safe but
loose: all vectors of cluster i lie in a sphere around its centroid, and the
gain d(x, c_j) - d(x, c_j') reaches the drift only on the line behind c_j'.
In the plane through c_i and that line, the points with a gain of at least g
lie within a hyperbola's branch, inside the cone around the direction of the
move whose angle has the cosine g / drift. So the gain in the sphere is at
most drift * cos(angle of the sphere's centre - half angle under which it is
seen from the middle of the move), and at most 0 for spheres behind. Vectors
whose bounds don't part their centroid from the others are scanned exactly in
integers; ties go to the smaller number. Bounds are widened by more than
rounding can do, so clusters are those of plain rounds.

Vectors are packed into blocks once, in a table bucketed by block; the state
(cluster and bounds, 20 bytes a vector) is a table of its own with the same
buckets, so a round joins them without an exchange, rewrites only the state
and adds up only the vectors that moved. Both are written in the shared
folder: a lost executor costs its tasks. The driver gets sums for each
cluster and dimension.

Defined results: kept are vectors of exactly ``size`` entries, none null or
non-finite; entries are floor(scale * x), held within a bound at which squared
distances fit a long (2^27 for 64 entries). First centroids are the kept rows
with the smallest hashes (ties by vector); rows with a null id are clustered
but are no first centroid. With fewer rows than clusters there are as many
clusters as rows with ids; without any, or with an empty table, the result is
empty. Repeated rows count one by one, empty clusters stay where they are,
other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import shared_folder
from contingo.llm.vectors import matrix, scaled_floor, whole_rows

#: Fixed values of the contract.
SIZE, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024.0, 8, 10, "3:"
#: Vectors in a block, about so many bytes of blocks in a bucket, and buckets at least and at most.
BLOCK_ROWS, BUCKET_BYTES, FEWEST, MOST = 1024, 64 << 20, 8, 4096
#: Bounds are widened by this share at every step, far more than rounding does.
SLACK = 1e-12

_MOVES = "array<struct<cluster:int,n:bigint,sums:binary,radius:double>>"
_STATE = f"block long, cluster binary, upper binary, lower binary, scanned long, moves {_MOVES}"
_MOVES_ARROW = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()),
                                   ("radius", pa.float64())]))


def entry_bound(size: int) -> int:
    """Largest absolute entry for which a squared distance fits a long."""
    return 1 << (max(1, (62 - max(size, 1).bit_length() + 1) // 2) - 1)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row of x to every row of c (integers)."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * largest * largest * max(1, x.shape[1]) < 1 << 53:            # all sums are exact in doubles
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        return ((fx * fx).sum(axis=1)[:, None] - 2 * (fx @ fc.T) + (fc * fc).sum(axis=1)).astype(np.int64)
    return np.stack([own_distances(x, np.broadcast_to(row, x.shape)) for row in c], axis=1)


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c
    return (d * d).sum(axis=1)


def gains(centres: np.ndarray, radii: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """[i, j]: an upper bound of how much nearer centroid j can have come to any point of sphere i, by moving from
    old[j] to new[j]; between 0 and the move's length."""
    out = np.zeros((len(centres), len(old)))
    for j in range(len(old)):
        move = new[j] - old[j]
        drift = float(np.sqrt(move @ move))
        if drift == 0.0:
            continue
        from_middle = centres - (old[j] + new[j]) / 2
        away = np.sqrt((from_middle * from_middle).sum(axis=1))
        seen = away > radii * (1 + SLACK)                               # otherwise the middle may be in the sphere
        at = np.where(seen, away, 1.0)
        cos, sin_half = np.clip(from_middle @ move / (at * drift), -1, 1), np.clip(radii / at, 0, 1)
        cos_half, sin = np.sqrt(1 - sin_half ** 2), np.sqrt(1 - cos ** 2)
        inside = cos >= cos_half                                        # the line of the move meets the sphere
        nearest = np.where(seen & ~inside, cos * cos_half + sin * sin_half, 1.0)
        out[:, j] = drift * np.clip(nearest + 1e-7, 0, 1)               # roots near 1 lose half the digits
    return out


@dataclass(frozen=True)
class Move:
    """What a round needs to know about the last one's end: all of k rows."""

    centroids: np.ndarray                                               # where they are now
    drift: np.ndarray | None = None                                     # how far each has moved
    loosen: np.ndarray | None = None                                    # what a vector's lower bound loses, by its cluster
    half_gap: np.ndarray | None = None                                  # half the distance to the nearest other centroid

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray, radii: np.ndarray, tighten: bool = True) -> Move:
        a, b = old.astype(np.float64), new.astype(np.float64)
        drift = np.sqrt(((b - a) ** 2).sum(axis=1))
        by = gains(a, radii, a, b) if tighten else np.broadcast_to(drift, (len(a), len(a))).copy()
        np.fill_diagonal(by, 0.0)
        apart = np.sqrt(squared_distances(new, new).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        return Move(new, drift, by.max(axis=1), apart.min(axis=1) / 2)


def assign(x: np.ndarray, move: Move, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, vectors scanned against all centroids) after a move; without a state all are scanned."""
    if state is None:
        cluster, upper, lower = np.zeros(len(x), dtype=np.int32), np.zeros(len(x)), np.zeros(len(x))
        open_ = np.arange(len(x))
    else:
        cluster, upper, lower = (a.copy() for a in state)
        upper += move.drift[cluster]
        upper += SLACK * upper
        loosen = move.loosen[cluster]
        lower -= loosen + SLACK * (np.abs(lower) + loosen)
        part = np.maximum(lower, move.half_gap[cluster] * (1 - SLACK))
        open_ = np.flatnonzero(upper >= part)
        upper[open_] = np.sqrt(own_distances(x[open_], move.centroids[cluster[open_]])) * (1 + SLACK)
        open_ = open_[upper[open_] >= part[open_]]
    if len(open_):
        d = squared_distances(x[open_], move.centroids)
        best = d.argmin(axis=1)                                         # the smaller number among equals
        cluster[open_] = best
        upper[open_] = np.sqrt(d[np.arange(len(open_)), best].astype(np.float64)) * (1 + SLACK)
        d[np.arange(len(open_)), best] = np.iinfo(np.int64).max
        lower[open_] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)
    return cluster, upper, lower, len(open_)


def moves_of(x: np.ndarray, before: np.ndarray | None, cluster: np.ndarray, upper: np.ndarray) -> list[dict]:
    """For each cluster of a block: vectors gained less vectors lost, their sums, and the largest upper bound."""
    out = []
    changed = np.arange(len(x)) if before is None else np.flatnonzero(before != cluster)
    touched = np.union1d(cluster, before[changed] if before is not None else cluster)
    for c in touched.tolist():
        gained = changed[cluster[changed] == c]
        lost = changed[before[changed] == c] if before is not None else gained[:0]
        held = upper[cluster == c]
        sums = None
        if len(gained) or len(lost):
            sums = (x[gained].sum(axis=0, dtype=np.int64) - x[lost].sum(axis=0, dtype=np.int64)).tobytes()
        out.append({"cluster": c, "n": len(gained) - len(lost), "sums": sums, "radius": float(held.max(initial=0.0))})
    return out


@dataclass
class Clustering:
    rows: DataFrame                                                     # vec_id, cluster, distance
    centroids: list[list[int]]
    scanned: list[int] = field(default_factory=list)                    # vectors scanned against all centroids, by round


class _Tables:
    """The bucketed tables of one run, in the shared folder; their names leave the catalog at the end."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.folder, self.prefix = shared_folder(spark, "centroids"), f"contingo_{uuid.uuid4().hex}"
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{self.prefix}_{name}"
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")             # the files stay: they are named by path


def _unpack(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    for i in range(batch.num_rows):
        packed = batch.column("vectors")[i].as_buffer()
        yield (batch.column("block")[i].as_py(), batch.column("ids")[i].values,
               np.frombuffer(packed, dtype=np.int32).reshape(-1, size))


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    block, cluster, upper, lower, scanned, moves = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, type=pa.int64()), pa.array(cluster, type=pa.binary()), pa.array(upper, type=pa.binary()),
         pa.array(lower, type=pa.binary()), pa.array(scanned, type=pa.int64()), pa.array(moves, type=_MOVES_ARROW)],
        ["block", "cluster", "upper", "lower", "scanned", "moves"])


def pack(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks (block, ids, vectors) of the usable rows of (id, vector)."""
    bound = entry_bound(size)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, _ = whole_rows(batch.column(1), size)
            for i in range(0, len(rows), BLOCK_ROWS):
                part = rows[i:i + BLOCK_ROWS]
                x = scaled_floor(matrix(batch.column(1), part, size), scale, bound).astype(np.int32)
                ids = batch.column(0).take(pa.array(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], type=pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(part)], type=pa.int32()), ids),
                     pa.array([x.tobytes()], type=pa.binary())], ["block", "ids", "vectors"])
                number += 1

    return vectors.mapInArrow(blocks, f"block long, ids array<{vectors.schema['id'].dataType.simpleString()}>, vectors binary")


def first_centroids(blocks: DataFrame, size: int, k: int, salt: str) -> np.ndarray:
    """The vectors of the k rows with the smallest sha256 of salt and id."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, x in _unpack(batch, size):
                found = sorted((hashlib.sha256(f"{salt}{v}".encode()).hexdigest(), x[i].tobytes())
                               for i, v in enumerate(ids.to_pylist()) if v is not None)[:k]
                if found:
                    yield pa.RecordBatch.from_pydict({"hash": [h for h, _ in found],
                                                      "vector": pa.array([v for _, v in found], type=pa.binary())})

    rows = blocks.mapInArrow(least, "hash string, vector binary").orderBy("hash", "vector").limit(k).collect()
    return np.array([np.frombuffer(r["vector"], dtype=np.int32) for r in rows], dtype=np.int64).reshape(-1, size)


def _assigned(vectors: DataFrame, state: DataFrame | None, move: Move, size: int) -> DataFrame:
    """The state after a move. Both tables have the same buckets, so the join needs no exchange."""
    rows = vectors.select("block", "ids", "vectors")
    if state is not None:
        rows = rows.join(state.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (block, _, x) in enumerate(_unpack(batch, size)):
                known = None
                if "cluster" in batch.schema.names:
                    known = tuple(np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind) for name, kind in
                                  (("cluster", np.int32), ("upper", np.float64), ("lower", np.float64)))
                cluster, upper, lower, scanned = assign(x, move, known)
                out.append((block, cluster.tobytes(), upper.tobytes(), lower.tobytes(), scanned,
                            moves_of(x, None if known is None else known[0], cluster, upper)))
            if out:
                yield _state_batch(out)

    return rows.mapInArrow(step, _STATE)


def _gathered(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, list[list[int]], np.ndarray, int]:
    """(change of counts, change of sums, radii, vectors scanned) of the state's last round, exact."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, radii, scanned = np.zeros(k, dtype=np.int64), {}, np.zeros(k), 0
        for batch in batches:
            scanned += sum(batch.column(0).to_pylist())
            for moves in batch.column(1).to_pylist():
                for m in moves:
                    c = m["cluster"]
                    n[c] += m["n"]
                    radii[c] = max(radii[c], m["radius"])
                    if m["sums"] is not None:
                        sums[c] = sums.get(c, 0) + np.frombuffer(m["sums"], dtype=np.int64)
        cells = [(c, d, int(v), 0.0) for c, s in sums.items() for d, v in enumerate(s)]
        cells += [(c, size, int(n[c]), float(radii[c])) for c in range(k)] + [(k, size, scanned, 0.0)]
        c, d, v, r = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32()), pa.array(d, type=pa.int32()),
                                          pa.array(v, type=pa.int64()), pa.array(r)], ["cluster", "dim", "value", "radius"])

    n, sums, radii, scanned = np.zeros(k, dtype=np.int64), [[0] * size for _ in range(k)], np.zeros(k), 0
    for r in state.select("scanned", "moves").mapInArrow(add, "cluster int, dim int, value long, radius double") \
            .groupBy("cluster", "dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"),
                                           F.max("radius").alias("radius")).collect():      # k x (size + 1) rows
        if r["cluster"] == k:
            scanned = int(r["value"])
        elif r["dim"] == size:
            n[r["cluster"]], radii[r["cluster"]] = int(r["value"]), r["radius"]
        else:
            sums[r["cluster"]][r["dim"]] = int(r["value"])
    return n, sums, radii, scanned


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            size: int = SIZE, scale: float = SCALE, salt: str = SALT, tighten: bool = True) -> Clustering | None:
    """Lloyd's rounds from the first centroids, then one more assignment; None without usable rows. ``tighten``
    off loosens bounds by full drifts, which gives the same clusters with more scans."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    kind = source.schema["id"].dataType.simpleString()
    blocks = pack(source, size, scale)
    folder = shared_folder(spark, "blocks")
    blocks.write.parquet(folder)                                        # once, so that block numbers stay
    blocks = spark.read.schema(blocks.schema).parquet(folder)
    held = blocks.agg(F.sum(F.length("vectors")).alias("n")).first()["n"] or 0
    tables = _Tables(spark, min(MOST, max(FEWEST, held // BUCKET_BYTES)))
    centroids = first_centroids(blocks, size, k, salt)
    k = len(centroids)
    if not k:
        return None
    vectors = tables.write(blocks.repartition(tables.buckets, "block"), "vectors")
    counts, sums, scanned = [0] * k, [[0] * size for _ in range(k)], []
    move, state = Move(centroids), None
    for i in range(rounds):
        state = tables.write(_assigned(vectors, state, move, size), f"state_{i}")
        dn, ds, radii, looked = _gathered(state, k, size)
        scanned.append(looked)
        counts = [a + int(b) for a, b in zip(counts, dn)]
        sums = [[a + b for a, b in zip(s, t)] for s, t in zip(sums, ds)]
        after = np.array([[v // n for v in s] if n else old for s, n, old in zip(sums, counts, centroids.tolist())],
                         dtype=np.int64).reshape(k, size)
        move = Move.between(centroids, after, radii, tighten)
        centroids = after

    final = vectors.select("block", "ids", "vectors")
    if state is not None:
        final = final.join(state.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, ids, x) in enumerate(_unpack(batch, size)):
                known = None
                if "cluster" in batch.schema.names:
                    known = tuple(np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind) for name, kind in
                                  (("cluster", np.int32), ("upper", np.float64), ("lower", np.float64)))
                number = assign(x, move, known)[0]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number, type=pa.int32()), pa.array(own_distances(x, move.centroids[number]))],
                    ["vec_id", "cluster", "distance"])

    out = f"{tables.folder}/result"
    final.mapInArrow(finish, f"vec_id {kind}, cluster int, distance long").write.parquet(out)
    tables.forget()
    return Clustering(spark.read.parquet(out), centroids.tolist(), scanned)


def with_inertia(found: Clustering) -> DataFrame:
    """The rows with their cluster's and the whole inertia and the centroid's digest. What is broadcast has a row
    for each cluster."""
    spark = found.rows.sparkSession
    by = {r["cluster"]: int(r["n"]) for r in found.rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    whole, most = sum(by.values()), (1 << 63) - 1
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    facts = spark.createDataFrame(
        [(c, n if n <= most else None, whole if whole <= most else None, digests[c]) for c, n in by.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = cluster(vectors)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    return with_inertia(found)


def _oracle(rounds: int = ROUNDS, k: int = CLUSTERS, size: int = SIZE) -> str:
    """The rounds written out, plain Lloyd over (row, dimension) rows."""
    def nearest(i: int) -> str:
        return (f"d{i} AS MATERIALIZED (SELECT e.r, c.cluster, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d "
                f"FROM e JOIN c{i} c USING (dim) GROUP BY e.r, c.cluster), "
                f"a{i} AS MATERIALIZED (SELECT r, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY r "
                f"ORDER BY d, cluster) AS place FROM d{i}) WHERE place = 1)")

    def moved(i: int) -> str:
        return (f"c{i} AS MATERIALIZED (SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{i - 1} c LEFT JOIN "
                f"(SELECT a.cluster, e.dim, CAST((sum(e.x) - ((sum(e.x) % count(*)) + count(*)) % count(*)) // count(*) "
                f"AS BIGINT) AS x FROM a{i - 1} a JOIN e USING (r) GROUP BY a.cluster, e.dim) m USING (cluster, dim))")

    steps = ", ".join([nearest(0), *(f"{moved(i)}, {nearest(i)}" for i in range(1, rounds + 1))])
    last = f"a{rounds}"
    return f"""
WITH u AS MATERIALIZED (SELECT r, vec_id, unnest(embedding) AS x, unnest(range({size})) AS dim FROM
  (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {size})),
v AS MATERIALIZED (SELECT r, vec_id FROM u GROUP BY r, vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
e AS MATERIALIZED (SELECT u.r, dim, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u JOIN v USING (r)),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{SALT}' || CAST(vec_id AS VARCHAR))) - 1 AS cluster
  FROM v WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT s.cluster, e.dim, e.x FROM s JOIN e USING (r) WHERE s.cluster < {k}),
{steps},
g AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster),
i AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM {last} GROUP BY cluster)
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.d AS distance, i.cluster_inertia,
  (SELECT CAST(sum(d) AS BIGINT) FROM {last}) AS inertia, g.centroid_sha256
FROM {last} a JOIN v USING (r) JOIN g USING (cluster) JOIN i USING (cluster)
"""


OP12_SQL = _oracle()
