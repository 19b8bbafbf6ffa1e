"""Embedding whitening by shifted CholeskyQR.

The centred rows X are never factored in one place. A pass over the vectors
solves every row against the triangular factors found so far and adds up the
Gram matrix of the result; its Cholesky factor, of the matrix plus a small
shift as long as rounding could make it indefinite, is the next factor. The
factors compose to R with X = Q R; the singular values and right vectors of R
are those of X, so they give the components, and Q times the left vectors the
whitened rows. A last pass measures how orthogonal Q is on the components.

A pass is a narrow scan. Gram matrices are added up in tasks, then in two
levels of groups, so one task adds at most about FAN_IN partial tiles, and the
driver gets one matrix of dimensions x dimensions, whatever the rows.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped, and so are vectors of another length than the most common one
(ties: the longer). Entries whose scaled floor is beyond 2^53 are set to that
bound. Directions without variance (constant or dependent dimensions, fewer
rows than dimensions) are no components, so fewer than the asked ones may come
out, and none for an empty table, equal rows or vectors without entries.
``deviation`` is null where it exceeds a long. Repeated rows, tied values and
null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contingo.llm.vectors import ENTRY_BOUND, matrix, scaled_floor, whole_rows

#: Entry c becomes floor(SCALE * c) + OFFSET (fixed values of the contract).
SCALE, OFFSET = 64.0, 1_000_000
#: Rows multiplied at once: bounds memory, and with it the rounding of a Gram matrix.
BLOCK_ROWS = 1024
#: Partial tiles added by one task of the first level, and rows of a Gram matrix in one tile.
FAN_IN, TILE_ROWS = 256, 16
#: Passes at most (shifted ones included), and how far a Gram matrix may be from the identity at the end.
MAX_PASSES, ORTHOGONAL = 10, 1e-14
#: Sums of integers travel as high and low halves, so that they stay exact.
HALF = 26


@dataclass(frozen=True)
class Fit:
    """What the passes found: sums are exact integers, factors upper triangular."""

    size: int
    n: int
    sums: tuple[int, ...]
    live: np.ndarray                    # whether a dimension varies; the others take no part
    factors: tuple[np.ndarray, ...]     # X = Q (factors[-1] ... factors[0])
    left: np.ndarray                    # left vectors of the composed factor, a column for each component
    components: np.ndarray              # unit eigenvectors, a column each, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 by substitution, column by column, for all rows at once."""
    out = np.empty(rows.shape, order="F")
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(x - sums / n as doubles, x - floor(sums / n) exact)."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    exact = x - whole
    return exact - rest, exact


def deviations(exact: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    rest = [s % n for s in sums]
    largest = (int(np.abs(exact).max(initial=0)) + 1) * n
    if largest * largest * max(1, exact.shape[1]) < 1 << 63:
        d = exact * n - np.array(rest, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    found = [sum((int(v) * n - r) ** 2 for v, r in zip(row, rest)) for row in exact.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def _blocks(batch: pa.RecordBatch, size: int, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) of a batch's usable vectors, BLOCK_ROWS at a time."""
    column = batch.column(at)
    rows, _ = whole_rows(column, size)
    for i in range(0, len(rows), BLOCK_ROWS):
        part = rows[i:i + BLOCK_ROWS]
        yield part, scaled_floor(matrix(column, part, size), SCALE) + OFFSET


def common_length(vectors: DataFrame) -> int:
    """The most common length of the usable vectors (ties: the longer); 0 if there is none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, n = np.unique(whole_rows(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"size": pa.array(lengths, type=pa.int64()), "n": pa.array(n, type=pa.int64())})

    top = vectors.mapInArrow(count, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def exact_sums(vectors: DataFrame, size: int) -> tuple[int, tuple[int, ...], np.ndarray]:
    """(rows, exact sum of x for each dimension, whether the dimension varies)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        least, most = np.full(size, ENTRY_BOUND * 2), np.full(size, -ENTRY_BOUND * 2)
        for batch in batches:
            for _, x in _blocks(batch, size):
                n += len(x)
                high += (x >> HALF).sum(axis=0)
                low += (x & ((1 << HALF) - 1)).sum(axis=0)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(size), "n": np.full(size, n), "high": high, "low": low,
                                              "least": least, "most": most})

    found = {r.dim: r for r in vectors.mapInArrow(add, "dim long, n long, high long, low long, least long, most long")
             .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"),
                                 F.min("least").alias("least"), F.max("most").alias("most")).collect()}   # a row a dimension
    if not found:
        return 0, (), np.zeros(0, dtype=bool)
    return (found[0].n, tuple((found[j].high << HALF) + found[j].low for j in range(size)),
            np.array([found[j].least < found[j].most for j in range(size)]))


def gram(vectors: DataFrame, size: int, n: int, sums: tuple[int, ...], live: np.ndarray,
         factors: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrix, column sums) of the centred rows' live dimensions after the triangular solves."""
    d = int(live.sum())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((d + 1, d), dtype=np.longdouble)
        for batch in batches:
            for _, x in _blocks(batch, size):
                q = centred(x, n, sums)[0][:, live]
                for r in factors:
                    q = solve_upper(q, r)
                total[:d] += q.T @ q
                total[d] += q.sum(axis=0)
        part = TaskContext.get().partitionId()
        for i in range(0, d + 1, TILE_ROWS):
            yield pa.RecordBatch.from_pydict(
                {"tile": pa.array([i], type=pa.int32()), "run": pa.array([part // FAN_IN], type=pa.int64()),
                 "part": pa.array([part], type=pa.int64()),
                 "sums": pa.array([total[i:i + TILE_ROWS].astype(np.float64).tobytes()], type=pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")       # the same order in every run
        parts = table.column("sums").to_pylist()
        total = np.zeros(len(parts[0]) // 8, dtype=np.longdouble)
        for i in order:
            total += np.frombuffer(parts[i])
        first = table.slice(0, 1)
        return pa.table({"tile": first.column("tile"), "run": pa.array([0], type=pa.int64()),
                         "part": first.column("run"), "sums": pa.array([total.astype(np.float64).tobytes()], type=pa.binary())})

    shape = "tile int, run long, part long, sums binary"
    tiles = vectors.mapInArrow(multiply, shape).groupBy("tile", "run").applyInArrow(add, shape) \
        .groupBy("tile").applyInArrow(add, shape).collect()                       # dimensions^2 numbers in all
    whole = np.concatenate([np.frombuffer(t["sums"]).reshape(-1, d) for t in sorted(tiles, key=lambda t: t["tile"])])
    return whole[:d], whole[d]


def next_factor(g: np.ndarray) -> np.ndarray:
    """Upper triangular R with R'R = G, plus a shift where rounding could make G indefinite. The shift is that of
    shifted CholeskyQR with the block's rows in place of all rows, since blocks are added in longer numbers."""
    d = len(g)
    g = (g + g.T) / 2
    largest = float(np.linalg.eigvalsh(g)[-1])
    shift = 11 * (BLOCK_ROWS * d + d * (d + 1)) * 2.0 ** -53 * largest
    if float(np.linalg.eigvalsh(g)[0]) > 100 * shift:
        shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T.copy()
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 2.0 ** -53 * largest)


def fit(vectors: DataFrame, components: int | None = 32) -> Fit | None:
    """Whitening components of the one column's vectors; None if there are none."""
    size = common_length(vectors)
    n, sums, live = exact_sums(vectors, size) if size else (0, (), np.zeros(0, dtype=bool))
    if not live.any():
        return None
    factors: tuple[np.ndarray, ...] = ()
    composed = np.eye(int(live.sum()))
    for done in range(MAX_PASSES + 1):
        g, column_sums = gram(vectors, size, n, sums, live, factors)
        if factors:
            left, singular, right = np.linalg.svd(composed)
            rank = int((singular > 8 * len(g) * 2.0 ** -53 * singular[0]).sum())
            error = left[:, :rank].T @ g @ left[:, :rank] - np.eye(rank)
            if np.abs(error).max() <= ORTHOGONAL * len(g) or done == MAX_PASSES:
                break
        r = next_factor(g)
        factors, composed = (*factors, r), r @ composed
    take = rank if components is None else min(rank, components)
    means = np.sqrt(n) * (column_sums @ left[:, :take]) / n                       # of the whitened columns
    vec = np.zeros((size, take))
    vec[live] = right[:take].T
    sign = np.where(vec[np.abs(vec).argmax(axis=0), np.arange(take)] < 0, -1.0, 1.0)
    whitened_error = error[:take, :take] - np.outer(means, means)
    return Fit(size, n, sums, live, factors, left[:, :take] * sign, vec * sign, singular[:take] ** 2 / n,
               float((singular ** 2).sum() / n), float(np.abs(whitened_error).max()))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = df.select(F.col(vector).alias("v"), F.col(id_col).alias("id"))
    found = fit(rows.select("v"), components)
    kind = rows.schema["id"].dataType.simpleString()
    shape = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
    if found is None:
        return df.sparkSession.createDataFrame([], shape)
    k = found.components.shape[1]
    share = found.eigenvalues / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch, found.size):
                q, exact = centred(x, found.n, found.sums)
                q = q[:, found.live]
                for r in found.factors:
                    q = solve_upper(q, r)
                values = np.sqrt(found.n) * (q @ found.left)
                again = pa.array(np.repeat(np.arange(len(at)), k))
                m = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(m, found.n)), pa.array(deviations(exact, found.n, found.sums), type=pa.int64()).take(again),
                     pa.array(values.ravel()), pa.array(np.tile(share, len(at))), pa.array(np.full(m, found.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, shape)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
