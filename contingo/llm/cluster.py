"""Shared folders, checkpoints and fixed-size membership filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contingo.llm.words import mix


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_top(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; only a local session without
    one gets a folder of its own."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="contingo-")
    return top.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts go to Python in batches of at most so many rows, which bounds a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Hands memory that this process has freed back to the system (glibc keeps it for later otherwise)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The step of ``mapInArrow``, before and after which a worker gives back what it has freed: workers live on from task
    to task and from operator to operator, and what each has kept counts together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder: what follows survives lost executors and reads them from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_top(spark))
    return df.checkpoint()


#: Bits of a membership filter: BITS_PER_KEY for each key, but at most FILTER_BITS (8 MB), whatever goes in.
FILTER_BITS, LEAST_BITS, BITS_PER_KEY = 1 << 26, 1 << 18, 16
FILTER_PARTS = 64
PROBES = 2


def filter_places(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) * np.uint64(2 * probe + 1) + np.uint64(probe)) & np.uint64(bits - 1)


def long_keys(column: pa.Array) -> np.ndarray:
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def member_filter(keys: DataFrame, expected: int, keys_of: Callable[[pa.Array], np.ndarray] = long_keys) -> bytes:
    """A bitmap of bounded size in which every key of the one long column is found; keys_of makes the keys in the same
    Python worker that places them. Others are found too, the more
    the fuller it is (``expected`` keys fill it well); whoever uses it must give right results for any such
    answer. Its parts are put together on executors."""
    bits = LEAST_BITS
    while bits < min(FILTER_BITS, BITS_PER_KEY * expected):
        bits *= 2
    part_bytes = bits // 8 // FILTER_PARTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            got = keys_of(batch.column(0))
            for probe in range(PROBES):
                at = filter_places(got, probe, bits)
                np.bitwise_or.at(found, (at >> np.uint64(3)).astype(np.int64),
                                 np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        for i in range(FILTER_PARTS):
            part = found[i * part_bytes:(i + 1) * part_bytes]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], type=pa.int32()),
                                                  "bits": pa.array([part.tobytes()], type=pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, dtype=np.uint8) for b in table.column("bits").to_pylist()]
        return pa.table({"part": table.column("part").slice(0, 1),
                         "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], type=pa.binary())})

    few = max(1, min(16, keys.sparkSession.sparkContext.defaultParallelism))
    out = bytearray(bits // 8)
    for r in keys.coalesce(few).mapInArrow(lean(place), "part int, bits binary").groupBy("part") \
            .applyInArrow(join, "part int, bits binary").toLocalIterator():
        out[r.part * part_bytes:(r.part + 1) * part_bytes] = r.bits
    return bytes(out)


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for probe in range(PROBES):
        at = filter_places(keys, probe, 8 * len(bitmap))
        found &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches. Each round a label becomes the
    least of its own, its neighbours' and its label's label, so long chains shorten by more than half."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = cut(labels.join(near, "node", "left").join(up, "label", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near", "up").alias("label")))
        if not step.where("old <> label").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")
