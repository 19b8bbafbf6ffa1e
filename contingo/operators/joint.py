"""Independent sigmoids for several labels, fitted together.

One pass over the training rows gives the gradient of all labels: the weights
are a labels x buckets matrix, bounded by its two parameters, that every task
gets; a task adds its rows' gradients and hands on one row for each bucket it
touched. Gradients are added as integers (units of 2^-30), so the sum, and
with it the model, doesn't depend on how rows are dealt to tasks.

A text is its distinct hashed tokens, scaled to unit length, and a bias. The
loss is the mean binary cross-entropy of each label over the rows that have
it, with ``l2`` on the weights (not on the bias). A row's vector has length
sqrt(2), so the loss bends by at most 1/2 + l2 and steps of its inverse
never overshoot.

A model is a small table (label, bucket, weight), the bias under bucket -1: it is
written and read like any other table, and scores batches without a fit.

Defined results: a null text takes no part and gets no row; a text without
tokens has the bias alone; a row without a label value doesn't count for that
label; a label without rows keeps weights of 0; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contingo.functions.columns import md5_unit_hash
from contingo.session import ensure_checkpoint_dir

BUCKETS = 4096
STEPS = 20
L2 = 0.001
BIAS = -1
#: Gradients are added in these units.
UNIT = 2.0 ** 30


def with_buckets(df: DataFrame, text_col: str, buckets: int = BUCKETS, out: str = "_buckets") -> DataFrame:
    """The distinct hashed tokens (lower-cased ASCII letters and digits) of each text that isn't null, in order."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    hashed = F.transform(words, lambda w: (md5_unit_hash(w) % buckets).cast("int"))
    return df.where(F.col(text_col).isNotNull()).withColumn(out, F.array_sort(F.array_distinct(hashed)))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every cell of a batch of bucket lists."""
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, column.flatten().to_numpy(zero_copy_only=False), 1.0 / np.sqrt(sizes[row])


def _scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """labels x rows: the bias (last column of the weights) and the weights of the rows' tokens."""
    row, bucket, value = _rows(column)
    return np.stack([np.bincount(row, w[bucket] * value, minlength=len(column)) + w[-1] for w in weights])


def gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Summed gradient of the cross-entropy at the weights, labels x (buckets and bias), from rows (_buckets, _y:
    0, 1 or null for each label). One narrow pass and a partially aggregated sum by bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros(w.shape, dtype=np.int64)
        for batch in batches:
            lists, y = batch.column("_buckets"), batch.column("_y")
            truth = y.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), len(w)).T
            off = 1.0 / (1.0 + np.exp(-_scores(lists, w))) - truth
            off[np.isnan(off)] = 0.0
            row, bucket, value = _rows(lists)
            for i, o in enumerate(off):
                np.add.at(total[i], bucket, np.rint(o[row] * value * UNIT).astype(np.int64))
                total[i, -1] += np.rint(o * UNIT).astype(np.int64).sum()
        label, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, type=pa.int32()), "bucket": pa.array(bucket, type=pa.int32()),
                                          "g": pa.array(total[label, bucket], type=pa.int64())})

    out = np.zeros(weights.shape)
    parts = rows.select("_buckets", "_y").mapInArrow(run, "label int, bucket int, g long")
    for r in parts.groupBy("label", "bucket").agg(F.sum("g").alias("g")).toLocalIterator():
        out[r.label, r.bucket] = r.g / UNIT                  # at most labels x (buckets + 1) rows
    return out


def fit_joint(train: DataFrame, text_col: str, labels: Sequence[str], buckets: int = BUCKETS, steps: int = STEPS,
              l2: float = L2) -> DataFrame:
    """The model after so many full gradient steps for all labels at once, as (label, bucket, weight)."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    rows = with_buckets(train, text_col, buckets) \
        .select("_buckets", F.array(*[F.col(c).cast("double") for c in labels]).alias("_y")).checkpoint()
    n = rows.agg(*[F.count(F.col("_y")[i]).alias(f"n{i}") for i in range(len(labels))]).first()
    sizes = np.maximum(np.array(n, dtype=np.float64), 1.0)[:, None]
    weights, rate = np.zeros((len(labels), buckets + 1)), 1.0 / (0.5 + l2)
    decay = np.full(buckets + 1, l2)
    decay[-1] = 0.0
    for _ in range(steps):
        weights = weights - rate * (gradient(rows, weights) / sizes + decay * weights)
    label, bucket = np.nonzero(weights)
    cells = [(labels[i], BIAS if b == buckets else int(b), float(weights[i, b])) for i, b in zip(label, bucket)]
    cells += [(lab, BIAS, 0.0) for lab in labels if (lab, BIAS) not in {c[:2] for c in cells}]
    return spark.createDataFrame(cells, MODEL)


MODEL = T.StructType([T.StructField("label", T.StringType(), False), T.StructField("bucket", T.IntegerType(), False),
                      T.StructField("weight", T.DoubleType(), False)])


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def classify_joint(model: DataFrame, df: DataFrame, key_cols: Sequence[str], text_col: str, buckets: int = BUCKETS,
                   threshold: float = 0.5) -> DataFrame:
    """One row for each text and label whose probability exceeds the threshold: keys, label, score (the
    probability). A narrow pass; the model, bounded by labels x buckets, goes to every task."""
    cells = model.toLocalIterator()
    found = [(r.label, r.bucket, r.weight) for r in cells]
    labels = sorted({c[0] for c in found})
    weights = np.zeros((len(labels), buckets + 1))
    for label, bucket, weight in found:
        weights[labels.index(label), bucket] = weight        # the bias (-1) is the last column
    shared = df.sparkSession.sparkContext.broadcast(weights)
    rows = with_buckets(df.select(*key_cols, text_col), text_col, buckets).select(*key_cols, "_buckets")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1.0 / (1.0 + np.exp(-_scores(batch.column(batch.num_columns - 1), shared.value)))
            offsets = np.arange(0, p.size + 1, len(labels), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.T.reshape(-1)))], schema.names)

    if not labels:
        return rows.select(*key_cols, F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("score")).limit(0)
    each = F.transform(F.col("_p"), lambda p, i: F.struct(F.element_at(F.array(*map(F.lit, labels)), i + 1).alias("label"),
                                                          p.alias("score")))
    return rows.mapInArrow(run, schema).select(*key_cols, F.inline(F.filter(each, lambda e: e["score"] > threshold)))
