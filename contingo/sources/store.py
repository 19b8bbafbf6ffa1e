"""Tables laid out for their later readers.

``FeatureStore``: feature and evidence tables written once, bucketed and sorted by key, so that every later
join on that key reads them without an exchange.

Tiled matrices: a labelled matrix as square tiles of cells, written and read without a pivot or a schema as wide
as the matrix. Labels are numbered without gaps; a cell's tile is (row number / side, column number / side), and a
tile is one row: cell offsets in order and their values. So a tile is bounded by side * side cells, cells that
are absent take no room, and a filter on numbers reaches the scan as a filter on tiles.

Defined results of tiles: a null value is a cell; a cell with a null label is left out, as it has no place; of cells
with the same labels the one with the largest value stays (null is smallest); an empty matrix has no tiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contingo.operators.baseline import dense_index

SIDE = 256


class FeatureStore:
    """Bucketed tables of one number of buckets under a shared folder, so that any two of them with the same keys
    join bucket by bucket. ``buckets`` should be at least the session's shuffle partitions: the planner keeps the
    buckets then, and shuffles only sides that aren't from the store."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str, buckets: int | None = None):
        self.spark, self.folder, self.prefix = spark, folder.rstrip("/"), prefix
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def put(self, df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
        """Writes the table (again, if it is there) and returns it as read from the store. Rows are dealt to buckets
        before the write, so a bucket is one file, sorted by key: one exchange, once."""
        df.repartition(self.buckets, *keys).write.format("parquet").mode("overwrite") \
            .bucketBy(self.buckets, *keys).sortBy(*keys) \
            .option("path", f"{self.folder}/{table}").saveAsTable(self.name(table))
        return self.get(table)

    def get(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def forget(self, table: str) -> None:
        """Takes the table's name out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")


def write_tiles(cells: DataFrame, path: str, row: str = "row", col: str = "col", value: str = "value",
                side: int = SIDE) -> None:
    """Writes the long matrix (row, col, value) as ``path``/tiles and the numbered labels as ``path``/rows and
    ``path``/cols. Two exchanges of cells to number them (none if AQE can broadcast the labels), one by tile."""
    for axis, name in (("rows", row), ("cols", col)):
        dense_index(cells, name, "i").select(F.col(name).alias("label"), "i").write.mode("overwrite").parquet(f"{path}/{axis}")
    rows, cols = (cells.sparkSession.read.parquet(f"{path}/{axis}") for axis in ("rows", "cols"))
    placed = cells.join(rows.select(F.col("label").alias(row), F.col("i").alias("_i")), row) \
        .join(cols.select(F.col("label").alias(col), F.col("i").alias("_j")), col)
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    at = ((F.col("_i") % side) * side + F.col("_j") % side).cast("int")
    one = placed.groupBy(tile("_i").alias("row_tile"), tile("_j").alias("col_tile"), at.alias("at")) \
        .agg(F.max(F.col(value).cast("double")).alias("v"))
    cell = F.array_sort(F.collect_list(F.struct("at", "v")))
    one.groupBy("row_tile", "col_tile").agg(cell.alias("c")) \
        .select("row_tile", "col_tile", F.lit(side).alias("side"), F.col("c.at").alias("at"), F.col("c.v").alias("v")) \
        .repartitionByRange("row_tile", "col_tile").sortWithinPartitions("row_tile", "col_tile") \
        .write.mode("overwrite").parquet(f"{path}/tiles")


def read_tiles(spark: SparkSession, path: str, row: str = "row", col: str = "col", value: str = "value",
               rows: Sequence[str] | None = None) -> DataFrame:
    """The long matrix, or its rows with the given labels: then only tiles that hold one of them are read (their
    numbers are a filter of the scan)."""
    tiles = spark.read.parquet(f"{path}/tiles")
    names = spark.read.parquet(f"{path}/rows")
    if rows is not None:
        names = names.where(F.col("label").isin(list(rows)))
        side = tiles.select("side").first()
        # one number for each label that was asked for
        wanted = sorted({math.floor(r.i / side.side) for r in names.collect()}) if side else []
        tiles = tiles.where(F.col("row_tile").isin(wanted))
    cells = tiles.select("row_tile", "col_tile", "side", F.inline(F.arrays_zip("at", "v")))
    numbered = cells.select((F.col("row_tile") * F.col("side").cast("long") + F.floor(F.col("at") / F.col("side"))).alias("_i"),
                            (F.col("col_tile") * F.col("side").cast("long") + F.col("at") % F.col("side")).alias("_j"),
                            F.col("v").alias(value))
    cols = spark.read.parquet(f"{path}/cols")
    return numbered.join(names.select(F.col("label").alias(row), F.col("i").alias("_i")), "_i") \
        .join(cols.select(F.col("label").alias(col), F.col("i").alias("_j")), "_j").select(row, col, value)


def tile_sums(spark: SparkSession, path: str, by: str = "rows") -> DataFrame:
    """(label, total, n): sums over the rows or columns of the tiled matrix, added inside each tile before anything is
    exchanged (nulls don't count)."""
    part: Column = F.floor(F.col("at") / F.col("side")) if by == "rows" else F.col("at") % F.col("side")
    tile = "row_tile" if by == "rows" else "col_tile"
    sums = spark.read.parquet(f"{path}/tiles").select(tile, "side", F.inline(F.arrays_zip("at", "v"))) \
        .groupBy((F.col(tile) * F.col("side").cast("long") + part).alias("i")) \
        .agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    return spark.read.parquet(f"{path}/{by}").join(sums, "i").select("label", "total", "n")
