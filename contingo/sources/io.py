"""Scans and sinks.

Every reader takes an explicit schema where the format has none of its own,
so no job is spent on inference and the plan is stable.  Parquet keeps its
footer schema; Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """A1: one parquet table of the test data set."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: JSON lines (gzip is decoded by the Hadoop codec from the suffix)."""
    return spark.read.schema(schema).json(path)


def read_csv_header(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    trim: bool = False) -> DataFrame:
    """A3 / A4: CSV with a header row.  Without a schema every column is a
    string (what a header-only read gives); with ``trim`` leading and trailing
    blanks of every field are dropped (a lookup file may carry them)."""
    reader = spark.read.option("header", True)
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = reader.schema(schema)
    if trim:
        reader = (reader.option("ignoreLeadingWhiteSpace", True)
                  .option("ignoreTrailingWhiteSpace", True))
    return reader.csv(path)


def read_csv_named(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A5: headerless CSV whose columns are named by the given schema."""
    return spark.read.option("header", False).schema(schema).csv(path)


def read_labelled_matrix(spark: SparkSession, path: str, row_col: str = "row",
                         col_col: str = "col", value_col: str = "value") -> DataFrame:
    """A wide square matrix with a header of column labels and the row
    label in the first column, returned in long form (row, col, value).
    The header is read once (a one-line scan); the cells are typed by a
    declared schema and unpivoted on the executors."""
    header = spark.read.option("header", True).csv(path).columns
    labels = header[1:]
    schema = T.StructType([T.StructField(row_col, T.StringType())] +
                          [T.StructField(f"_c{i}", T.DoubleType()) for i in range(len(labels))])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    wide = wide.withColumnsRenamed({f"_c{i}": lab for i, lab in enumerate(labels)})
    return wide.unpivot(row_col, labels, col_col, value_col)


BAD_ROW = "_bad_row"


def read_checked(spark: SparkSession, path: str, fmt: str, schema: T.StructType, required: tuple[str, ...] = (),
                 **options) -> tuple[DataFrame, DataFrame]:
    """A2-A4 with nothing lost silently: (good rows, bad rows) of a json or csv source under a declared schema.

    A line that doesn't parse, has a field that doesn't fit its type (or, for csv, too few or too many fields) or lacks a
    ``required`` one is bad: it comes whole, as text, with its file and why ("malformed", or the first lacking
    column). Each source line is in exactly one of the two frames."""
    kept = T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType())])
    reader = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW)
    rows = reader.options(**options).format(fmt).load(path).select("*", F.input_file_name().alias("_file"))
    why = F.coalesce(F.when(F.col(BAD_ROW).isNotNull(), F.lit("malformed")),
                     *[F.when(F.col(c).isNull(), F.lit(c)) for c in required], F.lit(None).cast("string"))
    names = schema.fieldNames()
    # both filters use every field, always true: the parser only finds what is bad in fields that it is asked for
    whole = F.to_json(F.struct(*names))
    good = rows.where(why.isNull() & whole.isNotNull()).select(*names)
    bad = rows.where(why.isNotNull() & whole.isNotNull()) \
        .select(F.coalesce(BAD_ROW, whole).alias("line"), why.alias("why"), F.col("_file").alias("file"))
    return good, bad


def quarantine(bad: DataFrame, path: str) -> DataFrame:
    """Writes bad rows (a directory for each reason) and returns their number by reason."""
    bad.write.mode("overwrite").partitionBy("why").parquet(path)
    back = bad.sparkSession.read.schema("line string, file string, why string").parquet(path)
    return back.groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Overwrite sink; one directory per stratum / seed comes from
    ``partitionBy`` in a single write instead of a loop of writes."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType,
                  rank_col: str | None = None) -> DataFrame:
    """An inline lookup table.  When ``rank_col`` is given the list order
    becomes an explicit integer rank (stable under recomputation, unlike a
    generated row id)."""
    if rank_col is not None:
        rows = [tuple(r) + (i,) for i, r in enumerate(rows)]
        schema = T.StructType(list(schema.fields) + [T.StructField(rank_col, T.IntegerType(), False)])
    if not rows:
        return spark.createDataFrame([], schema)
    # Built from literals inside the JVM (a one-row range + inline): no Python
    # worker is started to deserialize driver-side rows.
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
