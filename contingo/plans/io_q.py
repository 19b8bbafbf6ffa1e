"""Source / sink round trips: derived tables are written to a
fresh folder under the shared checkpoint directory and read back with a
declared schema.  The oracle reads the source table directly."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from contingo.functions.columns import recode, sentence_case
from contingo.operators.cohort import assemble_cohort
from contingo.plans.common import query, scratch, tbl
from contingo.plans.textq import _SQL_SIM, similarity_long
from contingo.sources.io import (quarantine, read_checked, read_csv_header, read_csv_named, read_json_lines, read_labelled_matrix,
                                 read_parquet, write_parquet)
from contingo.sources.store import FeatureStore, read_tiles, tile_sums, write_tiles

CATEGORY_RECODE = {"SMALL": "Small things", "RED": "Red things"}


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType())])


@query("json_scan", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_json_scan(spark, d):
    """A2: gzip JSON lines written and read back with a declared schema."""
    path = scratch(spark, "json")
    (tbl(spark, d, "events").select(*EVENT_SCHEMA.fieldNames()).write.mode("overwrite")
     .option("compression", "gzip").json(path))
    return read_json_lines(spark, path, EVENT_SCHEMA)


@query("json_quarantine", """
SELECT event_type, CASE WHEN event_type = 'error' THEN 'malformed' WHEN value IS NULL THEN 'value' ELSE 'good' END AS state,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM events GROUP BY ALL""")
def q_json_quarantine(spark, d):
    """A2: JSON lines of which one kind of event is written with a text for its number (so the line doesn't fit the
    schema) and events without a value lack a required field; bad lines are kept apart, counted and still readable."""
    path = scratch(spark, "json-checked")
    e = tbl(spark, d, "events").select(*EVENT_SCHEMA.fieldNames())
    line = F.when(F.col("event_type") == "error", F.to_json(F.struct(
        "event_id", "user_id", "event_type", F.lit("not a number").alias("value"), "props"))) \
        .otherwise(F.to_json(F.struct(*EVENT_SCHEMA.fieldNames())))
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    good, bad = read_checked(spark, path, "json", EVENT_SCHEMA, required=("value",))
    quarantine(bad, scratch(spark, "bad-lines"))
    lines = bad.select(F.get_json_object("line", "$.event_type").alias("event_type"), F.col("why").alias("state"),
                       F.get_json_object("line", "$.event_id").cast("long").alias("event_id"))
    rows = good.select("event_type", F.lit("good").alias("state"), "event_id").unionByName(lines)
    return rows.groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


NATION_SCHEMA = T.StructType([T.StructField("n_nationkey", T.IntegerType()),
                              T.StructField("n_name", T.StringType()),
                              T.StructField("n_regionkey", T.IntegerType())])


@query("csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_csv_scan(spark, d):
    """A3 + A4: CSV with a header whose fields carry stray blanks; the typed
    read trims them."""
    path = scratch(spark, "csv")
    n = tbl(spark, d, "nation").select(
        F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("n_nationkey"),
        F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")).alias("n_name"),
        F.col("n_regionkey").cast("string").alias("n_regionkey"))
    n.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv_header(spark, path, NATION_SCHEMA, trim=True)


@query("sink_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_sink_roundtrip(spark, d):
    """A8 + A9: one overwrite write partitioned by a column (a directory per
    value), read back with partition discovery."""
    path = scratch(spark, "parquet")
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    write_parquet(o, path, partition_by=["o_orderstatus"])
    return read_parquet(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                            "o_orderpriority")


@query("matrix_scan", f"""WITH {_SQL_SIM}
SELECT CAST(row_label AS VARCHAR) AS row_label, CAST(col_label AS VARCHAR) AS col_label,
       round(similarity, 6) AS value FROM sim""")
def q_matrix_scan(spark, d):
    """A square labelled matrix (header of column labels, row label in
    the first column) written as CSV and read back in long form."""
    path = scratch(spark, "matrix")
    long = similarity_long(spark, d).select(F.col("row_label").cast("string").alias("row_label"),
                                            F.col("col_label").cast("string").alias("col_label"),
                                            F.round("similarity", 6).alias("similarity"))
    wide = long.groupBy("row_label").pivot("col_label").agg(F.first("similarity"))
    wide.write.mode("overwrite").option("header", True).csv(path)
    return read_labelled_matrix(spark, path, "row_label", "col_label", "value")


FREQ_SCHEMA = T.StructType([T.StructField("class", T.StringType()), T.StructField("freq", T.LongType()),
                            T.StructField("category", T.StringType())])


@query("class_frequency", """
WITH f AS (SELECT replace(p_name, ' ', '_') AS class, count(*) AS freq,
                  upper(split_part(p_name, ' ', 1)) AS category
           FROM part GROUP BY ALL)
SELECT class, freq, category,
  upper(left(trim(replace(class, '_', ' ')), 1)) || lower(substr(trim(replace(class, '_', ' ')), 2)) AS nicename,
  CASE category WHEN 'SMALL' THEN 'Small things' WHEN 'RED' THEN 'Red things' ELSE category END AS categoryLabel
FROM f""")
def q_class_frequency(spark, d):
    """I16 + A5: class frequencies written as headerless CSV, read back with
    named columns, then cleaned names and a recoded category."""
    path = scratch(spark, "freq")
    f = tbl(spark, d, "part").groupBy(
        F.regexp_replace("p_name", " ", "_").alias("class"),
        F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("category")).agg(
        F.count(F.lit(1)).alias("freq")).select("class", "freq", "category")
    f.write.mode("overwrite").option("header", False).csv(path)
    back = read_csv_named(spark, path, FREQ_SCHEMA)
    return back.select("class", "freq", "category",
                       sentence_case(F.trim(F.regexp_replace("class", "_", " "))).alias("nicename"),
                       recode("category", CATEGORY_RECODE).alias("categoryLabel"))


@query("matrix_tiles", """
WITH m AS (SELECT l_suppkey::VARCHAR AS supplier, p_brand AS brand, count(*)::DOUBLE AS value
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT supplier, brand, value, sum(value) OVER (PARTITION BY brand) AS brand_total FROM m""")
def q_matrix_tiles(spark, d):
    """A labelled matrix (order lines by supplier and brand) written as tiles, read back in long form with its
    column sums, which are added inside the tiles."""
    path = scratch(spark, "tiles")
    brand = tbl(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    cells = tbl(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("supplier")) \
        .join(brand, "l_partkey").groupBy("supplier", "brand").agg(F.count(F.lit(1)).cast("double").alias("value"))
    write_tiles(cells, path, "supplier", "brand", "value")
    sums = tile_sums(spark, path, "cols").select(F.col("label").alias("brand"), F.col("total").alias("brand_total"))
    return read_tiles(spark, path, "supplier", "brand", "value").join(sums, "brand")


def feature_store(spark, d) -> FeatureStore:
    """Order lines and part features, both bucketed by part."""
    tag = uuid.uuid4().hex
    store = FeatureStore(spark, scratch(spark, "store"), f"contingo_{tag}")
    lines = tbl(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    store.put(lines, "evidence", ["l_partkey"])
    part = tbl(spark, d, "part")
    store.put(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "brand", ["l_partkey"])
    store.put(part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") < 25, "small").otherwise("large")
                          .alias("size")), "size", ["l_partkey"])
    return store


def stored_cohorts(store: FeatureStore):
    """Two cohorts from one store: returned and shipped order lines with the features of their parts."""
    features = [(store.get("brand"), ["l_partkey"]), (store.get("size"), ["l_partkey"])]
    ids = ["l_partkey", "l_orderkey", "l_suppkey"]
    return {flag: assemble_cohort(store.get("evidence"), ids, features, where=F.col("l_returnflag") == flag)
            for flag in ("R", "N")}


@query("feature_store_cohorts", """
WITH c AS (SELECT DISTINCT l_returnflag AS cohort, l_partkey, l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('R', 'N'))
SELECT cohort, p_brand, CASE WHEN p_size < 25 THEN 'small' WHEN p_partkey IS NOT NULL THEN 'large' END AS size, count(*) AS n
FROM c LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def q_feature_store_cohorts(spark, d):
    """A8 + C1-C3: evidence and features written bucketed by key once; two cohorts read them, deduplicate and join
    without an exchange, and only their counts are shuffled."""
    cohorts = stored_cohorts(feature_store(spark, d))
    both = cohorts["R"].withColumn("cohort", F.lit("R")).unionByName(cohorts["N"].withColumn("cohort", F.lit("N")))
    return both.groupBy("cohort", "p_brand", "size").agg(F.count(F.lit(1)).alias("n"))
