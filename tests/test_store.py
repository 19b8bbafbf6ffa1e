"""Bucketed feature stores (A8, C1-C3) and tiled matrices."""
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from contingo.plans.io_q import feature_store, stored_cohorts
from contingo.sources.store import FeatureStore, read_tiles, tile_sums, write_tiles

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cohorts_read_the_store_without_an_exchange(spark):
    # sizes differ at scale: without broadcasts the joins must go bucket by bucket
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cohort in stored_cohorts(feature_store(spark, SF)).values():
            plan = plan_of(cohort)
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_keeps_rows_and_is_written_again(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path), f"t{uuid.uuid4().hex}", 4)
    rows = [(i % 7 if i % 5 else None, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, v string")
    assert sorted(map(str, store.put(df, "f", ["k"]).collect())) == sorted(map(str, df.collect()))
    other = store.put(df.where("k = 1"), "f", ["k"])
    assert other.count() == df.where("k = 1").count() and store.get("f").count() == other.count()
    assert store.put(df.limit(0), "none", ["k"]).count() == 0
    store.forget("f")
    assert not spark.catalog.tableExists(store.name("f"))


@pytest.mark.parametrize("side", [1, 3, 256])
def test_tiles_hold_the_matrix(spark, tmp_path, side):
    r = random.Random(side)
    cells = {(f"r{r.randrange(9)}", f"c{r.randrange(14)}"): r.choice([None, float(r.randrange(9)), -0.5]) for _ in range(60)}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()], "row string, col string, value double")
    path = str(tmp_path / "m")
    write_tiles(df, path, side=side)
    assert {(x.row, x.col): x.value for x in read_tiles(spark, path).collect()} == cells
    assert {(x.row, x.col): x.value for x in read_tiles(spark, path, rows=["r1", "r4", "no"]).collect()} == \
        {k: v for k, v in cells.items() if k[0] in ("r1", "r4")}
    for by, at in (("rows", 0), ("cols", 1)):
        want = {}
        for k, v in cells.items():
            total, n = want.get(k[at], (None, 0))
            want[k[at]] = ((total or 0) + v, n + 1) if v is not None else (total, n)
        assert {x.label: (x.total, x.n) for x in tile_sums(spark, path, by).collect()} == want
    stored = spark.read.parquet(f"{path}/tiles")
    assert stored.groupBy("row_tile", "col_tile").count().where("count > 1").count() == 0
    assert stored.where(F.size("at") > side * side).count() == 0


def test_repeated_cells_null_labels_and_no_cells(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "x", None), (None, "x", 9.0), ("a", None, 9.0)],
                               "row string, col string, value double")
    write_tiles(df, str(tmp_path / "m"))
    assert list(map(tuple, read_tiles(spark, str(tmp_path / "m")).collect())) == [("a", "x", 3.0)]
    write_tiles(df.limit(0), str(tmp_path / "e"))
    assert read_tiles(spark, str(tmp_path / "e")).count() == 0 and read_tiles(spark, str(tmp_path / "e"), rows=["a"]).count() == 0
    assert tile_sums(spark, str(tmp_path / "e")).count() == 0


def test_a_row_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("r"), (F.col("id") % 100).cast("string")).alias("row"),
                                  F.concat(F.lit("c"), F.col("id").cast("string")).alias("col"), F.lit(1.0).alias("value"))
    write_tiles(df, str(tmp_path / "m"), side=10)
    some = read_tiles(spark, str(tmp_path / "m"), rows=["r5"])
    assert some.count() == 20
    assert re.search(r"PushedFilters: \[[^\]]*row_tile", plan_of(some))
