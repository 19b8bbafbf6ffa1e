"""Labels, splits, metrics, classifier."""
import pytest
from pyspark.sql import functions as F

from contingo.functions.columns import md5_unit_hash, sigmoid, softmax
from contingo.operators.text import (hash_split, label_explode, label_list, multi_hot, multilabel_metrics,
                                     split_subset, top_k_classes)


def test_labels_explode_index_multihot(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0)], "id long, quality int, toxic int")
    ll = label_list(df, ["quality", "toxic"])
    ex = {(r["id"], r["label_description"], r["label"])
          for r in label_explode(ll, ["id"], "label_descriptions", {"quality": 0, "toxic": 1}).collect()}
    assert ex == {(1, "quality", 0), (2, "quality", 0), (2, "toxic", 1)}
    mh = {r["id"]: r["labels"] for r in multi_hot(ll, "label_descriptions", ["quality", "toxic"]).collect()}
    assert mh == {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [0.0, 0.0]}


def test_split_subset_exact_size(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    s = hash_split(df, ["k"], 0.1, 42)
    sub = split_subset(s, "split", ["k"], 0.05, 42, buckets=64)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    got = {r["split"]: r["count"] for r in sub.groupBy("split").count().collect()}
    assert got == {k: int(v * 0.05) for k, v in counts.items()}
    # the kept rows are exactly the lowest (hash, key) of each split
    rows = s.withColumn("h", md5_unit_hash("k", F.lit(42))).collect()
    keep = set()
    for sp in counts:
        rs = sorted((r["h"], r["k"]) for r in rows if r["split"] == sp)
        keep |= {k for _h, k in rs[:int(counts[sp] * 0.05)]}
    assert {r["k"] for r in sub.collect()} == keep


def test_top_k_and_softmax(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 2.0, 0.5])], "id long, logits array<double>")
    p = df.select("id", softmax("logits").alias("p")).collect()[0]["p"]
    assert sum(p) == pytest.approx(1.0) and p[1] == max(p)
    long = df.select("id", F.posexplode("logits").alias("cls", "v"))
    top = [r["cls"] for r in top_k_classes(long, "id", "cls", "v", 3).orderBy("rank").collect()]
    assert top == [1, 2, 0]
    assert df.select(sigmoid(F.lit(0.0))).collect()[0][0] == 0.5


def test_metrics_thresholds(spark):
    cells = [("a", 2.0, 1), ("a", -2.0, 0), ("a", 0.4, 0), ("b", 0.45, 1), ("b", -0.5, 1)]
    df = spark.createDataFrame(cells, "label string, score double, y int")
    r = multilabel_metrics(df, "score", "y", "label").collect()[0]
    # raw score > 0.3: a: tp1 fp1 fn0 ; b: tp1 fp0 fn1
    assert r["f1_micro"] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))
    assert r["f1_macro"] == pytest.approx((2 / 3 + 2 / 3) / 2)
    # confusion at raw 0.5: tp=1 (2.0), fp=0, fn=2 (0.45, -0.5), tn=2
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 0, 2, 1)
    # accuracy on sigmoid > 0.3: preds 1,0,1,1,1 vs 1,0,0,1,1 -> 4/5
    assert r["accuracy_thresh"] == pytest.approx(0.8)


def test_rule_texts_fire_their_rules(spark):
    from contingo.plans import all_queries
    clean = all_queries()["text_rules"](spark, "/root/testdata/sf0.001").first()["clean"]
    for part in ("what is ", " i am ", " will not ", " can not ", " do not ", " have ", " are ", " would ", " will ", " & "):
        assert part in clean
    assert "'" not in clean and "-" not in clean and "@" not in clean and "  " not in clean


def test_every_branch_occurs(spark):
    from contingo.plans import all_queries
    q = all_queries()
    assert {r[0] for r in q["reason_by_phase"](spark, "/root/testdata/sf0.001").select("prediction").distinct().collect()} >= {"Other"}
    cohort = q["cohort_build"](spark, "/root/testdata/sf0.001")
    assert cohort.where("reason is null").count() > 0 and cohort.where("reason is not null").count() > 0
    grid = q["complete_grid"](spark, "/root/testdata/sf0.001")
    assert grid.where("p_brand is null and n is not null").count() > 0 and grid.where("n is null").count() > 0
