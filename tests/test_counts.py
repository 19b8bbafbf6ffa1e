"""Contingency counts and the single-pass sweep."""
import itertools

import pytest
from pyspark.sql import functions as F

from contingo.operators.baseline import baseline_pairs, null_baseline
from contingo.operators.counts import (contingency_sweep, contingency_sweep_by_id, distinct_count_by, share_within)

ROWS = [
    # id, comparison x, comparison y, prediction p, prediction q, group
    (1, "x1", "y1", "p1", None, "g1"),
    (1, "x1", "y2", "p1", "q1", "g1"),     # repeated id, second category value
    (2, "x2", None, "p1", "q1", "g2"),
    (2, "x2", None, "p1", "q1", "g2"),     # exact duplicate row
    (3, None, "y1", "p2", "q2", None),     # null stratum label
    (4, "x1", "y1", None, "q2", "g1"),
    (5, "x2", "y2", "p2", None, "g2"),
    (6, "x1", None, "p2", "q1", "g1"),
]
SCHEMA = "id long, x string, y string, p string, q string, g string"
COMPS = [("x", "tx"), ("y", "ty")]
PREDS = [("p", "tp"), ("q", "tq")]


def per_pair_reference(rows, comps, preds, keep=lambda r: True):
    """The reference's method: per pair, three distinct-id counts."""
    rows = [r for r in rows if keep(r)]
    idx = {n: i for i, n in enumerate(["id", "x", "y", "p", "q", "g"])}
    total = len({r[0] for r in rows})
    out = set()
    for (c, ct), (p, pt) in itertools.product(comps, preds):
        ci, pi = idx[c], idx[p]
        for cv, pv in {(r[ci], r[pi]) for r in rows if r[ci] is not None and r[pi] is not None}:
            a = len({r[0] for r in rows if r[ci] == cv and r[pi] == pv})
            ctot = len({r[0] for r in rows if r[ci] == cv})
            ptot = len({r[0] for r in rows if r[pi] == pv})
            out.add((pv, cv, ct, pt, a, ptot, ctot, total, ptot - a, ctot - a, total - ptot - ctot + a))
    return out


def test_sweep_equals_per_pair(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {tuple(r) for r in contingency_sweep(df, ["id"], COMPS, PREDS).collect()}
    assert got == per_pair_reference(ROWS, COMPS, PREDS)


def test_sweep_unchanged_by_repartitioning(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a = {tuple(r) for r in contingency_sweep(df.repartition(7, "p"), ["id"], COMPS, PREDS).collect()}
    b = {tuple(r) for r in contingency_sweep(df.coalesce(1), ["id"], COMPS, PREDS).collect()}
    assert a == b


def test_stratified_totals_per_stratum(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    strata = F.filter(F.array(F.lit("all"), F.when(F.col("g") == "g1", F.lit("one")),
                              F.when(F.col("g") != "g1", F.lit("other"))), lambda s: s.isNotNull())
    out = contingency_sweep(df, ["id"], COMPS, PREDS, strata=strata).collect()
    by = {}
    for r in out:
        by.setdefault(r["stratum"], set()).add(tuple(r)[1:])
    assert by["all"] == per_pair_reference(ROWS, COMPS, PREDS)
    assert by["one"] == per_pair_reference(ROWS, COMPS, PREDS, lambda r: r[5] == "g1")
    # a null label is in neither subgroup (only in 'all')
    assert by["other"] == per_pair_reference(ROWS, COMPS, PREDS, lambda r: r[5] is not None and r[5] != "g1")


def test_cells_properties(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for r in contingency_sweep(df, ["id"], COMPS, PREDS).collect():
        assert r["a"] + r["b"] + r["c"] + r["d"] == r["total"]
        assert 1 <= r["a"] <= min(r["predictionTotal"], r["comparisonTotal"])


def test_unseen_pair_gives_no_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["comparison"], r["prediction"]) for r in contingency_sweep(df, ["id"], COMPS, PREDS).collect()}
    assert ("x2", "q2") not in got


def test_distinct_count_and_share(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    d = {r["x"]: r["n_ids"] for r in distinct_count_by(df, ["x"], ["id"], drop_null_groups=True).collect()}
    assert d == {"x1": 3, "x2": 2}
    s = share_within(df.where(F.col("g").isNotNull()), ["g"], "p").collect()
    for r in s:
        assert r["ratio"] == pytest.approx(r["count"] / r["groupCount"])


def test_bijection_gives_exactly_n_members(spark):
    from contingo.operators.baseline import shuffled
    grid = spark.range(7 * 11).select((F.col("id") % 7).alias("i"), F.floor(F.col("id") / 7).alias("j")) \
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    rows = shuffled(grid, "i", "j", F.lit(7), F.lit(11), "seed", "image").collect()
    members = {}
    for s in range(10):
        own = [r for r in rows if r["seed"] == s]
        assert sorted(r["image"] for r in own) == list(range(77))
        members[s] = frozenset((r["i"], r["j"]) for r in own if r["image"] < 20)
        assert len(members[s]) == 20
    assert len(set(members.values())) == 10


def test_bijection_matches_its_sql_twin(spark):
    import duckdb
    from contingo.operators.baseline import shuffled, sql_shuffled
    vals = [(i, j, s) for i in (0, 5, 1999) for j in (0, 3, 99) for s in (0, 1, 99)]
    got = {(r["i"], r["j"], r["s"]): r["m"] for r in shuffled(spark.createDataFrame(vals, "i long, j long, s int"), "i", "j",
                                                             F.lit(2000), F.lit(100), "s", "m").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i BIGINT, j BIGINT, s INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", vals)
    want = con.execute(f"SELECT i, j, s, m FROM ({sql_shuffled('t', 'i', 'j', '2000', '100', 's', 'm')})").fetchall()
    assert got == {r[:3]: r[3] for r in want}


def test_inverse_undoes_the_bijection(spark):
    from contingo.operators.baseline import restored, shuffled
    grid = spark.range(7 * 11 * 5).select((F.col("id") % 7).alias("i"), (F.floor(F.col("id") / 7) % 11).alias("j"),
                                          F.floor(F.col("id") / 77).cast("int").alias("seed"))
    there = shuffled(grid, "i", "j", F.lit(7), F.lit(11), "seed", "image")
    back = restored(there, "image", F.lit(7), F.lit(11), "seed", "x", "y").collect()
    assert len(back) == 385 and all((r["i"], r["j"]) == (r["x"], r["y"]) for r in back)


def test_listed_universe_and_bits_agree_with_the_grid(spark):
    from contingo.operators.baseline import listed_universe, member_bits, seeds_of
    left = spark.createDataFrame([(k,) for k in [3, 5, 8, 13, 21, None]], "e long")
    right = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "f string")
    grid = left.dropna().crossJoin(right.distinct()).toDF("t", "d")
    for n in (0, 1, 6, 15):
        listed = sorted(tuple(r) for r in listed_universe(left, right, ["t", "d"], 70, n).collect())
        bits = member_bits(grid, left, right, ["t", "d"], 70, n=n)
        asked = sorted(tuple(r) for r in bits.select("t", "d", F.explode(seeds_of(F.col("bits")))).collect())
        assert listed == asked and len(listed) == 70 * n
    assert len(listed_universe(left, right, ["t", "d"], 3, 40).collect()) == 3 * 15       # no more than the grid has


def test_listed_universe_undoes_the_rounds_once(spark):
    from contingo.operators.baseline import listed_universe
    left, right = spark.range(5).toDF("l"), spark.range(3).toDF("r")
    plan = listed_universe(left, right, ["t", "d"], 4, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod" in plan and not [x for x in plan.splitlines() if "Filter" in x and "pmod" in x and "16807" in x]


def test_dense_index_has_no_gaps(spark):
    from contingo.operators.baseline import dense_index
    df = spark.createDataFrame([(k,) for k in [5, 5, 9, 100, None, 7, 1000003]], "k long")
    rows = dense_index(df, "k", "i", buckets=3).collect()
    assert sorted(r["i"] for r in rows) == list(range(5)) and {r["k"] for r in rows} == {5, 9, 100, 7, 1000003}


def test_null_baseline_matches_per_seed_reference(spark):
    rows = [(i, i % 7, i % 5, ["r1", "r2", None][i % 3], ["x", "y", None][i % 3]) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "k long, t long, d long, reason string, g string")
    ents = lambda n: spark.range(n).toDF("e")
    members = baseline_pairs(df.where("k < 12"), ents(7), ents(5), ["t", "d"], 6)
    member = {(r["t"], r["d"], r["seed"]) for r in members.collect()}
    strata = F.filter(F.array(F.lit("all"), F.col("g")), lambda s: s.isNotNull())
    out = null_baseline(df, ["k", "t", "d"], ["t", "d"], "reason", "reason", members, strata=strata).collect()
    got = {(r["stratum"], r["seed"], r["prediction"]): tuple(r[k] for k in ("a", "predictionTotal", "comparisonTotal", "total", "d"))
           for r in out}
    want = {}
    for st in ("all", "x", "y"):
        own = {r for r in rows if st == "all" or r[4] == st}
        for s in range(6):
            mem = {r for r in own if (r[1], r[2], s) in member}
            for reason in ("r1", "r2"):
                a, p = sum(r[3] == reason for r in mem), sum(r[3] == reason for r in own)
                if a:
                    want[st, s, reason] = (a, p, len(mem), len(own), len(own) - p - len(mem) + a)
    assert got == want and want


def test_sweep_by_id_equals_the_row_form(spark):
    rows = [(1, "x1", ["m1", "m2"], "p1", ["q1", None], "g1"), (2, None, None, "p1", ["q2"], "g2"),
            (3, "x2", ["m2"], None, ["q1", "q2"], None), (4, "x1", [], "p2", None, "g1"), (5, "x1", ["m1", "m1"], "p2", [], "g1")]
    df = spark.createDataFrame(rows, "id long, x string, m array<string>, p string, q array<string>, g string")
    comps, preds = [("x", "X"), ("m", "M")], [("p", "P"), ("q", "Q")]
    strata = F.filter(F.array(F.lit("all"), F.col("g")), lambda s: s.isNotNull())
    flat = df.withColumn("m", F.explode_outer("m")).withColumn("q", F.explode_outer("q"))
    assert sorted(map(str, contingency_sweep_by_id(df, comps, preds, strata=strata).collect())) == \
        sorted(map(str, contingency_sweep(flat, ["id"], comps, preds, strata=strata).collect()))


@pytest.mark.parametrize("name", ["enrichment_sweep", "enrichment_stratified", "enrichment_corrected", "safety_table"])
def test_every_table_is_valid(spark, name):
    from contingo.plans import all_queries
    out = all_queries()[name](spark, "/root/testdata/sf0.001")
    if "d" in out.columns:
        assert out.where("least(a, b, c, d) < 0").count() == 0
    assert out.count() > 0
    if "significance" in out.columns:
        assert out.where("significance is null").count() == 0


def test_null_p_has_no_label(spark):
    from contingo.functions.columns import significance_change
    df = spark.createDataFrame([(None, None), (0.01, None), (0.01, 0.01), (0.2, 0.01), (0.01, 0.2), (0.2, 0.2)], "p double, q double")
    assert [r[0] for r in df.select(significance_change("p", "q")).collect()] == [
        None, None, "Remains Significant", "Now Significant", "No Longer Significant", "Never Significant"]


def _plan(df, which="optimizedPlan"):
    return str(getattr(df._jdf.queryExecution(), which)().toString())


def test_sweep_by_id_makes_its_arrays_once(spark):
    df = spark.range(3).select("id", F.col("id").cast("string").alias("x"), F.array(F.lit("m")).alias("m"))
    plan = _plan(contingency_sweep_by_id(df, [("x", "X"), ("m", "M")], [("x", "P")]))
    assert "lambda" not in plan and not [x for x in plan.splitlines() if "Filter" in x and "array(" in x]


def test_null_baseline_reads_its_cohort_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, "r")], "k long, t long, d long, reason string").write.parquet(f"{tmp_path}/c")
    members = spark.createDataFrame([(2, 3, [1])], "t long, d long, bits array<long>")
    out = null_baseline(spark.read.parquet(f"{tmp_path}/c"), ["k", "t", "d"], ["t", "d"], "reason", "reason", members)
    assert _plan(out, "sparkPlan").count("FileScan") == 1
    assert [(r["seed"], r["a"], r["total"]) for r in out.collect()] == [(0, 1, 1)]


def test_entities_are_dealt_once_for_orders_and_once_for_parts(spark):
    from contingo.operators.cohort import assemble_cohort
    row = spark.createDataFrame([(1, 2, 3, "F")], "o long, p long, s long, flag string")
    one, two, three = row.select("o", F.lit(1).alias("x")), row.select("p", "s", F.lit(2).alias("y")), row.select("p", F.lit(3).alias("z"))
    flags = {"flag": F.col("flag")}
    out = assemble_cohort(row, ["o", "p", "s"], [(one, ["o"]), (two, ["p", "s"]), (three, ["p"])], flags=flags,
                          flag_values={"flag": ["F"]}, one_row=True)
    dealt = [x for x in _plan(out).splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 3 and not [x for x in dealt if "[p#" not in x and "[o#" not in x]
    assert [(r["flag"], r["x"], r["y"], r["z"]) for r in out.collect()] == [(["F"], 1, 2, 3)]


def test_events_and_images_are_made_in_a_stated_number_of_tasks(spark):
    from contingo.operators.baseline import member_bits
    from contingo.plans.enrichment import _lineitem_orders
    bits = member_bits(spark.range(9).select(F.col("id").alias("t"), F.col("id").alias("d")), spark.range(9).toDF("t"),
                       spark.range(9).toDF("d"), ["t", "d"], 3)
    assert "REPARTITION_BY_NUM" in _plan(bits, "executedPlan")
    assert "REPARTITION_BY_NUM" in _plan(_lineitem_orders(spark, "/root/testdata/sf0.001"), "executedPlan")


def test_enrich_end_to_end(spark):
    from contingo.operators.enrich import enrich
    from contingo.operators.stats import bh_adjust, with_fisher_and_or
    df = spark.createDataFrame(ROWS, SCHEMA)
    strata = F.filter(F.array(F.lit("all"), F.when(F.col("g") == "g1", F.lit("one"))), lambda s: s.isNotNull())
    got = enrich(df, ["id"], COMPS, PREDS, strata=strata)
    assert {"stratum", "pvalue", "pvalue_corrected", "significance", "or_result"} <= set(got.columns)
    want = bh_adjust(with_fisher_and_or(contingency_sweep(df, ["id"], COMPS, PREDS, strata=strata)),
                     group_cols=["stratum", "predictionType", "comparisonType"], tiebreak=["prediction", "comparison"])
    key = lambda r: (r["stratum"], r["comparisonType"], r["comparison"], r["predictionType"], r["prediction"])
    g = {key(r): r["pvalue_corrected"] for r in got.collect()}
    w = {key(r): r["pvalue_corrected"] for r in want.collect()}
    assert g == w and len(g) > 0
