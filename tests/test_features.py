"""Column helpers, cohort operators and their edge rows (FIXTURES 5)."""
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contingo.functions.columns import (TEXT_RULES, clean_text, collapse_to_default, degree_bin, effect_text,
                                        empty_to_null, extract_group, left_closed_bins, log_factorial, lump_other,
                                        parse_date_any, pvalue_text, recode, replace_first, sentence_case,
                                        threshold_labels, two_sided_bin, year_or_other)
from contingo.operators.cohort import (allowlist_keep, ancestor_closure, best_category, best_category_strict,
                                       complete_grid, explode_field, neighbour_degree, propagate, stack_tagged)
from contingo.operators.report import count_bins, group_median
from contingo.sources.io import literal_table

PREC = [("A", "area a", "Top"), ("B", "area b", "Other"), ("C", "area c", "Other")]
PREC_SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("label", T.StringType()),
                            T.StructField("simple", T.StringType())])


def test_log_factorial_matches_lgamma(spark):
    import math
    ns = [0, 1, 2, 5, 15, 16, 17, 100, 1000, 123456, 10 ** 9]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = {r["n"]: r["lf"] for r in df.select("n", log_factorial("n").alias("lf")).collect()}
    for n in ns:
        assert got[n] == pytest.approx(math.lgamma(n + 1), rel=1e-14, abs=1e-12)


def test_threshold_tiers_are_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.75,), (0.76,), (None,)], "s double")
    cols = threshold_labels("s", [0.75, 0.5], ["t75", "t50"])
    rows = df.select("s", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()
    got = {r["s"]: (r["c0"], r["c1"]) for r in rows}
    assert got[0.5] == (None, None) and got[0.75] == (None, "t50") and got[0.76] == ("t75", "t50")
    assert got[None] == (None, None)


def test_two_sided_bin_gap(spark):
    df = spark.createDataFrame([(0.95,), (0.5,), (0.05,), (None,)], "v double")
    got = [r[0] for r in df.select(two_sided_bin("v", 0.9, 0.1, "hi", "lo")).collect()]
    assert got == ["hi", None, "lo", None]


def test_degree_bins_edges(spark):
    df = spark.createDataFrame([(10,), (11,), (20,), (21,), (0,), (None,)], "n long")
    got = [r[0] for r in df.select(degree_bin("n")).collect()]
    assert got == ["from1to10", "from11to20", "from11to20", "greaterThan20", "none", "none"]


def test_undirected_degree_edges(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "C"), ("D", None), ("A", "B")], "a string, b string")
    got = {r["node"]: r["partners"] for r in neighbour_degree(edges, "a", "b").collect()}
    assert got == {"A": 1, "B": 1, "C": 1}


def test_allowlist_null_rules(spark):
    # null list keep / [] drop / only other drop / other + null keep / one allowed keep
    rows = [(1, None), (2, []), (3, ["benign"]), (4, ["benign", None]), (5, ["pathogenic"])]
    df = spark.createDataFrame(rows, "i int, sig array<string>")
    kept = sorted(r["i"] for r in df.where(allowlist_keep("sig", ["pathogenic", "affects"])).collect())
    assert kept == [1, 4, 5]


def test_greedy_url_capture(spark):
    pat = "(.+)(id=%22)(.+)(%22)"
    df = spark.createDataFrame([("http://x/none",), ("http://x?id=%22NCT01%22",),
                                ("http://x?id=%22NCT01%22OR%22NCT02%22",)], "u string")
    got = [r[0] for r in df.select(extract_group("u", pat, 3)).collect()]
    assert got == [None, "NCT01", "NCT01%22OR%22NCT02"]


def test_xxhash_skips_nulls(spark):
    df = spark.createDataFrame([("t", "d", None)], "a string, b string, c string")
    r = df.select(F.xxhash64("a", "b", "c").alias("x"), F.xxhash64("a", "b").alias("y")).collect()[0]
    assert r["x"] == r["y"]


def test_closure_and_propagation(spark):
    nodes = spark.createDataFrame([("n1", ["p1", "root"]), ("n2", []), ("n3", None)],
                                  "id string, ancestors array<string>")
    clo = ancestor_closure(nodes, "id", "ancestors")
    got = {(r["nodeId"], r["propagatedId"]) for r in clo.collect()}
    assert got == {("n1", "n1"), ("n1", "p1"), ("n1", "root"), ("n2", "n2"), ("n3", "n3")}
    ev = spark.createDataFrame([("t", "n1"), ("t", "n2"), ("u", "zz")], "tid string, node string")
    prop = {(r["tid"], r["node"]) for r in propagate(ev, "node", clo).collect()}
    assert prop == {("t", "n1"), ("t", "p1"), ("t", "root"), ("t", "n2"), ("u", None)}


def test_best_category_lenient_and_strict(spark):
    prec = literal_table(spark, PREC, PREC_SCHEMA, rank_col="rank")
    pairs = spark.createDataFrame([("d1", "B"), ("d1", "C"), ("d2", "Z"), ("d3", "A"), ("d3", "A"), ("d4", "C")],
                                  "e string, cat string")
    lenient = {(r["e"], r["k"]) for r in best_category(pairs, "e", "cat", prec, "k", "rank").collect()}
    assert lenient == {("d1", "B"), ("d3", "A"), ("d4", "C")}      # d2: unknown areas only -> gone
    strict = {(r["e"], r["k"]) for r in best_category_strict(pairs, "e", "cat", prec, "k", "rank").collect()}
    assert strict == {("d1", "B"), ("d4", "C")}                     # d3: tie at the top -> dropped


def test_nested_field_explode_keeps_null_elements(spark):
    df = spark.createDataFrame([("t1", [(1,), (None,)]), ("t2", [])],
                               "id string, constraint array<struct<upperBin6:int>>")
    got = sorted(explode_field(df, ["id"], "constraint", "upperBin6", "gc").collect(), key=lambda r: str(r["gc"]))
    assert [(r["id"], r["gc"]) for r in got] == [("t1", "1"), ("t1", None)]


def test_small_value_helpers(spark):
    df = spark.createDataFrame([("Negative", "", "x_y_z", 7)], "p string, e string, s string, n long")
    r = df.select(collapse_to_default("p", ["Negative"], "Neutral").alias("a"),
                  collapse_to_default(F.lit("Other"), ["Negative"], "Neutral").alias("b"),
                  empty_to_null("e").alias("c"), replace_first("s", "_", "-").alias("d"),
                  sentence_case(F.lit("hELLO wORLD")).alias("f"),
                  recode("p", {"Negative": "Neg"}).alias("g"), recode(F.lit("keep"), {"x": "y"}).alias("h"),
                  lump_other("p", ["Cardiovascular"]).alias("i")).collect()[0]
    assert tuple(r) == ("Negative", "Neutral", None, "x-y_z", "Hello world", "Neg", "keep", "Other")


def test_count_bins_left_closed(spark):
    df = spark.createDataFrame([(c,) for c in [None, 0, 1, 4, 5, 9, 10, 24, 25, 99, 100, 249, 250, 499, 500, 10 ** 6]],
                               "count long")
    got = [r["interval"] for r in count_bins(df).collect()]
    assert got == [None, None, "1-4", "1-4", "5-9", "5-9", "10-24", "10-24", "25-99", "25-99", "100-249",
                   "100-249", "250-499", "250-499", "500+", "500+"]


def test_dates_and_years(spark):
    df = spark.createDataFrame([("05/03/1994",), ("05.03.2020",), ("bad",)], "t string")
    r = df.select(parse_date_any("t", ["dd/MM/yyyy", "dd.MM.yyyy"]).alias("d")) \
        .select("d", year_or_other("d", 1995, 2021).alias("y")).collect()
    assert [str(x["d"]) for x in r] == ["1994-03-05", "2020-03-05", "None"]
    assert [x["y"] for x in r] == ["Other", "2020", "Other"]


def test_effect_and_pvalue_text(spark):
    df = spark.createDataFrame([(1.5, 0.7, 2.0, 0.6323376), (3.14159, 1.0, 10.0, 2.8e-5), (1.0, 1.0, 1.0, 1e-50)],
                               "o double, l double, h double, p double")
    r = df.select(effect_text("o", "l", "h").alias("e"), pvalue_text("p").alias("p")).collect()
    assert [x["e"] for x in r] == ["1.5 (0.7-2)", "3.14 (1-10)", "1 (1-1)"]
    assert [x["p"] for x in r] == ["0.63", "2.8e-05", "<1e-40"]


def test_complete_grid_and_median(spark):
    counts = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "g string, n string, c long")
    got = {(r["g"], r["n"], r["c"]) for r in complete_grid(counts, "g", "n").collect()}
    assert got == {("a", "x", 1), ("a", "y", None), ("b", "x", None), ("b", "y", 2)}
    nulls = spark.createDataFrame([("x", "p", 3), (None, "p", 5), ("y", None, 7), ("y", "q", 1)], "g string, n string, c long")
    got = {(r["g"], r["n"], r["c"]) for r in complete_grid(nulls, "g", "n").collect()}
    assert got == {(g, n, {("x", "p"): 3, (None, "p"): 5, ("y", None): 7, ("y", "q"): 1}.get((g, n)))
                   for g in ("x", "y", None) for n in ("p", "q", None)}
    vals = spark.createDataFrame([("k", v) for v in [5.0, 1.0, 3.0, 3.0, None]] + [("j", 2.0), ("j", 4.0)],
                                 "g string, v double")
    med = {r["g"]: r["median"] for r in group_median(vals, ["g"], "v").collect()}
    assert med == {"k": 3.0, "j": 3.0}


def test_stack_tagged_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n long, s string")
    b = spark.createDataFrame([("y", 2, 0.5)], "s string, n long, extra double")
    got = sorted(tuple(r) for r in stack_tagged({"A": a, "B": b}).select("tag", "n", "s", "extra").collect())
    assert got == [("A", 1, "x", None), ("B", 2, "y", 0.5)]


def python_clean(text):
    """The normalisation as plain Python ``re`` (brute-force check)."""
    text = text.lower()
    for pattern, repl in TEXT_RULES:
        text = re.sub(pattern, repl, text)
    return re.sub(r"\s+", " ", text).strip()


@pytest.mark.parametrize("text", [
    "What's this? It WON'T work-around, can't, isn't i'm we're he'd they'll 'scuse",
    "mail @someone here and @x\tthere &amp; more",
    "tabs\t\tand\nnew lines em space   nbsp　ideo",
    "quote'\nnewline and quote' nbsp", "   ", "",
    "Ünïcödé ÉTÉ straße – dash — long",
])
def test_clean_text_matches_python(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_text("t")).collect()[0][0] == python_clean(text)


def test_clean_text_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["c"] for r in docs.select("doc_id", clean_text("text").alias("c")).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == python_clean(r["text"])


@pytest.mark.parametrize("buckets", [1, 4, 4096])
def test_group_median_matches_numpy(spark, buckets):
    import random
    import statistics
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)]           # one hot group, many ties
    rows += [(f"g{i % 9}", rnd.uniform(-5, 5)) for i in range(400)]
    rows += [("single", 2.5), ("pair", 1.0), ("pair", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in group_median(df, ["g"], "v", buckets=buckets).collect()}
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, vs in want.items():
        assert got[g] == pytest.approx(statistics.median(vs), rel=1e-12, abs=1e-12)


def test_median_ranges_follow_the_rows_not_the_values(spark):
    df = spark.range(4000).select(F.lit("k").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id")).alias("v"))
    cuts = df.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 640).alias("c")).first()["c"]
    sizes = [0] * 64
    for r in df.collect():
        sizes[sum(c < r["v"] for c in cuts)] += 1
    assert max(sizes) < 200                                   # below 5% of the rows
    assert group_median(df, ["g"], "v").collect()[0]["median"] == 2000.5
