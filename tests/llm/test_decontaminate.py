import random
import re

import numpy as np

from contingo.llm import decontaminate as d
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_suffix_array_and_search_equal_brute_force():
    r = random.Random(3)
    for n in (1, 2, 30, 200):
        text = [r.randrange(1, 5) for _ in range(n)]
        index = d.FMIndex(np.array(text), 6)
        assert d.suffix_array(np.array(text + [0])).tolist() == sorted(range(n + 1), key=lambda i: (text + [0])[i:])
        for size in (1, 2, 3):
            for _ in range(20):
                p = [r.randrange(1, 6) for _ in range(size)]
                low, high = index.search(np.array([p]))
                got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
                assert got == [i for i in range(n - size + 1) if text[i:i + size] == p]


def test_spans_equal_brute_force(spark, make_docs):
    items = [(1, " ".join(prose(10, 30, 50))), (2, "Short one"), (3, " ".join(prose(10, 30, 50))[:60]), (4, None), (5, ""),
             (None, "w1 w2 w3"), (7, "word")]
    r = random.Random(1)
    texts = EDGE_TEXTS + [" ".join(prose(20, 40, 50) + prose(10, 30, 50)[r.randrange(5):r.randrange(8, 30)] + prose(21, 9, 50))
                          for _ in range(20)] + ["a SHORT--one here. short one", " ".join(prose(10, 30, 50)) * 3]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.find_spans(make_docs(texts, range(len(texts)), **CLASHES), bench).collect()
    for row in out:
        n, n_hit, found = brute(texts[row.doc_id], items)
        assert row.hit_words == n and sum(x["last"] - x["first"] + 1 for x in row.hit_spans) == n_hit
        assert row.hit_items == [f for f in found if f != "None"]


def test_many_blocks_give_the_same(spark, make_docs, monkeypatch):
    items = [(i, " ".join(prose(i, 25, 60))) for i in range(6)]
    docs = make_docs([" ".join(prose(i, 25, 60) + prose(50 + i, 20, 60)) for i in range(8)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, d.find_spans(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 150)
    assert sorted(map(str, d.find_spans(docs, bench).collect())) == one


def test_removal_takes_hits_out_and_leaves_the_rest(spark, make_docs):
    passage = " ".join(prose(10, 20, 50))
    texts = [f"Before it. {passage}, after it!", "clean text stays  as it is\n", passage, None]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = make_docs(texts, **CLASHES)
    out = d.decontaminate(docs, bench)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "Before it. , after it!", 1: texts[1], 2: "", 3: None}
    assert not any(brute(t, [(1, passage)])[1] for t in got.values())


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs(EDGE_TEXTS, EDGE_IDS)
    assert [r.text for r in d.decontaminate(docs, none).collect()] == [r.text for r in docs.collect()]
    assert d.decontaminate(make_docs([]), none).count() == 0


def test_removal_is_part_of_the_search(spark, make_docs, monkeypatch):
    """A second Python step would keep a second worker for each core of an executor."""
    items = [(i, " ".join(prose(i, 25, 60))) for i in range(6)]
    docs = make_docs([" ".join(prose(i % 6, 25, 60) + prose(50 + i, 20, 60)) for i in range(8)] + [None], **CLASHES)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.decontaminate(docs, bench)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    one = sorted(map(str, out.collect()))
    assert all(" ".join(prose(i % 6, 25, 60)) not in r.text for i, r in enumerate(sorted(out.collect(), key=lambda r: r.doc_id)[:8]))
    monkeypatch.setattr(d, "BLOCK_BYTES", 150)
    assert sorted(map(str, d.decontaminate(docs, bench).collect())) == one and out.columns == docs.columns
