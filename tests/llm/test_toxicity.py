import random
import zlib

import numpy as np

from contingo.llm import toxicity as t
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS, prose


def test_search_equals_brute_force():
    r = random.Random(4)
    vectors = []
    for _ in range(500):
        v = {r.randrange(40): r.random() for _ in range(r.randrange(1, 6))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({k: w / norm for k, w in v.items()})
    index = t.BlockMaxIndex(vectors)
    for q in vectors[:60] + [{}, {99: 1.0}]:
        sims = np.array([sum(w * v.get(k, 0) for k, w in q.items()) for v in vectors])
        e, s = index.search(q, 10)
        assert np.allclose(s, np.sort(sims[sims > 0])[::-1][:10])
        assert np.allclose(sims[e], s)


def brute(vectors, q):
    return np.array([sum(w * v.get(k, 0) for k, w in q.items()) for v in vectors])


def test_search_leaves_terms_out_and_stays_exact(monkeypatch):
    """Few postings first, small blocks, terms of very unlike weight: most terms are bounded, not added."""
    monkeypatch.setattr(t, "FIRST_POSTINGS", 60)
    monkeypatch.setattr(t, "BLOCK", 16)
    for often, seed in ((200, 1), (6, 2), (1, 3)):
        monkeypatch.setattr(t, "OFTEN", often)
        r = random.Random(seed)
        vectors = []
        for _ in range(700):
            v = {min(299, int(r.expovariate(0.02))): r.random() ** 6 + 1e-3 for _ in range(r.randrange(1, 30))}
            norm = sum(w * w for w in v.values()) ** 0.5
            vectors.append({k: float(np.float32(w / norm)) for k, w in v.items()})
        vectors[10:14] = [dict(vectors[5]) for _ in range(4)]                # ties
        index = t.BlockMaxIndex(vectors)
        for i, q in enumerate(vectors[:80]):
            for without in (-1, i):
                sims = brute(vectors, q)
                if without >= 0:
                    sims[without] = 0
                e, s = index.search(q, 10, without)
                assert np.allclose(s, np.sort(sims[sims > 0])[::-1][:10], atol=1e-5)
                assert np.allclose(sims[e], s, atol=1e-5) and without not in e.tolist() and len(set(e.tolist())) == len(e)


def test_terms_of_a_run_equal_those_of_each_text():
    every = [b"Trash trashy trash", None, b"", "Über über-all".encode(), b"a b a"]
    hashes, places = t.text_terms(every)
    for text, own in zip(every, places):
        want = sorted(h for w in t.alnum_words(text) for h in t.word_hashes(t.word_terms(w)).tolist())
        assert sorted(hashes[own].tolist()) == want
    assert [x for r in t.runs(every) for x in every[r]] == every and list(t.runs([])) == []


def test_isotonic_is_monotone_and_pools():
    knots, rates = t.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]))
    assert list(knots) == [1, 3, 4] and (np.diff(rates) >= 0).all()


def labelled(spark, make_docs, n=400):
    bad = ["idiotish", "scumbag", "trashy"]
    r = random.Random(2)
    texts, toxic = [], []
    for i in range(n):
        own = prose(i, 40, 800)
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(3):
                own[r.randrange(40)] = r.choice(bad)
        texts.append(" ".join(own))
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)] + [(0, 1, 1), (99999, 1, 1), (None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    return make_docs(texts, **CLASHES), labels, toxic


def test_held_out_accuracy_and_evidence(spark, make_docs):
    docs, labels, toxic = labelled(spark, make_docs)
    got = t.score(docs, labels).collect()
    assert len(got) == len(toxic)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    assert all(zlib.crc32(str(e.doc_id).encode()) % 3 != 1 for r in got for e in r.evidence)


def test_held_out_labels_change_nothing(spark, make_docs):
    from pyspark.sql import functions as F
    docs, labels, _ = labelled(spark, make_docs, 120)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    assert sorted(map(str, t.score(docs, labels).collect())) == sorted(map(str, t.score(docs, flipped).collect()))


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    got = t.score(make_docs(EDGE_TEXTS, EDGE_IDS, **CLASHES), labels).collect()
    assert len(got) == len(EDGE_TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert t.score(make_docs([]), labels).count() == 0
    none = t.score(make_docs(["a"]), labels.where("false")).collect()[0]
    assert none.score == 0.5 and none.predicted == 0


def test_rare_toxic_words_and_every_row_count(spark, make_docs):
    texts = [" ".join(prose(i, 30, 300)) for i in range(300)]
    toxic = [0] * 300
    for i in range(0, 300, 3):                              # each toxic word stands in three toxic rows only
        toxic[i] = 1
        texts[i] = f"{texts[i]} zq{i // 9}bad zq{i // 9}bad"
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = t.learn(make_docs(texts), labels, folds=1, held=1)
    assert sorted(model.ids) == list(range(300))            # rows without a toxic term are examples too
    assert all(len(term) for term, _ in model.words.vectors([f"w{j}".encode() for j in range(200)]))
    got = {r.doc_id: r for r in t.score(make_docs(texts), labels, folds=1, held=1).collect()}
    assert all(len(r.evidence) == t.NEIGHBOURS for r in got.values())
    assert all({e.doc_id for e in got[i].evidence[:3]} == {j for j in range(300) if f"zq{i // 9}bad" in texts[j]}
               for i in range(0, 297, 3))


def test_cosines_are_over_whole_texts(spark, make_docs):
    texts = ["trash " + " ".join(prose(i, 40, 400)) for i in range(40)] + [" ".join(prose(i, 40, 400)) for i in range(40, 200)]
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in t.score(make_docs(texts), labels, folds=1, held=1).collect()}
    assert all(e.cosine < 0.999 for r in got.values() for e in r.evidence if e.doc_id != r.doc_id)


def test_terms_found_in_one_pass_equal_those_of_single_words():
    words = [b"a", b"abc", b"abcd", "Ünïcödé".encode(), "日本語話者".encode(), "😀😀😀😀".encode(), b"x" * 2000, b"abcdef"]
    hashes, size = t.term_hashes(words)
    terms = [t.word_terms(w) for w in words]
    assert size.tolist() == [len(x) for x in terms]
    assert hashes.tolist() == t.word_hashes([x for part in terms for x in part]).tolist()
    found, places = t.text_terms([b"trash \xe6\x97 \xe6\x97abcd"])           # no whole characters: as word by word
    assert found[places[0]].tolist() == [h for w in (b"trash", b"\xe6\x97", b"\xe6\x97abcd")
                                         for h in t.word_hashes(t.word_terms(w)).tolist()]


def test_index_of_terms_in_any_numbers_and_stretches_joined():
    values = np.array([70000, 3, 65536, 3, 131072, 70000])
    assert t.by_value(values).tolist() == np.argsort(values, kind="stable").tolist()
    a, b = t.joined(np.array([4, 0]), np.array([2, 3]), np.arange(6), np.arange(6) * 10)
    assert a.tolist() == [4, 5, 0, 1, 2] and b.tolist() == [40, 50, 0, 10, 20]
    index = t.BlockMaxIndex([{7: 1.0}, {900: 0.6, 7: 0.8}])              # numbers between them that no example has
    e, s = index.search({900: 1.0}, 2)
    assert e.tolist() == [1] and np.allclose(s, 0.6)


def test_vectors_searched_together_equal_those_searched_alone(monkeypatch):
    """Frequent terms have the largest numbers and come last in the vectors; the index puts them first."""
    monkeypatch.setattr(t, "FIRST_POSTINGS", 40)
    monkeypatch.setattr(t, "BLOCK", 16)
    monkeypatch.setattr(t, "OFTEN", 8)
    monkeypatch.setattr(t, "TOGETHER", 7)
    r = random.Random(9)
    vectors = []
    for _ in range(500):
        v = {299 - min(299, int(r.expovariate(0.03))): r.random() ** 6 + 1e-3 for _ in range(r.randrange(1, 30))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({k: float(np.float32(v[k] / norm)) for k in sorted(v)})
    index = t.BlockMaxIndex(vectors)
    assert 0 < (index.row >= 0).sum() < 60 and (index.often_held > 0).any()
    asked = [*vectors[:40], {}, {9999: 1.0}]
    without = [i if i % 2 else -1 for i in range(len(asked))]
    for (e, s), q, w in zip(index.search_all(asked, 10, without), asked, without):
        sims = brute(vectors, q)
        if w >= 0:
            sims[w] = 0
        assert np.allclose(s, np.sort(sims[sims > 0])[::-1][:10], atol=1e-5) and np.allclose(sims[e], s, atol=1e-5)
        alone, cosines = index.search(q, 10, w)
        assert np.array_equal(e, alone) and np.allclose(s, cosines, atol=1e-6)
    assert index.search_all([], 10) == [] and t.BlockMaxIndex([]).search_all([{1: 1.0}], 3)[0][0].tolist() == []
