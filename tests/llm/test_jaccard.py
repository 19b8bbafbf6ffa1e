import random
import re

import numpy as np
import pyarrow as pa
import pytest

from contingo.llm import jaccard
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS, prose


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, s in zip(range(len(ids)), sets):
        known = [ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None]
        out.append((ids[i], len(s), (min(known) if known else None) if s else ids[i]))
    return sorted(out, key=str)


def families(seed):
    """Families of near copies, chains, shared passages, short texts."""
    r = random.Random(seed)
    texts = []
    for f in range(4):
        base = prose(100 * seed + f, r.choice([8, 20, 60, 120]))
        for _ in range(r.randrange(3, 9)):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(own) // 25))):
                own[r.randrange(len(own))] = f"z{r.randrange(1000)}"
            texts.append(" ".join(own))
    passage = prose(7, 40)
    texts += [" ".join(prose(seed * 50 + i, 30) + passage + prose(seed * 60 + i, 30)) for i in range(8)]
    chain = prose(seed + 9, 100)
    texts += [" ".join(chain[3 * i:3 * i + 70]) for i in range(8)]
    texts += ["one", "One", "one two", "two one", "a b c d e", "a b c d e f", ""]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,frequent,long", [(1, 24, 512), (2, 2, 16), (3, 0, 32)])
def test_components_equal_brute_force(make_docs, seed, frequent, long):
    texts = families(seed)
    got = jaccard.near_duplicates(make_docs(texts, **CLASHES), frequent=frequent, long=long).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(range(len(texts))), texts)


def linked(x, y):
    common = len(np.intersect1d(x, y))
    return 100 * common >= 75 * (len(x) + len(y) - common)


@pytest.mark.parametrize("long", [16, 32, 64])
def test_linked_sets_always_share_a_signature(long):
    """Sets around every change of level, with classes of all shares: a rare token or a combination is in both, and
    sets that share no rare token are within each other's size limits."""
    r = np.random.default_rng(long)
    met = kinds = 0
    for _ in range(1500):
        n = int(r.integers(2, 9 * long))
        world = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        often = r.random(2 * n) < r.choice([0.3, 0.8, 0.95, 1.0])
        base = np.arange(n)
        x = np.unique(world[base])
        keep = base[r.random(n) > r.choice([0.02, 0.1, 0.2, 0.25])]
        y = np.unique(world[np.concatenate([keep, n + np.arange(int(r.integers(0, 2 + n // 8)))])])
        if not len(y) or not linked(x, y) or len(x) == len(y) == len(np.intersect1d(x, y)):
            continue
        common = dict(zip(world.tolist(), often.tolist()))
        (ra, ca), (rb, cb) = (jaccard.signatures(s, np.array([common[t] for t in s.tolist()]), 75, long) for s in (x, y))
        share = len(np.intersect1d(ra, rb))
        assert share or len(np.intersect1d(ca, cb)), (n, long)
        if not share:
            assert len(y) <= jaccard.size_limit(len(x), len(ra), 75) and len(x) <= jaccard.size_limit(len(y), len(rb), 75)
            kinds += 1
        met += 1
    assert met > 200 and kinds > 20


def test_signatures_of_long_sets_stay_in_proportion():
    for n in (500, 511, 512, 2047, 2048, 20_000, 100_000, 400_000):
        tokens = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        rare, combos = jaccard.signatures(tokens, np.ones(n, dtype=bool))
        assert not len(rare) and len(combos) <= 24 * n, (n, len(combos))


def test_combinations_of_three_are_all_there():
    tokens = np.arange(3, 9, dtype=np.uint64)
    assert len(np.unique(jaccard.combinations(tokens, 3))) == 20 and len(np.unique(jaccard.combinations(tokens))) == 15
    assert not len(jaccard.combinations(tokens[:2], 3)) and not len(jaccard.combinations(tokens[:1]))


def test_partners_within_a_group_keep_each_other():
    token = np.array([1, 1, 1, 2, 2], dtype=np.uint64)
    n, rare = np.array([100, 100, 88, 100, 100]), np.array([5, 20, 3, 20, 20])
    kept = jaccard.supported(token, n, jaccard.size_limit(n, rare, 75))
    assert kept.tolist() == [0, 2]                            # 20 rare ones of 100 ask for a partner of at most 86


def test_documents_of_a_hundred_thousand_words(make_docs):
    words = prose(5, 100_000, 50_000)
    other = list(words)
    for i in range(0, len(other), 45):
        other[i] = f"changed{i}"
    far = list(words)
    for i in range(0, len(far), 12):
        far[i] = f"far{i}"
    texts = [" ".join(w) for w in (words, other, far)] + ["a short one of six words"]
    want = brute(list(range(4)), texts)
    assert [c for _, _, c in want] == [0, 0, 2, 3]
    for frequent in (0, 24):                                  # every token frequent; every token rare
        got = jaccard.near_duplicates(make_docs(texts), frequent=frequent).collect()
        assert sorted(map(tuple, got)) == want


def test_edges_and_representatives(make_docs):
    docs = make_docs(EDGE_TEXTS, EDGE_IDS, **CLASHES)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGE_IDS, EDGE_TEXTS)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.text for r in out.collect()]
    want = [t for t in EDGE_TEXTS if not shingles(t)]
    want += list({shingles(t): t for t in EDGE_TEXTS if shingles(t)}.values())
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_one_of_each_keeps_the_smallest_id(make_docs):
    texts = families(4)
    want = sorted({c for i, n, c in brute(list(range(len(texts))), texts)})
    assert sorted(r.doc_id for r in jaccard.one_of_each(make_docs(texts)).collect()) == want


def test_empty_table(make_docs):
    assert jaccard.near_duplicates(make_docs([])).count() == 0
    assert jaccard.one_of_each(make_docs([])).count() == 0


def test_packing_round_trip():
    r = np.random.default_rng(1)
    tokens = np.sort(r.integers(0, 1 << 40, 5000, dtype=np.uint64))
    top = (tokens >> np.uint64(24)).astype(np.int64)
    edges = jaccard.bucket_edges(7)
    for i in range(7):
        own = tokens[(top >= edges[i]) & (top < edges[i + 1])]
        counts = np.bincount((own >> np.uint64(24)).astype(np.int64) - edges[i], minlength=edges[i + 1] - edges[i])
        low = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()
        assert jaccard.unpacked(i, counts.astype("<u4").tobytes(), low, 7).tolist() == own.tolist()


def test_id_filter_is_made_by_one_python_step(spark, make_docs, monkeypatch):
    """Two chained steps would hold two Python workers in every task."""
    from contingo.llm import cluster
    ids = make_docs(["a"] * 5, ids=[3, None, 7, 7, 10 ** 15]).select("doc_id")
    steps, before = [], type(ids).mapInArrow
    monkeypatch.setattr(type(ids), "mapInArrow", lambda self, *a, **k: steps.append(1) or before(self, *a, **k))
    bitmap = np.frombuffer(jaccard.id_filter(ids, 5), dtype=np.uint8)
    assert len(steps) == 1
    keys = jaccard.id_keys(pa.array([3, None, 7, 10 ** 15, 4, 8], type=pa.int64()))
    assert cluster.in_filter(bitmap, keys).tolist() == [True, True, True, True, False, False]


def test_sketches_differ_in_no_more_bits_than_sets_differ_in_tokens(spark):
    from pyspark.sql import functions as F
    r = np.random.default_rng(5)
    rows = []
    for n in (1, 2, 30, 400, 3000):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for kept in (0, n // 2, n - 1, n):
            y = np.concatenate([x[:kept], r.integers(0, 1 << 63, n // 3, dtype=np.uint64)])
            a, b = jaccard.sketch(x), jaccard.sketch(y)
            own = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64).tolist())
            assert own <= n - kept + n // 3
            assert n - kept + n // 3 > 60 or own >= (n - kept + n // 3) // 2
            rows.append((dict(zip(jaccard.SKETCHED, a.tolist())), dict(zip(jaccard.SKETCHED, b.tolist())), own))
    kind = "struct<" + ",".join(f"{s}:long" for s in jaccard.SKETCHED) + ">"
    df = spark.createDataFrame(rows, f"x {kind}, y {kind}, own int")
    assert df.where(jaccard.differing(F.col("x"), F.col("y")) != F.col("own")).count() == 0


def test_texts_of_one_origin_that_do_not_link_are_no_candidates(make_docs, monkeypatch):
    """Their rare tokens are few enough for a link of one text, but not of two; most frequent ones are the same."""
    base = prose(11, 100, 10_000)
    texts = []
    for i in range(16):
        own = list(base)
        own[3 + 6 * (i % 8)], own[52 + 6 * (i // 2 % 8)] = f"y{i}", f"z{i}"
        texts.append(" ".join(own))
    asked = []
    before = jaccard.Join.verified
    monkeypatch.setattr(jaccard.Join, "verified",
                        lambda self, pairs, nodes: asked.append(pairs.count()) or before(self, pairs, nodes))
    got = jaccard.near_duplicates(make_docs(texts), frequent=2).collect()
    want = brute(list(range(16)), texts)
    assert sorted(map(tuple, got), key=str) == want and len({c for _, _, c in want}) > 4
    assert asked[-1] <= 8                                     # the pairs that still meet behind folding and centres


@pytest.mark.parametrize("long", [64, 512])
def test_first_common_pair_bounds_the_partner(long):
    """Of linked short sets without common rare tokens, the first pair of common tokens is in both, within both limits."""
    r = np.random.default_rng(long)
    met = tight = 0
    for _ in range(600):
        n = int(r.integers(8, long))
        world = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        x = np.unique(world[:n][r.random(n) > 0.07])
        y = np.unique(np.concatenate([world[:n][r.random(n) > 0.07], world[n:n + int(r.integers(0, 2 + n // 16))]]))
        if len(x) < 2 or len(y) < 2 or not linked(x, y):
            continue
        both = np.intersect1d(x, y)
        (_, cx, bx), (_, cy, by) = (jaccard.signed(s, np.isin(s, both), 75, long) for s in (x, y))
        limits = []
        for s, own, before, other in ((x, cx, bx, y), (y, cy, by, x)):
            if not len(own):
                break
            at = np.flatnonzero(own == jaccard.combinations(both[:2])[0])
            assert len(at) == 1 and (np.diff(own.astype(object)) > 0).all()
            limits.append(jaccard.size_limit(len(s), int(before[at[0]]), 75))
            assert len(other) <= limits[-1] and before.max() >= before[at[0]]
            tight += int((jaccard.size_limit(len(s), before, 75) < len(other)).any())
        met += len(limits) == 2
    assert met > 100 and tight > 50
