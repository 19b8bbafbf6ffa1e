import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contingo.llm import lattice as m
from contingo.llm.words import space_words
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS, prose


@pytest.fixture(scope="module")
def small():
    pieces = [b"\xe2\x96\x81", b"\xe2\x96\x81a", b"a", b"ab", b"b", b"aba", b"\xe2\x96\x81ab"] + [bytes([b]) for b in range(256)]
    weights = np.arange(1, len(pieces) + 1) / np.arange(1, len(pieces) + 1).sum()
    return pieces, m.Lattice(pieces), np.log(weights)


def segmentations(pieces, word):
    if not word:
        yield []
    for i, p in enumerate(pieces):
        if word.startswith(p):
            for rest in segmentations(pieces, word[len(p):]):
                yield [i, *rest]


def test_forward_sums_over_all_segmentations(small):
    pieces, lattice, logp = small
    words = [b"a", b"abab", b"baab", "é".encode(), b"c"]
    got = lattice.log10(words, logp)
    for w, g in zip(words, got):
        total = sum(math.exp(sum(logp[i] for i in s)) for s in segmentations(pieces, m.MARK + w))
        assert g == pytest.approx(math.log10(total), abs=1e-9)


def test_expected_counts_equal_enumeration(small):
    pieces, lattice, logp = small
    words, counts = [b"abab", b"ba"], np.array([2.0, 3.0])
    want = np.zeros(len(pieces))
    for w, c in zip(words, counts):
        every = [(math.exp(sum(logp[i] for i in s)), s) for s in segmentations(pieces, m.MARK + w)]
        total = sum(p for p, _ in every)
        for p, s in every:
            for i in s:
                want[i] += c * p / total
    assert np.allclose(lattice.expected(words, counts, logp), want)


def test_words_beyond_a_run_and_long_words(small):
    _, lattice, logp = small
    one = lattice.log10([b"ab" * 500], logp)[0]
    assert np.allclose(lattice.log10([b"ab" * 500] * 600, logp), one)


def test_document_probability_is_the_urn(small):
    logp = np.log(np.array([0.1, 0.5, 0.4]))
    got = m.document_log10(np.array([1, 1, 2, 1, 0]), logp)
    want, seen = 0.0, Counter()
    for i, w in enumerate([1, 1, 2, 1, 0]):
        want += math.log10((seen[w] + m.STRENGTH * math.exp(logp[w])) / (i + m.STRENGTH))
        seen[w] += 1
    assert got == pytest.approx(want)


def test_base_counts_equal_brute_force(make_docs):
    texts = EDGE_TEXTS + [" ".join(prose(i, 50, 80)) for i in range(30)]
    ids = EDGE_IDS + list(range(100, 130))
    got = m.score(make_docs(texts, ids, **CLASHES), m.default_pieces()).collect()
    assert len(got) == len(texts)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) + [None] for t in texts]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), h, len(t), sum(c[w] > 0 for w in t), n,
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, h, t in zip(ids, held, tokens))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_words_handed_on_twice_count_once(make_docs, monkeypatch):
    monkeypatch.setattr(m, "HELD_WORDS", 100)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10][:1200]
    texts = [" ".join(prose(i, 40, 60)) for i in train] + [" ".join(prose(i, 20, 60)) + f" new{i} other{i}" for i in held]
    got = m.score(make_docs(texts, train + held).coalesce(1), m.default_pieces()).where("held_out").collect()
    tokens = {i: t.split() + [None] for i, t in zip(train + held, texts)}
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in got) == \
        [(i, 21, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i]), 6)) for i in held]


def test_probabilities_of_words_sum_to_at_most_one(small):
    pieces, lattice, logp = small
    words = [bytes([a]) for a in range(33, 127)] + [bytes([a, b]) for a in range(33, 127) for b in range(33, 127)]
    c = np.where(np.arange(len(words)) % 7 == 0, 3.0, 0.0)
    p = m.word_log(c, lattice.log10(words, logp), int(c.sum()), int((c > 0).sum()))
    assert np.exp(p).sum() < 1


def test_empty_table_and_no_training_rows(make_docs):
    assert m.score(make_docs([]), m.default_pieces()).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = m.score(make_docs(["some words"], [held]), m.default_pieces()).collect()[0]
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


def test_all_words_are_numbered_at_once():
    texts = ["Ab c\td", None, "", " \n", "c c \u00fcx\x0bAB", "zz \u4e2d zz"]
    texts = [None if v is None else v.encode() for v in texts]
    listed = [b"c", b"ab", b"unused"]
    got, others = m.numbered(texts, listed)
    every = listed + others
    assert [[every[i] for i in own.tolist()] for own in got] == [space_words(v) for v in texts]
    assert others == [b"d", "\u00fcx".encode(), b"zz", "\u4e2d".encode()]
    assert m.numbered([], listed) == ([], []) and [len(v) for v in m.numbered([None], [])[0]] == [0]


def test_steps_lead_along_the_pieces():
    pieces = [b"ab", b"abc", b"b", b"\xffz"] + [bytes([b]) for b in range(256)]
    laid = m.Lattice(pieces)
    row, to = laid.steps()
    for piece, number in zip(pieces[:4], range(4)):
        node = 0
        for b in piece:
            node = int(to[row[node] * 256 + b])
            assert node > 0
        assert laid.piece[node] == number
    assert (to[row[node] * 256:][:256] == -1).all()           # behind the end of a piece that none goes on from
    assert int((to >= 0).sum()) == len(laid.keys)
