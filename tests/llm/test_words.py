"""Word identity: hashes, and what must hold when hashes collide."""
import hashlib

import numpy as np
import pytest

from contingo.llm import bpe, jaccard, pretoken, quality, words


def thue_morse(n):
    """The two words of 2^n letters whose sums of byte * base^i agree modulo 2^64 for odd bases, from n = 10."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


TM = [f"x{w}x" for w in thue_morse(11)] + list(thue_morse(10))


def hashes(ws):
    return words.word_hashes([w.encode() for w in ws])


def test_hashes_of_constructed_words_differ():
    for n in range(1, 13):
        a, b = hashes(thue_morse(n))
        assert a != b
    assert len(set(hashes(TM).tolist())) == 4


def test_hash_depends_on_the_word_alone_and_on_every_byte():
    ws = [b"a", b"b", b"ab", b"ba", b"abcdefgh", b"abcdefgi", b"abcdefghi", b"a" * 9, b"a" * 10, b"a" * 1024, b"a" * 1025, b"\x00a"]
    alone = [int(words.word_hashes([w])[0]) for w in ws]
    buf = np.frombuffer(b"".join(ws), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in ws])
    for seed in (0, 5):
        together = words.hash_spans(buf, ends - [len(w) for w in ws], ends, seed)
        assert len(set(together.tolist())) == len(ws)
        if not seed:
            assert together.tolist() == alone


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """With a hash of only two values everything still comes out right."""
    monkeypatch.setattr(pretoken, "hash_spans", lambda buf, starts, ends, seed=0: ((ends - starts) % 2).astype(np.uint64)
                        if not seed else words.hash_spans(buf, starts, ends, seed))
    encode = lambda ws: (np.array([x for w in ws for x in w], dtype=np.uint32), np.array([len(w) for w in ws]))
    cache = pretoken.IdCache(encode, {})
    for batch in ([b"ab cd ef ab", b"xy"], [b"cd zz", b"a b c"], [b"ab cd"]):
        ids, n = pretoken.encode_texts(batch, cache, ())
        assert bytes(ids.astype(np.uint8)) == b"".join(batch) and n.tolist() == [len(t) for t in batch]


def test_shingles_of_constructed_words_differ():
    a, b = (jaccard.fingerprint(words.shingle_set(f"one two {w} four five six".encode())) for w in TM[:2])
    assert a[0] != b[0] and a[1] != b[1]


def test_operators_on_constructed_words(make_docs):
    tokenizers = pytest.importorskip("tokenizers")
    texts = [*TM, " ".join(TM), *[f"one two {w} four five six seven" for w in TM[:2]]]
    path = bpe.default_vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_decode(make_docs(texts), path).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
    judged = {r.doc_id: r.n_repeat_words for r in quality.judge(make_docs([" ".join(TM[:2] * 3)]), order=list(quality.RULES)).collect()}
    assert judged == {0: 6}


def test_shingle_sets_of_a_run_equal_those_of_single_texts():
    from contingo.llm.words import shingle_set, shingle_sets
    from tests.llm.conftest import EDGE_TEXTS
    run = [None if t is None else t.encode() for t in EDGE_TEXTS] + [b"A b\tC\x0bd\x0ce\rf", b" lead", b"trail \n", b"\x00\x1f a"]
    for width in (1, 2, 5):
        for some in (run, run[::-1], run[:1], []):
            got = shingle_sets(some, width)
            assert len(got) == len(some) and all(np.array_equal(s, shingle_set(t, width)) for s, t in zip(got, some))
