import hashlib
import random
import zlib

import numpy as np
import pytest

from contingo.llm import bpe, tokenfile
from contingo.llm.pretoken import IdCache, Words, encode_texts
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS

ALPHABET = " \t\n\r  ab1é中²Ⅷ.!'ś😀\x85\x1ctheingrst"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.Vocabulary(f.read())


def random_texts(n):
    r = random.Random(5)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(n)]
    return made + ["it's <|endoftext|> 'll x", "<|endoftext|>", "  ", "\n\n a", "a" * 3000, "the" * 200, "ab" * 500, "don't 's''s"]


def test_ids_and_text_equal_the_library(library, vocabulary):
    texts = random_texts(3000)
    cache = IdCache(lambda w: vocabulary.encode_words(w)[:2], {b"<|endoftext|>": 50256}, most=500)
    at = 0
    ids, counts = encode_texts([t.encode() for t in texts], cache, tuple(vocabulary.specials))
    for t, n in zip(texts, counts.tolist()):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at:at + n].tolist() == want, t
        assert vocabulary.decode(ids[at:at + n]) == library.decode(want, skip_special_tokens=False) == t
        at += n


def test_incompatible_neighbours_fail_and_are_merged_exactly(vocabulary):
    words = [w for w in Words([" ".join(random_texts(500)).replace("'", "").encode()]).distinct(np.arange(300))]
    _, _, redone = vocabulary.encode_words(words)
    assert 0 < redone < len(words)


def test_exact_paths_agree(vocabulary):
    words = [t.encode() for t in random_texts(200) if t]
    flat, lens = vocabulary.exact(words)
    ends = np.cumsum(lens)
    for w, e, n in zip(words, ends, lens):
        assert flat[e - n:e].tolist() == vocabulary._exact_long(list(w))


def test_frame_with_edge_rows(make_docs, library):
    docs = make_docs(EDGE_TEXTS, EDGE_IDS, **CLASHES)
    got = bpe.encode_decode(docs, bpe.default_vocabulary()).collect()
    want = sorted((str(i), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes())
                   .hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(EDGE_IDS, EDGE_TEXTS))
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in got)
    assert bpe.encode_decode(make_docs([]), bpe.default_vocabulary()).count() == 0


def test_files_round_trip(spark, make_docs, library, tmp_path):
    ids = [9, 3, None, 3, 7, 1, 100, 2, 50, 60, 70]
    docs = make_docs(EDGE_TEXTS, ids, **CLASHES)
    path = str(tmp_path / "ids")
    tokenfile.write_ids(docs, path, bpe.default_vocabulary())
    got = sorted(tokenfile.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i))
    start = 0
    left = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
            for i, t in zip(ids, EDGE_TEXTS)]
    for r in got:
        assert r.start == start and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        left.remove((r.doc_id, bytes(r.ids)))
        start += r.n_tokens
    assert not left
    some = tokenfile.read_ids(spark, path, [7, 3, 12345]).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 7]
    assert {r.start for r in some} <= {r.start for r in got}


def test_files_of_an_empty_table(spark, make_docs, tmp_path):
    tokenfile.write_ids(make_docs([]), str(tmp_path / "none"), bpe.default_vocabulary())
    assert tokenfile.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_damaged_dictionary_is_refused(spark, make_docs, tmp_path):
    path = str(tmp_path / "ids")
    tokenfile.write_ids(make_docs(["one text", "two texts"]), path, bpe.default_vocabulary())
    spark.createDataFrame([(bytearray(b"other"), hashlib.sha256(b"other").hexdigest(), 2)],
                          "dictionary binary, sha256 string, id_bytes int").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tokenfile.read_ids(spark, path).collect()


def test_ids_of_single_words_by_the_librarys_model(library):
    """The vocabulary's words go to the library's model one by one; ids are those of the whole texts."""
    import json
    with open(bpe.default_vocabulary(), "rb") as f:
        content = f.read()
    assert tokenfile.plain(json.loads(content))
    assert not tokenfile.plain({**json.loads(content), "normalizer": {"type": "NFC"}})
    texts = random_texts(1500) + ["", bytes(range(128)).decode(), "".join(map(chr, range(128, 900)))]
    found = list(tokenfile._id_arrays([t.encode() for t in texts], content, 0))
    for t, ids in zip(texts, found):
        assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], t


def test_words_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    """Whatever part of two words differs, they are not taken for one word."""
    from contingo.llm import pretoken
    monkeypatch.setattr(pretoken, "hash_spans", lambda buf, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    for a, b in (("abcd", "abce"), ("x" * 8 + "y", "x" * 8 + "z"), ("x" * 20, "x" * 15 + "yxxxx"), ("a", "b")):
        words = Words([f"{a}\n{b}\n{a}".encode()])
        assert words.distinct(words.index) == [w.encode() for w in (a, "\n", b, "\n", a)]
