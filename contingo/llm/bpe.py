"""Byte-level BPE by speculate and verify.

For the distinct words of a batch, a vectorised trie walk finds the longest
vocabulary token at every byte, and hopping from token to token proposes a
segmentation.  A proposal equals the merge procedure's result exactly when
every token is what its own bytes merge to and no pair of neighbours would
have merged across their border.  Both are checked on arrays: at a border the
last merges on either side are undone in reverse order of rank, and the
border holds if no pair that once met there has a merge that came earlier
than the next merge on either side (or as early, on the right: equal merges
go from left to right).  Only words with a failing pair are merged exactly.

Decoding concatenates the tokens' bytes.

Defined results: a null or empty text has no ids and decodes to the empty
text; special tokens' strings become their ids; repeated rows, null ids and
extra columns are kept row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contingo.llm.cluster import lean, small_batches
from contingo.llm.pretoken import IdCache, batches_of, encode_texts, ragged
from contingo.llm.words import texts

#: Largest vocabulary file that is sent to the tasks.
MAX_VOCABULARY_BYTES = 64 << 20
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable Latin-1 characters
    stand for themselves, the other bytes in ascending order for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file. Inside, a token is a byte (0 to 255) or 256 + its merge's rank."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        token_bytes: list[bytes] = [bytes([b]) for b in range(256)]
        inner = {letter: b for letter, b in letters.items()}
        left, right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = inner[a], inner[b]
            inner.setdefault(a + b, len(token_bytes))
            self.merge.setdefault((x, y), len(token_bytes))
            left.append(x)
            right.append(y)
            token_bytes.append(token_bytes[x] + token_bytes[y])
        self.token_bytes = token_bytes
        self.left, self.right = np.array(left), np.array(right)
        self.ids = np.zeros(len(token_bytes), dtype=np.uint32)
        for text, i in ids.items():
            if text in inner:
                self.ids[inner[text]] = i
        self.bytes_of = {int(i): t for i, t in zip(self.ids, token_bytes)}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        keys = np.array([x << 32 | y for x, y in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array(list(self.merge.values()), dtype=np.int64)[order]
        self._trie()
        self.whole = self.exact(token_bytes)[1] == 1

    def _trie(self) -> None:
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for t, data in enumerate(self.token_bytes):
            at = 0
            for b in data:
                nxt = nodes.get((at, b))
                if nxt is None:
                    nxt = nodes[at, b] = len(token)
                    token.append(-1)
                at = nxt
            if token[at] < 0:
                token[at] = t
        keys = np.array([n << 8 | b for n, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.step_keys, self.step_to = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.node_token = np.array(token, dtype=np.int64)
        self.root = np.array([nodes[0, b] for b in range(256)], dtype=np.int64)

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The merge procedure (again and again the earliest merge, leftmost first) on many words at once:
        tokens of all words, one after another, and each word's number of tokens."""
        out: list[list[int] | np.ndarray] = [self._exact_long(list(w)) if len(w) > 48 else [] for w in words]
        short = [i for i, w in enumerate(words) if len(w) <= 48]
        parts = np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8).astype(np.int64)
        owner = np.repeat(np.array(short, dtype=np.int64), [len(words[i]) for i in short])
        done_parts, done_owner = [], []
        while len(parts):
            keys = parts[:-1] << 32 | parts[1:]
            i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.full(len(parts), NONE)
            ok = (self.pair_keys[i] == keys) & (owner[:-1] == owner[1:])
            rank[:-1][ok] = self.pair_rank[i[ok]]
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(parts)))
            ended = best == NONE
            done_parts.append(parts[ended])
            done_owner.append(owner[ended])
            hit = (rank == best) & ~ended
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            hit &= (run & 1) == 1                        # of overlapping hits (aaa) every other one, from the left
            parts = np.where(hit, best, parts)
            keep = ~ended
            keep[1:] &= ~hit[:-1]
            parts, owner = parts[keep], owner[keep]
        if done_parts:
            flat, of = np.concatenate(done_parts), np.concatenate(done_owner)
            flat = flat[np.argsort(of, kind="stable")]
            for i, part in zip(short, np.split(flat, np.cumsum(np.bincount(of, minlength=len(words))[short])[:-1])):
                out[i] = part
        lens = np.array([len(x) for x in out], dtype=np.int64)
        return np.concatenate([np.asarray(x, dtype=np.int64) for x in out]) if out else lens, lens

    def _exact_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.merge.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or self.merge.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := self.merge.get((r, parts[after[j]]))) is not None:
                    heapq.heappush(heap, (q, i))
            if before[i] >= 0 and (q := self.merge.get((parts[before[i]], r))) is not None:
                heapq.heappush(heap, (q, before[i]))
        return [p for p in parts if p >= 0]

    def longest(self, buf: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The longest token at each byte that doesn't pass its word's end (room: bytes left in the word)."""
        node = self.root[buf]
        found = self.node_token[node]
        at = np.flatnonzero(room > 1)
        node, depth = node[at], 1
        while len(at):
            keys = node << 8 | buf[at + depth]
            i = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
            ok = self.step_keys[i] == keys
            at, node = at[ok], self.step_to[i[ok]]
            t = self.node_token[node]
            found[at[t >= 0]] = t[t >= 0]
            depth += 1
            go = room[at] > depth
            at, node = at[go], node[go]
        return found

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the neighbours x, y stay apart (see the module's text)."""
        good = np.ones(len(x), dtype=bool)
        at, x, y, limit = np.arange(len(x)), x.copy(), y.copy(), np.full(len(x), NONE)
        while len(at):
            keys = x << 32 | y
            i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[i] == keys) & (self.pair_rank[i] < limit)
            good[at[crossed]] = False
            go = ~crossed & ((x > 255) | (y > 255))
            at, x, y, limit = at[go], x[go], y[go], limit[go]
            undo_left = x > y
            limit = np.where(undo_left, x, y + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of the words, one after another; each word's number of ids; how many words were merged exactly."""
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lens)
        word_of = np.repeat(np.arange(len(words)), lens)
        token_len = np.array([len(t) for t in self.token_bytes])
        best = self.longest(buf, ends[word_of] - np.arange(len(buf)))
        taken = np.zeros(len(buf) + 1, dtype=bool)
        at, end = ends - lens, ends
        while len(at):
            taken[at] = True
            at = at + token_len[best[at]]
            go = at < end
            at, end = at[go], end[go]
        where = np.flatnonzero(taken[:-1])
        tokens, owner = best[where], word_of[where]
        failed = np.zeros(len(words), dtype=bool)
        failed[owner[~self.whole[tokens]]] = True
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, inverse = np.unique(tokens[border] << 32 | tokens[border + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed[owner[border[bad[inverse]]]] = True
        counts = np.bincount(owner, minlength=len(words))
        redo = np.flatnonzero(failed)
        again, again_len = self.exact([words[i] for i in redo])
        flat_len = counts.copy()
        flat_len[redo] = again_len
        flat = np.zeros(int(flat_len.sum()), dtype=np.uint32)
        first = np.cumsum(flat_len) - flat_len
        flat[ragged(first[~failed], flat_len[~failed])] = self.ids[tokens[~failed[owner]]]
        flat[ragged(first[redo], again_len)] = self.ids[again]
        return flat, flat_len, len(redo)

    def decode(self, ids: np.ndarray) -> str:
        get = self.bytes_of
        return b"".join([get[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(content: bytes) -> tuple[Vocabulary, IdCache]:
    vocabulary = Vocabulary(content)
    return vocabulary, IdCache(lambda words: vocabulary.encode_words(words)[:2],
                               {s.encode(): i for s, i in vocabulary.specials.items()})


def shared_file(spark: SparkSession, path: str):
    """A small file of the driver, sent to the tasks once (its size is checked)."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                  keep_ids: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_tokens, the ids (little-endian unsigned 32-bit, if kept), the hash
    of the ids, and the hash and equality of the text decoded from them."""
    small_batches(docs.sparkSession)
    content = shared_file(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cache = _loaded(content.value)
        for batch in batches:
            every = [t or b"" for t in texts(batch.column(1))]
            for a, b in batches_of(every):
                ids, counts = encode_texts(every[a:b], cache, tuple(words.specials))
                ends = np.cumsum(counts)
                ids = ids.astype("<u4")
                parts = [ids[e - n:e] for e, n in zip(ends.tolist(), counts.tolist())]
                raw = [p.tobytes() for p in parts]
                back = [words.decode(p).encode() for p in parts]
                out = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(counts, type=pa.int64()),
                       "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], type=pa.string()),
                       "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], type=pa.string()),
                       "round_trip": pa.array([x == t for x, t in zip(back, every[a:b])], type=pa.bool_())}
                if keep_ids:
                    out["ids"] = pa.array(raw, type=pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, "
                                "round_trip boolean" + ", ids binary" * keep_ids)


def op6_bpe_encode_decode(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, vocabulary or default_vocabulary(), keep_ids=False)
