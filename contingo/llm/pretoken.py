"""Vectorised pre-tokenisation for byte-level BPE, and distinct words of a batch.

The pre-tokeniser splits a text into contractions, runs of letters, of
numbers and of other signs (each with one leading blank), and white space
(a run before a word leaves its last character to that word's side).  A text
that holds an apostrophe or a special token goes through the pattern itself;
all others are split by comparing the character classes of neighbours.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from contingo.llm.words import hash_spans

#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Words hashed at once.
HASH_AT_ONCE = 100_000


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, len(out))])
    every, kinds = points.astype("<u4").tobytes().decode("utf-32-le"), np.zeros(len(points), dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):       # a few thousand runs, not a million characters
            kinds[run.start():run.end()] = kind
    out[points] = kinds
    return out


def _starts(points: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point (no apostrophes)."""
    n = len(points)
    kind = char_classes()[points]
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == SPACE
    last = np.zeros(n, dtype=bool)                       # last white space before a word
    last[:-1] = space[:-1] & ~space[1:]
    start |= last                                        # a run before a word leaves its last character
    led = np.zeros(n, dtype=bool)                        # words led by one blank don't start anew
    led[1:] = last[:-1] & (points[:-1] == 32)
    return start & ~led


class Words:
    """The words of a batch of texts: distinct ones, and for each text the indices of its words in order."""

    def __init__(self, texts: list[bytes], specials: tuple[str, ...] = ()):
        found: list[np.ndarray] = []                     # byte lengths of each text's words
        split = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        for t in texts:
            if not t:
                found.append(np.zeros(0, dtype=np.int64))
            elif b"'" in t or any(s.encode() in t for s in specials):
                found.append(np.array([len(w.encode()) for w in self._slow(t.decode(), split)], dtype=np.int64))
            else:
                buf = np.frombuffer(t, dtype=np.uint8)
                if t.isascii():
                    at = np.flatnonzero(_starts(buf))
                else:
                    lead = np.flatnonzero((buf & 0xC0) != 0x80)
                    at = lead[_starts(np.frombuffer(t.decode().encode("utf-32-le"), dtype=np.uint32))]
                found.append(np.diff(at, append=len(t)))
        self.counts = np.array([len(x) for x in found], dtype=np.int64)
        lens = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        self.buf = np.frombuffer(b"".join(t for t in texts if t), dtype=np.uint8)
        ends = np.cumsum(lens)
        starts = ends - lens
        keys = np.concatenate([hash_spans(self.buf, starts[i:i + HASH_AT_ONCE], ends[i:i + HASH_AT_ONCE])
                               for i in range(0, max(len(lens), 1), HASH_AT_ONCE)])
        self._group(keys, starts, lens)
        if len(lens) and not self._same(starts, lens):
            self._group(self._exact(starts, lens), starts, lens)
        self.checks = np.zeros(0, dtype=np.uint64) if not len(self.keys) else self._checks()

    def _group(self, keys: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        self.index, self.keys = pd.factorize(keys)
        first = np.empty(len(self.keys), dtype=np.int64)
        first[self.index[::-1]] = np.arange(len(keys) - 1, -1, -1)
        self.first_start, self.first_end = starts[first], starts[first] + lens[first]

    def _same(self, starts: np.ndarray, lens: np.ndarray) -> bool:
        """Whether each word is its representative, byte by byte (some words at a time)."""
        rep = self.first_start[self.index]
        if not np.array_equal(lens, (self.first_end - self.first_start)[self.index]):
            return False
        other = np.flatnonzero(rep != starts)
        padded = np.concatenate([self.buf, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
        for i in range(0, len(other), HASH_AT_ONCE):         # eight bytes of every word, then of the longer ones
            part = other[i:i + HASH_AT_ONCE]
            own, first, left = starts[part], rep[part], lens[part]
            while len(left):
                unlike = eight[own] ^ eight[first]
                if (unlike << (8 * (8 - np.minimum(left, 8))).astype(np.uint64)).any():
                    return False
                more = np.flatnonzero(left > 8)
                own, first, left = own[more] + 8, first[more] + 8, left[more] - 8
        return True

    def _exact(self, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Keys by the words themselves, for a batch in which two words share a hash."""
        data, seen = self.buf.tobytes(), {}
        number = [seen.setdefault(data[a:a + n], len(seen)) for a, n in zip(starts.tolist(), lens.tolist())]
        keys = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in seen], dtype=np.uint64)
        while len(np.unique(keys)) < len(keys):
            again = np.setdiff1d(np.arange(len(keys)), np.unique(keys, return_index=True)[1])
            keys[again] += np.uint64(1)
        return keys[np.array(number, dtype=np.int64)]

    def _checks(self) -> np.ndarray:
        """A second, independent hash of each distinct word."""
        order = np.argsort(self.first_start, kind="stable")
        out = np.empty(len(order), dtype=np.uint64)
        for i in range(0, len(order), HASH_AT_ONCE):
            part = order[i:i + HASH_AT_ONCE]
            out[part] = hash_spans(self.buf, self.first_start[part], self.first_end[part], seed=5)
        return out

    @staticmethod
    def _slow(text: str, split) -> list[str]:
        if split is None:
            return PATTERN.findall(text)
        out, at = [], 0
        for m in split.finditer(text):
            out += PATTERN.findall(text[at:m.start()]) + [m.group()]
            at = m.end()
        return out + PATTERN.findall(text[at:])

    def __len__(self) -> int:
        return len(self.keys)

    def distinct(self, which: np.ndarray) -> list[bytes]:
        data = self.buf.tobytes()
        return [data[a:b] for a, b in zip(self.first_start[which].tolist(), self.first_end[which].tolist())]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lens[i] - 1 of all i, one after another."""
    total = int(lens.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


class IdCache:
    """Ids of words already encoded, by two word hashes; emptied when it holds more than ``most`` words or two words
    share the first one.
    ``specials`` are words with an id of their own."""

    def __init__(self, encode, specials: dict[bytes, int], most: int = 400_000):
        self.encode, self.specials, self.most = encode, specials, most
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.checks = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.len = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = [i for i, w in enumerate(words) if w in self.specials]
        flat, lens = self.encode([w for w in words if w not in self.specials] if own else words)
        for i in own:
            flat = np.insert(flat, int(lens[:i].sum()), self.specials[words[i]])
            lens = np.insert(lens, i, 1)
        return flat, lens

    def lookup(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Start and length, in ``flat``, of the ids of each distinct word."""
        order = np.argsort(words.keys)                       # looked up in order: neighbours in memory
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.searchsorted(self.keys, words.keys[order])
        known = np.zeros(len(words), dtype=bool)
        other = False
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            known = self.keys[at] == words.keys
            other = bool((known & (self.checks[at] != words.checks)).any())
        if len(self.keys) and (other or len(self.keys) + int((~known).sum()) > self.most):
            self._empty()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            flat, lens = self._encode(words.distinct(new))
            keys = np.concatenate([self.keys, words.keys[new]])
            start = np.concatenate([self.start, len(self.flat) + np.cumsum(lens) - lens])
            every = np.concatenate([self.len, lens])
            checks = np.concatenate([self.checks, words.checks[new]])
            by_key = np.argsort(keys, kind="stable")
            self.keys, self.checks, self.start, self.len = keys[by_key], checks[by_key], start[by_key], every[by_key]
            self.flat = np.concatenate([self.flat, flat])
            at[order] = np.searchsorted(self.keys, words.keys[order])
        return self.start[at], self.len[at]


def encode_texts(texts: list[bytes], cache: IdCache, specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after another, and each text's number of ids."""
    words = Words(texts, specials)
    start, lens = cache.lookup(words)
    each = lens[words.index]
    ids = cache.flat[ragged(start[words.index], each)]
    ends = np.concatenate([[0], np.cumsum(each)])
    bounds = ends[np.concatenate([[0], np.cumsum(words.counts)])]
    return ids, np.diff(bounds)


def special_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def batches_of(texts: list[bytes | None], most_bytes: int = 1 << 20):
    """Runs (first, end) of texts of about so many bytes together; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > first and size + n > most_bytes:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
