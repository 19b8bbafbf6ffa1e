"""Word splitting and word hashing shared by the operators (task-side helpers).

Two word definitions occur: white-space words (``[^\\x20\\x09-\\x0D]+``) and
alphanumeric words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
A-Z).  Both work on UTF-8 bytes, where every non-ASCII byte is a word byte.
A null text has no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_UPPER = bytes(range(65, 91))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cases A-Z and turns every byte that is not a digit, letter or non-ASCII into a space.
ALNUM = bytes(b if b in range(48, 58) or b in range(97, 123) or b > 127 else b + 32 if b in _UPPER else 32
              for b in range(256))
#: The white space of the word definition.
SPACES = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and turns white space into spaces.
SPACED = LOWER.translate(bytes.maketrans(SPACES, b" " * len(SPACES)))

_K = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
               0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3],
              dtype=np.uint64)
#: Words hashed at once; longer texts go chunk by chunk.
CHUNK_WORDS = 1 << 17
#: Longer spans are hashed one by one.
LONG_SPAN = 1 << 10


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (null stays None)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def space_words(text: bytes | None, lower: bool = True) -> list[bytes]:
    if not text:
        return []
    return (text.translate(LOWER) if lower else text).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a fresh array)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of buf; spans ascend and don't overlap. Eight bytes at a time go into a state that is
    scrambled before the next ones, so no sum or difference of bytes is kept by it; other seeds give independent
    hashes."""
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    base, lens = int(starts[0]), ends - starts
    region = np.concatenate([buf[base:int(ends[-1])], np.zeros(8, dtype=np.uint8)])
    blocks = np.ndarray(len(region) - 7, dtype="<u8", buffer=region, strides=(1,))
    state = mix(lens.astype(np.uint64) * _K[seed % len(_K)] + _K[(seed + 3) % len(_K)])
    at, left = starts - base, lens.copy()
    for i in np.flatnonzero(lens > LONG_SPAN):
        whole = hashlib.blake2b(region[at[i]:at[i] + lens[i]].tobytes(), digest_size=8, salt=bytes([seed]))
        state[i], left[i] = int.from_bytes(whole.digest(), "little"), 0
    rows = np.flatnonzero(left > 0)
    while len(rows):
        tail = np.minimum(left[rows], 8)
        block = blocks[at[rows]] << (8 * (8 - tail)).astype(np.uint64)
        state[rows] = mix((state[rows] ^ block) * _K[(seed + 1) % len(_K)])
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] > 0]
    return state


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    out = []
    for i in range(0, len(words), CHUNK_WORDS):
        part = words[i:i + CHUNK_WORDS]
        buf = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
        ends = np.flatnonzero(buf == 32)
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        out.append(hash_spans(buf, starts, ends))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of so many consecutive words (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n] * _K[0]
    for j in range(1, width):
        out += hashes[j:n + j] * _K[j % len(_K)] + np.uint64(j)
    return mix(out)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle; none without words."""
    words = space_words(text)
    hashes = word_hashes(words)
    if 0 < len(words) < width:
        return window_hashes(hashes, len(words)) + np.uint64(len(words))
    return np.unique(window_hashes(hashes, width))


def shingle_sets(run: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """``shingle_set`` of each text; the words of all are hashed together."""
    parts = [t.translate(SPACED) if t else b"" for t in run]
    buf = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    turn = np.flatnonzero(np.diff(buf != 32))                # where words begin and end, in turn
    starts, ends = turn[::2] + 1, turn[1::2] + 1
    hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(
        hash_spans(buf, starts[i:i + CHUNK_WORDS], ends[i:i + CHUNK_WORDS]) for i in range(0, len(starts), CHUNK_WORDS))])
    windows = window_hashes(hashes, width)
    behind = np.cumsum([len(p) + 1 for p in parts])          # the space behind each text
    cuts = np.concatenate([[0], np.searchsorted(starts, behind)]).tolist()
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if 0 < b - a < width:
            out.append(window_hashes(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.unique(windows[a:max(b - width + 1, a)]))
    return out
