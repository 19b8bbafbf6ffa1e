"""Benchmark decontamination with an FM-index for each shard of training documents.

Test phrases are windows of consecutive words of the benchmark items.  A
shard is a run of documents in one task.  Its text for the index keeps only
what a phrase can match: words outside the phrases' vocabulary, and stretches
of vocabulary words shorter than the shortest phrase, become one separator
that no phrase holds.  Over that text the shard gets a suffix array, the
Burrows-Wheeler transform, a wavelet matrix for ranks and the suffix
positions sampled at every 16th text position.  All phrases are searched
backwards at once; occurrences are located by walking to a sampled position;
the word spans of the hits are merged.

The benchmark is a stated query set: it goes to the tasks in blocks of
bounded size, one pass over the documents for each block.

Defined results: a null or blank text, or one without words, has no hits;
repeated rows are judged one by one; items of the same text all count; null
item ids are left out of the lists; an empty benchmark hits nothing; other
columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contingo.llm.cluster import cut, lean, small_batches
from contingo.llm.pretoken import ragged
from contingo.llm.words import ALNUM, alnum_words, texts

WINDOW = 10
#: Bytes of benchmark text in a block, at most (a longer item is a block of its own).
BLOCK_BYTES = 2 << 20
#: Symbols that one index covers, at most about.
SHARD_SYMBOLS = 1 << 20
SAMPLE = 16
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in ascending order, by doubling the compared length until all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    ordered = text[order]
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    width = 1
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, dtype=np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        width *= 2
    return order


class WaveletMatrix:
    """Ranks over a sequence of symbols below 2 ** levels: one bit row a level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        first = np.zeros(len(at), dtype=np.int64)
        at = at.astype(np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - i)) & 1 == 1
            first = np.where(bit, zeros + ones[first], first - ones[first])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - first


class FMIndex:
    """Text symbols are 1 .. sigma - 1; 0 ends the text."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        counts = np.bincount(text, minlength=sigma)
        self.before = np.cumsum(counts) - counts
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(sigma - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each phrase (one a row, all of the same length)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items as rows of vocabulary symbols (2 and up; 1 separates)."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        by_width: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = alnum_words(text)
            codes = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words]
            size = min(width, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                by_width.setdefault(size, {}).setdefault(tuple(codes[i:i + size]), set()).add(item)
        self.rows = {w: np.array(list(p), dtype=np.int64) for w, p in by_width.items()}
        self.items = {w: [sorted(x for x in s if x is not None) for s in p.values()] for w, p in by_width.items()}
        self.shortest = min(self.rows, default=0)

    def reduced(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words; the symbols that a phrase can match, in order, and the word position of each."""
        if not text:
            return 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        words = text.translate(ALNUM).split()
        get = self.symbol.get
        codes = np.array([get(w, 1) for w in words], dtype=np.int64)
        edge = np.flatnonzero(np.diff(codes == 1, prepend=True, append=True))
        first, last = edge[::2], edge[1::2]              # stretches of vocabulary words
        long = last - first >= self.shortest
        first, size = first[long], (last - first)[long]
        at = ragged(first, size + 1)                     # each with the separator that follows it
        out = np.append(codes, 1)[at]
        out[np.cumsum(size + 1) - 1] = 1
        return len(words), out, at


def search_shard(phrases: Phrases, docs: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list]]:
    """For each document of a shard its number of words, merged word spans (first, last) of hits, and items."""
    reduced = [phrases.reduced(t) for t in docs]
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    held, size = [], 0
    for i, (_, symbols, _) in enumerate(reduced):
        if len(symbols):
            held.append(i)
            size += len(symbols)
        if held and (size >= SHARD_SYMBOLS or i == len(reduced) - 1):
            _search(phrases, held, reduced, spans, items)
            held, size = [], 0
    return [(r[0], s, sorted(x)) for r, s, x in zip(reduced, spans, items)]


def _search(phrases: Phrases, held: list[int], reduced: list, spans: list, items: list) -> None:
    ends = np.cumsum([len(reduced[i][1]) for i in held])
    position = np.concatenate([reduced[i][2] for i in held])
    index = FMIndex(np.concatenate([reduced[i][1] for i in held]), len(phrases.symbol) + 2)
    owners, firsts, lasts = [], [], []
    for width, rows in phrases.rows.items():
        low, high = index.search(rows)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        at = index.locate(ragged(low[found], count))
        owner = np.searchsorted(ends, at, side="right")
        for o, p in np.unique(np.stack([owner, np.repeat(found, count)]), axis=1).T.tolist():
            items[held[o]].update(phrases.items[width][p])
        owners.append(owner)
        firsts.append(position[at])
        lasts.append(position[at] + width - 1)
    for o, a, b in zip(*(x.tolist() for x in _merged(*map(np.concatenate, (owners, firsts, lasts))))):
        spans[held[o]].append((a, b))


def _merged(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same owner that overlap or touch become one."""
    order = np.lexsort((first, owner))
    owner, first, last = owner[order], first[order], last[order]
    if not len(owner):
        return owner, first, last
    shift = owner.astype(np.int64) * (int(last.max()) + 3)
    reach = np.maximum.accumulate(last + shift)
    starts = np.flatnonzero(np.concatenate([[True], first[1:] + shift[1:] > reach[:-1] + 1]))
    return owner[starts], first[starts], np.maximum.reduceat(last, starts)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    a, b = np.array(spans, dtype=np.int64).reshape(-1, 2).T
    return [(x, y) for _, x, y in zip(*(z.tolist() for z in _merged(np.zeros(len(a), dtype=np.int64), a, b)))]


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; one blank stays in their place."""
    if not spans:
        return text
    buf = np.frombuffer(text.translate(ALNUM), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(buf != 32, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:starts[a]].rstrip(b" "))
        at = int(ends[b])
    return b" ".join([*out, text[at:].lstrip(b" ")]).strip(b" ")


def item_blocks(benchmark: DataFrame, id_col: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list]:
    """The benchmark's (id as text, text) in blocks of bounded size, one after another on the driver; one empty
    block if there are no items."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text).alias("text")) \
        .where(F.col("text").isNotNull())
    held, size = [], 0
    for r in rows.toLocalIterator():
        data = r.text.encode()
        if held and size + len(data) > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, data))
        size += len(data)
    yield held


def find_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", prefix: str = "hit", width: int = WINDOW, remove: bool = False) -> DataFrame:
    """The documents with three more columns: <prefix>_words (number of words), <prefix>_spans (merged word
    spans, first and last inclusive) and <prefix>_items (sorted item ids as strings). Columns of these names are
    replaced. With ``remove`` instead the documents with the spans cut out of their texts, columns as before; the
    last block's search does that, as a Python step of its own would keep a second worker for each core."""
    names = [f"{prefix}_words", f"{prefix}_spans", f"{prefix}_items"]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()),
                           T.StructField(names[1], SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))])
    names_before, docs_schema = docs.columns, docs.schema
    at, n = names_before.index(text), len(names_before)
    spark = docs.sparkSession
    small_batches(spark, 4000)
    out = None
    blocks = item_blocks(benchmark, item_id, item_text)
    following = next(blocks)                              # there is at least one
    while following is not None:
        items, following = following, next(blocks, None)
        shared = spark.sparkContext.broadcast(items)      # at most BLOCK_BYTES, or one item
        cutting = remove and following is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, more=out is not None,
                cutting=cutting) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, width)
            for batch in batches:
                found = search_shard(phrases, texts(batch.column(at)))
                if more:
                    spans = [merge_spans([(x["first"], x["last"]) for x in old] + new)
                             for old, (_, new, _) in zip(batch.column(n + 1).to_pylist(), found)]
                    items = [sorted({*old, *new}) for old, (_, _, new) in zip(batch.column(n + 2).to_pylist(), found)]
                else:
                    spans, items = [f[1] for f in found], [f[2] for f in found]
                if cutting:
                    new = [None if t is None else remove_spans(t, s) for t, s in zip(texts(batch.column(at)), spans)]
                    columns = list(batch.columns[:n])
                    columns[at] = pa.array(new, type=pa.binary()).cast(batch.schema.types[at])
                    yield pa.RecordBatch.from_arrays(columns, names_before)
                    continue
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], pa.array([f[0] for f in found], type=pa.int64()),
                     pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], type=kind),
                     pa.array(items, type=pa.list_(pa.string()))], schema.names)

        out = (docs if out is None else cut(out)).mapInArrow(lean(run), docs_schema if cutting else schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with the hit spans cut out of their texts; columns as before."""
    free = "hit"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    return find_spans(docs, benchmark, text, prefix=free, remove=True, **options)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return found.select("doc_id", F.col("hit_words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, w, array_to_string(ws[i:i + w - 1], ' ') AS g
       FROM (SELECT item, ws, least(10, len(ws)) AS w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
             FROM b WHERE len(ws) > 0)),
wd AS (SELECT DISTINCT w FROM bw),
dw AS (SELECT r, i, w, array_to_string(ws[i:i + w - 1], ' ') AS g
       FROM (SELECT r, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, wd WHERE len(ws) >= w)),
h AS (SELECT r, i, dw.w, item FROM dw JOIN bw ON dw.g = bw.g AND dw.w = bw.w),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + w)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
  coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
