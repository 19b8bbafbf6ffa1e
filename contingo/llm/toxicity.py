"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are alphanumeric words (A-Z lower-cased) and the beginnings (3 to 5
characters) of longer ones, named by 64-bit hashes.  Of the labelled rows at
most SAMPLE_ROWS, taken in the order of a hash of their ids, are learned from.
Each of them is an example with its full vector: every term of its text has a
weight, (1 + ln count) * idf * emphasis, where the emphasis is FLOOR for terms
that say nothing and rises with how much a term speaks for toxicity (its
shrunk log ratio).  Terms that no example holds have no weight.

The index has for each term its examples in ascending order and its largest
weight.  Examples are ordered by the sum of their weights and cut into blocks
of BLOCK; for terms in more than a share of 1 / OFTEN of the examples it has
each block's largest weight.  A search adds up the terms that can add most and
leaves out those with many examples that can add little together; it bounds
these by the largest weights (of blocks where known) and by their norm, visits
examples in descending order of their bound and ends when no bound reaches the
k-th best cosine, so its neighbours are exact.  The neighbours vote with their cosines; votes are calibrated on
the examples themselves, each without its own vote (isotonic rates).

Defined results: a text without any known term (also null or empty) has no
neighbours and gets the calibrated rate of labelled rows without terms; repeated rows are
scored one by one; null labels are left out of learning; labels of unknown
documents are ignored; with no usable labels every score is 0.5; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contingo.llm.cluster import small_batches
from contingo.llm.pretoken import ragged
from contingo.llm.words import alnum_words, hash_spans, texts, word_hashes

#: Bound on the labelled rows that are learned from (a parameter of ``score``).
SAMPLE_ROWS = 20_000
NEIGHBOURS = 15
BLOCK = 64
#: Terms in more than one of so many examples are frequent.
OFTEN = 200
#: Postings added up before the k-th sum is first known, and the share of it that the terms left out may add.
FIRST_POSTINGS, LEFT = 15_000, 0.4
#: An example that holds a term, and the term's weight there. Of terms with fewer postings these are taken one by one.
POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])
FEW = 64
#: Vectors whose terms left out are bounded together.
TOGETHER = 64
#: Emphasis of a term that says nothing about toxicity, and rows that its ratio is shrunk by.
FLOOR, SHRINK = 0.02, 5.0
#: Bytes of texts whose words are looked up at once.
RUN_BYTES = 1 << 22
#: Weight of the examples' overall rate in a vote.
PRIOR = 0.05


def word_terms(word: bytes) -> list[bytes]:
    u = word.decode("utf-8", "ignore")
    return [word, *(b"^" + u[:size].encode() for size in (3, 4, 5) if len(u) > size)]


def term_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' terms, word by word, and how many each word has."""
    buf = np.frombuffer(b"".join(b"^" + w for w in words), dtype=np.uint8)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1)
    starts = ends - lens                                     # behind the sign
    lead = np.flatnonzero((buf & 0xC0) != 0x80)              # the signs and the first bytes of characters
    sign = np.searchsorted(lead, starts - 1)
    after = np.append(lead, len(buf))
    chars = np.diff(sign, append=len(lead)) - 1
    hashes, holder = [hash_spans(buf, starts, ends)], [np.arange(len(words))]
    for size in (3, 4, 5):
        own = np.flatnonzero(chars > size)
        if len(own):
            hashes.append(hash_spans(buf, starts[own] - 1, after[sign[own] + 1 + size]))
            holder.append(own)
    every = np.concatenate(holder)
    return np.concatenate(hashes)[np.argsort(every, kind="stable")], np.bincount(every, minlength=len(words))


def text_terms(run: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the texts' terms, and for each text the places of its words' terms there (as often as they occur)."""
    words: dict[bytes, int] = {}
    own = [np.array([words.setdefault(w, len(words)) for w in alnum_words(t)], dtype=np.int64) for t in run]
    if not words:
        return np.zeros(0, dtype=np.uint64), own
    every = list(words)
    try:
        b" ".join(every).decode()
        found, size = term_hashes(every)
    except UnicodeDecodeError:                               # characters that are cut short have no part in beginnings
        terms = [word_terms(w) for w in every]
        found = word_hashes([t for part in terms for t in part])
        size = np.array([len(part) for part in terms], dtype=np.int64)
    hashes, flat = np.unique(found, return_inverse=True)
    start = np.cumsum(size) - size
    return hashes, [flat[ragged(start[o], size[o])] for o in own]


def runs(every: list[bytes | None]) -> Iterator[slice]:
    """Runs of the texts of about RUN_BYTES."""
    first = size = 0
    for i, t in enumerate(every):
        size += len(t or b"")
        if size >= RUN_BYTES:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(every):
        yield slice(first, len(every))


def joined(starts: np.ndarray, size: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """Of each array the stretches of these starts and sizes, one after another."""
    stretches = [slice(a, b) for a, b in zip(starts.tolist(), (starts + size).tolist())]
    return [np.concatenate([x[s] for s in stretches]) if stretches else x[:0] for x in arrays]


def kth(sums: np.ndarray, k: int) -> float:
    return float(np.partition(sums, -k)[-k]) if len(sums) >= k else 0.0


def by_value(x: np.ndarray) -> np.ndarray:
    """The stable order of fewer than 2^31 values from 0 to 2^31 - 1, by halves of 16 bits (both sorted by radix)."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
    upper = np.argsort((x >> 16).astype(np.uint16)[order], kind="stable").astype(np.int32)
    return order[upper]


class BlockMaxIndex:
    """Examples as sparse vectors {term: weight}, numbered from 0."""

    def __init__(self, vectors: list[dict[int, float]]):
        self.build(np.cumsum([0] + [len(v) for v in vectors]), np.array([t for v in vectors for t in v], dtype=np.int32),
                   np.array([w for v in vectors for w in v.values()], dtype=np.float32))

    @classmethod
    def packed(cls, starts: np.ndarray, term: np.ndarray, weight: np.ndarray) -> BlockMaxIndex:
        """Of the examples' terms and weights end to end; example e's are starts[e] to starts[e + 1]."""
        out = cls.__new__(cls)
        out.build(starts, term, weight)
        return out

    def build(self, starts: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.n, self.blocks = len(starts) - 1, -(-(len(starts) - 1) // BLOCK)
        self.n_terms = int(term.max()) + 1 if len(term) else 0
        self.size = np.bincount(term, minlength=self.n_terms)
        self.start = np.cumsum(self.size) - self.size
        often = np.flatnonzero(self.size > self.n / OFTEN)
        self.row = np.full(self.n_terms, -1, dtype=np.int32)                       # of a frequent term
        self.row[often] = np.arange(len(often))
        frequent = self.row[term] >= 0
        late = np.flatnonzero(frequent[1:] & ~frequent[:-1]) + 1
        if not np.isin(late, starts).all():                                        # frequent ones come first
            order = np.lexsort((~frequent, np.repeat(np.arange(self.n), np.diff(starts))))
            term, weight, frequent = term[order], weight[order], frequent[order]
        self.starts, self.term, self.own = starts, term, weight
        self.often_held = np.zeros(self.n, dtype=np.int64)                         # frequent terms of each example
        held = np.flatnonzero(np.diff(starts))
        if len(held):
            self.often_held[held] = np.add.reduceat(frequent, starts[held], dtype=np.int64)
        del frequent, late
        order = by_value(term)
        by_weight = weight[order]
        example = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))[order]
        del order
        both = np.empty(len(example), dtype=POSTING)                         # by term
        both["example"], both["weight"] = example, by_weight
        self.posting = both.view(np.int64)                                   # plain numbers are joined faster
        del example
        self.largest = np.zeros(self.n_terms, dtype=np.float32)
        held = self.size > 0
        if held.any():
            self.largest[held] = np.maximum.reduceat(by_weight, self.start[held])
        del by_weight
        self.most = np.zeros((len(often), self.blocks), dtype=np.float32)          # its largest weight in each block
        for i in range(0, len(often), 64):
            some = often[i:i + 64]
            own = joined(self.start[some], self.size[some], self.posting)[0].view(POSTING)
            cell = np.repeat(np.arange(len(some)), self.size[some]) * self.blocks + own["example"] // BLOCK
            new = np.flatnonzero(np.diff(cell, prepend=-1))                        # cells ascend
            self.most[i:i + 64].reshape(-1)[cell[new]] = np.maximum.reduceat(own["weight"], new)
        self.firsts = np.arange(0, self.n, BLOCK)
        self.usual = self.largest.copy()
        if self.blocks:
            self.usual[often] = self.most.mean(axis=1)
        self.asked = np.zeros(self.n_terms, dtype=np.float32)

    def added(self, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What these terms add to each example's cosine."""
        size = self.size[term]
        few = size < FEW
        many = ~few
        own = np.concatenate([*joined(self.start[term[many]], size[many], self.posting),
                              self.posting[ragged(self.start[term[few]], size[few])]]).view(POSTING)
        w = np.concatenate([np.repeat(w[many].astype(np.float32), size[many]), np.repeat(w[few].astype(np.float32), size[few])])
        return np.bincount(own["example"], own["weight"] * w, minlength=self.n).astype(float, copy=False)

    def search(self, vector: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int,
               without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosines (ties: the first), best first, and the cosines."""
        return self.search_all([vector], k, [without])[0]

    def search_all(self, vectors: list, k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``search`` of each vector (without the example of that number); the terms left out are bounded for
        TOGETHER of them at once."""
        without, out = without or [-1] * len(vectors), []
        for first in range(0, len(vectors), TOGETHER):
            some, leave = vectors[first:first + TOGETHER], without[first:first + TOGETHER]
            summed = [self.summed(v, k, w) for v, w in zip(some, leave)]
            rows = [self.row[term] for term, _, _ in summed]
            every = np.flatnonzero(np.bincount(np.concatenate(rows)))
            share = np.zeros((len(some), len(every)), dtype=np.float32)
            for i, (row, (_, own, _)) in enumerate(zip(rows, summed)):
                share[i, np.searchsorted(every, row)] = own
            for (rest, own, sums), w, more in zip(summed, leave, share @ self.most[every]):
                out.append(self.visited(rest, own, sums, more, k, w))
        return out

    def summed(self, vector: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int,
               without: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The frequent terms that are left out, their weights, and what the others add to each example's cosine."""
        if isinstance(vector, dict):
            vector = np.array(list(vector), dtype=np.int64), np.array(list(vector.values()), dtype=float)
        known = vector[0] < self.n_terms
        term, w = vector[0][known], vector[1][known]
        if not len(term):
            return term, w, np.zeros(self.n)
        # terms that can add most come first; what the others can add together must stay well below the k-th sum
        size = self.size[term]
        order = np.argsort(-(w * self.largest[term]), kind="stable")
        first = 1 + int(np.searchsorted(np.cumsum(size[order]), FIRST_POSTINGS))
        sums = self.added(term[order[:first]], w[order[:first]])
        if 0 <= without < self.n:
            sums[without] = 0
        order = order[first:]
        usual = w[order] * self.usual[term[order]]
        ascending = np.argsort(usual / size[order], kind="stable")
        order = order[ascending]
        left = int(np.searchsorted(np.cumsum(usual[ascending]), LEFT * self.low_kth(sums, k)))
        frequent = self.row[term[order]] >= 0
        frequent[left:] = False
        rest, order = order[frequent], order[~frequent]
        if len(order):
            sums += self.added(term[order], w[order])
            if 0 <= without < self.n:
                sums[without] = 0
        return term[rest], w[rest], sums

    def low_kth(self, sums: np.ndarray, k: int) -> float:
        """The k-th of the blocks' largest sums, which is no larger than the k-th sum."""
        return kth(np.maximum.reduceat(sums, self.firsts) if self.blocks >= 4 * k else sums, k)

    def visited(self, rest: np.ndarray, own: np.ndarray, sums: np.ndarray, more: np.ndarray, k: int,
                without: int) -> tuple[np.ndarray, np.ndarray]:
        """The best examples, visited in descending order of their bounds: the sums and what the block's largest weights
        and the norm of the rest allow."""
        best_e, best_s = np.zeros(0, dtype=np.int64), np.zeros(0)
        if not self.n:
            return best_e, best_s
        more = np.minimum(more.astype(float), np.sqrt(own @ own)) * (1 + 1e-5)
        tops = np.maximum.reduceat(sums, self.firsts)         # of the blocks
        least = kth(sums[sums >= self.low_kth(sums, k)], k) * (1 - 1e-5)
        reached = np.flatnonzero((tops + more > 0) & (tops + more >= least))
        visit = (reached[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        visit = visit[:np.searchsorted(visit, self.n)]
        bound = sums[visit] + np.repeat(more[reached], BLOCK)[:len(visit)]
        if 0 <= without < self.n:
            bound[visit == without] = 0
        held_in = np.flatnonzero((bound > 0) & (bound >= least))
        order = held_in[np.argsort(-bound[held_in], kind="stable")]
        visit, bound = visit[order], bound[order]
        self.asked[rest] = own
        done, step = 0, 2 * k
        while done < len(visit):
            if len(best_s) == k:
                least = max(least, best_s[-1] * (1 - 1e-5))
            end = min(done + step, int(np.searchsorted(-bound, -least, side="right")))
            e = np.sort(visit[done:end])
            if not len(e):
                break
            done, step = done + step, 2 * step
            s = sums[e]
            some = np.flatnonzero(self.often_held[e]) if len(rest) else e[:0]
            if len(some):                                    # what is left out is among an example's frequent terms
                size = self.often_held[e[some]]
                held, weight = joined(self.starts[e[some]], size, self.term, self.own)
                more = self.asked.take(held) * weight
                s[some] += np.add.reduceat(more.astype(float), np.cumsum(size) - size)
            e, s = np.concatenate([best_e, e[s > 0]]), np.concatenate([best_s, s[s > 0]])
            order = np.lexsort((e, -s))[:k]
            best_e, best_s = e[order], s[order]
        self.asked[rest] = 0
        return best_e, best_s


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending knots and non-decreasing rates that fit y best (neighbours that violate the order are pooled)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []                            # sum, count, largest x
    for v, t in zip(x[order].tolist(), y[order].tolist()):
        pools.append([t, 1.0, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, v = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, v]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


class Vocabulary:
    """The examples' terms, numbered from the one in most rows down (near ones in memory meet often), and their weights."""

    def __init__(self, hashes: np.ndarray, n0: np.ndarray, n1: np.ndarray, total0: int, total1: int):
        order = np.argsort(hashes)
        self.hashes, n0, n1 = hashes[order], n0[order], n1[order]
        idf = np.log((total0 + total1 + 1) / (n0 + n1 + 1)) + 1
        rate = (total1 + 0.5) / (total0 + total1 + 1)
        ratio = (n1 + SHRINK * rate) / (n0 + n1 + SHRINK) / rate
        by_rows = np.argsort(-(n0 + n1), kind="stable")
        self.number = np.empty(len(by_rows), dtype=np.int32)
        self.number[by_rows] = np.arange(len(by_rows))
        self.weights = (idf * (FLOOR + np.maximum(np.log(ratio), 0) ** 2)).astype(np.float32)[by_rows]

    def vectors(self, run: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: ascending term numbers and weights of norm 1."""
        if not len(self.hashes):
            return [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in run]
        hashes, places = text_terms(run)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = np.where(self.hashes[at] == hashes, self.number[at], -1)
        out = []
        for own in places:
            found = number[own]
            term, n = np.unique(found[found >= 0], return_counts=True)
            weight = (1 + np.log(n)) * self.weights[term]
            out.append((term, weight / np.sqrt(weight @ weight) if len(term) else weight))
        return out


class Model:
    def __init__(self, words: Vocabulary, ids: list, labels: list[int], starts: np.ndarray, term: np.ndarray,
                 weight: np.ndarray, no_term: tuple[int, int]):
        """Examples (doc_id, toxic, terms and weights end to end); toxic rows and rows without any term."""
        self.words, self.ids, self.labels = words, ids, np.array(labels, dtype=float)
        self.starts, self.term, self.weight = starts, term, weight
        self.rate = float((self.labels.sum() + 0.5) / (len(ids) + 1))
        self.none = (no_term[0] + 0.5) / (no_term[1] + 1)
        self.index: BlockMaxIndex | None = None

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]],
                without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.index is None:                               # each worker turns the examples round once
            self.index = BlockMaxIndex.packed(self.starts, self.term, self.weight)
        return self.index.search_all(vectors, NEIGHBOURS, without)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        return float(((cosines * self.labels[found]).sum() + PRIOR * self.rate) / (cosines.sum() + PRIOR))

    def own_votes(self, some: list[int]) -> list[float]:
        """The votes of these examples, each without itself."""
        at = [slice(self.starts[i], self.starts[i + 1]) for i in some]
        return [self.vote(*x) for x in self.nearest(
            [(self.term[a].astype(np.int64), self.weight[a].astype(float)) for a in at], some)]

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], knots: np.ndarray,
               rates: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each vector: the score, the nearest examples and their cosines."""
        out = []
        for found, cosines in self.nearest(vectors):
            score = self.none
            if len(found):
                vote = self.vote(found, cosines)
                score = 0.98 * float(np.interp(vote, knots, rates)) + 0.02 * vote
            out.append((score, found, cosines))
        return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 3, held: int = 1) -> Model:
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("l_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("l_id").cast("string")) % folds != held))
    sample = usable.dropDuplicates(["l_id"]).orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")) \
        .select("doc_id", "text", "toxic")                   # at most sample_rows ids are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = texts(batch.column(1)), np.array(batch.column(2), dtype=np.int64)
            for run in runs(every):
                hashes, places = text_terms(every[run])
                n = np.zeros((2, len(hashes) + 1), dtype=np.int64)           # the last column: rows
                for own, y in zip(places, toxic[run].tolist()):
                    n[y, np.unique(own)] += 1
                    n[y, -1] += 1
                yield pa.RecordBatch.from_pydict(
                    {"term": pa.array([*hashes.view(np.int64).tolist(), None], type=pa.int64()),
                     "n0": pa.array(n[0]), "n1": pa.array(n[1])})

    counts = rows.mapInArrow(count, "term long, n0 long, n1 long").groupBy("term") \
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()     # the terms of at most sample_rows rows
    is_term = np.array(counts.column("term").is_valid())
    n0, n1 = (counts.column(c).to_numpy() for c in ("n0", "n1"))
    hashes = counts.column("term").drop_null().to_numpy().astype(np.int64).view(np.uint64)
    words = Vocabulary(hashes, n0[is_term], n1[is_term], int(n0[~is_term].sum()), int(n1[~is_term].sum()))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = texts(batch.column(1))
            own = [v for run in runs(every) for v in shared.value.vectors(every[run])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([t.astype(np.int32).tobytes() for t, _ in own], type=pa.binary()),
                 pa.array([w.astype(np.float32).tobytes() for _, w in own], type=pa.binary())],
                ["doc_id", "toxic", "terms", "weights"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(examples, f"doc_id {kind}, toxic int, terms binary, weights binary").toArrow().to_pydict()
    vectors = sorted(zip(got["doc_id"], got["toxic"], got["terms"], got["weights"]),
                     key=lambda r: (-np.frombuffer(r[3], dtype=np.float32).sum(), zlib.crc32(str(r[0]).encode()), str(r[0]), r[2], r[3]))
    none = [r[1] for r in vectors if not r[2]]
    vectors = [r for r in vectors if r[2]]
    return Model(words, [r[0] for r in vectors], [r[1] for r in vectors],
                 np.cumsum([0] + [len(r[2]) // 4 for r in vectors]),
                 np.frombuffer(b"".join(r[2] for r in vectors), dtype=np.int32),
                 np.frombuffer(b"".join(r[3] for r in vectors), dtype=np.float32), (sum(none), len(none)))


def calibrate(spark: SparkSession, shared: Broadcast, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rates of the examples' own votes, which are searched for in tasks."""
    n = len(model.ids)
    if not n:
        return np.zeros(1), np.full(1, 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.own_votes(batch.column(0).to_pylist()),
                                           type=pa.float64())], ["id", "vote"])

    parts = max(1, min(spark.sparkContext.defaultParallelism, n // 200))
    got = spark.range(0, n, 1, parts).mapInArrow(run, "id long, vote double").toArrow()
    votes = np.zeros(n)
    votes[got.column("id").to_numpy()] = got.column("vote").to_numpy()
    return isotonic(votes, model.labels)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 3, held: int = 1,
          threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_id and cosine of the nearest labelled examples)."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    model = learn(docs, labels, sample_rows, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    knots, rates = calibrate(docs.sparkSession, shared, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            every = texts(batch.column(1))
            found = [x for run in runs(every) for x in model.scores(model.words.vectors(every[run]), knots, rates)]
            ids = batch.column(0)
            held_out = [zlib.crc32(b"" if i is None else str(i).encode()) % folds == held for i in ids.to_pylist()]
            ends = np.cumsum([0] + [len(e) for _, e, _ in found]).astype(np.int32)
            nearest = [model.ids[e] for _, own, _ in found for e in own.tolist()]
            cosines = np.concatenate([np.zeros(0), *(c for _, _, c in found)])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held_out, type=pa.bool_()), pa.array([s for s, _, _ in found], type=pa.float64()),
                 pa.array([int(s >= threshold) for s, _, _ in found], type=pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                     [pa.array(nearest, type=ids.type), pa.array(cosines)], ["doc_id", "cosine"]))],
                ["doc_id", "held_out", "score", "predicted", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, "
                                f"evidence array<struct<doc_id:{kind},cosine:double>>")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted")
