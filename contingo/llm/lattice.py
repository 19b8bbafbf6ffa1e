"""Subword lattice likelihood: a document's probability over all segmentations of its words.

The pieces come from an existing vocabulary file.  Its scores give the first
weights; expected piece counts over the training corpus's distinct words
(forward and backward over each word's lattice) refine them.  A word's lattice
has an arc for each piece at each place and, for a word of the training
corpus, one arc over the whole word with its discounted share of the corpus;
the discounts are the share of the pieces.  The log-space forward recursion
sums over all segmentations.  Words are lower-cased (A-Z) and start with the
pieces' word mark, so a lattice never crosses into the next word.  Single
bytes are pieces too, so every text has a probability.

Within a document a word's probability grows with its earlier occurrences:
(earlier + STRENGTH * lattice probability) / (tokens before + STRENGTH).  A
document's log10 probability is the sum over its words and its end.

Word counts stay distributed: words are counted by a shuffle, scored once a
distinct word, and sent to the blocks of documents that hold them.

Defined results: a null or blank text is the end alone; repeated rows are
scored (and learned from) one by one; a null id counts as held out (its text
is empty, whose crc32 is 0); without training rows all counts are 0; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import cut, small_batches
from contingo.llm.words import SPACED, space_words, texts

MARK = "▁".encode()
#: Rounds of expected counts.
ROUNDS = 2
#: Added to each piece's expected count.
SMOOTH = 0.01
#: Taken off each word's training count for the pieces.
DISCOUNT = 0.5
#: Tokens that the corpus weighs as much as, against the document itself.
STRENGTH = 1000.0
#: Documents in a block, about.
BLOCK_DOCS = 2000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 500_000
#: Word bytes whose lattices are laid out at once.
LATTICE_BYTES = 1 << 18


def vocabulary_scores(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and their scores; the 256 single bytes come last."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(model.id_to_piece(i).encode(), model.get_score(i)) for i in range(model.get_piece_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [p for p, _ in found] + [bytes([b]) for b in range(256)], np.array([s for _, s in found])


def first_weights(scores: np.ndarray) -> np.ndarray:
    """Scores of a unigram vocabulary are log probabilities; those of a merge vocabulary are negative ranks,
    which stand for a share falling with the rank."""
    if len(scores) and np.allclose(np.diff(scores), np.diff(scores).round()):
        weights = 1 / (np.abs(scores) + 10)
    else:
        weights = np.exp(scores)
    weights = weights / max(weights.sum(), 1e-300)
    return np.concatenate([weights * 0.99, np.full(256, 0.01 / 256)])


class Lattice:
    """All pieces at all places of words, and sums over their segmentations."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i, p in enumerate(pieces[:-256]):
            at = 0
            for b in p:
                nxt = nodes.get((at, b))
                if nxt is None:
                    nxt = nodes[at, b] = len(piece)
                    piece.append(-1)
                at = nxt
            piece[at] = i
        keys = np.array([n << 8 | b for n, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.piece = np.array(piece, dtype=np.int64)
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each node, and rows of the node that each byte leads to (-1: none); leaves share the last row. Each
        worker lays them out once."""
        if self.table is None:
            inner = np.unique(self.keys >> 8)
            row = np.full(len(self.piece), len(inner), dtype=np.int32)
            row[inner] = np.arange(len(inner))
            to = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
            to[row[self.keys >> 8], self.keys & 255] = self.to
            self.table = row, to.reshape(-1)
        return self.table

    def arcs(self, words: list[bytes]):
        """(starts, ends of the words' bytes, arc start, arc end, arc piece); arcs in order of their end's
        distance from the word's start, then of their end."""
        marked = [MARK + w for w in words]
        buf = np.frombuffer(b"".join(marked), dtype=np.uint8)
        lens = np.array([len(w) for w in marked], dtype=np.int64)
        ends = np.cumsum(lens)
        stop = np.repeat(ends, lens)
        begin = np.repeat(ends - lens, lens)
        every = np.arange(len(buf), dtype=np.int64)
        start, end, piece = [every], [every + 1], [self.n - 256 + buf.astype(np.int64)]
        row, to = self.steps()
        at, node, depth = every, np.zeros(len(buf), dtype=np.int32), 0
        while len(at):
            node = to[(row[node] << 8) | buf[at + depth]]
            ok = node >= 0
            at, node = at[ok], node[ok]
            depth += 1
            found = self.piece[node]
            hit = found >= 0
            start.append(at[hit])
            end.append(at[hit] + depth)
            piece.append(found[hit])
            go = at + depth < stop[at]
            at, node = at[go], node[go]
        start, end, piece = np.concatenate(start), np.concatenate(end), np.concatenate(piece)
        order = np.argsort((end - begin[start]) * (len(buf) + 1) + end)
        return ends - lens, ends, begin, start[order], end[order], piece[order]

    def forward(self, laid, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of reaching each byte border (borders of word w: its bytes shifted by w), and of words."""
        first, last, begin, start, end, piece = laid
        word = np.repeat(np.arange(len(first)), last - first)
        alpha = np.full(int(last[-1]) + len(first), -np.inf)
        alpha[first + np.arange(len(first))] = 0
        a, b, w = start + word[start], end + word[start], logp[piece]
        distance = end - begin[start]
        cuts = np.searchsorted(distance, np.arange(1, int(distance[-1]) + 2))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            value, target = alpha[a[i:j]] + w[i:j], b[i:j]
            group = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            top = np.maximum.reduceat(value, group)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(group, append=len(value)))), group)
            alpha[target[group]] = top + np.log(total)
        return alpha, alpha[last + np.arange(len(first))]

    def expected(self, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected count of each piece over the words' segmentations."""
        laid = self.arcs(words)
        first, last, begin, start, end, piece = laid
        alpha, total = self.forward(laid, logp)
        word = np.repeat(np.arange(len(first)), last - first)
        beta = np.full(len(alpha), -np.inf)
        beta[last + np.arange(len(first))] = 0
        a, b, w = start + word[start], end + word[start], logp[piece]
        back = start - begin[start]
        order = np.argsort((back.max() - back) * len(alpha) + a)   # from the words' ends towards their starts
        a, b, w, back = a[order], b[order], w[order], back[order]
        edges = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1], [True]]))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            value, target = beta[b[i:j]] + w[i:j], a[i:j]
            group = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            top = np.maximum.reduceat(value, group)
            sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(group, append=len(value)))), group)
            beta[target[group]] = top + np.log(sums)
        of = word[start[order]]
        share = np.exp(alpha[a] + w + beta[b] - total[of]) * counts[of]
        return np.bincount(piece[order], weights=share, minlength=self.n)

    def log10(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """log10 of the words' marginal probabilities."""
        out = [self.forward(self.arcs(words[i:j]), logp)[1] for i, j in parts(words)]
        return np.concatenate(out) / np.log(10) if out else np.zeros(0)


def numbered(run: list[bytes | None], listed: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text the numbers of its words (A-Z lower-cased), and the words that are not listed: they have the numbers
    after the listed ones'. All words are looked up at once."""
    each = [t.translate(SPACED) if t else b"" for t in run]
    buf = np.frombuffer(b" " + b" ".join(each) + b" ", dtype=np.uint8)
    letter = buf != 32
    turn = np.flatnonzero(np.diff(letter))                   # where words begin and end, in turn
    starts, ends = turn[::2] + 1, turn[1::2] + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[letter])])
    found = pc.index_in(words, value_set=pa.array(listed, type=pa.large_binary()))
    other = words.filter(found.is_null()).dictionary_encode()
    number = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    number[number < 0] = len(listed) + other.indices.to_numpy(zero_copy_only=False)
    cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in each]))
    return np.split(number, cuts[:-1]) if each else [], other.dictionary.to_pylist()


def parts(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of words of about LATTICE_BYTES; a longer word is a run of its own."""
    first = size = 0
    for i, w in enumerate(words):
        if i > first and size + len(w) > LATTICE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(w) + len(MARK)
    if first < len(words):
        yield first, len(words)


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def word_counts(docs: DataFrame, folds: int = 10, fold: int = 0) -> DataFrame:
    """(word, c) over the training documents; the empty word counts the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), type=pa.binary()).cast(pa.string()),
                                              pa.array(seen.values(), type=pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if not held_out(doc_id, folds, fold):
                    seen.update(space_words(text))
                    seen[b""] += 1
            if len(seen) > HELD_WORDS:
                yield rows()
        if seen:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, c long") \
        .groupBy("word").agg(F.sum("c").alias("c"))


def learn(counts: DataFrame, pieces: list[bytes], weights: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log weights of the pieces after some rounds of expected counts over the distinct words."""
    spark = counts.sparkSession
    words = counts.where("word <> ''").select("word")
    laid = Lattice(pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((laid, np.log(weights)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, logp = shared.value
            total = np.zeros(lattice.n)
            for batch in batches:
                every = texts(batch.column(0))
                for i, j in parts(every):
                    total += lattice.expected(every[i:j], np.ones(j - i), logp)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(used, type=pa.int64()), "n": pa.array(total[used])})

        expected = np.zeros(len(pieces))
        for r in words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[r.piece] = r.n                          # one row for each piece of the vocabulary
        weights = (expected + SMOOTH) / (expected.sum() + SMOOTH * len(pieces))
    return np.log(weights)


def word_log(c: np.ndarray, log10_pieces: np.ndarray, n_tokens: int, n_types: int) -> np.ndarray:
    """Natural log of the words' probabilities: the arc over the whole word and the arcs over its pieces."""
    if not n_tokens:
        return log10_pieces * np.log(10)
    whole = np.log(np.maximum(c - DISCOUNT, 1e-300) / n_tokens)
    return np.logaddexp(np.where(c > 0, whole, -np.inf), np.log(DISCOUNT * n_types / n_tokens) + log10_pieces * np.log(10))


def document_log10(words: np.ndarray, logp: np.ndarray) -> float:
    """log10 probability of a sequence of word numbers whose first is a document's end."""
    ordered = np.sort(words)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    earlier = np.arange(len(words)) - np.repeat(starts, np.diff(starts, append=len(words)))
    grown = np.log(STRENGTH) + logp[ordered]
    again = np.flatnonzero(earlier)
    grown[again] = np.logaddexp(grown[again], np.log(earlier[again]))
    return float((grown - np.log(STRENGTH + np.arange(len(words)))).sum() / np.log(10))


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", folds: int = 10,
          fold: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = cut(word_counts(docs, folds, fold))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                      F.sum(F.when(F.col("word") == "", F.col("c"))).alias("docs")).first()
    n_train, n_types, n_ends = sums.n or 0, sums.v or 0, sums.docs or 0
    pieces, scores = vocabulary_scores(vocabulary)
    logp = learn(counts, pieces, first_weights(scores))
    shared = spark.sparkContext.broadcast((Lattice(pieces), logp))     # bounded by the vocabulary file

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, weights = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lattice.log10(texts(batch.column(0)), weights), type=pa.float64())],
                ["word", "c", "logp"])

    known = counts.where("word <> ''").mapInArrow(weigh, "word string, c long, logp double")
    n_blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))) \
        .repartition(min(n_parts, n_blocks), "block")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        size = 0

        def rows(block: int):
            own = list(seen.pop(block))
            return pa.RecordBatch.from_arrays([pa.array(own, type=pa.binary()).cast(pa.string()),
                                               pa.array([block] * len(own), type=pa.int64())], ["word", "block"])

        for batch in batches:
            for block, t in zip(batch.column(2).to_pylist(), texts(batch.column(1))):
                own = seen.setdefault(block, set())
                size -= len(own)
                own.update(space_words(t))
                size += len(own)
                if size > HELD_WORDS:
                    for b in [*seen]:
                        yield rows(b)
                    size = 0
        for b in [*seen]:
            yield rows(b)

    asked = blocks.mapInArrow(words_of, "word string, block long")
    answers = asked.join(known, "word").select("block", "word", "c", "logp")
    floor = n_train + 0.1 * (n_types + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        lattice, weights = shared.value
        numbers, others = numbered(texts(left.column("text").combine_chunks()) if left.num_rows else [],
                                   texts(right.column("word").combine_chunks()) if right.num_rows else [])
        c = right.column("c").to_numpy().astype(np.float64)
        p = right.column("logp").to_numpy()
        if others:                                            # words of held-out documents only
            p = np.concatenate([p, lattice.log10(others, weights)])
            c = np.concatenate([c, np.zeros(len(others))])
        p = word_log(c, p, n_train, n_types - (n_ends > 0))
        c, p = np.append(c, n_ends), np.append(p, np.log(max(n_ends, 1) / max(n_train, 2)))
        base = np.log10((c + 0.1) / floor)
        rows = [np.append(r, len(c) - 1) for r in numbers]
        ids = left.column("doc_id").to_pylist()
        return pa.table({
            "doc_id": pa.array(ids, type=pa.int64()),
            "held_out": pa.array([held_out(i, folds, fold) for i in ids], type=pa.bool_()),
            "n_tokens": pa.array([len(r) for r in rows], type=pa.int64()),
            "n_known": pa.array([int((c[r] > 0).sum()) for r in rows], type=pa.int64()),
            "train_tokens": pa.array([n_train] * len(rows), type=pa.int64()),
            "base_score": pa.array([float(base[r].sum()) for r in rows], type=pa.float64()),
            "score": pa.array([document_log10(r, p) for r in rows], type=pa.float64())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double")


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op8_lattice_likelihood(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or default_pieces())
