"""Quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a document.  ``estimate_rules`` measures
every rule's cost and selectivity on a bounded sample, ``order_rules`` puts
the rules with the most rejections per second first, and the cascade stops at
a document's first rejecting rule.  A document is kept when no rule rejects
it, so the verdict does not depend on the measured order, only the time does.

Defined results: a null or blank text has no words and is rejected by
``too_short``; repeated rows, null ids and other columns pass through as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import lean, small_batches
from contingo.llm.words import SPACES, texts, window_hashes, word_hashes

#: Rows of the cost and selectivity sample, at most about so many.
SAMPLE_ROWS = 1000
#: Characters counted as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"


class Measures:
    """A document's counts, each made when a rule first asks for it."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: all bytes but white space and UTF-8 continuation bytes."""
        return len(self.text.translate(None, SPACES + bytes(range(0x80, 0xC0))))

    def count(self, chars: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, chars))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        windows = window_hashes(word_hashes(self.words), 3)
        if len(windows) < 2:
            return 0
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        found = np.isin(windows, twice)
        covered = np.zeros(self.n_words, dtype=bool)
        for j in range(3):
            covered[j:j + len(windows)] |= found
        return int(covered.sum())


#: name -> whether the rule rejects the document. All integer arithmetic.
RULES: dict[str, Callable[[Measures], bool]] = {
    "too_short": lambda m: m.n_words < 50,
    "repeated_words": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 100 * m.n_symbols > 30 * m.n_words,
    "duplicate_lines": lambda m: 100 * m.n_dup_lines > 40 * len(m.lines),
    "capitals": lambda m: 100 * m.count(bytes(range(65, 91))) > 40 * m.word_chars,
    "exclamations": lambda m: 100 * m.count(b"!") > 50 * m.n_words,
}
BASE = ("too_short", "repeated_words")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate_rules(docs: DataFrame, text: str = "text", rules: tuple[str, ...] = tuple(RULES),
                   sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """name -> (seconds a document, rejected share), measured on executors over a sample of about
    sample_rows rows. Each rule is measured alone on fresh counts; only sums reach the driver."""
    spark = docs.sparkSession
    if spark is None or not sample_rows:
        return {r: (1.0, 0.0) for r in rules}
    whole = docs.select(F.col(text).alias("text"))
    n = whole.count()
    share = min(1.0, sample_rows / max(n, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for t in texts(batch.column(0)):
                seen += 1
                for i, r in enumerate(rules):
                    began = time.perf_counter()
                    hits[i] += RULES[r](Measures(t))
                    took[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "took": took, "hits": hits, "seen": [seen] * len(rules)})

    rows = (whole.sample(fraction=share, seed=7).mapInArrow(measure, "rule string, took double, hits long, seen long")
            .groupBy("rule").agg(F.sum("took").alias("took"), F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
            .collect())                                     # one row for each rule
    return {r.rule: (r.took / max(r.seen, 1), r.hits / max(r.seen, 1)) for r in rows}


def order_rules(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejections per second first; ties by cost, then name."""
    return sorted(measured, key=lambda r: (-measured[r][1] / max(measured[r][0], 1e-9), measured[r][0], r))


def first_rejection(m: Measures, order: list[str]) -> str | None:
    return next((r for r in order if RULES[r](m)), None)


def cascade(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, all columns kept."""
    order = order or order_rules(estimate_rules(docs, text)) or list(RULES)
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Measures(t), order) is None for t in texts(batch.column(at))],
                                        type=pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row for each document: id, its counts, whether a base rule or any rule rejects it, and which came first."""
    order = order or order_rules(estimate_rules(docs, text)) or list(RULES)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = [Measures(t) for t in texts(batch.column(1))]
            why = [first_rejection(m, order) for m in ms]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([getattr(m, k) for m in ms], type=pa.int64()) for k in METRICS),
                 pa.array([any(RULES[r](m) for r in BASE) for m in ms], type=pa.bool_()),
                 pa.array([w is None for w in why], type=pa.bool_()), pa.array(why, type=pa.string())],
                ["doc_id", *METRICS, "base_failed", "kept", "rejected_by"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(verdicts, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in METRICS)
                           + ", base_failed boolean, kept boolean, rejected_by string")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).drop("rejected_by")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
ln AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY r),
m AS (SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(dup.lines, 0) AS n_lines,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_caps,
        length(t) - length(replace(t, '!', '')) AS n_bang
      FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
       OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_caps > 40 * word_chars OR 100 * n_bang > 50 * n_words) AS kept
FROM m
"""
