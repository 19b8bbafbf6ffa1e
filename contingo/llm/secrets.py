"""Secret scan with a random forest that removes false positives.

Candidates are strings that look like keys: known key formats, values
assigned to words like password or token, and long strings of mixed
characters.  A random forest, trained on labelled findings, decides which of
them are secrets, from the candidate's length, the transitions between its
character kinds, its entropy, how much of it a dictionary of the corpus's
words covers, the kind of path (the document's source) it stands in and the
words before and after.

Labelled findings: a DataFrame (doc_id, first, last, secret) of candidates'
byte positions in documents and 0/1.  Where there are none, ``seed_labels``
makes them from rules that are certain about a part of the candidates (key
formats and values of credential assignments are secrets; numbers, words,
addresses, URLs, paths and bare digests aren't).  To keep the forest from
repeating the rules, training hides a candidate's neighbouring words in half
of the rows.

Defined results: a null or empty text has no candidates; repeated rows are
scanned one by one; a candidate overlapping an earlier one is part of it;
without labels of both kinds every candidate is reported with probability
0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import cut, small_batches
from contingo.llm.words import ALNUM, alnum_words, texts

#: Labelled findings that the forest is trained on, at most about.
SAMPLE_FINDINGS = 20_000
#: A word is in the dictionary if at least two documents and one in so many hold it.
DICTIONARY_SHARE = 5_000
THRESHOLD = 0.5

#: Public key formats (fixed values).
PRIVATE_KEY = rb"-----BEGIN [A-Z ]{0,64}PRIVATE KEY-----" \
              rb"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,64}PRIVATE KEY-----)?"
FORMATS = rb"(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}" \
          rb"|sk_live_[0-9A-Za-z]{24,}|AIza[0-9A-Za-z_\-]{35}|eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{6,}" \
          rb"|" + PRIVATE_KEY
ASSIGNED = rb"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?" \
           rb"\s{0,3}[=:]\s{0,3}[\"']?(" + PRIVATE_KEY + rb"|[^\s\"'<>,;]{6,})"
#: A maximal run with a digit and a letter. Look-aheads start at a run's first byte only, so the time is linear.
MIXED = rb"(?<![0-9A-Za-z_\-+/])(?=[A-Za-z_\-+/]*+[0-9])(?=[0-9_\-+/]*+[A-Za-z])[0-9A-Za-z_\-+/]{16,}+={0,2}(?![0-9A-Za-z_\-])"
LONG = rb"(?<![0-9A-Za-z])[0-9]{12,}+(?![0-9A-Za-z])|(?<![\w])[a-z]{18,}+(?![\w])"
CANDIDATE = re.compile(b"(?P<format>" + FORMATS + b")|" + ASSIGNED + b"|(?P<mixed>" + MIXED + b")|(?P<long>" + LONG + b")")
CREDENTIAL = re.compile(rb"(?i)(?:pass|pwd|secret|token|key|auth|cred)")
DIGEST_WORDS = re.compile(rb"(?i)(?:sha\d*|md5|commit|checksum|digest|hash|rev|etag|uuid|guid|id)$")
CONTEXT = 24
KINDS = bytes(0 if 48 <= b <= 57 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 for b in range(256))
N_FEATURES = 16 + 9 + 3 + 8


def candidates(text: bytes) -> Iterator[tuple[int, int, str]]:
    """(first byte, end byte, how it was found) of each candidate, left to right."""
    for m in CANDIDATE.finditer(text):
        if m[2] is not None:
            yield m.start(2), m.end(2), "assigned"
        else:
            yield m.start(), m.end(), m.lastgroup


def around(text: bytes, first: int, end: int) -> tuple[bytes, bytes]:
    return text[max(0, first - CONTEXT):first], text[end:end + CONTEXT]


def features(value: bytes, before: bytes, after: bytes, source: str | None, dictionary: set) -> list[float]:
    n = len(value)
    kinds = value.translate(KINDS)
    moves = Counter(zip(kinds, kinds[1:]))
    share = [moves[i, j] / max(n - 1, 1) for i in range(4) for j in range(4)]
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    covered = sum(len(w) for w in value.translate(ALNUM).split() if w in dictionary) / n
    pieces = sum(value[i:i + 3].lower() in dictionary for i in range(n - 2)) / max(n - 2, 1)
    hexed = sum(b in b"0123456789abcdefABCDEF" for b in value) / n
    last = before.translate(ALNUM).split()[-1:] or [b""]
    nxt = after.translate(ALNUM).split()[:1] or [b""]
    hashed = [0.0] * 8
    hashed[zlib.crc32(last[0]) % 4] = 1.0
    hashed[4 + zlib.crc32(nxt[0]) % 4] = 1.0
    return share + [float(n), entropy, covered, pieces, hexed, len(counts) / n, kinds.count(0) / n, kinds.count(2) / n,
                    kinds.count(3) / n, float(bool(CREDENTIAL.search(before))), float(before[-1:] in b"=:\"' " and
                    b"=" in before[-6:] or b":" in before[-4:]), zlib.crc32((source or "").encode()) % 8 / 8.0] + hashed


def rule_label(value: bytes, before: bytes, how: str) -> int | None:
    """What rules are certain about: 1 secret, 0 not, None unknown."""
    if how == "format":
        return 1
    if how == "assigned":
        if len(set(value)) >= 6 and re.search(rb"[0-9]", value) and re.search(rb"[A-Za-z]", value):
            return 1
        return 0 if len(set(value)) < 4 or value.isalpha() else None
    if how == "long":
        return 0
    if DIGEST_WORDS.search(before.translate(ALNUM).rstrip()) or re.search(rb"https?://\S*$", before) or b"/" in value[1:-1]:
        return 0
    return None


def corpus_dictionary(docs: DataFrame, share: int = DICTIONARY_SHARE) -> set:
    """The words that enough of all documents hold, and their 3-letter pieces. Their number is at most ``share``
    times a document's mean number of different words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"w": pa.array(seen.keys(), type=pa.binary()),
                                              "n": pa.array(seen.values(), type=pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for t in texts(batch.column(0)):
                seen.update(w for w in set(alnum_words(t)) if len(w) > 2 and not w.isdigit())
                if len(seen) > 200_000:
                    yield found()
        if seen:
            yield found()

    least = max(2, -(-docs.count() // share))
    rows = docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= least).select("w").toArrow()
    found = set(rows.column("w").to_pylist())
    return found | {w[i:i + 3] for w in found if w.isalpha() for i in range(len(w) - 2)}


def scan(docs: DataFrame, dictionary: set) -> DataFrame:
    """One row for each candidate, and one without (first null) for each document: row (which document row),
    doc_id, first, last, how, rule, features."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dictionary)      # bounded by DICTIONARY_SHARE
    docs = docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            index, first, last, how, rule, made = [], [], [], [], [], []
            for i, (text, source) in enumerate(zip(texts(batch.column(1)), batch.column(2).to_pylist())):
                text = text or b""
                index.append(i)
                for column in (first, last, how, rule, made):
                    column.append(None)
                for a, b, kind in candidates(text):
                    before, after = around(text, a, b)
                    index.append(i)
                    first.append(a)
                    last.append(b - 1)
                    how.append(kind)
                    rule.append(rule_label(text[a:b], before, kind))
                    made.append(features(text[a:b], before, after, source, known))
            at = pa.array(index, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).take(at), batch.column(0).take(at), pa.array(first, type=pa.int64()),
                 pa.array(last, type=pa.int64()), pa.array(how, type=pa.string()), pa.array(rule, type=pa.int32()),
                 pa.array(made, type=pa.list_(pa.float64()))], ["row", "doc_id", "first", "last", "how", "rule", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, first long, last long, how string, rule int, features array<double>")


def seed_labels(found: DataFrame) -> DataFrame:
    return found.where("rule is not null").select("doc_id", "first", "last", F.col("rule").alias("secret"))


def train(found: DataFrame, labels: DataFrame, sample_findings: int = SAMPLE_FINDINGS):
    """A random forest from labelled findings, or None without both kinds. Rows are drawn by a hash of where
    they stand; in half of them the neighbouring words' features are hidden."""
    keys = ["doc_id", "first", "last"]
    rows = found.where("first is not null").join(labels.dropDuplicates(keys), keys)
    per_kind = rows.groupBy("secret").count().collect()
    counts = {r.secret: r["count"] for r in per_kind}
    if not counts.get(0) or not counts.get(1):
        return None
    place = F.pmod(F.xxhash64(*keys), F.lit(1_000_000))
    share = F.when(F.col("secret") == 1, sample_findings / 2 / counts[1]).otherwise(sample_findings / 2 / counts[0])
    n = 16 + 9
    hide = F.pmod(F.xxhash64("first", "doc_id"), F.lit(2)) == 0
    shown = F.when(hide, F.transform("features", lambda x, i: F.when((i < n), x).otherwise(F.lit(0.0)))).otherwise(F.col("features"))
    rows = cut(rows.where(place < share * 1_000_000).select(array_to_vector(shown).alias("x"),
                                                           F.col("secret").cast("double").alias("y")))
    if rows.select("y").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="y", probabilityCol="p", rawPredictionCol="r",
                                  predictionCol="z", numTrees=30, maxDepth=7, seed=17).fit(rows)


def find_secrets(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (first and last byte, probability): one row for each document."""
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    found = cut(scan(docs, corpus_dictionary(docs)))
    model = train(found, seed_labels(found) if labels is None else labels)
    real = F.col("first").isNotNull()
    if model is None:
        scored = found.withColumn("probability", F.when(real, F.lit(0.5)))
    else:
        none = F.array_repeat(F.lit(0.0), N_FEATURES)
        scored = model.transform(found.withColumn("x", array_to_vector(F.coalesce("features", none)))) \
            .withColumn("probability", F.when(real, vector_to_array("p")[1]))
    hit = F.col("probability") >= threshold
    return scored.groupBy("row", "doc_id").agg(
        F.count("first").alias("n_candidates"), F.count(F.when(hit, 1)).alias("n_secrets"),
        F.array_sort(F.collect_list(F.when(hit, F.struct("first", "last", F.round("probability", 6).alias("probability")))))
        .alias("secrets")).drop("row")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
