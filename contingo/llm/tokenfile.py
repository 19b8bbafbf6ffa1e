"""Token-id files: every document compressed on its own with one shared zstandard dictionary.

Layout under one folder (all tables are Parquet, so that any store that Spark writes will do):

* ``dictionary``: one row (dictionary, sha256, id_bytes), trained on the serialized id arrays of a bounded
  sample of documents;
* ``blocks``: one row for each block of consecutive documents (part, block, first_doc, last_doc, n_docs,
  n_ids, dictionary_sha256, index, frames).  ``frames`` holds the documents' zstandard frames one after
  another; ``index`` holds for each document its id, frame offset, frame length and number of ids as
  little-endian 64-bit integers, so one short document is read without touching its neighbours;
* ``starts``: (part, block, start), the ids before each block.

Documents stand in ascending doc_id order over parts (ranges of doc_id) and blocks.  A reader refuses frames
whose dictionary hash is not the dictionary's.

Defined results: a null or empty text is the end id alone; repeated rows are all written; a null doc_id
stands before all others; an empty table gives an empty file set.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contingo.llm.bpe import default_vocabulary, shared_file
from contingo.llm.cluster import shared_folder, small_batches
from contingo.llm.pretoken import IdCache, batches_of, encode_texts
from contingo.llm.words import texts

#: Documents that the dictionary is trained on, at most; the dictionary's bytes, at most.
SAMPLE_DOCS = 2000
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 8 << 20
#: Bytes of frames after which a block ends.
BLOCK_BYTES = 1 << 18
#: Words given to the tokenizers library in one call.
AT_ONCE = 1000
NULL_ID = np.iinfo(np.int64).min
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n_ids", "<i8")])


def byte_table() -> dict[int, int]:
    """The character that byte-level pre-tokenisers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def plain(vocabulary: dict) -> bool:
    """Whether a word's ids are what the model makes of its bytes: no normaliser, bytes without a prefix space."""
    steps = vocabulary.get("pre_tokenizer") or {}
    return (vocabulary.get("normalizer") is None and steps.get("type") == "ByteLevel"
            and not steps.get("add_prefix_space", True) and vocabulary.get("post_processor") is None
            and vocabulary["model"].get("type") == "BPE" and not vocabulary["model"].get("dropout"))


@lru_cache(maxsize=2)
def _library(content: bytes) -> tuple[IdCache, int]:
    """The tokenizers library on distinct words: a word is what its pre-tokeniser never splits or joins."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    if plain(json.loads(content)):
        model, table = tokenizer.model, byte_table()

        def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Each word by the library's model, its bytes written as the pre-tokeniser writes them."""
            found = [[t.id for t in model.tokenize(w.decode("latin-1").translate(table))] for w in words]
            lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lens.sum())), lens

        return IdCache(encode_words, {s.encode(): i for s, i in specials.items()}), tokenizer.get_vocab_size()

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(words), AT_ONCE):          # one encoding for many words, which stay apart
            part = [w.decode() for w in words[i:i + AT_ONCE]]
            found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(found.ids, dtype=np.uint32))
            lens.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part)))
        return np.concatenate(flat), np.concatenate(lens)

    return IdCache(encode, {s.encode(): i for s, i in specials.items()}), tokenizer.get_vocab_size()


def _id_arrays(every: list[bytes], content: bytes, end_id: int) -> Iterator[np.ndarray]:
    cache, _ = _library(content)
    specials = tuple(s.decode() for s in cache.specials)
    for a, b in batches_of(every):
        ids, counts = encode_texts(every[a:b], cache, specials)
        for part in np.split(ids, np.cumsum(counts)[:-1]):
            yield np.append(part, np.uint32(end_id))


def _dtype(content: bytes) -> str:
    return "<u2" if _library(content)[1] <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, vocabulary, end_id: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from the serialized ids of at most about sample_docs whole documents. The trainer wants many
    short ones, so they are drawn from those of at most SAMPLE_BYTES / 64 characters; the driver holds at most
    SAMPLE_BYTES of them."""
    docs = docs.where(F.length("text") <= SAMPLE_BYTES // 64)
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))

    def serialize(batches):
        for batch in batches:
            dtype = _dtype(vocabulary.value)
            every = [t or b"" for t in texts(batch.column(0))]
            for ids in _id_arrays(every, vocabulary.value, end_id):
                yield pa.RecordBatch.from_pydict({"raw": [ids.astype(dtype).tobytes()]})

    rows = (docs.select("text").sample(fraction=share, seed=11).mapInArrow(serialize, "raw binary")
            .limit(2 * sample_docs).toLocalIterator())
    samples, size = [], 0
    for r in rows:
        if size + len(r.raw) <= SAMPLE_BYTES:
            samples.append(bytes(r.raw))
            size += len(r.raw)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // 8, 256)), samples).as_bytes()
    except zstandard.ZstdError:                          # too little to learn from: raw content serves as one
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def write_ids(docs: DataFrame, path: str, vocabulary_path: str, id_col: str = "doc_id", text: str = "text",
              end_id: int = 0, level: int = 1) -> None:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    content = shared_file(spark, vocabulary_path)
    data = train_dictionary(rows, content, end_id)
    digest = hashlib.sha256(data).hexdigest()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.approxQuantile("doc_id", [i / n_parts for i in range(1, n_parts)], 0.1 / n_parts) if n_parts > 1 else []
    edges = spark.sparkContext.broadcast((data, sorted(set(cuts))))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, bounds = edges.value
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary),
                                          write_checksum=False)
        for batch in batches:
            dtype = _dtype(content.value)
            keys = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            counts, frames, at = [], [], 0
            every = [t or b"" for t in texts(batch.column(1))]
            for ids in _id_arrays(every, content.value, end_id):
                counts.append(len(ids))
                frames.append(packer.compress(ids.astype(dtype).tobytes()))
            part = np.searchsorted(np.array(bounds, dtype=np.float64), keys.astype(np.float64), side="left")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, type=pa.int32()), pa.array(keys, type=pa.int64()),
                 pa.array(counts, type=pa.int64()), pa.array(frames, type=pa.binary())],
                ["part", "doc_id", "n_ids", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, block = 0, None, 0

        def flush():
            frames = [h[2] for h in held]
            index = np.zeros(len(held), dtype=INDEX)
            index["doc_id"], index["n_ids"] = [h[0] for h in held], [h[1] for h in held]
            index["length"] = [len(f) for f in frames]
            index["offset"] = np.cumsum(index["length"]) - index["length"]
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], type=pa.int32()), "block": pa.array([block], type=pa.int64()),
                 "first_doc": [held[0][0]], "last_doc": [held[-1][0]], "n_docs": [len(held)],
                 "n_ids": [int(index["n_ids"].sum())], "dictionary_sha256": [digest],
                 "index": pa.array([index.tobytes()], type=pa.binary()),
                 "frames": pa.array([b"".join(frames)], type=pa.binary())})

        for batch in batches:
            for p, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size >= BLOCK_BYTES):
                    yield flush()
                    block = block + 1 if p == part else 0
                    held, size = [], 0
                elif not held and p != part:
                    block = 0
                part = p
                held.append((doc, n, frame))
                size += len(frame)
        if held:
            yield flush()

    blocks = (rows.mapInArrow(compress, "part int, doc_id long, n_ids long, frame binary")
              .repartition(n_parts, "part").sortWithinPartitions("part", "doc_id", "n_ids", "frame")
              .mapInArrow(pack, "part int, block long, first_doc long, last_doc long, n_docs long, n_ids long, "
                                "dictionary_sha256 string, index binary, frames binary"))
    blocks.write.parquet(f"{path}/blocks")
    id_bytes = 2 if _dtype(content.value) == "<u2" else 4
    spark.createDataFrame([(bytearray(data), digest, id_bytes)], "dictionary binary, sha256 string, id_bytes int") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    sizes = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row for each range of doc_id, so the one task below is bounded by the number of partitions
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    sizes.withColumn("within", within).join(before, "part") \
        .select("part", "block", (F.col("part_start") + F.col("within")).alias("start")).write.parquet(f"{path}/starts")


def _dictionary(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.sha256:
        raise ValueError("the dictionary is damaged")
    return spark.sparkContext.broadcast((data, row.sha256, "<u2" if row.id_bytes == 2 else "<u4"))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, or of the given ones: then only blocks
    whose range holds one are read, and only those documents' frames are decompressed."""
    small_batches(spark)
    shared = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_ids is not None:
        found = F.lit(False)
        for d in doc_ids:
            found = found | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
        blocks = blocks.where(found)
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), dtype=np.int64)
    rows = blocks.join(spark.read.parquet(f"{path}/starts"), ["part", "block"]) \
        .select("start", "dictionary_sha256", "index", "frames")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, digest, dtype = shared.value
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for start, made_with, index, frames in zip(*(c.to_pylist() for c in batch.columns)):
                if made_with != digest:
                    raise ValueError("a block was made with another dictionary")
                entries = np.frombuffer(index, dtype=INDEX)
                first = start + np.cumsum(entries["n_ids"]) - entries["n_ids"]
                if wanted is not None:
                    own = np.isin(entries["doc_id"], wanted)
                    entries, first = entries[own], first[own]
                raw, crc = [], []
                for offset, length, n in zip(entries["offset"].tolist(), entries["length"].tolist(),
                                             entries["n_ids"].tolist()):
                    ids = np.frombuffer(reader.decompress(frames[offset:offset + length]), dtype=dtype).astype("<u4")
                    if len(ids) != n:
                        raise ValueError("a document has another length than its index says")
                    crc.append(zlib.crc32(ids))
                    if keep_ids:
                        raw.append(ids.tobytes())
                docs = entries["doc_id"]
                out = {"doc_id": pa.array(docs, type=pa.int64(), mask=docs == NULL_ID),
                       "start": pa.array(first, type=pa.int64()),
                       "n_tokens": pa.array(entries["n_ids"], type=pa.int64()),
                       "ids_crc32": pa.array(crc, type=pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array(raw, type=pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def op7_token_id_files(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = shared_folder(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary or default_vocabulary())
    return read_ids(spark, path, keep_ids=False)
