"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashes of word shingles; two documents link when their sets'
Jaccard similarity reaches the threshold.  A set of n tokens can miss at most
n - ceil(t n) of them in a partner.  Tokens are ordered rare class first, then
by hash.  Rare tokens are indexed singly and frequent ones as k-token
combinations of the tokens of one part; a set's prefix is extended until its
rare tokens and, of each part, its frequent tokens less k - 1 exceed what may
be missing: then two linked sets share a rare token or a combination inside
both prefixes.  Sets that meet are candidates, and candidates are verified on
their whole sets.

Short sets have one part and k = 2.  From LONG tokens on, k is 3 and the number
of parts grows with the set (four times at four times the size), so the number of
combinations stays within about a dozen times the tokens.  Both must be alike in
two linked sets, so a set is indexed as its own size and its smallest possible
partner's ask for.

1. Equal sets become one node.
2. Folding: nodes that share a 2-token combination of their four lowest hashes meet the lowest node there,
   one candidate a node; verified ones are linked. Large families of near copies thus become one component.
3. Class of a token: how many unfolded nodes hold it, counted over all tokens, which travel as packed 40-bit
   arrays. Frequent ones go into a fixed-size filter. Whatever a filter answers, it answers the same for every
   set, so a false positive only moves a token to the other class and loses no link.
4. Signatures of all nodes, packed likewise. Each node is verified against the best centre of its meetings, which
   makes families one component. Nodes that still meet across components are candidates if what their
   prefixes share, and all that follows them, can make the overlap that a link needs, and if their sketches don't
   differ in more bits than linked sets can (``sketch``): pairs that only meet in much the same frequent tokens end
   inside the join, before a row is made of them. A set with combinations has all
   its rare tokens indexed, so two sets that meet in combinations alone share none of them, nor any frequent token
   that comes before the second of the first pair they share: that bounds the sizes of such partners, place by
   place (``size_limit``), and empties most meetings before any pair is made.
5. Verification in cells of a grid over the pairs, where each set goes once to a cell; then connected components
   over all links.

Defined results: a null, empty or blank text has no tokens, links with
nothing and is its own component; a text shorter than a shingle is one token;
repeated rows share a node; null ids are never smallest unless alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contingo.llm.cluster import components, cut, free_name, in_filter, lean, member_filter, small_batches
from contingo.llm.pretoken import batches_of, ragged
from contingo.llm.words import mix, shingle_sets, texts

WORDS = 5
PERCENT = 75
#: A token in more nodes than this is frequent.
FREQUENT = 24
LOWEST = 4
#: 64-bit words of a set's sketch.
SKETCH = 24
#: Sets of so many tokens have several parts (a sixteenth of this number at first) and combinations of three.
LONG = 512
#: Tokens in a bucket of the index, and bytes of sets in a cell of the verification, about.
BUCKET_TOKENS = 1 << 20
CELL_BYTES = 1 << 24


def most_missing(n: int, percent: int = PERCENT) -> int:
    """How many of n tokens a partner may lack."""
    return n - -(-percent * n // 100)


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F))


def combinations(tokens: np.ndarray, k: int = 2) -> np.ndarray:
    """Hash of every combination of k = 2 or 3 of the tokens (which ascend)."""
    i, j = np.triu_indices(len(tokens), 1)
    pairs = pair_hash(tokens[i], tokens[j])
    if k == 2:
        return pairs
    after = len(tokens) - 1 - j                              # every later token goes with a pair
    third = ragged(j + 1, after)
    return pair_hash(np.repeat(pairs, after), tokens[third])


def level(n: int, long: int) -> int:
    """0 for short sets, one more at each four times the size."""
    out = 0
    while n >= long:
        n, out = n // 4, out + 1
    return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set: the node, and a check that no two sets share a node."""
    if not len(tokens):
        return 0, 0
    a = mix(np.array([tokens.sum(), np.bitwise_xor.reduce(tokens)], dtype=np.uint64) + np.uint64(len(tokens)))
    b = mix(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True))
    node = int((a[:1] ^ (a[1:] << np.uint64(1))).view(np.int64)[0])
    return node or 1, int(b.view(np.int64)[0])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Of each of SKETCH * 64 classes of tokens, whether the set has an odd number of them. Every bit that differs between
    two sets takes a token that only one of them has."""
    odd = np.bincount((tokens % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(x: Column, y: Column) -> Column:
    """In how many bits two sketches (structs of s0, s1, ...) differ."""
    return sum((F.bit_count(x[s].bitwiseXOR(y[s])) for s in SKETCHED[1:]), F.bit_count(x["s0"].bitwiseXOR(y["s0"])))


def extended(tokens: np.ndarray, more: int, k: int, parts: int) -> list[np.ndarray]:
    """The first of the tokens, by part, until so many of them follow the first k - 1 of their parts."""
    part = (tokens % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[order] = np.arange(len(tokens)) - np.repeat(starts, np.diff(starts, append=len(tokens)))
    end = int(np.searchsorted(np.cumsum(rank >= k - 1), more)) + 1
    own = tokens[order[order < end]]
    cuts = np.flatnonzero(np.diff(part[order[order < end]])) + 1
    return np.split(own, cuts)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT,
               long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """The extended prefix of a set: its rare tokens, and the combinations of its frequent ones."""
    return signed(tokens, frequent, percent, long)[:2]


def signed(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT,
           long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signatures``, and for each combination how many tokens a partner lacks that shares none of the rare ones and
    whose first common tokens these are: the rare ones and, of pairs, the frequent ones that come before the second."""
    n = len(tokens)
    need = most_missing(n, percent) + 1
    rare = tokens[~frequent][:need]
    more = need - len(rare)
    if not more or n < 2:                                    # a set of one token links with equal sets only
        return rare, tokens[:0], np.zeros(0, dtype=np.int64)
    often, out, lacked = tokens[frequent], [], []
    for at in range(level(-(-percent * n // 100), long), level(n, long) + 1):
        k, parts = (3, long // 16 * 4 ** (at - 1)) if at else (2, 1)
        for own in extended(often, more, k, parts):
            out.append(combinations(own, k))
            lacked.append(len(rare) + (np.zeros(len(out[-1]), dtype=np.int64) if at else np.triu_indices(len(own), 1)[1] - 1))
    every, before = np.concatenate(out), np.concatenate(lacked)
    order = np.lexsort((before, every))
    every, before = every[order], before[order]
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[:len(every)])
    return rare, every[new], before[new]


def size_limit(n, rare, percent: int):
    """The largest partner of a set that shares none of its rare tokens with it (integers or arrays)."""
    return (n - rare) * (100 + percent) // percent - n


def supported(token: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which rows of the groups of equal tokens (in order) can have a partner in their group: one within their limit,
    and one whose limit they are within. What drops out is taken away once more."""
    kept = np.arange(len(token))
    for _ in range(2):
        if not len(kept):
            break
        t, own, most = token[kept], n[kept], limit[kept]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(starts, append=len(t))
        ok = (np.repeat(np.minimum.reduceat(own, starts), size) <= most) \
            & (np.repeat(np.maximum.reduceat(most, starts), size) >= own)
        kept = kept[ok]
    return kept


def meet_bound(c1: Column, often: Column, tails: Column) -> Column:
    """Most tokens that two sets can share: c1 rare ones in both prefixes, frequent ones (at most ``often``), and
    what follows the longer of the tails."""
    return c1 + often + tails


def id_keys(ids: pa.Array) -> np.ndarray:
    """A filter's key of each document id (null is a key of its own)."""
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(known * np.uint64(0x9E3779B97F4A7C15) + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))


def id_filter(ids: DataFrame, expected: int) -> bytes:
    """A fixed-size filter of the one column of document ids."""
    return member_filter(ids, expected, id_keys)


def filtered(batch: pa.RecordBatch, bitmap: bytes | None, inside: bool) -> pa.RecordBatch:
    """The rows whose ids the filter holds, or doesn't."""
    if bitmap is None:
        return batch
    held = in_filter(np.frombuffer(bitmap, dtype=np.uint8), id_keys(batch.column(0)))
    return batch.filter(pa.array(held if inside else ~held))


def doc_sets(batch: pa.RecordBatch, width: int, column: int = 1) -> list[np.ndarray]:
    every = texts(batch.column(column))
    return [s for a, b in batches_of(every) for s in shingle_sets(every[a:b], width)]


class Join:
    def __init__(self, docs: DataFrame, id_col: str, text: str, width: int, percent: int, frequent: int,
                 long: int = LONG):
        if long < 16 or not 25 <= percent <= 100:
            raise ValueError("long sets have at least 16 tokens, and percent is from 25 to 100")
        self.spark, self.width, self.percent, self.frequent = docs.sparkSession, width, percent, frequent
        self.long = long
        small_batches(self.spark)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.n_buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(self) -> DataFrame:
        """(doc_id, n, node, check, low, s0, ...): one row for each document; low has the folding combinations, s0, ...
        the sketch."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = doc_sets(batch, width)
                prints = [fingerprint(s) for s in every]
                sketches = np.array([sketch(s) for s in every], dtype=np.int64).reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in every], type=pa.int64()),
                     pa.array([p[0] for p in prints], type=pa.int64()),
                     pa.array([p[1] for p in prints], type=pa.int64()),
                     pa.array([combinations(s[:LOWEST]).view(np.int64) for s in every], type=pa.list_(pa.int64())),
                     *(pa.array(column) for column in sketches.T.copy())],
                    ["doc_id", "n", "node", "check", "low", *SKETCHED])

        return self.docs.mapInArrow(lean(run), "doc_id long, n long, node long, check long, low array<long>, "
                                    + ", ".join(f"{s} long" for s in SKETCHED))

    def packed(self, skip: bytes | None, frequent: bytes | None) -> DataFrame:
        """(bucket, kind, counts, low, owners, before, nodes): tokens of one bucket, sorted, as the number of tokens for
        each value of their upper 16 bits and the next 24 bits of each; each one's owner, how many tokens come before a
        combination (``signed``), and the owners (OWNER). Without
        ``frequent`` all tokens (kind 0) of the documents that ``skip`` doesn't hold; else signatures of all:
        rare tokens (kind 0) and combinations of frequent ones (kind 1)."""
        shared = self.spark.sparkContext.broadcast((skip, frequent))
        n_buckets, width, percent, long = self.n_buckets, self.width, self.percent, self.long
        named = frequent is not None
        edges = bucket_edges(n_buckets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            skipped, common = shared.value
            bitmap = None if common is None else np.frombuffer(common, dtype=np.uint8)
            seen: set[int] = set()
            held: tuple[list, list, list] = [], [], []
            nodes: list[tuple[int, int, int]] = []
            size = 0
            for batch in batches:
                for tokens in doc_sets(filtered(batch, skipped, False), width):
                    node = fingerprint(tokens)[0]
                    if not len(tokens) or node in seen:
                        continue
                    seen.add(node)
                    own = (tokens, tokens[:0], np.zeros(0, dtype=np.int64))
                    if bitmap is not None:
                        own = signed(tokens, in_filter(bitmap, tokens >> np.uint64(24)), percent, long)
                    for part, some in zip(held, own):
                        part.append(some)
                    size += len(own[0]) + len(own[1])
                    nodes.append((node, len(tokens), len(own[0])))
                    if size > 1 << 20:
                        yield from pack(held, nodes)
                        held, nodes, size = ([], [], []), [], 0
            if nodes:
                yield from pack(held, nodes)

        def pack(held: tuple[list, list, list], nodes: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                tokens = np.concatenate(held[kind]) >> np.uint64(24)
                owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(h) for h in held[kind]])
                order = np.argsort(tokens)
                tokens, owner = tokens[order], owner[order]
                before = np.minimum(np.concatenate(held[2])[order], 65535).astype("<u2") if kind else None
                top = (tokens >> np.uint64(24)).astype(np.int64)
                cuts = np.searchsorted(top, edges)
                rows = []
                for i in range(n_buckets):
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    if a == b:
                        continue
                    counts = np.bincount(top[a:b] - edges[i], minlength=edges[i + 1] - edges[i])
                    low = tokens[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()
                    owners = names = b""
                    lacked = before[a:b].tobytes() if kind else b""
                    if named:
                        who, own = np.unique(owner[a:b], return_inverse=True)
                        owners = own.astype(narrow(len(who))).tobytes()
                        names = np.array(nodes, dtype=OWNER)[who].tobytes()
                    rows.append((i, kind, counts.astype("<u4").tobytes(), low, owners, lacked, names))
                if rows:
                    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(zip(*rows), types)],
                        ["bucket", "kind", "counts", "low", "owners", "before", "nodes"])

        return self.docs.mapInArrow(lean(run), "bucket int, kind int, counts binary, low binary, owners binary, before binary, "
                                    "nodes binary")

    def frequent_tokens(self, skip: bytes) -> DataFrame:
        most, n_buckets = self.frequent, self.n_buckets

        def count(table: pa.Table) -> pa.Table:
            tokens = np.sort(np.concatenate([unpacked(*r, n_buckets) for r in zip(
                *(table.column(c).to_pylist() for c in ("bucket", "counts", "low")))]))
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            often = np.diff(starts, append=len(tokens)) > most
            return pa.table({"token": pa.array(tokens[starts[often]].view(np.int64), type=pa.int64())})

        return self.packed(skip, None).groupBy("bucket").applyInArrow(count, "token long")

    def meetings(self, frequent: bytes) -> DataFrame:
        """(meeting, kind, times, node, rare, limit): the sets of at least two nodes that share signatures, and how many;
        rare is the number of a node's rare tokens in its prefix, limit the size of its largest partner whose first
        common tokens (no rare ones) are in such a signature."""
        n_buckets, percent = self.n_buckets, self.percent

        def meet(table: pa.Table) -> pa.Table:
            tokens, owners_of, lacked = [], [], []
            kind = table.column("kind")[0].as_py()
            for bucket, counts, low, owners, before, names in zip(
                    *(table.column(c).to_pylist() for c in ("bucket", "counts", "low", "owners", "before", "nodes"))):
                who = np.frombuffer(names, dtype=OWNER)
                tokens.append(unpacked(bucket, counts, low, n_buckets))
                owners_of.append(who[np.frombuffer(owners, dtype=narrow(len(who)))])
                lacked.append(np.frombuffer(before, dtype="<u2") if kind else owners_of[-1]["rare"])
            token, owner = np.concatenate(tokens), np.concatenate(owners_of)
            n = owner["n"].astype(np.int64)
            limit = size_limit(n, np.concatenate(lacked).astype(np.int64), percent)
            order = np.lexsort((-limit, owner["node"], token))
            token, owner, n, limit = token[order], owner[order], n[order], limit[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner["node"][1:] != owner["node"][:-1])])
            token, owner, n, limit = token[new], owner[new], n[new], limit[new]
            if kind:
                kept = supported(token, n, limit)
                token, owner, limit = token[kept], owner[kept], limit[kept]
            if not len(token):
                return MEETINGS.empty_table()
            node = np.ascontiguousarray(owner["node"])
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(starts, append=len(token))
            mixed = mix(node.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            together = mix(np.add.reduceat(mixed, starts) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) \
                + mix(np.bitwise_xor.reduceat(mixed, starts))
            kept = np.flatnonzero(size > 1)
            meeting, first, same, times = np.unique(together[kept], return_index=True, return_inverse=True, return_counts=True)
            every, kept = kept, kept[first]
            at = ragged(starts[kept], size[kept])
            place = np.cumsum(size[kept]) - size[kept]        # meetings of the same nodes are one, with the largest limits
            most = np.full(len(at), np.iinfo(np.int64).min)
            np.maximum.at(most, ragged(place[same], size[every]), limit[ragged(starts[every], size[every])])
            return pa.table([np.repeat(meeting, size[kept]).view(np.int64), np.full(len(at), kind, dtype=np.int32),
                             np.repeat(times, size[kept]).astype(np.int64), node[at], owner["rare"][at].astype(np.int32),
                             most], schema=MEETINGS)

        return self.packed(None, frequent).groupBy("bucket", "kind") \
            .applyInArrow(meet, "meeting long, kind int, times long, node long, rare int, limit long") \
            .groupBy("meeting", "kind", "node") \
            .agg(F.sum("times").alias("times"), F.max("rare").alias("rare"), F.max("limit").alias("limit"))

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the threshold. nodes: (node, n, doc_id of one such row). Only
        documents whose ids a filter of the needed ones holds are split into tokens again. Pairs are dealt to the cells
        of a grid by both their nodes, and a set goes once to each cell that has a pair of it."""
        width, percent = self.width, self.percent
        pairs = cut(pairs)
        asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
                    .agg(F.count(F.lit(1)).alias("pairs")).join(nodes, "node").select("node", "doc_id", "n", "pairs"))
        size = asked.agg(F.sum(F.col("n") * F.col("pairs") * 8).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
        side = max(1, math.isqrt((size.bytes or 0) // CELL_BYTES) + 1)
        shared = self.spark.sparkContext.broadcast(id_filter(asked.select("doc_id"), size.n))

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()                            # equal sets of one task go once
            for batch in batches:
                batch = filtered(batch, shared.value, True)
                found = [(fingerprint(s)[0], s) for s in doc_sets(batch, width)]
                new = [(n, s) for n, s in found if n not in sent and not sent.add(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in new], type=pa.int64()),
                     pa.array([s.tobytes() for _, s in new], type=pa.binary())], ["node", "tokens"])

        def at(node: str) -> Column:
            return F.pmod(F.xxhash64(node), F.lit(side))

        placed = pairs.select("a", "b", (at("a") * side + at("b")).alias("cell"))
        places = placed.select(F.explode(F.array("a", "b")).alias("node"), F.col("cell").alias("place")).distinct()
        sets = places.join(self.docs.mapInArrow(lean(wanted), "node long, tokens binary"), "node").select("place", "node", "tokens")

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            # documents with equal sets may bring a set more than once
            own = {n: np.frombuffer(t, dtype=np.uint64)
                   for n, t in zip(right.column("node").to_pylist(), right.column("tokens").to_pylist())}
            a, b = (left.column(c).to_numpy() for c in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else []
            ok = np.zeros(len(a), dtype=bool)
            for i, j in zip(cuts[:-1], cuts[1:]):
                ok[i:j] = partners(own[int(a[i])], [own[n] for n in b[i:j].tolist()], percent)
            return pa.table({"a": pa.array(a[ok], type=pa.int64()), "b": pa.array(b[ok], type=pa.int64())})

        return cut(placed.groupBy("cell").cogroup(sets.groupBy("place")).applyInArrow(check, "a long, b long").distinct())


#: A node in a bucket: its hash, its tokens and the rare ones of its prefix.
OWNER = np.dtype([("node", "<i8"), ("n", "<i4"), ("rare", "<i4")])
MEETINGS = pa.schema([("meeting", pa.int64()), ("kind", pa.int32()), ("times", pa.int64()), ("node", pa.int64()),
                      ("rare", pa.int32()), ("limit", pa.int64())])
#: The columns of a sketch.
SKETCHED = [f"s{i}" for i in range(SKETCH)]
#: Tokens compared at once.
COMPARED = 1 << 20


def partners(tokens: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets (none empty) reach the threshold with the set of these tokens."""
    ok, first = np.zeros(len(others), dtype=bool), 0
    while first < len(others):
        last, size = first, 0
        while last < len(others) and (last == first or size + len(others[last]) <= COMPARED):
            size += len(others[last])
            last += 1
        lens = np.array([len(o) for o in others[first:last]])
        flat = np.concatenate(others[first:last])
        held = tokens[np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)] == flat
        common = np.add.reduceat(held.astype(np.int64), np.cumsum(lens) - lens)
        ok[first:last] = 100 * common >= percent * (lens + len(tokens) - common)
        first = last
    return ok


def bucket_edges(n_buckets: int) -> np.ndarray:
    """Buckets are ranges of a token's upper 16 bits."""
    return np.arange(n_buckets + 1, dtype=np.int64) * 65536 // n_buckets


def narrow(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def unpacked(bucket: int, counts: bytes, low: bytes, n_buckets: int) -> np.ndarray:
    wide = np.zeros((len(low) // 3, 8), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(low, dtype=np.uint8).reshape(-1, 3)
    first, end = bucket_edges(n_buckets)[bucket:bucket + 2]
    top = np.repeat(np.arange(first, end, dtype=np.uint64), np.frombuffer(counts, dtype="<u4"))
    return wide.reshape(-1).view("<u8") | (top << np.uint64(24))


def linked(join: Join) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of each document, and (node, doc_id, part, component_id) of each distinct set: the
    smallest id that holds it, its component's smallest node and smallest id."""
    rows = cut(join.rows())
    real = rows.where("n > 0")
    every = rows.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    join.n_buckets = min(65536, max(join.n_buckets, (every.tokens or 0) // BUCKET_TOKENS))
    nodes = real.groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"),
                                     F.min("check").alias("c1"), F.max("check").alias("c2"),
                                     *(F.max(s).alias(s) for s in SKETCHED))
    nodes = cut(nodes.select("node", "n", "doc_id", *SKETCHED, F.when(F.col("c1") == F.col("c2"), F.lit(True)).otherwise(
        F.raise_error(F.lit("two different sets share a 64-bit hash")).cast("boolean")).alias("sound")))

    # 2. folding: one candidate a node, the lowest node that shares one of its lowest combinations
    low = real.groupBy("node").agg(F.first("low").alias("low")).select("node", F.explode("low").alias("s"))
    lowest = low.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    fold = low.join(lowest.select("s", "a"), "s").where("a < node").groupBy(F.col("node").alias("b")) \
        .agg(F.min("a").alias("a")).select("a", "b")
    folded = join.verified(fold, nodes)
    # each folded node has one lower node; two steps along them name a family well enough to keep its pairs apart
    # from candidates (a family under two names costs candidates, not links)
    one = folded.select(F.col("b").alias("node"), F.col("a").alias("up"))
    labels = one.join(one.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left") \
        .select("node", F.coalesce("top", "up").alias("label"))

    # 3. classes: copies and folded nodes don't count again
    rep = nodes.select("node", F.col("doc_id").alias("rep"))
    again = real.select("node", "doc_id").join(rep, "node").where(~F.col("doc_id").eqNullSafe(F.col("rep"))) \
        .select("doc_id").union(folded.select(F.col("b").alias("node")).distinct().join(nodes, "node").select("doc_id"))
    often = cut(join.frequent_tokens(id_filter(again, every.rows)))
    common = member_filter(often, often.count())

    # 4. signatures that meet across components, as often as linked sets must
    named = nodes.join(labels.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left") \
        .select("node", "n", F.coalesce("label", "node").alias("part"))
    met = cut(join.meetings(common).join(named, "node").withColumn(
        "w", F.sum("times").over(Window.partitionBy("node"))))
    # of a meeting's nodes the one that meets others most often is likely to link with most of them: each other node
    # is verified against the best of its meetings' centres first, so that families become one part
    centre = met.groupBy("meeting", "kind").agg(F.max(F.struct("w", "node", "n", "limit", "part")).alias("c"))
    best = met.join(centre, ["meeting", "kind"]).where(F.col("part") != F.col("c.part")) \
        .where(100 * F.least("n", "c.n") >= join.percent * F.greatest("n", "c.n")) \
        .where((F.col("kind") == 0) | (F.col("c.n") <= F.col("limit")) & (F.col("n") <= F.col("c.limit"))) \
        .groupBy("node").agg(F.max(F.struct("c.w", "c.node")).alias("c"))
    folded = cut(folded.union(join.verified(best.select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct(), nodes)))
    labels = components(folded)
    met = cut(met.drop("part").join(labels, "node", "left").select(
        "meeting", "kind", "times", "node", "n", "rare", "limit", F.coalesce("label", "node").alias("part")))
    apart = met.groupBy("meeting", "kind").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 < p2")
    met = met.join(apart.select("meeting", "kind"), ["meeting", "kind"], "left_semi") \
        .join(nodes.select("node", *SKETCHED), "node")
    need = F.col("n") - F.ceil(join.percent * F.col("n") / 100 - 1e-9) + 1
    tail = F.col("n") - need                                  # tokens behind a prefix of the shortest length
    # frequent tokens in a prefix: two for each of at most n / 16 parts beyond what is needed
    often = F.when(F.col("rare") >= need, 0).otherwise(need - F.col("rare") + 2 + F.floor(F.col("n") / 8))
    met = met.withColumns({"tail": tail, "often": often})

    def side(name: str) -> DataFrame:
        return met.select("meeting", "kind", *(["times"] if name == "a" else []), F.col("node").alias(name),
                          F.struct("n", "limit", "part", "tail", "often", *SKETCHED).alias(f"of_{name}"))

    x, y = F.col("of_a"), F.col("of_b")
    least = F.ceil(join.percent * (x["n"] + y["n"]) / (100 + join.percent) - 1e-9)
    pairs = side("a").join(side("b"), ["meeting", "kind"]).where(x["part"] < y["part"]) \
        .where(100 * F.least(x["n"], y["n"]) >= join.percent * F.greatest(x["n"], y["n"])) \
        .where((F.col("kind") == 0) | (x["n"] <= y["limit"]) & (y["n"] <= x["limit"])) \
        .where(x["n"] + y["n"] - differing(x, y) >= 2 * least) \
        .select("a", "b", "kind", "times", F.least(x["often"], y["often"]).alias("often"), least.alias("least"),
                F.greatest(x["tail"], y["tail"]).alias("tails")) \
        .groupBy("a", "b", "often", "least", "tails") \
        .agg(F.sum(F.when(F.col("kind") == 0, F.col("times")).otherwise(0)).alias("c1")) \
        .where(meet_bound(F.col("c1"), F.col("often"), F.col("tails")) >= F.col("least")) \
        .select("a", "b")

    # 5. verification and components
    links = folded.union(join.verified(pairs, nodes))
    labels = components(links)
    whole = nodes.join(labels.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left") \
        .select("node", "doc_id", F.coalesce("label", "node").alias("part"))
    smallest = whole.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "n", "node"), whole.join(smallest, "part")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WORDS,
                    percent: int = PERCENT, frequent: int = FREQUENT, long: int = LONG) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, nodes = linked(Join(docs, id_col, text, width, percent, frequent, long))
    of_node = nodes.select(F.col("node").alias("n2"), "component_id")
    return rows.join(of_node, (F.col("node") == F.col("n2")) & (F.col("n") > 0), "left") \
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WORDS,
                percent: int = PERCENT, frequent: int = FREQUENT, long: int = LONG) -> DataFrame:
    """The documents without near duplicates, columns as before: of each component one row with its smallest id
    stays (of nodes that share that id the smallest). Documents without tokens all stay."""
    node, keep_node, keep_id = (free_name(docs.columns, n) for n in ("node", "keep_node", "keep_id"))
    _, nodes = linked(Join(docs, id_col, text, width, percent, frequent, long))
    keep = nodes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("part") \
        .agg(F.min("node").alias(keep_node), F.first("component_id").alias(keep_id)).drop("part")
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(s)[0] for s in doc_sets(batch, width, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, type=pa.int64())], [*schema.names, node])

    marked = docs.mapInArrow(lean(run), T.StructType([*schema.fields, T.StructField(node, T.LongType())]))
    empty = marked.where(F.col(node) == 0).drop(node)
    full = marked.where(F.col(node) != 0).join(
        keep, (F.col(node) == F.col(keep_node)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep_id)), "left_semi")
    return full.dropDuplicates([node]).drop(node).unionByName(empty)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
