"""Operator 10: n-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (a word is a run of ASCII letters, digits,
underscores and non-ASCII code points, in lower case; a text of one to four words is one
shingle). Documents with equal sets form a copy class and are compared once.

1. Every class gets MinHash values. Bands of them give buckets; two classes of similarity
   0.8 share no bucket with probability 3e-6.
2. In a bucket, classes are compared on 4-bit values, 16 at a time; a pair goes as soon as the
   posterior probability that it reaches the threshold is below ``TOLERANCE``. Of the pairs that
   stay only a spanning forest leaves the bucket: fewer edges than members, however alike they are.
   A bucket of more than ``CELL`` members is dealt out as pairs of blocks.
3. The components of these edges are clusters. All pairs within a cluster are compared: more
   MinHash values, 32 at a time, with the posterior again, and then the exact sets for the rest. A
   cluster that fills more than one block of bounded size is packed once, block by block, into
   files of the shared folder; a row for each pair of blocks, which holds only their places, goes
   to the task that reads and compares them. A task returns counts of links and a spanning
   forest, never the pairs. So the work grows with the square of a cluster, as an exact count of
   links must, while the rows and bytes that are shuffled and kept grow with its size.

Defined results: texts without a word (null and empty among them) are copies of each other
where they are equal, null counting as empty, and have no other links. Repeated rows and ids
are copies like any others; null ids are kept, and class ids are the smallest non-null id. Texts of
any length are read whole. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, new_file, open_fs, pack, remove, shared_dir, small, tidied, unpack
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: MinHash values: bands of four.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: Members of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
CELL = 16384
#: Rows of buckets that are looked at together.
GATHERED = 8192
#: Least posterior probability of reaching the threshold with which a pair goes on.
TOLERANCE = 1e-6
#: A block of a cluster holds about so many classes and shingles; a task compares so many pairs of blocks.
BLOCK, BLOCK_SHINGLES, PAIRS = 1024, 1 << 19, 8
#: Most ids (8 bytes each) that are broadcast to pick texts; beyond it that join shuffles.
BROADCAST_IDS = 1_000_000
#: Most rows of at most 150 bytes that are broadcast; beyond it those joins shuffle.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_CLASS = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as the longest text needs."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(1 << 16, 1 << n.bit_length())
            back = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls.up, cls.down = (
                    np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_BASE, back)
                )
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of ``text``, in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _CLASS[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edge):
        return np.empty(0, np.uint64)
    first, last = edge[::2], edge[1::2]
    up, down = _Powers.of(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw + np.uint64(1)) * down[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * up[first] + (last - first).astype(np.uint64))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = out * _STEP + h[k : k + m]
    return np.unique(mix(out + np.uint64(n)))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 512):
        np.minimum(low, ((h[i : i + 512, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return low


def bands_of(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * _STEP + v[:, k])
    return h.view(np.int64)


def sketch_of(values: np.ndarray) -> bytes:
    """64 four-bit values, 16 in each of four integers."""
    nibbles = (values[:64] & np.uint32(15)).astype(np.uint64).reshape(4, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).tobytes()


@lru_cache(maxsize=1000)
def least_matches(compared: int, bits: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values with which P(similarity >= threshold | matches), on a uniform prior, reaches ``tolerance``."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / (1 << bits)
    for m in range(compared + 1):
        log = m * np.log(p) + (compared - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
        w = np.exp(log - log.max())
        if w[s >= threshold].sum() >= tolerance * w.sum():
            return m
    return compared


SIGNED = "doc_id long, text_hash long, key binary, n int, bands array<long>, sketch binary, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, bands, sketches, sigs = [], [], [], [], []
        for t in batch.column(1):
            text = t.as_py() or ""
            s = shingle_set(text)
            keys.append(hashlib.md5(s.tobytes() if len(s) else b"text:" + text.encode("utf-8", "surrogatepass")).digest())
            sizes.append(len(s))
            v = minhashes(s) if len(s) else np.empty(0, np.uint32)
            bands.append(bands_of(v) if len(s) else v.view(np.int32).astype(np.int64))
            sketches.append(sketch_of(v) if len(s) else bytes(32))
            sigs.append(v.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sigs, pa.binary())],
            names=["doc_id", "text_hash", "key", "n", "bands", "sketch", "sig"],
        )


_NIBBLE = np.uint64(0x1111111111111111)


def _may_reach(n: np.ndarray, words: np.ndarray, x, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (x, y) may reach the threshold, by sizes and the posterior after every 16 values."""
    large = np.maximum(n[x], n[y])
    left = np.flatnonzero(np.minimum(n[x], n[y]) >= threshold * large - 1e-9)
    same = np.zeros(len(left), np.int64)
    for w in range(4):
        d = words[x if np.isscalar(x) else x[left], w] ^ words[y[left], w]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        same = same + 16 - np.bitwise_count(d & _NIBBLE)
        go = same >= least_matches(16 * w + 16, 4, threshold)
        left, same = left[go], same[go]
    return left


def forest(n: np.ndarray, words: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one bucket that may reach the threshold.

    Whatever a tree has reached is compared with what none has, so a bucket of near copies takes
    few rounds.
    """
    rest, edges = np.arange(len(n)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _may_reach(n, words, x, rest, threshold)
            if len(near):
                found = rest[near].tolist()
                rest = np.delete(rest, near)
                edges += [(x, y) for y in found]
                queue += found
    return edges


def _bucket_edges(threshold: float):
    """Edges (a, b) of whole buckets; rows are sorted by (h, i, j, key)."""

    def edges_of(rows: pa.Table, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        keys, n = rows.column(3), rows.column(4).to_numpy().astype(np.int64)
        words = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint64).reshape(-1, 4)
        two = first[size == 2]
        two = two[_may_reach(n, words, two, two + 1, threshold)]
        a, b = two.tolist(), (two + 1).tolist()
        for at, count in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            for x, y in forest(n[at : at + count], words[at : at + count], threshold):
                a.append(at + x)
                b.append(at + y)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(k, pa.int64())).combine_chunks() for k in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            group = [c.to_numpy() for c in rows.columns[:3]]
            starts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in group]))))
            end = rows.num_rows if last else int(starts[-1])
            held[:] = [] if last else rows.slice(end).to_batches()
            starts = starts[starts < end]
            if len(starts):
                yield tidied(edges_of(rows.slice(0, end).combine_chunks(), starts, np.diff(np.append(starts, end))))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHERED:
                yield from whole(False)
        if held and sum(b.num_rows for b in held):
            yield from whole(True)

    return run


class Sets:
    """Shingle sets of one block: distinct shingles, and each set's places among them."""

    def __init__(self, keys: np.ndarray, copies: np.ndarray, sig: np.ndarray, distinct: np.ndarray, place: np.ndarray, size: np.ndarray):
        self.keys, self.copies, self.sig, self.distinct, self.place, self.size = keys, copies, sig, distinct, place, size

    @classmethod
    def of(cls, rows: list[tuple[bytes, int, bytes, bytes]]) -> Sets:
        """rows: (key, documents, sig, shingles)."""
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
        keys = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), -1)
        sig = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
        return cls(keys, np.array([r[1] for r in rows], np.int64), sig, distinct, place.astype(np.uint32), np.array([len(s) for s in sets], np.uint32))

    def packed(self) -> bytes:
        return pack(self.keys.reshape(-1), self.copies, self.sig.reshape(-1), self.distinct, self.place, self.size)

    @classmethod
    def unpacked(cls, data: bytes) -> Sets:
        keys, copies, sig, *rest = unpack(data)
        return cls(keys.reshape(len(copies), -1), copies, sig.reshape(len(copies), -1), *rest)


def compare(one: Sets, other: Sets | None, threshold: float) -> list[tuple[bytes, int, int, bytes]]:
    """Links within a block, or between two: (key, other classes, other documents, root) of every class that has one.

    The root is a class of the same component of the links that this call has seen.
    """
    both = [one] if other is None else [one, other]
    shift = len(one.size) if other is not None else 0
    keys, copies, sig = (np.concatenate([getattr(s, f) for s in both]) for f in ("keys", "copies", "sig"))
    size = np.concatenate([s.size for s in both]).astype(np.int64)
    distinct, back = np.unique(np.concatenate([s.distinct for s in both]), return_inverse=True)
    place = np.concatenate([back[s.place + at] for s, at in zip(both, (0, len(one.distinct)))])
    ends = np.cumsum(size)
    starts = ends - size
    seen = np.zeros(len(distinct), bool)
    steps = [(n, least_matches(n, 8, threshold)) for n in range(32, VALUES + 1, 32)]
    right = np.arange(shift, len(size))
    right_place, right_starts = place[starts[shift] :], starts[shift:] - starts[shift]
    classes, docs, root = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), list(range(len(size)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(len(one.size)):
        c = right if shift else right[k + 1 :]
        c = c[np.minimum(size[c], size[k]) >= threshold * np.maximum(size[c], size[k]) - 1e-9]
        matched, before = np.zeros(len(c), np.int64), 0
        for n, least in steps:
            if not len(c):
                break
            matched = matched + (sig[c, before:n] == sig[k, before:n]).sum(axis=1)
            go = matched >= least
            c, matched, before = c[go], matched[go], n
        if not len(c):
            continue
        own = place[starts[k] : ends[k]]
        seen[own] = True
        if len(c) * 4 > len(right):
            common = np.add.reduceat(seen[right_place], right_starts, dtype=np.int64)[c - shift]
        else:
            common = np.array([np.count_nonzero(seen[place[starts[x] : ends[x]]]) for x in c])
        seen[own] = False
        linked = c[common >= threshold * (size[k] + size[c] - common) - 1e-9]
        if len(linked):
            classes[k] += len(linked)
            docs[k] += copies[linked].sum()
            classes[linked] += 1
            docs[linked] += copies[k]
            for x in linked.tolist():
                p, q = find(k), find(x)
                root[max(p, q)] = min(p, q)
    return [(keys[k].tobytes(), int(classes[k]), int(docs[k]), keys[find(k)].tobytes()) for k in np.flatnonzero(classes).tolist()]


def shingles_udf():
    @F.arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        return tidied(pa.array([shingle_set(t.as_py() or "").tobytes() for t in texts], pa.binary()))

    return shingles


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) between class keys: a spanning forest of each bucket's pairs that may reach the threshold."""
    rows = classes.where("n > 0").select("key", F.explode("bands").alias("h"))
    full = materialize(rows.groupBy("h").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    shared = materialize(rows.join(small(full, BROADCAST_IDS), "h"), "shared")
    block, blocks = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.ceil(F.col("members") / CELL).cast("int")
    # each block of a large bucket meets every other one; the pairs within a block are part of that
    others = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    member = (
        shared.join(classes.select("key", "n", "sketch"), "key")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(others))
        .where("blocks = 1 or block <> other")
        .select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "n", "sketch")
    )
    dealt = member.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "key")
    edges = materialize(dealt.mapInArrow(_bucket_edges(threshold), "a binary, b binary").distinct(), "bucket-edges")
    discard(full, shared)
    return edges


LINKS = "key binary, others long, documents long, root binary, label binary, block int, blocks int, file string, offset long, length long"


def _link_batch(links: list[tuple] = (), packed: list[tuple] = ()) -> pa.RecordBatch:
    """Rows of ``LINKS``: links of classes, and places of packed blocks."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    rows = [(*r, *[None] * 6) for r in links] + [(*[None] * 4, *r) for r in packed]
    cols = list(zip(*rows)) or [[]] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in LINKS.split(", ")])


def _compare_or_pack(path: str, threshold: float):
    """Clusters of one block are compared; blocks of larger ones are compared in themselves and packed into a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, offset, out = None, [], 0, None
        fs, folder = open_fs(path)
        name = f"blocks-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.bin"

        def done() -> pa.RecordBatch:
            nonlocal offset, out
            label, block, blocks = group
            sets = Sets.of(rows)
            links, packed = compare(sets, None, threshold), []
            if blocks > 1:
                if out is None:
                    out = new_file(fs, f"{folder}/{name}")
                data = sets.packed()
                out.write(data)
                packed.append((label, block, blocks, name, offset, len(data)))
                offset += len(data)
            return tidied(_link_batch(links, packed))

        try:
            for batch in batches:
                for label, block, blocks, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                    if (label, block, blocks) != group:
                        if rows:
                            yield done()
                        group, rows = (label, block, blocks), []
                    rows.append(tuple(rest))
            if rows:
                yield done()
        finally:
            if out is not None:
                out.close()

    return run


def _compare_packed(path: str, threshold: float):
    """Links between two packed blocks; rows (file, offset, length) of the one and of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)

        def read(file: str, offset: int, length: int) -> Sets:
            with fs.open_input_file(f"{folder}/{file}") as source:
                source.seek(offset)
                return Sets.unpacked(source.read(length))

        held, one = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != held:
                    held, one = row[:3], read(*row[:3])
                yield tidied(_link_batch(compare(one, read(*row[3:]), threshold)))

    return run


def cluster_links(held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``LINKS`` of the clusters (label, key, copies, sig, shingles); a class may have several."""
    spark = held.sparkSession
    share = held.groupBy("label").agg(F.count("*").alias("c"), F.sum(F.octet_length("shingles")).alias("s"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / (8 * BLOCK_SHINGLES))).cast("int")
    share = materialize(share.where("c > 1").select("label", blocks.alias("blocks")), "blocks")
    dealt = held.join(share, "label").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("label", "block", "blocks", "key", "copies", "sig", "shingles").repartition("label", "block").sortWithinPartitions("label", "block")
    path = shared_dir(spark, "packed")
    first = materialize(dealt.mapInArrow(_compare_or_pack(path, threshold), LINKS), "links")
    discard(share)
    place = first.where("file is not null").select("label", "block", "blocks", "file", "offset", "length")
    pairs = place.agg(F.sum(F.col("blocks") - 1 - F.col("block"))).first()[0] or 0
    if not pairs:
        return first
    right = place.select("label", F.col("block").alias("other"), F.col("file").alias("file_b"), F.col("offset").alias("offset_b"), F.col("length").alias("length_b"))
    left = place.where("block + 1 < blocks").withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    met = left.join(right, ["label", "other"]).select("file", "offset", "length", "file_b", "offset_b", "length_b")
    met = met.repartition(math.ceil(pairs / PAIRS), "file", "offset", "file_b", "offset_b").sortWithinPartitions("file", "offset")
    second = materialize(met.mapInArrow(_compare_packed(path, threshold), LINKS), "links-between")
    both = materialize(first.where("file is null").unionByName(second), "links")
    discard(first, second)
    remove(spark, path)
    return both


def text_hash_of(text):
    """Tells texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_id, n_links, n_text_links, text_hash, is_first.

    ``class_id`` is the smallest id of the documents connected by links, ``copy_id`` that of the
    documents with an equal shingle set, ``n_links`` the number of other documents of similarity
    ``threshold`` or more (copies among them), ``n_text_links`` of other shingle sets. ``text_hash``
    is the text's ``text_hash_of``; ``is_first`` marks the rows of a class of the smallest
    (id, text_hash), and every row of a class without an id.
    Bands are those of ``THRESHOLD``; a lower ``threshold`` is refused.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {THRESHOLD}, for which candidates are searched")
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", text_hash_of(F.col("text")))
    signed = materialize(docs.mapInArrow(_sign, SIGNED), "signed")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    grouped = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.min(row).alias("first")), "classes")
    classes = materialize(signed.dropDuplicates(["key"]).select("key", "n", "bands", "sketch", "sig"), "class-values")
    edges = candidate_edges(classes, threshold)
    clusters = components(edges)
    discard(edges)

    # shingles of the clustered classes alone, from the text of one document each
    wanted = materialize(grouped.join(small(clusters, BROADCAST_ROWS), F.col("node") == F.col("key")).select("key", "label", "copy_id", "copies"), "wanted")
    ids = wanted.select(F.col("copy_id").alias("doc_id")).distinct()
    same_id = docs["doc_id"].eqNullSafe(ids["doc_id"])
    texts = docs.join(small(ids, BROADCAST_IDS), same_id, "left_semi").select("text")
    sets = (
        texts.withColumn("shingles", shingles_udf()("text"))
        .select(F.unhex(F.md5("shingles")).alias("key"), "shingles")
        .where(F.length("shingles") > 0)
        .dropDuplicates(["key"])
    )
    signatures = materialize(classes.select("key", "sig").join(small(wanted, BROADCAST_ROWS), "key"), "signatures")
    held = materialize(sets.join(small(signatures, BROADCAST_ROWS), "key"), "sets")
    links = cluster_links(held, threshold)
    parts = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("others").alias("others"), F.sum("documents").alias("documents"))
    labelled = grouped.join(counts, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    labelled = materialize(labelled.where("copies > 1 or label is not null"), "labelled")
    least = labelled.where("label is not null").groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min("first").alias("class_first"))
    info = materialize(
        labelled.join(least, "label", "left").select(
            "key",
            "copy_id",
            F.coalesce("class_id", "copy_id").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"),
            F.coalesce("others", F.lit(0)).alias("n_text_links"),
            F.coalesce("class_first", "first").alias("first"),
        ),
        "info",
    )
    discard(grouped, classes, clusters, wanted, signatures, held, links, parts, labelled)
    return (
        signed.select("doc_id", "key", "text_hash")
        .join(small(info, BROADCAST_ROWS), "key", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("copy_id", "doc_id").alias("copy_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
            "text_hash",
            F.coalesce(F.struct("doc_id", "text_hash") == F.col("first"), F.col("first").isNull()).alias("is_first"),
        )
    )
