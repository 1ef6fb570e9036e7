"""Operator 9: exact top-k search in binary codes by incremental multi-index hashing.

A vector's code has a bit for the sign of each dimension. Rows of equal codes are one entry with
its k smallest ids, which is all that a top-k can ask of them. Entries are searched in blocks of
bounded size by blocks of query codes, which stream through. In a block, each of the code's segments has a table
from segment values to entries. A query looks up values at a growing number of flipped bits,
segment by segment, verifies what it finds, and stops when its kth distance is covered: after
radius r in all segments and r + 1 in j of them, every code nearer than ``m * (r + 1) + j`` was
seen. Where the values to look up outnumber the block's entries, all of them are verified instead.

Results are exact, ties go to the smaller id. Defined results: a null vector has no code, so it
is neither found nor answered; NaN counts as not positive; shorter vectors are padded with zero
bits. Rows with equal ids are rows of their own; null ids are not found. A table of fewer than k
rows gives all of them. Vectors of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

K = 10
#: Entries and query codes of a block, at most about; query codes of a block that is cut to give every core work.
ENTRIES, QUERIES, LEAST = 1 << 18, 1 << 16, 128


def sign_codes(vectors: list[list[float] | None], dims: int) -> list[bytes | None]:
    """Packed sign bits, padded to whole 64-bit words."""
    size = -(-max(1, dims) // 64) * 64
    out: list[bytes | None] = []
    for v in vectors:
        if v is None:
            out.append(None)
            continue
        bits = np.zeros(size, bool)
        bits[: len(v)] = np.array([0 if x is None else x for x in v], float) > 0
        out.append(np.packbits(bits).tobytes())
    return out


@lru_cache(maxsize=64)
def flips(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


class Block:
    """Segment tables over one block of distinct codes."""

    def __init__(self, codes: list[bytes], weights: np.ndarray, dims: int):
        self.words = np.frombuffer(b"".join(codes), np.uint64).reshape(len(codes), -1)
        self.weights = weights
        bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, :dims]
        segments = max(1, round(dims / max(8, min(20, math.log2(len(codes) + 1)))))
        cuts = [dims * k // segments for k in range(segments + 1)]
        self.cuts = list(zip(cuts, cuts[1:]))
        self.tables = []
        for a, b in self.cuts:
            value = bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64))
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.append(0, np.cumsum(np.bincount(value, minlength=1 << (b - a))))))
        self.dims = dims

    def search(self, code: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances) that hold the k nearest rows, ties of the last distance among them."""
        query = np.frombuffer(code, np.uint64)
        bits = np.unpackbits(np.frombuffer(code, np.uint8))[: self.dims]
        own = [int(bits[a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64))) for a, b in self.cuts]
        n, m = len(self.words), len(self.cuts)
        seen = np.zeros(n, bool)
        at, far = [], []

        def verify(found: np.ndarray) -> None:
            found = np.unique(found[~seen[found]])
            seen[found] = True
            at.append(found)
            far.append(np.bitwise_count(self.words[found] ^ query).sum(axis=1, dtype=np.int64))

        def kth() -> float:
            d = np.concatenate(far)
            order = np.argsort(d, kind="stable")
            total = np.cumsum(self.weights[np.concatenate(at)][order])
            i = np.searchsorted(total, k)
            return float(d[order[i]]) if i < len(order) else math.inf

        for radius in range(self.dims + 1):
            if sum(math.comb(b - a, radius) for a, b in self.cuts if radius <= b - a) >= n or seen.all():
                verify(np.flatnonzero(~seen))
                break
            covered = False
            for j, ((a, b), (order, first)) in enumerate(zip(self.cuts, self.tables)):
                if radius <= b - a:
                    values = own[j] ^ flips(b - a, radius)
                    lo, size = first[values], first[values + 1] - first[values]
                    total = int(size.sum())
                    if total:
                        place = np.repeat(lo, size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
                        verify(order[place])
                # radius in segments 0..j, radius - 1 in the others: all below m * radius + j + 1 were seen
                if at and kth() < m * radius + j + 1:
                    covered = True
                    break
            if covered:
                break
        entries, distance = np.concatenate(at), np.concatenate(far)
        limit = kth()
        return entries[distance <= limit], distance[distance <= limit]


def _smallest_ids(k: int):
    """At most k smallest ids of every code in a partition."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(c, i) for c, ids in best.items() for i in ids]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["code", "id"])

        for batch in batches:
            for code, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = best.setdefault(code, [])
                if len(ids) < k or i < ids[-1]:
                    ids.append(i)
                    ids.sort()
                    del ids[k:]
            if len(best) > 500_000:
                yield flush()
        yield flush()

    return reduce


def _first(k: int):
    """The first k rows of every run of equal first columns, in rows that are sorted; adds the place in the run."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0
        for batch in batches:
            places, keep = [], []
            for i, code in enumerate(batch.column(0).to_pylist()):
                place = place + 1 if code == held else 1
                held = code
                if place <= k:
                    keep.append(i)
                    places.append(place)
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(places, pa.int32())], names=[*batch.schema.names, "rank"])

    return first


def _search(k: int, dims: int):
    """Per group: each query code's k nearest ids in the group's block; rows of entries come before queries.

    Queries stream through the block, so a group holds nothing but its entries.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, codes, ids, counts, block, starts = None, [], [], [], None, None
        for batch in batches:
            out = []
            for g, asks, code, own in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    group, codes, ids, counts, block = g, [], [], [], None
                if not asks:
                    codes.append(code)
                    ids.extend(own)
                    counts.append(len(own))
                    continue
                if block is None:
                    if not codes:
                        continue
                    block = Block(codes, np.array(counts), dims)
                    ids, starts = np.array(ids, np.int64), np.cumsum([0, *counts])
                entries, distances = block.search(code, k)
                near = sorted((d, i) for e, d in zip(entries.tolist(), distances.tolist()) for i in ids[starts[e] : starts[e + 1]].tolist())
                out += [(code, d, i) for d, i in near[:k]]
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64()))], names=["code", "distance", "id"])

    return search


def blocks_of(entries: int, queries: int, tasks: int) -> tuple[int, int]:
    """(entry blocks, query blocks): bounded ones, and so many groups that ``tasks`` have work.

    A search costs more than its share in a smaller block of entries, so it is the queries that are cut further.
    """
    e = max(1, math.ceil(entries / ENTRIES))
    return e, max(1, math.ceil(queries / QUERIES), min(math.ceil(tasks / e), math.ceil(queries / LEAST)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k rows of ``vectors`` nearest to each row of ``queries``."""
    size = F.size(F.col(f"`{embedding}`"))
    dims = vectors.select(size.alias("n")).unionByName(queries.select(size.alias("n"))).agg(F.max("n")).first()[0] or 1
    dims = max(1, dims)

    @F.arrow_udf("binary")
    def code(values: pa.Array) -> pa.Array:
        return pa.array(sign_codes(values.to_pylist(), dims), pa.binary())

    def coded(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(f"`{embedding}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v"))
        return rows.select(code("v").alias("code"), "id")

    spark = vectors.sparkSession
    smallest = coded(vectors).where("id is not null").mapInArrow(_smallest_ids(k), "code binary, id long")
    smallest = smallest.repartition("code").sortWithinPartitions("code", "id").mapInArrow(_first(k), "code binary, id long, rank int")
    entries = materialize(smallest.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = materialize(coded(queries), "query-codes")
    distinct = materialize(asked.select("code").distinct(), "query-classes")
    eb, qb = blocks_of(entries.count(), distinct.count(), 2 * spark.sparkContext.defaultParallelism)
    block = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select(every(qb).alias("q"), block(eb).alias("e"), F.lit(False).alias("asks"), "code", "ids")
    right = distinct.select(block(qb).alias("q"), every(eb).alias("e"), F.lit(True).alias("asks"), "code", F.lit(None).cast("array<long>").alias("ids"))
    group = (F.col("q") * eb + F.col("e")).cast("int").alias("g")
    dealt = left.unionByName(right).select(group, "asks", "code", "ids").repartitionById(eb * qb, F.col("g")).sortWithinPartitions("g", "asks")
    found = dealt.mapInArrow(_search(k, dims), "code binary, distance int, id long")
    nearest = found.repartition("code").sortWithinPartitions("code", "distance", "id").mapInArrow(_first(k), "code binary, distance int, id long, rank int")
    best = materialize(nearest, "nearest")
    discard(entries, distinct)
    return asked.join(best.withColumnRenamed("id", "vec_id"), "code").select(F.col("id").alias("query_id"), "rank", "vec_id", "distance")
