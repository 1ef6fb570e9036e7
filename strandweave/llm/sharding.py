"""Operator 12: shards by jump consistent hashing.

A stable 60-bit key of the id and the number of shards decide alone; there is no ring table. With
one shard more only the rows that the new shard takes move, one in ``shards + 1``. Law: ``key``.

Slots number a shard's rows in the order of their ids without a gap. Rows without their texts are
dealt by ranges of that order (equal rows by their place in the scan as well, so a repeated row does
not meet in one task), numbered in each range, and moved on by the counts of the ranges before.

Defined results: a null id is an id of its own and comes first; rows of one id share a shard
whatever their texts are, and are numbered by size and checksum; of rows alike in all of that either
order is the same result. A null text has size 1 and checksum 0, as an empty one. Columns of other
names pass through ``assign_shards``, whose new ones get names that are not taken; an empty table has
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import clash_free, discard, materialize, small

#: Multiplier of the generator that jumps are drawn from, a fixed value of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)
#: Most rows of range counts (shards times tasks) that are broadcast.
BROADCAST_COUNTS = 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. Each key jumps ahead to the shard counts at which it would move, until one is beyond ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * MULTIPLIER + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        ahead[live] = (at[live] + 1) * (float(1 << 31) / draw)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def stable_key(column: Column) -> Column:
    """60 bits of the SHA-256 of the value's text; null counts as the empty text."""
    return F.conv(F.substring(F.sha2(F.coalesce(column.cast("string"), F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def found(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(), shards), pa.int32())

    return found(stable_key(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> tuple[DataFrame, str, str]:
    """``docs`` with its shard among ``shards`` and among one more; the names of both columns."""
    now, grown = clash_free(docs, "shard"), clash_free(docs, "grown_shard")

    @F.arrow_udf("now int, grown int")
    def both(keys: pa.Array) -> pa.Array:
        k = keys.to_numpy()
        return pa.StructArray.from_arrays([pa.array(jump(k, shards + more), pa.int32()) for more in (0, 1)], names=["now", "grown"])

    pair = clash_free(docs, "shards")
    rows = docs.withColumn(pair, both(stable_key(F.col(f"`{key}`"))))
    return rows.withColumns({now: F.col(pair)["now"], grown: F.col(pair)["grown"]}).drop(pair), now, grown


def with_slots(rows: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``: the place of each row in its shard by ``order``, from 0 without a gap.

    ``rows`` should be narrow: they are written twice and shuffled once. They must not have columns
    ``slot``, ``scan_place`` or ``range_number``.
    """
    kept = rows.columns
    stored = materialize(rows.withColumn("scan_place", F.monotonically_increasing_id()), "assigned")
    places = [*order, "scan_place"]
    dealt = stored.repartitionByRange(*places).sortWithinPartitions(*places).drop("scan_place")
    schema = ", ".join([*[f"`{c}` {t}" for c, t in dealt.dtypes], "range_number int", "slot long"])
    at = kept.index(shard)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            shards, slots = batch.column(at).to_numpy(), np.empty(batch.num_rows, np.int64)
            for s in np.unique(shards).tolist():
                own = np.flatnonzero(shards == s)
                slots[own] = seen.get(s, 0) + np.arange(len(own))
                seen[s] = seen.get(s, 0) + len(own)
            added = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(slots, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, "range_number", "slot"])

    numbered = materialize(dealt.mapInArrow(number, schema), "numbered")
    discard(stored)
    counts = numbered.groupBy(shard, "range_number").count()
    ahead = W.partitionBy(shard).orderBy("range_number").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(shard, "range_number", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("rows_before"))
    found = numbered.join(small(before, BROADCAST_COUNTS), [shard, "range_number"])
    return found.select(*kept, (F.col("slot") + F.col("rows_before")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    rows, _, _ = assign_shards(narrow, shards)
    found = with_slots(rows, ["doc_id", "size", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Whole rows as Parquet below ``path/shard=K``; large shards are dealt to several tasks and files."""
    placed = docs.withColumn("shard", shard_of(F.col(f"`{key}`"), shards))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, shards: int, key: str = "doc_id") -> DataFrame:
    """The rows of written shards, once each: what later shards have taken is left out where it stood before."""
    return spark.read.parquet(path).where(F.col("shard") == shard_of(F.col(f"`{key}`"), shards))


def append_shard(spark: SparkSession, path: str, shards: int, key: str = "doc_id") -> None:
    """One shard more: only the rows that it takes, one in ``shards + 1``, are written, into its own folder."""
    moved = read_shards(spark, path, shards, key).where(shard_of(F.col(f"`{key}`"), shards + 1) == shards).drop("shard")
    moved.write.mode("overwrite").parquet(f"{path}/shard={shards}")
