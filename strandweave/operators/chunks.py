"""Reads as overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = "read_ordinal long, read_name string, chunk_idx int, chunk_offset long, chunk_seq string"
#: Characters of chunks that are handed on together.
TOGETHER = 4 << 20


def cut_up(pieces, part_size: int, overlap: int, offset: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(index, offset, chunk) of one read that comes in pieces, those chunks that start in its own part.

    pieces: (bytes, own). The read goes on at ``offset``; pieces that are not own only complete chunks.
    Offsets are multiples of ``part_size``; a chunk is kept if ``overlap`` characters are left or the
    read is shorter than that. No more than a piece and a chunk are held.
    """
    start = -(-offset // part_size) * part_size
    held, base, end, own_end = b"", offset, offset, None
    for piece, own in pieces:
        if not own and own_end is None:
            own_end = end
        if own_end is not None and start >= own_end:
            return
        end += len(piece)
        held = held[max(0, start - base) :] + piece if start < end else b""
        base = end - len(held)
        while end - start >= part_size + overlap and (own_end is None or start < own_end):
            yield start // part_size, start, held[start - base : start - base + part_size + overlap]
            start += part_size
    while start < (end if own_end is None else own_end):
        if end - start >= overlap or end < overlap:
            yield start // part_size, start, held[start - base : start - base + part_size + overlap]
        start += part_size


def chunk_batches(rows: Iterator[tuple[int, str, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``CHUNKS`` in batches of a bounded size."""
    fields = [x.split() for x in CHUNKS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        *first, seqs = zip(*out)
        columns = [pa.array(c, kinds[t]) for c, (_, t) in zip(first, fields)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(seqs, pa.binary()).cast(pa.string())], names=[f for f, _ in fields])

    for row in rows:
        out.append(row)
        size += len(row[-1])
        if size > TOGETHER or len(out) >= 10_000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _cuts(seq: Column, part_size: int, overlap: int) -> Column:
    """The chunks of a read as an array in their order; null where it is null or empty."""
    n = F.octet_length(seq)
    last = ((n - F.when(n < overlap, 1).otherwise(max(overlap, 1))) / part_size).cast("int")
    # the read is a lambda's variable, so that its bytes are taken from the row once and not for each chunk
    cut = lambda read: F.transform(F.sequence(F.lit(0), last, F.lit(1)), lambda k: F.substring(read, k * part_size + 1, F.lit(part_size + overlap)).cast("string"))
    return F.when(n > 0, F.transform(F.array(seq.cast("binary")), cut)[0])


def chunk_reads(reads: DataFrame, part_size: int = 5000, overlap: int = 500) -> DataFrame:
    """(read_ordinal, read_name, seq) -> one row per chunk, with its place in the read; see ``cut_up``.

    Each read is sliced once, in the JVM, so it costs its length and its overlaps, and no Python process has
    to hold it. A read that one row can't hold (2 GB with the overlaps), or that many tasks should share,
    comes in chunks from ``sources.fasta.read_fasta_chunks``. Sequences are ASCII; reads that are null or
    empty have no chunks.
    """
    named = reads.select(F.col("read_ordinal").cast("long"), F.col("read_name").cast("string"), "seq")
    cut = named.select("read_ordinal", "read_name", F.posexplode(_cuts(F.col("seq"), part_size, overlap)).alias("chunk_idx", "chunk_seq"))
    return cut.select("read_ordinal", "read_name", "chunk_idx", (F.col("chunk_idx").cast("long") * part_size).alias("chunk_offset"), "chunk_seq")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("read_ordinal", "read_name").agg(F.count("*").alias("chunks"))


def require_unique_names(reads: DataFrame) -> DataFrame:
    """The names that occur twice or more; a caller fails if there is one."""
    return reads.groupBy("read_name").count().where("count > 1")
