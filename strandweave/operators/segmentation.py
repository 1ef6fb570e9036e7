"""Segmentation of chunks, de-duplication of their overlaps, and the raw table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Scoring
from . import kernels, lanes

BLOCKS = "read_ordinal long, read_name string, chunk_idx int, block_idx int, monomer string, start long, end long, score float, segment string"
KEPT = "read_ordinal long, read_name string, block_idx int, monomer string, start long, end long, score float, segment string, prev_end long"
LOOK_AHEAD = 6


CANDIDATES = "read_ordinal long, chunk_idx int, place int, dp_ordinal int, distance int"
DISTANCES = "read_ordinal long, chunk_idx int, dp_ordinal int, distance int"
#: Cells of the segmentation that one task should have, and for fewer of which a task isn't worth its start.
TASK_CELLS, LEAST_CELLS = 1 << 32, 1 << 26


#: Chunks that are compared together.
TOGETHER = 512


def _over_chunks(chunks: DataFrame, schema: str, seqs: list[str], table_of) -> DataFrame:
    """The rows that ``table_of(index, part)`` gives for each batch of at most ``TOGETHER`` rows (read_ordinal, chunk_idx, chunk_seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lanes.Index(seqs)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield table_of(index, batch.slice(at, TOGETHER))

    return chunks.select("read_ordinal", "chunk_idx", "chunk_seq").mapInArrow(run, schema)


def monomer_distances(chunks: DataFrame, monomers: list) -> DataFrame:
    """Least distance of every monomer to a stretch of each chunk; see ``DISTANCES``. ``monomers``: a checked list, as for ``segment_chunks``.

    The rows are made as arrays, ``TOGETHER`` chunks at a time, so a task's memory depends neither on the input nor on
    the number of rows that Spark hands over together.
    """
    seqs, ordinals = [m["seq"] for m in monomers], np.array([m["dp_ordinal"] for m in monomers], np.int32)

    def table_of(index: lanes.Index, part: pa.RecordBatch) -> pa.RecordBatch:
        found = index.queries.infix_table(part.column(2).to_pylist())
        rows = np.repeat(np.arange(part.num_rows), len(ordinals))
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.tile(ordinals, part.num_rows)), pa.array(found.reshape(-1).astype(np.int32))],
            names=["read_ordinal", "chunk_idx", "dp_ordinal", "distance"],
        )

    return _over_chunks(chunks, DISTANCES, seqs, table_of)


def candidate_monomers(chunks: DataFrame, monomers: list, ed_thr: int) -> DataFrame:
    """Of each chunk the nearest monomer and all within ``ed_thr``, in the order that breaks ties; see ``CANDIDATES``.

    ``monomers``: a checked list, as for ``segment_chunks``. An index leaves out those that can't be among them.
    """
    seqs, ordinals = [m["seq"] for m in monomers], [m["dp_ordinal"] for m in monomers]

    def table_of(index: lanes.Index, part: pa.RecordBatch) -> pa.RecordBatch:
        ordinal, chunk, seq = (c.to_pylist() for c in part.columns)
        return _table([(ordinal[c], chunk[c], place, ordinals[k], d) for c, found in enumerate(index.nearest(seq, ed_thr)) for place, (k, d) in enumerate(found, 1)], CANDIDATES)

    return _over_chunks(chunks, CANDIDATES, seqs, table_of)


def with_candidates(chunks: DataFrame, monomers: list, ed_thr: int) -> DataFrame:
    """``chunks`` with ``chosen``, the places of their candidates in ``monomers`` in the order that breaks ties, and ``cells``, those that a segmentation by them has."""
    seqs, names = [m["seq"] for m in monomers], [*chunks.columns, "chosen", "cells"]
    sizes = [len(s) for s in seqs]
    at = chunks.columns.index("chunk_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lanes.Index(seqs)
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                texts = part.column(at).to_pylist()
                chosen = [[k for k, _ in found] for found in index.nearest(texts, ed_thr)]
                cells = [len(t) * sum(sizes[k] for k in c) for t, c in zip(texts, chosen)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chosen, pa.list_(pa.int32())), pa.array(cells, pa.int64())], names=names)

    return chunks.mapInArrow(run, ", ".join([*[f"{c} {t}" for c, t in chunks.dtypes], "chosen array<int>", "cells long"]))


def task_count(cells: int, parallelism: int) -> int:
    """Tasks for so many cells: it grows with them; on small inputs every core has work that is worth its start."""
    return max(1, -(-cells // TASK_CELLS), min(parallelism, -(-cells // LEAST_CELLS)))


def segment_chunks(chunks: DataFrame, monomers: list, scoring: Scoring, ed_thr: int = -1, letters: int | None = None) -> DataFrame:
    """Best tiling of each chunk; see ``BLOCKS``. Positions are those of the read.

    ``monomers``: rows (name, seq) in the order that breaks ties. All of them compete in one
    program, so they go to the tasks as a list whose length the caller has checked. With
    ``ed_thr`` >= 0 a chunk only meets the nearest monomer and those within that infix distance,
    nearest first.

    Chunks are dealt to as many tasks as their cells (letters of a chunk times letters of the monomers that
    it meets) ask for. ``letters``: those of all chunks, where the caller knows them; else they are counted,
    as are, with ``ed_thr``, the cells of the chosen monomers.
    """
    names, seqs = [m["name"] for m in monomers], [m["seq"] for m in monomers]
    scores = (scoring.insertion, scoring.deletion, scoring.mismatch, scoring.match)
    wanted = chunks.select("read_ordinal", "read_name", "chunk_idx", "chunk_offset", "chunk_seq")
    parallelism = chunks.sparkSession.sparkContext.defaultParallelism
    if letters is None:
        letters = chunks.agg(F.sum(F.octet_length("chunk_seq").cast("long"))).first()[0] or 0
    cells = letters * sum(map(len, seqs))
    if ed_thr >= 0:
        # the choice is work of its own, 64 cells a machine word, and is dealt out as such
        dealt = wanted.repartition(task_count(cells // 16, parallelism), "read_ordinal", "chunk_idx")
        wanted = with_candidates(dealt, monomers, ed_thr)
        cells = wanted.agg(F.sum("cells")).first()[0] or 0
        wanted = wanted.drop("cells")
    else:
        wanted = wanted.withColumn("chosen", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = kernels.Templates(seqs, *scores)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ordinal, read, index, offset, seq, chosen = (c.to_pylist() for c in batch.slice(at, 512).columns)
                found = kernels.segment(seq, every, None if ed_thr < 0 else chosen)
                rows = [
                    (ordinal[c], read[c], index[c], b, names[j], s + offset[c], e + offset[c], float(v), seq[c][s : e + 1])
                    for c, blocks in enumerate(found)
                    for b, (j, s, e, v) in enumerate(blocks)
                ]
                yield _table(rows, BLOCKS)

    # chunks are small beside their work, so their bytes must not decide how many share a task
    tasks = task_count(cells, parallelism)
    return wanted.repartition(tasks, "read_ordinal", "chunk_idx").mapInArrow(run, BLOCKS)


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "float": pa.float32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])


def jumps(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each row how far ahead, up to six rows, the first one lies that it reaches over half of; 0 where none does."""
    out = np.zeros(len(start), np.int64)
    for ahead in range(min(LOOK_AHEAD, len(start) - 1), 0, -1):
        over = (end[:-ahead] - start[ahead:]) * 2 > end[ahead:] - start[ahead:]
        out[:-ahead][over] = ahead
    return out


class Run:
    """The fold of a stretch of a read's rows, as a function of how it is entered.

    A row at which the fold looks stays. If it reaches over half of a later one, the rows up to that one
    go and the row after it stays without a look. So all that a run needs to know of the rows before it is
    its *entry*: how many of its first rows are passed over, the last of which stays (0 to 7). The run's
    function gives for each entry the entry of what follows, the number of rows that stay and the end of
    the last of them; such functions compose, so a read is folded run by run in any order.

    start, end: the run's rows and up to six that follow; ``own``: how many of them are the run's.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, own: int):
        self.own, self.end = own, end
        self.jump = jumps(start, end)[:own].tolist()

    def function(self) -> list[tuple[int, int, int | None]]:
        """For entries 0 to 7: (entry of the next run, rows that stay, the last one's end or None)."""
        n = self.own
        # by the place where the fold looks next, from the last place on
        after: list[tuple[int, int, int | None]] = [(0, 0, None)] * (n + 1)
        for p in range(n - 1, -1, -1):
            jump = self.jump[p]
            following = p + jump + 2 if jump else p + 1
            leaves, stay, last = after[following] if following <= n else (following - n, 0, None)
            unseen = jump and following - 1 < n
            if last is None:
                last = int(self.end[following - 1 if unseen else p])
            after[p] = (leaves, stay + 1 + bool(unseen), last)
        out = [after[0]]
        for entry in range(1, LOOK_AHEAD + 2):
            if entry > n:
                out.append((entry - n, 0, None))
            else:
                leaves, stay, last = after[entry]
                out.append((leaves, stay + 1, int(self.end[entry - 1]) if last is None else last))
        return out

    def stay(self, entry: int) -> list[int]:
        """Places of the rows that stay."""
        out, p = [entry - 1] if 0 < entry <= self.own else [], entry
        while p < self.own:
            out.append(p)
            if self.jump[p]:
                p += self.jump[p] + 2
                if p - 1 < self.own:
                    out.append(p - 1)
            else:
                p += 1
        return out


def overlap_fold(rows: Iterator[tuple]) -> list[tuple]:
    """The blocks of one read that stay, in one run. rows: tuples whose items 5 and 6 are start and end, in (chunk, block) order."""
    held = list(rows)
    run = Run(*(np.array([r[c] for r in held], np.int64) for c in (5, 6)), len(held))
    return [held[p] for p in run.stay(0)]


#: Chunks of a read whose blocks are folded by one task.
RUN_CHUNKS = 256
_FUNCTIONS = "read_ordinal long, run long, leaves array<int>, stay array<long>, last array<long>"
_ENTRIES = "read_ordinal long, run long, entry int, before long, prev_end long"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first ``keys`` columns and follow each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _run_of(rows: list[tuple]) -> Run:
    """rows: as ``_dealt`` gives them, those of the next run last."""
    return Run(np.array([r[6] for r in rows]), np.array([r[7] for r in rows]), sum(not r[-1] for r in rows))


def _dealt(blocks: DataFrame, run_chunks: int) -> DataFrame:
    """Blocks by (read, run) in order; the first ones of a run are with the run before it, too, without their segments."""
    run = F.floor(F.col("chunk_idx") / run_chunks).cast("long")
    # six chunks have six blocks, and each run but the last has all its chunks
    leads = (F.col("chunk_idx") % run_chunks < LOOK_AHEAD) & (F.col("block_idx") < LOOK_AHEAD) & (run > 0)
    seen = F.explode(F.when(leads, F.array(run, run - 1)).otherwise(F.array(run)))
    rows = blocks.withColumn("run", seen).withColumn("ahead", F.col("run") != run)
    segment = F.when(~F.col("ahead"), F.col("segment")).alias("segment")
    return rows.select("read_ordinal", "run", "chunk_idx", "block_idx", "read_name", "monomer", "start", "end", "score", segment, "ahead").repartition("read_ordinal", "run").sortWithinPartitions("read_ordinal", "run", "ahead", "chunk_idx", "block_idx")


def drop_overlaps(blocks: DataFrame, run_chunks: int = RUN_CHUNKS) -> DataFrame:
    """Kept blocks of each read in order, with the end of the one before (0 for the first); see ``KEPT``.

    A read's blocks are dealt in runs of chunks. Every run of a read that has several becomes its function
    (see ``Run``), a row of three short arrays; composing these in order gives each run's entry, with which it
    keeps its rows. Both passes read the same shuffle.
    """
    if run_chunks < LOOK_AHEAD:
        raise ValueError(f"a run needs {LOOK_AHEAD} chunks at least")
    dealt = _dealt(blocks, run_chunks)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            read, run, *_, ahead = rows[-1]
            if run or ahead:  # a read of one run is entered at its start
                found = _run_of(rows).function()
                yield _table([(read, run, *map(list, zip(*found)))], _FUNCTIONS)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches, 1):
            entry, before, end = 0, 0, 0
            for read, run, leaves, stay, last in rows:
                out.append((read, run, entry, before, end))
                before, end = before + stay[entry], end if last[entry] is None else last[entry]
                entry = leaves[entry]
            if len(out) >= 4096:
                yield _table(out, _ENTRIES)
                out = []
        yield _table(out, _ENTRIES)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches, 2):
            entry, before, end = rows[0][-3:]
            for k, p in enumerate(_run_of([r[:-3] for r in rows]).stay(entry or 0), before or 0):
                r = rows[p]
                out.append((r[0], r[4], k, r[5], r[6], r[7], r[8], r[9], end or 0))
                end = r[7]
                if len(out) >= 4096:
                    yield _table(out, KEPT)
                    out = []
        yield _table(out, KEPT)

    entries = dealt.mapInArrow(functions, _FUNCTIONS).repartition("read_ordinal").sortWithinPartitions("read_ordinal", "run").mapInArrow(compose, _ENTRIES)
    order = ["read_ordinal", "run", "ahead", "chunk_idx", "block_idx"]
    entered = dealt.join(entries, ["read_ordinal", "run"], "left").select(*dealt.columns, "entry", "before", "prev_end").sortWithinPartitions(*order)
    return entered.mapInArrow(keep, KEPT)


def with_gap_and_span(kept: DataFrame) -> DataFrame:
    return kept.withColumn("gap", F.col("start") - F.col("prev_end")).withColumn("span", F.col("end") - F.col("start")).drop("prev_end")
