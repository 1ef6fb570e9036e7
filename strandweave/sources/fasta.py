"""FASTA as a data source: ``spark.read.format("fasta").load(path)`` and a plain text reader."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sequences import header_name
from ..operators.chunks import CHUNKS, chunk_batches, cut_up

SCHEMA = "ordinal long, name string, seq string"
#: Bytes of a file that make one partition, where the option ``splitBytes`` does not say otherwise, and bytes read at a time.
SPLIT, READ = 64 << 20, 4 << 20
#: An ordinal is the file's number and the byte where the record starts.
FILE_BITS = 44


def header(line: bytes) -> str:
    """The name that a header line without its ``>`` gives: its first token."""
    tokens = line.decode().split()
    if not tokens:
        raise ValueError("a FASTA header without a name")
    return tokens[0]


@dataclass
class _Split(InputPartition):
    number: int
    path: str
    first: int
    last: int


def _walk(source, first: int, last: int, in_header: bool = False) -> Iterator[tuple]:
    """What stands from byte ``first`` to the end of the file, in order, read block by block.

    (byte, name, end of the line) for a record's ``>`` at the start of a line, and (None, bases, own) for a
    stretch of sequence, own where it lies before ``last``. Line ends are left out. ``in_header``: the
    split starts within a header line, which is skipped.
    """
    source.seek(max(0, first - 1))
    line_start = first == 0 or source.read(1) == b"\n"
    at, mark = first, None
    head: list[bytes] | None = [] if in_header else None
    while block := source.read(READ):
        i, size = 0, len(block)
        while i < size:
            if head is not None:
                stop = min((x for x in (block.find(b"\n", i), block.find(b"\r", i)) if x >= 0), default=size)
                head.append(block[i:stop])
                i = stop
                if stop < size:
                    if mark is not None:
                        yield mark, header(b"".join(head)), at + stop
                    head = None
                continue
            begins = 0 if line_start and i == 0 and block[:1] == b">" else block.find(b"\n>", i) + 1 or None
            stop = size if begins is None else begins
            inside = min(max(last - at, i), stop)
            for piece, own in ((block[i:inside], True), (block[inside:stop], False)):
                bases = piece.translate(None, b"\r\n")
                if bases:
                    yield None, bases, own
            i = stop
            if begins is not None:
                head, mark, i = [], at + begins, begins + 1
        line_start = block[-1:] == b"\n"
        at += size
    if head is not None and mark is not None:
        yield mark, header(b"".join(head)), at


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return [_Split(*s) for s in file_splits(self.path, self.split)] or [_Split(0, "", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _system(self.path)[0].open_input_file(partition.path) as source:
            rows, size, parts = [], 0, None
            for at, what, _ in _walk(source, partition.first, partition.last):
                if at is None:
                    if parts is not None:
                        parts.append(what)
                        size += len(what)
                    elif partition.first == 0:
                        raise ValueError("sequence before the first FASTA header")
                    continue
                if parts is not None:
                    rows.append((*name, b"".join(parts)))
                if size > READ:
                    yield _batch(rows)
                    rows, size = [], 0
                name, parts = ((partition.number << FILE_BITS) + at, what), []
                if at >= partition.last:
                    parts = None
                    break
            if parts is not None:
                rows.append((*name, b"".join(parts)))
            if rows:
                yield _batch(rows)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def file_splits(path: str, split: int) -> list[tuple[int, str, int, int]]:
    """(file number, path, first byte, byte after the last) of the splits of a file, or of a folder's files by name; hidden and marker files are left out."""
    from pyarrow import fs

    system, place = _system(path)
    info = system.get_file_info(place)
    files = [info] if info.is_file else sorted(system.get_file_info(fs.FileSelector(place, recursive=True)), key=lambda f: f.path)
    files = [f for f in files if f.is_file and f.size and (info.is_file or f.base_name[0] not in "._")]
    return [(k, f.path, a, min(a + split, f.size)) for k, f in enumerate(files) for a in range(0, f.size, split)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t).cast(to) for c, t, to in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()), (pa.int64(), pa.string(), pa.string()))], names=["ordinal", "name", "seq"])


class FastaSource(DataSource):
    """Files in splits of ``splitBytes``; a record belongs to the split where it starts, and ordinals rise in file order. Options: ``path``, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def read_fasta(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.read.format("fasta").option("splitBytes", split_bytes).load(path)


def _summary(source, first: int, last: int) -> tuple:
    """What a split adds to the record that is open where it starts, and which record is open where it ends; see ``_SUMMARY``."""
    source.seek(max(0, first - 1))
    line_start = first == 0 or source.read(1) == b"\n"
    lead, ended = 0, line_start
    while not ended and lead < last - first:
        block = source.read(min(READ, last - first - lead))
        stop = min((x for x in (block.find(b"\n"), block.find(b"\r")) if x >= 0), default=len(block))
        lead, ended = lead + stop, stop < len(block)
    total = tail = 0
    at = name = None
    open_header = False if ended else None
    for mark, what, more in _walk(source, first, last):
        if mark is None and not more or mark is not None and mark >= last:
            break
        if mark is None:
            total, tail = total + len(what), tail + len(what)
        else:
            at, name, tail, open_header = mark, what, 0, more >= last
    return total, lead, at, name, tail, open_header


_SPLITS = "place int, file int, path string, first long, last long"
#: ``total`` bases, of which the ``lead`` ones are a header's letters if the split starts in one; the last record that starts
#: in the split and its bases there; whether a header line is open at the end (null: as at the start).
_SUMMARY = f"{_SPLITS}, total long, lead long, at long, name string, tail long, open_header boolean"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _over_splits(rows: DataFrame, tasks: int, path: str, schema: str, each) -> DataFrame:
    """``each(source, *columns from first on)`` gives rows for every split, a task for each; they follow the split's columns."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(path)[0]
        for batch in batches:
            for split in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(split[2]) as source:
                    found = [(*split[:5], *row) for row in each(source, *split[3:])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(zip(*found), fields)], names=[n for n, _ in fields])

    return rows.repartitionById(tasks, F.col("place")).mapInArrow(run, schema)


def _splits(spark: SparkSession, path: str, split_bytes: int) -> tuple[DataFrame, int]:
    found = [(k, *s) for k, s in enumerate(file_splits(path, split_bytes))]
    return spark.createDataFrame(found, _SPLITS), max(1, len(found))


def fasta_summaries(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """A row for each split; ``total`` adds up to the bases of all records (and a few letters of headers that splits cut)."""
    return _over_splits(*_splits(spark, path, split_bytes), path, _SUMMARY, lambda source, first, last: [_summary(source, first, last)])


def fasta_names(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(read_ordinal, read_name) of every record; no sequence leaves the tasks."""

    def names(source, first: int, last: int) -> Iterator[tuple]:
        for mark, name, more in _walk(source, first, last):
            if mark is None and not more or mark is not None and mark >= last:
                return
            if mark is not None:
                yield mark, name

    found = _over_splits(*_splits(spark, path, split_bytes), path, f"{_SPLITS}, at long, name string", names)
    return found.select((F.shiftleft(F.col("file").cast("long"), FILE_BITS) + F.col("at")).alias("read_ordinal"), F.col("name").alias("read_name"))


def read_fasta_chunks(spark: SparkSession, path: str, part_size: int = 5000, overlap: int = 500, split_bytes: int = SPLIT) -> DataFrame:
    """The chunks of ``chunk_reads(as_reads(read_fasta(path)))``, straight from byte splits.

    A first pass counts the bases of every split; their sums before a split, since the last header, say
    which record is open there and at which offset, so that the second pass cuts every split on its own:
    it yields the chunks that start in it and reads on until the last of them is whole. No record is
    ever one string, and a long one is cut by as many tasks as it has splits. Both passes read the file.
    """
    rows, tasks = _splits(spark, path, split_bytes)
    found = _over_splits(rows, tasks, path, _SUMMARY, lambda source, first, last: [_summary(source, first, last)])
    before = W.partitionBy("file").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    known = found.withColumn("in_header", F.coalesce(F.last("open_header", ignorenulls=True).over(before), F.lit(False)))
    bases = known.withColumn("bases", F.col("total") - F.when(F.col("in_header"), F.col("lead")).otherwise(0))
    summed = bases.withColumn("ahead", F.coalesce(F.sum("bases").over(before), F.lit(0)))
    begun = summed.withColumn("begun", F.when(F.col("at").isNotNull(), F.col("ahead") + F.col("bases") - F.col("tail")))
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    states = begun.select("place", "file", "path", "first", "last", "in_header", last("at").alias("at"), last("name").alias("name"), (F.col("ahead") - F.coalesce(last("begun"), F.lit(0))).alias("offset"))

    def rows_of(file: int, source, first: int, last_byte: int, in_header: bool, at: int | None, name: str | None, offset: int) -> Iterator[tuple]:
        events = _walk(source, first, last_byte, in_header)
        ahead: list[tuple] = []

        def own() -> Iterator[tuple[bytes, bool]]:
            """The open record's bases; the header after them goes to ``ahead``."""
            for event in events:
                if event[0] is not None:
                    ahead.append(event)
                    return
                if at is None:
                    raise ValueError("sequence before the first FASTA header")
                yield event[1:]

        while at is None or at < last_byte:
            for chunk in cut_up(own(), part_size, overlap, offset):
                yield (file << FILE_BITS) + at, name, *chunk
            if not ahead:
                return
            (at, name, _), offset = ahead.pop(), 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(path)[0]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for _, file, name, *state in zip(*(c.to_pylist() for c in batch.columns)):
                    with system.open_input_file(name) as source:
                        yield from rows_of(file, source, *state)

        return chunk_batches(rows())

    return states.repartitionById(tasks, F.col("place")).mapInArrow(cut, CHUNKS)


def write_fasta(reads: DataFrame, path: str, width: int = 60) -> None:
    """Reads as FASTA files of a folder, in lines of ``width`` bases."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    reads.select(F.concat(F.lit(">"), "read_name", F.when(F.col("seq") != "", F.concat(F.lit("\n"), lines)).otherwise(F.lit("")))).write.text(path)


def read_fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through the text source, split at record starts, so that large files split too."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    rec = F.regexp_replace("value", r"^>|[\r\n]+$", "")
    head = F.regexp_extract(rec, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(rec, r"^[^\r\n]*", ""), r"[\r\n]", "")
    rows = raw.where(F.length(F.trim(rec)) > 0).select(F.monotonically_increasing_id().alias("ordinal"), header_name(head).alias("name"), seq.alias("seq"))
    return rows


def _seq(upper: bool):
    return F.upper("seq") if upper else F.col("seq")


def as_reads(df: DataFrame, upper: bool = False) -> DataFrame:
    """Reads; ``upper`` takes lower-case letters for the same bases, which otherwise fail."""
    return df.select(F.col("ordinal").alias("read_ordinal"), F.col("name").alias("read_name"), _seq(upper).alias("seq"))


def as_monomers(df: DataFrame, upper: bool = False) -> DataFrame:
    """Monomers with ordinals from 0 in their order; they are few, so one task may number them."""
    return df.select((F.row_number().over(W.orderBy("ordinal")) - 1).alias("ordinal"), "name", _seq(upper).alias("seq"))
