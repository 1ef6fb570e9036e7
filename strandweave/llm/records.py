"""Operator 5: token ids in length-delimited binary records with an offset index.

A record is ``u64 length | u32 masked check of the length | payload | u32 masked check of
the payload``, all little-endian; the check is CRC-32, rotated right by 15 bits plus a
constant, so that a check stored inside a payload is not its own check. A payload is
``u8 bytes per id | u8 key present | i64 key | ids``. Files hold ascending keys, file by
file; the index has a row for each record (file, offset, length), so a reader can take the
records in any order with range reads.

Defined results: a null or empty text gives the end id alone; a null key sorts first and
reads back as null; rows with equal keys are kept, ordered by text (equal ones in any order);
texts of any length are encoded whole, into one record; an empty table gives an index without
rows. Extra columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Memory, bounded_batches, new_file, open_fs, ranges, shared_dir, sized_broadcast, tidied

VOCABULARY_BYTES = 64 << 20
#: Words remembered by a worker (results don't depend on it).
REMEMBERED = 400_000

INDEX_SCHEMA = "part int, seq long, key long, file string, offset long, length long, n_tokens long, local_start long"


def masked(data: bytes) -> int:
    check = zlib.crc32(data)
    return ((check >> 15 | check << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one framed record; raises where a length or check does not hold."""
    (length,) = struct.unpack_from("<Q", record)
    if struct.unpack_from("<I", record, 8)[0] != masked(record[:8]) or len(record) != length + 16:
        raise ValueError("record length is damaged")
    payload = record[12:-4]
    if struct.unpack_from("<I", record, len(record) - 4)[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload


def serialize(key: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BBq", width, key is not None, key or 0) + ids


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, present, key = struct.unpack_from("<BBq", payload)
    return (key if present else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


# The normalisation and word rule of the tokenizer files that ``WordCodec`` takes word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_RULE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(file: dict) -> bool:
    """Whether a tokenizer file has the rules above, and no added token without ``<|``."""
    plain = all(file.get(k) is None for k in ("truncation", "padding")) and file["model"].get("type") == "BPE" and not file["model"].get("dropout")
    return plain and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == WORD_RULE and all("<|" in t["content"] for t in file["added_tokens"])


class WordCodec:
    """The tokenizers library behind a memory of words.

    In a text of ASCII, Latin letters up to U+017F and plain white space, normalisation is
    lower case and words never touch each other, so each word is encoded by the library once
    and remembered. Any other text, any text that may hold a special token, and every text where
    the file has other rules, goes to the library whole.
    """

    plain = re.compile("[\t-\r\x20-\x7e\xa0-\u012f\u0131-\u017f]*").fullmatch
    #: The vocabulary's word rule over lower-cased plain texts.
    words = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f\xb2\xb3\xb9\xbc-\xbe]+").findall

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(blob)
        self.by_words = by_words(json.loads(blob))
        if self.by_words:
            self.library.model._resize_cache(0)  # words are remembered here
        self.width = 2 if self.library.get_vocab_size() <= 65536 else 4
        self.memory = Memory(self._word, REMEMBERED)
        self.spell = dict(enumerate(byte_alphabet()))

    def _word(self, word: str) -> bytes:
        """A lower-case word goes through the library's merge model as its byte letters."""
        return self._pack([t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(self.spell))])

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def encode(self, text: str) -> bytes:
        """Ids, little-endian, ``width`` bytes each."""
        if not self.by_words or "<|" in text or not self.plain(text):
            return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        memory = self.memory
        ids = b"".join([memory[w] for w in self.words(text.lower())])
        memory.trim()
        return ids


_CODECS: dict[str, WordCodec] = {}


def _codec(key: str, blob) -> WordCodec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(blob.value)
    return _CODECS[key]


def write_records(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Encode ``text`` with the tokenizer file, write record files below ``path``, return their index.

    Rows are dealt by ranges of (key, hash of the text), so a repeated key splits too. The
    sampling for the ranges reads the text but encodes nothing. Encoding and writing happen
    in one task a file; the index goes through Spark's commit, so it names only files of
    tasks that ended well. Index columns: see ``INDEX_SCHEMA``.
    """
    spark = df.sparkSession
    with open(tokenizer, "rb") as f:
        blob = sized_broadcast(spark, f.read(), VOCABULARY_BYTES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out, part = _codec(tokenizer, blob), None, TaskContext.get().partitionId()
        end = b"" if end_id is None else codec._pack([end_id])
        offset = seq = start = 0
        fs, folder = open_fs(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.rec"
        try:
            for batch in batches:
                if out is None:
                    out = new_file(fs, f"{folder}/{name}")
                rows = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = codec.encode(t.as_py() or "") + end
                    record, n = frame(serialize(k, ids, codec.width)), len(ids) // codec.width
                    out.write(record)
                    rows.append((part, seq, k, name, offset, len(record), n, start))
                    offset, seq, start = offset + len(record), seq + 1, start + n
                if rows:
                    cols = list(zip(*rows))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4)
                    yield tidied(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")]))
        finally:
            if out is not None:
                out.close()

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    ranged = rows.repartitionByRange(F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    bounded_batches(spark)
    ranged.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def with_start(index: DataFrame) -> DataFrame:
    """The index with ``start``, the ids of all records before this one."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    return index.join(before, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start")


def read_records(index: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """``index`` rows with ``key`` and ``ids`` (binary, little-endian 32-bit) as the files hold them.

    Works for any subset or order of the index; each task sorts the rows it has by place and
    joins neighbouring records into range reads. Both checks of every record are verified.
    """
    tasks = tasks or max(1, index.select("file").distinct().count())
    columns = [c for c in index.columns if c not in ("key", "file", "offset", "length")]
    rows = index.select("file", "offset", "length", *columns)
    rows = rows.repartitionById(tasks, F.col("part").cast("int")) if "part" in columns else rows.repartition(tasks, "file")
    rows = rows.sortWithinPartitions("file", "offset")
    kinds = dict(rows.dtypes)
    schema = "key long, ids binary, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        held, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for file, begin, end, members in ranges(places):
                if held != file:
                    if source is not None:
                        source.close()
                    held, source = file, fs.open_input_file(f"{folder}/{file}")
                source.seek(begin)
                block = source.read(end - begin)
                got = [deserialize(unframe(block[places[i][1] - begin : places[i][1] - begin + places[i][2]])) for i in members]
                picked = batch.take(pa.array(members))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in got], pa.int64()), pa.array([v.tobytes() for _, v in got], pa.binary()), *picked.columns[3:]],
                    names=["key", "ids", *columns],
                )
            tidied(None)
        if source is not None:
            source.close()

    return rows.mapInArrow(read, schema)


def encode_to_records(spark: SparkSession, df: DataFrame, tokenizer: str, path: str | None = None) -> tuple[str, DataFrame]:
    """(folder, index with ``start``) of the record files of ``df``."""
    path = path or shared_dir(spark, "records")
    return path, with_start(write_records(df, path, tokenizer))
