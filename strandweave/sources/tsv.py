"""The raw, final and alternative tables as headerless TSV, and raw files read back."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import header_name, two_decimals

RAW = "read_name string, monomer string, start long, end long, score double, gap long, span long"


def _percent(name: str):
    return two_decimals(F.coalesce(F.col(name), F.lit(-1.0)))


def raw_lines(raw: DataFrame) -> DataFrame:
    return raw.select("read_ordinal", "block_idx", "read_name", "monomer", "start", "end", F.format_string("%.6f", F.col("score").cast("double")).alias("score"), "gap", "span")


def final_lines(final: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(F.col(c), F.lit("None")).alias(c)
    return final.select(
        "read_ordinal", "block_idx", "read_name", "monomer", "start", "end", _percent("identity").alias("identity"),
        none("second_best"), _percent("second_best_identity").alias("second_best_identity"),
        none("homo_best"), _percent("homo_best_identity").alias("homo_best_identity"),
        none("homo_second_best"), _percent("homo_second_best_identity").alias("homo_second_best_identity"), "reliability",
    )


def alt_lines(alt: DataFrame) -> DataFrame:
    return alt.select("read_ordinal", "block_idx", "alt_idx", "read_name", "monomer", "start", "end", _percent("identity").alias("identity"), "star")


def write_tsv(lines: DataFrame, path: str, single: bool = False) -> None:
    """Ordered by read, block (and alternative); ``single`` gathers one file for byte parity."""
    keys = [c for c in ("read_ordinal", "block_idx", "alt_idx") if c in lines.columns]
    rows = lines.orderBy(*keys).drop(*keys)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=False, quote="")


def write_tsv_file(lines: DataFrame, path: str) -> None:
    """The same as exactly one file ``path``, which is there only when all of it is.

    Tasks write ranges of the order beside it. On a file system with plain paths tasks then copy them to
    their places in the file, which are known from the ranges' sizes; elsewhere the ranges are joined by the
    file system where it can do that, or else stream through the driver.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    system = target.getFileSystem(conf)
    folder = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex[:12]}")
    write_tsv(lines, folder.toString())
    parts = sorted((f.getPath().toString(), f.getLen()) for f in system.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
    if system.getScheme() == "file":
        _copy(spark, _places(parts), whole.toUri().getPath())
    else:
        _join(spark, system, parts, whole)
    system.delete(target, True)
    if not system.rename(whole, target):
        raise OSError(f"{path} could not be put in place")
    system.delete(folder, True)


def _places(parts: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(file, size, bytes before it)."""
    ends = list(accumulate(size for _, size in parts))
    return [(file, size, end - size) for (file, size), end in zip(parts, ends)]


def _copy(spark: SparkSession, places: list[tuple[str, int, int]], whole: str) -> None:
    """Tasks copy files to their places in ``whole``; a task that runs again writes the same bytes."""
    with open(whole, "wb") as f:
        f.truncate(sum(size for _, size, _ in places))
    if not places:
        return

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                with open("/" + file.removeprefix("file:").lstrip("/"), "rb") as source, open(whole, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(source, out, 4 << 20)
            yield batch

    schema = "file string, size long, place long"
    rows = spark.createDataFrame(places, schema)
    copied = rows.repartition(len(places)).mapInArrow(copy, schema).agg(F.sum("size")).first()[0]
    if copied != sum(size for _, size, _ in places):
        raise OSError(f"{copied} bytes were copied to {whole}")


def _join(spark: SparkSession, system, parts: list[tuple[str, int]], whole) -> None:
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(file) for file, _ in parts]
    system.create(whole).close()
    try:
        if paths:
            array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths))
            for k, p in enumerate(paths):
                array[k] = p
            system.concat(whole, array)
    except Py4JJavaError:  # this file system can't
        out = system.create(whole, True)
        for p in paths:
            source = system.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 4 << 20, False)
            source.close()
        out.close()


def read_raw_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A raw file; names end at the first white space."""
    rows = spark.read.csv(path, sep="\t", schema=RAW, quote="")
    return rows.withColumns({c: header_name(F.col(c)) for c in ("read_name", "monomer")})
