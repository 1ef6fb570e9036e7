"""Alignment as SQL-callable functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, lanes

_INTS = T.ArrayType(T.IntegerType())
ALIGNMENT = T.StructType(
    [
        T.StructField("status", T.IntegerType()), T.StructField("edit_distance", T.IntegerType()), T.StructField("end_locations", _INTS),
        T.StructField("start_locations", _INTS), T.StructField("cigar", T.StringType()), T.StructField("alphabet_length", T.IntegerType()),
    ]
)
_ARROW = pa.struct(
    [
        ("status", pa.int32()), ("edit_distance", pa.int32()), ("end_locations", pa.list_(pa.int32())),
        ("start_locations", pa.list_(pa.int32())), ("cigar", pa.string()), ("alphabet_length", pa.int32()),
    ]
)


def aligner(mode: str = "NW", task: str = "DISTANCE", k: int = -1, equalities: list[tuple[str, str]] = (), extended: bool = True):
    """A column function (query, target) -> alignment; null in, null out."""

    @F.arrow_udf(ALIGNMENT)
    def align(queries: pa.Array, targets: pa.Array) -> pa.Array:
        pairs = list(zip(queries.to_pylist(), targets.to_pylist()))
        distinct = list(dict.fromkeys(p for p in pairs if None not in p))
        found = dict(zip(distinct, lanes.align_many(distinct, mode, task, k, list(equalities), extended)))
        return pa.array([found.get(p) for p in pairs], _ARROW)

    return align


def align_to_all(df: DataFrame, text: str, queries: list[tuple[str, str]], mode: str = "NW", task: str = "DISTANCE", k: int = -1, equalities: list[tuple[str, str]] = (), extended: bool = True) -> DataFrame:
    """Every row of ``df`` with each of ``queries`` (name, sequence; few): its columns but ``text``, ``query`` and ``alignment``.

    One pass over the rows; a text is not repeated for its queries. A null text has null alignments.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("query", T.StringType()), T.StructField("alignment", ALIGNMENT)])
    names, seqs = [n for n, _ in queries], [s for _, s in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(text).to_pylist()
                distinct = [t for t in dict.fromkeys(texts) if t is not None]
                pairs = [(q, t) for t in distinct for q in seqs]
                found = dict(zip(pairs, lanes.align_many(pairs, mode, task, k, list(equalities), extended)))
                rows = pa.array([i for i in range(part.num_rows) for _ in seqs])
                columns = [part.column(f.name).take(rows) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names * part.num_rows, pa.string()), pa.array([found.get((q, t)) for t in texts for q in seqs], _ARROW)], names=schema.names)

    return df.mapInArrow(run, schema)


#: Results of short pairs that a worker remembers; beyond so many it starts anew.
REMEMBERED, SHORT = 200_000, 32
_memory: dict[tuple[str, str], tuple[int, int]] = {}


def remembered_pairs(pairs: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """``kernels.distance_and_matches``, each distinct pair once."""
    new = [p for p in dict.fromkeys(pairs) if p not in _memory]
    found = dict(zip(new, kernels.distance_and_matches(new)))
    out = [found[p] if p in found else _memory[p] for p in pairs]
    if len(_memory) + len(found) > REMEMBERED:
        _memory.clear()
    _memory.update((p, r) for p, r in found.items() if len(p[0]) + len(p[1]) <= SHORT)
    return out


@F.arrow_udf(T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("matches", T.IntegerType())]))
def distance_and_matches(queries: pa.Array, targets: pa.Array) -> pa.Array:
    """Global distance, and matches on the traced path; (-1, 0) where a side is empty."""
    found = remembered_pairs([(q or "", t or "") for q, t in zip(queries.to_pylist(), targets.to_pylist())])
    return pa.StructArray.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([m for _, m in found], pa.int32())], names=["distance", "matches"])


def unstarred(seq: str) -> str:
    return seq.removesuffix("*")


def identity(query, target):
    """Matches in percent of the alignment's columns; one trailing ``*`` of a side is left out (``unstarred``), 0 where one is empty."""
    strip = lambda c: F.regexp_replace(c, r"\*$", "")
    return identity_of(distance_and_matches(strip(query), strip(target)))


def identity_of(found):
    d, m = found["distance"], found["matches"]
    return F.when(d < 0, F.lit(0.0)).otherwise(m / F.greatest(m + d, F.lit(1)) * 100)


@F.arrow_udf(T.IntegerType())
def infix_distance(queries: pa.Array, targets: pa.Array) -> pa.Array:
    """Least distance of a query to a substring of its target."""
    pairs = list(zip(queries.to_pylist(), targets.to_pylist()))
    whole = [p for p in pairs if None not in p]
    qs, asked = {q: i for i, q in enumerate(dict.fromkeys(q for q, _ in whole))}, {}
    for q, t in dict.fromkeys(whole):
        asked.setdefault(t, []).append(qs[q])
    table = lanes.Queries(list(qs)).infix_distances(list(asked), only=[np.array(x) for x in asked.values()])
    found = dict(zip(asked, table))
    return pa.array([None if None in p else found[p[1]][qs[p[0]]] for p in pairs], pa.int32())


def register(spark: SparkSession) -> None:
    """SQL names: seq_align_nw, seq_align_shw, seq_align_hw (with path), seq_infix_distance, seq_decompose."""
    for mode in ("NW", "SHW", "HW"):
        spark.udf.register(f"seq_align_{mode.lower()}", aligner(mode, "PATH"))
    spark.udf.register("seq_infix_distance", infix_distance)
    spark.udtf.register("seq_decompose", SeqDecompose)


@F.udtf(returnType=T.StructType([T.StructField(n, T.IntegerType()) for n in ("monomer", "start", "end", "score")]))
class SeqDecompose:
    """``seq_decompose(read, array(monomers))``: blocks with the monomer's place in the array."""

    def eval(self, read: str, monomers: list[str]) -> Iterator[tuple]:
        if read and monomers:
            yield from kernels.segment([read], kernels.Templates(list(monomers), -1, -1, -1, 1))[0]
