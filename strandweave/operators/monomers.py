"""Both strands of the monomers, with the two orders that ties depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import homopolymer_compress, is_valid, reverse_complement


def require_valid(df: DataFrame, what: str, seq: str = "seq") -> DataFrame:
    """``df``, failing at run time on a symbol other than A, C, G, T, N."""
    bad = F.concat(F.lit(f"{what}: sequence with a symbol other than A, C, G, T, N: "), F.substring(F.col(seq), 1, 80))
    return df.withColumn(seq, F.when(is_valid(F.col(seq)), F.col(seq)).otherwise(F.raise_error(bad).cast("string")))


def both_strands(monomers: DataFrame) -> DataFrame:
    """(ordinal, name, seq) -> every monomer and its reverse complement, named with a prime.

    ``dp_ordinal`` has all forward ones first, ``rank_ordinal`` has each pair side by side.
    """
    count = monomers.select(F.count("*").alias("monomer_count"))
    strands = F.array(
        F.struct(F.lit(0).alias("strand"), F.col("name").alias("name"), F.col("seq").alias("seq")),
        F.struct(F.lit(1).alias("strand"), F.concat("name", F.lit("'")).alias("name"), reverse_complement(F.col("seq")).alias("seq")),
    )
    rows = monomers.select("ordinal", F.explode(strands).alias("s")).join(F.broadcast(count))
    return rows.select(
        (F.col("ordinal") + F.col("s.strand") * F.col("monomer_count")).cast("int").alias("dp_ordinal"),
        (F.col("ordinal") * 2 + F.col("s.strand")).cast("int").alias("rank_ordinal"),
        F.col("s.name").alias("name"),
        F.col("s.seq").alias("seq"),
        homopolymer_compress(F.col("s.seq")).alias("homo_seq"),
    )


def collect_checked(strands: DataFrame, most: int, most_bytes: int = 64 << 20) -> list:
    """Rows in ``dp_ordinal`` order; raises where there are none, more than ``most`` rows or bytes, or an empty sequence."""
    size = strands.agg(F.count("*"), F.sum(F.octet_length("seq"))).first()
    if not size[0]:
        raise ValueError("there are no monomers")
    if size[0] > most or size[1] > most_bytes:
        raise ValueError(f"more than {most} monomers or {most_bytes} bytes of them; raise max_monomers if the executors have room")
    rows = sorted(strands.collect(), key=lambda r: r["dp_ordinal"])
    if any(not r["seq"] for r in rows):
        raise ValueError("a monomer is empty")
    return rows
