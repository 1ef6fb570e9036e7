"""The whole decomposition as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import chunk_reads, require_unique_names
from ..operators.monomers import both_strands, collect_checked, require_valid
from ..operators.scoring import alt_table, no_alt, reliability, score_full, score_light
from ..operators.segmentation import drop_overlaps, segment_chunks, task_count, with_gap_and_span
from ..params import Options
from ..sources.fasta import SPLIT, fasta_names, read_fasta_chunks


@dataclass
class Decomposition:
    raw: DataFrame
    final: DataFrame
    alt: DataFrame
    #: Blocks with their segments, which the tables are made of.
    blocks: DataFrame


def decompose(reads: DataFrame, monomers: DataFrame, options: Options = Options(), check_names: bool = True, keep: bool = False) -> Decomposition:
    """Tables of (read_ordinal, read_name, seq) against (ordinal, name, seq).

    ``raw``: kept blocks with score, gap and span. ``final``: identity, the second-best columns and
    reliability, blocks below ``min_identity`` left out. ``alt``: every monomer's identity (only with
    ``second_best``). A read without symbols has no rows; other symbols and repeated names fail.
    ``keep`` persists the blocks, so that writing several of the tables segments once.
    """
    reads = require_valid(reads, "reads")
    names = reads.groupBy("read_name").agg(F.count("*").alias("reads"), F.sum(F.octet_length("seq").cast("long")).alias("letters"))
    name, most, letters = names.agg(F.max_by("read_name", "reads"), F.max("reads"), F.sum("letters")).first()
    if check_names and most is not None and most > 1:
        raise ValueError(f"read name {name!r} occurs more than once")
    chunks = chunk_reads(reads, options.part_size, options.overlap)
    with_overlaps = (letters or 0) * (options.part_size + options.overlap) // options.part_size
    return decompose_chunks(chunks, monomers, options, with_overlaps, keep)


def decompose_chunks(chunks: DataFrame, monomers: DataFrame, options: Options = Options(), letters: int | None = None, keep: bool = False) -> Decomposition:
    """The same for chunks of differently named reads, cut by the options' sizes; ``letters``: about how many they have, counted where it is not known."""
    strands = both_strands(require_valid(monomers, "monomers"))
    order = collect_checked(strands, options.max_monomers)
    if letters is None and options.second_best:
        letters = chunks.agg(F.sum(F.octet_length("chunk_seq").cast("long"))).first()[0] or 0
    blocks = with_gap_and_span(drop_overlaps(segment_chunks(chunks, order, options.scoring, options.ed_thr, letters)))
    if options.second_best:
        # a block meets all monomers, which its bytes don't tell
        tasks = task_count(letters * sum(len(s["seq"]) for s in order), chunks.sparkSession.sparkContext.defaultParallelism)
        blocks = blocks.repartition(tasks, "read_ordinal", "block_idx")
    if keep:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    scored = score_full(blocks, order) if options.second_best else score_light(blocks, chunks.sparkSession.createDataFrame(order, strands.schema))
    second = F.coalesce("second_best_identity", F.lit(-1.0))
    scored = scored.withColumn("reliability", reliability(F.col("identity"), second, options.reliability))
    final = scored.where(F.col("identity") >= options.min_identity)
    raw = blocks.select("read_ordinal", "read_name", "block_idx", "monomer", "start", "end", "score", "gap", "span")
    alt = alt_table(blocks, order, options.min_identity) if options.second_best else no_alt(final)
    return Decomposition(raw, final.drop("segment"), alt, blocks)


def decompose_files(spark: SparkSession, reads: str, monomers: DataFrame, options: Options = Options(), upper: bool = False, split_bytes: int = SPLIT, keep: bool = False) -> Decomposition:
    """The same for FASTA files of reads, cut straight from their splits, so that a contig is never one row."""
    twice = require_unique_names(fasta_names(spark, reads, split_bytes)).limit(1).collect()
    if twice:
        raise ValueError(f"read name {twice[0]['read_name']!r} occurs more than once")
    chunks = read_fasta_chunks(spark, reads, options.part_size, options.overlap, split_bytes)
    if upper:
        chunks = chunks.withColumn("chunk_seq", F.upper("chunk_seq"))
    return decompose_chunks(require_valid(chunks, "reads", "chunk_seq"), monomers, options, keep=keep)
