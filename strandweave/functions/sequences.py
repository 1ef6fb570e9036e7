"""Sequence functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGTN"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def homopolymer_compress(seq: Column) -> Column:
    """Runs of equal characters become one."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def is_valid(seq: Column) -> Column:
    return seq.rlike("^[ACGTN]*$")


def has_n(seq: Column) -> Column:
    return F.instr(seq, "N") > 0


def header_name(header: Column) -> Column:
    """First white-space token of a FASTA header."""
    return F.split(F.ltrim(header), r"\s+")[0]


def bases(text: Column) -> Column:
    """Letters A, C, G, T, N of any case, in upper case; other characters go first, so nothing expands."""
    return F.upper(F.regexp_replace(text, "[^ACGTNacgtn]+", ""))


def segment(seq: Column, start: Column, end: Column) -> Column:
    """Characters ``start``..``end``, counted from 0, end included."""
    return F.substring(seq, start + 1, end - start + 1)


def cigar_length(cigar: Column) -> Column:
    """Sum of the counts of all operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def cigar_matches(cigar: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)="), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def two_decimals(x: Column) -> Column:
    """``%.2f`` with ties to even."""
    return F.format_string("%.2f", F.bround(x, 2))
