"""Queries over the driver's tables.

Reads are documents or benchmark items; monomers are made of part names (few, and alike at every
size) or are the benchmark items. SQL covers the queries over benchmark items as reads, and those
over documents that are plain expressions; the decomposition of all documents is too slow in SQL on
whole tables, and tests compare the same operators with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracles as O
from .functions import sequences as S
from .operators import align as A
from .operators import segmentation
from .operators.chunks import chunk_counts, chunk_reads, require_unique_names
from .operators.monomers import both_strands, collect_checked
from .params import Options
from .plans.decompose import decompose
from .sources import fasta, tsv
from .sources.scratch import shared_folder

PART_SIZE, OVERLAP, ED_THR = 500, 100, 6
OPTIONS = Options(part_size=PART_SIZE, overlap=OVERLAP)
#: Items are short reads, so their chunks are too.
ITEM_PART, ITEM_OVERLAP = 40, 15
#: Splits of the FASTA files that queries write, small so that small tables have several.
FASTA_SPLIT = 1 << 18
EQUALITIES = [("A", "N"), ("G", "T")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("read_ordinal"), F.col("doc_id").cast("string").alias("read_name"), S.bases(F.coalesce("text", F.lit(""))).alias("seq")
    )


def item_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("read_ordinal"), F.col("item_id").cast("string").alias("read_name"), S.bases(F.coalesce("text", F.lit(""))).alias("seq")
    )


def item_monomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as monomers, named by their ids."""
    rows = item_reads(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit("m"), "read_name").alias("name"), "seq", "read_ordinal")
    return rows.select((F.row_number().over(W.orderBy("read_ordinal")) - 1).alias("ordinal"), "name", "seq")


def monomers_of(spark: SparkSession, sf_dir: str, total: bool = False) -> DataFrame:
    """One monomer for each first word of the part names (a small, fixed vocabulary): all such names' bases, joined.

    ``total`` adds one of all the names, longer than 128 symbols.
    """
    names = _table(spark, sf_dir, "part").select("p_name").distinct().withColumn("name", F.substring_index("p_name", " ", 1))
    joined = (names.rollup("name") if total else names.groupBy("name")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "").alias("names"))
    rows = joined.select(F.coalesce("name", F.lit("all names")).alias("name"), S.bases(F.col("names")).alias("seq")).where("seq <> ''")
    return rows.select((F.row_number().over(W.orderBy("name")) - 1).alias("ordinal"), "name", "seq")


def _strands(spark: SparkSession, sf_dir: str, total: bool = True) -> DataFrame:
    """Both strands of the word monomers, as a small table of a checked size."""
    strands = both_strands(monomers_of(spark, sf_dir, total))
    return spark.createDataFrame(collect_checked(strands, OPTIONS.max_monomers), strands.schema)


READS_SQL = "SELECT doc_id AS read_ordinal, CAST(doc_id AS VARCHAR) AS read_name, upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents"
CHUNKS_SQL = f"""WITH r AS ({READS_SQL}), {O.chunks(PART_SIZE, OVERLAP)}"""


def reads_projection(spark, sf_dir):
    return reads_of(spark, sf_dir)


def invalid_symbols(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_ordinal"), F.coalesce("text", F.lit("")).alias("seq"))
    return raw.where(~S.is_valid(F.col("seq"))).select("read_ordinal", F.length(F.regexp_replace("seq", "[ACGTN]", "")).cast("long").alias("invalid_symbols"))


def n_content(spark, sf_dir):
    n = F.length("seq") - F.length(F.replace(F.col("seq"), F.lit("N"), F.lit("")))
    return reads_of(spark, sf_dir).select("read_ordinal", S.has_n(F.col("seq")).alias("has_n"), n.cast("long").alias("n_count"))


def reverse_complement(spark, sf_dir):
    return reads_of(spark, sf_dir).select("read_ordinal", S.reverse_complement(F.col("seq")).alias("rc"))


def monomers_both_strands(spark, sf_dir):
    return both_strands(monomers_of(spark, sf_dir, total=True)).select("dp_ordinal", "rank_ordinal", "name", "seq", "homo_seq")


def homopolymer_compress(spark, sf_dir):
    return reads_of(spark, sf_dir).select("read_ordinal", S.homopolymer_compress(F.col("seq")).alias("homo_seq"))


def chunked_reads(spark, sf_dir):
    return chunk_reads(reads_of(spark, sf_dir), PART_SIZE, OVERLAP).select("read_ordinal", "chunk_idx", F.col("chunk_offset").cast("long").alias("chunk_offset"), "chunk_seq")


def counted_chunks(spark, sf_dir):
    return chunk_counts(chunk_reads(reads_of(spark, sf_dir), PART_SIZE, OVERLAP)).select("read_ordinal", F.col("chunks").cast("long").alias("chunks"))


def duplicate_names(spark, sf_dir):
    """Sources as read names: those that the check of names refuses."""
    found = require_unique_names(_table(spark, sf_dir, "documents").select(F.col("source").alias("read_name")))
    return found.select(F.col("read_name").alias("source"), F.col("count").alias("occurrences"))


def _fasta_folder(spark, sf_dir):
    """The documents' bases as FASTA files in lines of 60. They stay, since the plan that is returned reads them."""
    path = shared_folder(spark, "fasta")
    fasta.write_fasta(reads_of(spark, sf_dir), path)
    return path


def fasta_records(spark, sf_dir):
    """Records of FASTA files, read by splits."""
    return fasta.read_fasta(spark, _fasta_folder(spark, sf_dir), FASTA_SPLIT).select(F.col("name").alias("read_name"), "seq")


def fasta_chunks(spark, sf_dir):
    """Chunks of the same files, cut straight from their splits."""
    found = fasta.read_fasta_chunks(spark, _fasta_folder(spark, sf_dir), PART_SIZE, OVERLAP, FASTA_SPLIT)
    return found.select("read_name", "chunk_idx", "chunk_offset", "chunk_seq")


def _strand_pairs(spark, sf_dir):
    """Every strand with every strand."""
    s = _strands(spark, sf_dir)
    return s.select(F.col("name").alias("query"), F.col("seq").alias("q")).crossJoin(F.broadcast(s.select(F.col("name").alias("target"), F.col("seq").alias("t"))))


def edit_distance_nw(spark, sf_dir):
    """The JVM's distance and the aligner's."""
    found = A.aligner("NW")(F.col("q"), F.col("t"))["edit_distance"]
    return _strand_pairs(spark, sf_dir).select("query", "target", F.levenshtein("q", "t").cast("long").alias("distance"), found.cast("long").alias("aligned"))


def identity(spark, sf_dir):
    pairs = _strand_pairs(spark, sf_dir).withColumn("found", A.distance_and_matches(F.col("q"), F.col("t")))
    return pairs.select("query", "target", "found.distance", "found.matches", A.identity_of(F.col("found")).alias("identity"))


def _operations(cigar: str):
    """A CIGAR spelled out."""
    runs = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+.)"), F.lit(1)), lambda x: F.repeat(F.right(x, F.lit(1)), F.regexp_extract(x, "[0-9]+", 0).cast("int")))
    return F.array_join(runs, "")


def align_global(spark, sf_dir):
    """Global paths: their operations spelled out from the CIGAR, its length and its matches."""
    pairs = _strand_pairs(spark, sf_dir).withColumn("found", A.aligner("NW", "PATH")(F.col("q"), F.col("t")))
    return pairs.select(
        "query", "target", F.col("found.edit_distance").alias("distance"), _operations("found.cigar").alias("operations"),
        S.cigar_length(F.col("found.cigar")).alias("columns"), S.cigar_matches(F.col("found.cigar")).alias("matches"),
    )


def _locations(spark, sf_dir, mode):
    pairs = _strand_pairs(spark, sf_dir).withColumn("found", A.aligner(mode, "LOC")(F.col("q"), F.col("t")))
    at = lambda c: F.array_join(F.transform(f"found.{c}", lambda x: x.cast("string")), ",").alias(c)
    return pairs.select("query", "target", F.col("found.edit_distance").alias("distance"), at("end_locations"), at("start_locations"))


def align_infix(spark, sf_dir):
    """Against substrings: all optimal ends, and the last start of each."""
    return _locations(spark, sf_dir, "HW")


def align_prefix(spark, sf_dir):
    """Against prefixes: all optimal ends."""
    return _locations(spark, sf_dir, "SHW")


def align_within(spark, sf_dir):
    """Global distances up to 12; beyond, -1."""
    found = A.aligner("NW", "DISTANCE", 12)(F.col("q"), F.col("t"))["edit_distance"]
    return _strand_pairs(spark, sf_dir).select("query", "target", found.cast("long").alias("distance"))


def align_equalities(spark, sf_dir):
    """Global distances where A equals N and G equals T."""
    found = A.aligner("NW", "DISTANCE", equalities=EQUALITIES)(F.col("q"), F.col("t"))["edit_distance"]
    return _strand_pairs(spark, sf_dir).select("query", "target", found.cast("long").alias("distance"))


def _item_chunks(spark, sf_dir):
    return chunk_reads(item_reads(spark, sf_dir), ITEM_PART, ITEM_OVERLAP)


def _order(spark, sf_dir, total=True):
    return collect_checked(both_strands(monomers_of(spark, sf_dir, total)), OPTIONS.max_monomers)


def _items(spark, sf_dir, **options):
    return decompose(item_reads(spark, sf_dir), monomers_of(spark, sf_dir, total=True), Options(part_size=ITEM_PART, overlap=ITEM_OVERLAP, **options))


def _wide(df):
    return df.select(*[F.col(c).cast("double") if t == "float" else F.col(c) for c, t in df.dtypes])


def item_infix_distance(spark, sf_dir):
    """Every chunk of the items against every strand."""
    return segmentation.monomer_distances(_item_chunks(spark, sf_dir), _order(spark, sf_dir))


def item_candidates(spark, sf_dir):
    return segmentation.candidate_monomers(_item_chunks(spark, sf_dir), _order(spark, sf_dir), ED_THR)


def item_chunk_blocks(spark, sf_dir):
    """Blocks of the chunks, before overlaps are folded."""
    found = segmentation.segment_chunks(_item_chunks(spark, sf_dir), _order(spark, sf_dir), OPTIONS.scoring)
    return _wide(found.select("read_ordinal", "chunk_idx", F.col("block_idx").cast("long").alias("block_idx"), "monomer", "start", "end", "score"))


def item_raw_blocks(spark, sf_dir):
    return _wide(_items(spark, sf_dir).raw)


def item_pruned_blocks(spark, sf_dir):
    return _wide(_items(spark, sf_dir, ed_thr=ED_THR).raw)


FINAL = ("read_ordinal", "read_name", "block_idx", "monomer", "start", "end", "identity", "second_best", "second_best_identity", "homo_best", "homo_best_identity", "homo_second_best", "homo_second_best_identity", "reliability")


def item_final(spark, sf_dir):
    return _items(spark, sf_dir, second_best=True).final.select(*FINAL)


def item_light(spark, sf_dir):
    """Light mode, with the filter by identity."""
    return _items(spark, sf_dir, min_identity=50).final.select("read_ordinal", "block_idx", "monomer", "start", "end", "identity", "reliability")


def item_alt(spark, sf_dir):
    return _items(spark, sf_dir, second_best=True).alt


def item_lines(spark, sf_dir):
    """The lines of the three files."""
    found = _items(spark, sf_dir, second_best=True)
    out = None
    for kind, lines in (("raw", tsv.raw_lines(found.raw)), ("final", tsv.final_lines(found.final)), ("alt", tsv.alt_lines(found.alt))):
        keys = [c for c in ("read_ordinal", "block_idx", "alt_idx") if c in lines.columns]
        part = lines.select(F.lit(kind).alias("kind"), F.concat_ws("\t", *[F.col(c).cast("string") for c in lines.columns if c not in keys]).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def raw_read_back(spark, sf_dir):
    """The raw table written as one TSV file and read back."""
    path = f"{shared_folder(spark, 'raw')}/raw.tsv"
    tsv.write_tsv_file(tsv.raw_lines(_items(spark, sf_dir).raw), path)
    return tsv.read_raw_tsv(spark, path)


def item_paths(spark, sf_dir):
    """Every item against every word strand as a stretch of it: all ends, their first starts, and the first one's operations."""
    strands = [(s["name"], s["seq"]) for s in _order(spark, sf_dir, total=False)]
    items = item_reads(spark, sf_dir).where("seq <> ''").select("read_ordinal", "seq")
    found = A.align_to_all(items, "seq", strands, "HW", "PATH")
    at = lambda c: F.array_join(F.transform(f"alignment.{c}", lambda x: x.cast("string")), ",").alias(c)
    return found.select("read_ordinal", "query", F.col("alignment.edit_distance").alias("distance"), at("end_locations"), at("start_locations"), _operations("alignment.cigar").alias("operations"))


def second_best(spark, sf_dir):
    return item_final(spark, sf_dir).select("read_ordinal", "block_idx", "second_best", "second_best_identity")


def best_two(spark, sf_dir):
    """The best two strands of each block by homopolymer identity."""
    return item_final(spark, sf_dir).select("read_ordinal", "block_idx", "homo_best", "homo_best_identity", "homo_second_best", "homo_second_best_identity")


def reliability_filter(spark, sf_dir):
    """Blocks of an identity of 55 or more, with their reliability."""
    return _items(spark, sf_dir, second_best=True, min_identity=55).final.select("read_ordinal", "block_idx", "identity", "reliability")


def infix_distance(spark, sf_dir):
    """Least distance of every monomer strand to each chunk of the documents: the pairs that candidate pruning looks at."""
    return segmentation.monomer_distances(chunk_reads(reads_of(spark, sf_dir), PART_SIZE, OVERLAP), _order(spark, sf_dir, total=False))


def candidate_monomers(spark, sf_dir):
    """Of each chunk of the documents the nearest strand and all within the threshold, in tie order."""
    return segmentation.candidate_monomers(chunk_reads(reads_of(spark, sf_dir), PART_SIZE, OVERLAP), _order(spark, sf_dir, total=False), ED_THR)


def _decomposed(spark, sf_dir, monomers=monomers_of, **options):
    return decompose(reads_of(spark, sf_dir), monomers(spark, sf_dir), Options(part_size=PART_SIZE, overlap=OVERLAP, **options))


def raw_blocks(spark, sf_dir):
    return _decomposed(spark, sf_dir).raw


def pruned_blocks(spark, sf_dir):
    return _decomposed(spark, sf_dir, ed_thr=ED_THR).raw


def light_decomposition(spark, sf_dir):
    return _decomposed(spark, sf_dir, min_identity=50).final


def final_decomposition(spark, sf_dir):
    """All documents by the benchmark items, with second best."""
    return _decomposed(spark, sf_dir, item_monomers, second_best=True).final.select(*FINAL)


def alt_table(spark, sf_dir):
    return _decomposed(spark, sf_dir, item_monomers, second_best=True).alt


QUERIES = {
    f.__name__: f
    for f in (
        reads_projection, invalid_symbols, n_content, reverse_complement, monomers_both_strands, homopolymer_compress, chunked_reads,
        counted_chunks, fasta_records, fasta_chunks, duplicate_names, edit_distance_nw, identity, align_global, align_infix, align_prefix, align_within, align_equalities,
        item_infix_distance, item_candidates, item_chunk_blocks, item_raw_blocks, item_pruned_blocks, item_light, item_final, item_alt, item_lines, item_paths, raw_read_back,
        second_best, best_two, reliability_filter, infix_distance, candidate_monomers, raw_blocks, pruned_blocks, light_decomposition,
        final_decomposition, alt_table,
    )
}

_WORDS = f"WITH RECURSIVE {O.MONOMERS}"
_PAIRS = f"{_WORDS}, {O.STRAND_PAIRS}"
_ITEMS = f"{_WORDS}, {O.READS}, {O.chunks(ITEM_PART, ITEM_OVERLAP)}"
_NEAR = f"{_ITEMS}, {O.PAIRED}, {O.infix('cs')}"
_RAW = f"{_ITEMS}, {O.EVERY_LANE}, {O.BLOCKS}, {O.RAW}"
_FINAL = f"{_RAW}, {O.SCORES}"
_TABLE = 'SELECT read_ordinal, read_name, block_idx, monomer, "start", "end", CAST(score AS DOUBLE) AS score, gap, span FROM raw'
_SAME = "(q[i + 1] = t[j] OR q[i + 1] || t[j] IN ('AN', 'NA', 'GT', 'TG'))"
_ALT = "SELECT read_ordinal, read_name, block_idx, CAST(row_number() OVER (PARTITION BY read_ordinal, block_idx ORDER BY rank_ordinal) - 1 AS INTEGER) AS alt_idx, candidate AS monomer, \"start\", \"end\", idnt AS identity, CASE WHEN candidate = monomer THEN '*' ELSE '-' END AS star FROM scored"


def _ends(first: str, starts: str) -> str:
    """Optimal ends; the place before the first letter counts where the query's length is no multiple of 64."""
    return f"""{_PAIRS}, {O.traced('sp', first)},
    least AS (SELECT *, min(d) OVER (PARTITION BY pid) AS best FROM bottom WHERE j > 0 OR length(q) % 64 <> 0)
    SELECT query, target, best AS distance, string_agg(CAST(j - 1 AS VARCHAR), ',' ORDER BY j) AS end_locations, string_agg(CAST({starts} AS VARCHAR), ',' ORDER BY j) AS start_locations
    FROM least JOIN sp USING (pid) WHERE d = best GROUP BY ALL"""


ORACLES = {
    "reads_projection": READS_SQL,
    "invalid_symbols": "SELECT doc_id AS read_ordinal, CAST(length(regexp_replace(coalesce(text, ''), '[ACGTN]', '', 'g')) AS BIGINT) AS invalid_symbols FROM documents WHERE NOT regexp_full_match(coalesce(text, ''), '[ACGTN]*')",
    "n_content": f"SELECT read_ordinal, contains(seq, 'N') AS has_n, CAST(length(seq) - length(replace(seq, 'N', '')) AS BIGINT) AS n_count FROM ({READS_SQL})",
    "reverse_complement": f"SELECT read_ordinal, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM ({READS_SQL})",
    "monomers_both_strands": f"{_WORDS} SELECT dp_ordinal, rank_ordinal, name, seq, {O.homo('seq')} AS homo_seq FROM s",
    "homopolymer_compress": f"SELECT read_ordinal, {O.homo('seq')} AS homo_seq FROM ({READS_SQL})",
    "chunked_reads": f"{CHUNKS_SQL} SELECT read_ordinal, chunk_idx, off AS chunk_offset, seq AS chunk_seq FROM c",
    "counted_chunks": f"{CHUNKS_SQL} SELECT read_ordinal, count(*) AS chunks FROM c GROUP BY read_ordinal",
    "fasta_records": f"SELECT read_name, seq FROM ({READS_SQL})",
    "fasta_chunks": f"{CHUNKS_SQL} SELECT CAST(read_ordinal AS VARCHAR) AS read_name, chunk_idx, off AS chunk_offset, seq AS chunk_seq FROM c",
    "duplicate_names": "SELECT source, count(*) AS occurrences FROM documents GROUP BY source HAVING count(*) > 1",
    "edit_distance_nw": f"{_PAIRS} SELECT query, target, levenshtein(q, t) AS distance, levenshtein(q, t) AS aligned FROM sp",
    "identity": f"{_PAIRS}, {O.matched('SELECT DISTINCT q, t FROM sp')} SELECT query, target, d AS distance, m AS matches, {O.identity('f')} AS identity FROM sp JOIN nw_found f USING (q, t)",
    "align_global": f"{_PAIRS}, {O.traced('sp', '0')} SELECT query, target, d AS distance, o AS operations, CAST(length(o) AS INTEGER) AS columns, CAST(length(replace(o, '=', '==')) - length(o) AS INTEGER) AS matches FROM bottom JOIN sp USING (pid) WHERE j = length(bottom.t)",
    "align_infix": _ends("-k", "CASE WHEN j > 0 THEN a ELSE 0 END"),
    "align_prefix": _ends("0", "0"),
    "align_within": f"{_PAIRS} SELECT query, target, CASE WHEN levenshtein(q, t) <= 12 THEN levenshtein(q, t) ELSE -1 END AS distance FROM sp",
    "align_equalities": f"{_PAIRS}, {O.traced('sp', '0', _SAME)} SELECT query, target, CAST(d AS BIGINT) AS distance FROM bottom JOIN sp USING (pid) WHERE j = length(bottom.t)",
    "item_infix_distance": f"{_NEAR} SELECT read_ordinal, chunk_idx, dp_ordinal, distance FROM cs JOIN near USING (pid)",
    "item_candidates": f"{_NEAR}, {O.NEAREST.format(ED_THR)} SELECT read_ordinal, chunk_idx, CAST(place AS INTEGER) AS place, dp_ordinal, distance FROM chosen",
    "item_chunk_blocks": f'{_ITEMS}, {O.EVERY_LANE}, {O.BLOCKS} SELECT read_ordinal, chunk_idx, block_idx, monomer, "start", "end", CAST(score AS DOUBLE) AS score FROM b',
    "item_raw_blocks": f"{_RAW} {_TABLE}",
    "item_pruned_blocks": f"{_NEAR}, {O.NEAREST.format(ED_THR)}, {O.CHOSEN_LANES}, {O.BLOCKS}, {O.RAW} {_TABLE}",
    "item_light": f"""{_FINAL} SELECT read_ordinal, block_idx, monomer, "start", "end", identity, CASE WHEN {O.B0} + {O.B1} * identity + {O.B2} * (identity + 1) > 0 THEN '+' ELSE '?' END AS reliability FROM final WHERE identity >= 50""",
    "item_final": f"{_FINAL} SELECT * FROM final",
    "item_alt": f"{_FINAL} {_ALT}",
    "item_lines": f"""{_FINAL}, alts AS ({_ALT})
        SELECT 'raw' AS kind, concat_ws('\t', read_name, monomer, "start", "end", printf('%.6f', CAST(score AS DOUBLE)), gap, span) AS line FROM raw
        UNION ALL SELECT 'final', concat_ws('\t', read_name, monomer, "start", "end", printf('%.2f', identity), second_best, printf('%.2f', second_best_identity), homo_best, printf('%.2f', homo_best_identity), homo_second_best, printf('%.2f', homo_second_best_identity), reliability) FROM final
        UNION ALL SELECT 'alt', concat_ws('\t', read_name, monomer, "start", "end", printf('%.2f', identity), star) FROM alts""",
    "raw_read_back": f"""{_RAW} SELECT read_name, monomer, "start", "end", CAST(score AS DOUBLE) AS score, gap, span FROM raw""",
    "item_paths": f"""{_WORDS}, {O.READS},
        sp AS (SELECT row_number() OVER (ORDER BY read_ordinal, dp_ordinal) AS pid, read_ordinal, s.name AS query, s.seq AS q, r.seq AS t FROM r, s WHERE r.seq <> '' AND s.name NOT LIKE 'all names%'),
        {O.traced('sp', '-k')},
        least AS (SELECT *, min(d) OVER (PARTITION BY pid) AS best FROM bottom WHERE j > 0 OR length(q) % 64 <> 0),
        ends AS (SELECT pid, best, min(j) AS e, min_by(CASE WHEN j > 0 THEN a ELSE 0 END, j) AS b, string_agg(CAST(j - 1 AS VARCHAR), ',' ORDER BY j) AS end_locations,
                        string_agg(CAST(CASE WHEN j > 0 THEN a ELSE 0 END AS VARCHAR), ',' ORDER BY j) AS start_locations FROM least WHERE d = best GROUP BY pid, best),
        part AS (SELECT pid, q, substr(t, b + 1, e - b) AS t FROM sp JOIN ends USING (pid)),
        {O.traced('part', '0', name='al2', bottom='bottom2')}
        SELECT read_ordinal, query, best AS distance, end_locations, start_locations, o AS operations
        FROM sp JOIN ends USING (pid) JOIN bottom2 USING (pid) WHERE bottom2.j = length(bottom2.t)""",
    "second_best": f"{_FINAL} SELECT read_ordinal, block_idx, second_best, second_best_identity FROM final",
    "best_two": f"{_FINAL} SELECT read_ordinal, block_idx, homo_best, homo_best_identity, homo_second_best, homo_second_best_identity FROM final",
    "reliability_filter": f"{_FINAL} SELECT read_ordinal, block_idx, identity, reliability FROM final WHERE identity >= 55",
}
