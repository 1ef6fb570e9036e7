import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandweave.functions import sequences as S
from strandweave.operators import align, segmentation
from strandweave.operators.chunks import chunk_reads, cut_up
from strandweave.operators.monomers import both_strands
from strandweave.params import Options, Scoring
from strandweave.plans.decompose import decompose, decompose_files
from strandweave.sources import tsv
from strandweave.sources.fasta import as_monomers, as_reads, fasta_names, fasta_summaries, read_fasta, read_fasta_chunks, read_fasta_text, write_fasta
from strandweave.streaming.reads import decompose_stream
from tests import plain

READS = "read_ordinal long, read_name string, seq string"
MONOMERS = "ordinal long, name string, seq string"


def reads(spark, *seqs):
    return spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], READS)


def monomers(spark, **seqs):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs.items())], MONOMERS)


def test_sequence_functions(spark):
    row = spark.range(1).select(
        S.reverse_complement(F.lit("ACGTN")).alias("rc"), S.homopolymer_compress(F.lit("AAACCGTTTA")).alias("homo"), S.bases(F.lit("a-Cß gx")).alias("b"),
        S.cigar_length(F.lit("10=2X1I")).alias("n"), S.cigar_matches(F.lit("10=2X3=")).alias("m"), S.two_decimals(F.lit(78.125)).alias("t"), S.segment(F.lit("ACGT"), F.lit(1), F.lit(2)).alias("s"),
    ).first()
    assert tuple(row) == ("NACGT", "ACGTA", "ACG", 13, 13, "78.12", "CG")


@pytest.mark.parametrize("n,part,overlap,want", [(12, 5, 3, [(0, 8), (5, 7)]), (4, 5, 6, [(0, 4)]), (7, 3, 8, [(0, 7), (3, 4), (6, 1)]), (0, 3, 8, [])])
def test_chunks(spark, n, part, overlap, want):
    got = chunk_reads(reads(spark, "A" * n), part, overlap).orderBy("chunk_idx").collect()
    assert [(r["chunk_offset"], len(r["chunk_seq"])) for r in got] == want


def test_strands_have_two_orders(spark):
    rows = both_strands(monomers(spark, m1="AC", m2="AAG")).orderBy("dp_ordinal").collect()
    assert [(r["name"], r["seq"], r["rank_ordinal"]) for r in rows] == [("m1", "AC", 0), ("m2", "AAG", 2), ("m1'", "GT", 1), ("m2'", "CTT", 3)]


def test_light_rows(spark, tmp_path):
    found = decompose(reads(spark, "ACGT", ""), monomers(spark, m1="AC"))
    raw = [tuple(r)[2:] for r in tsv.raw_lines(found.raw).orderBy("block_idx").collect()]
    assert raw == [("r0", "m1", 0, 1, "2.000000", 0, 1), ("r0", "m1'", 2, 3, "2.000000", 1, 1)]
    final = [tuple(r)[2:] for r in tsv.final_lines(found.final).orderBy("block_idx").collect()]
    assert final[0] == ("r0", "m1", 0, 1, "100.00", "None", "-1.00", "None", "-1.00", "None", "-1.00", "+")
    assert found.alt.count() == 0
    tsv.write_tsv(tsv.raw_lines(found.raw), str(tmp_path / "raw"), single=True)
    back = tsv.read_raw_tsv(spark, str(tmp_path / "raw")).collect()
    assert [(r["monomer"], r["start"], r["end"], r["gap"]) for r in back] == [("m1", 0, 1, 0), ("m1'", 2, 3, 1)]


def test_second_best_rows(spark):
    found = decompose(reads(spark, "ACGT"), monomers(spark, m1="AC"), Options(second_best=True))
    final = [tuple(r)[2:] for r in tsv.final_lines(found.final).orderBy("block_idx").collect()]
    assert final[0] == ("r0", "m1", 0, 1, "100.00", "m1'", "0.00", "m1", "100.00", "m1'", "0.00", "+")
    alt = [tuple(r)[3:] for r in tsv.alt_lines(found.alt).orderBy("block_idx", "alt_idx").collect()]
    assert alt[:2] == [("r0", "m1", 0, 1, "100.00", "*"), ("r0", "m1'", 0, 1, "0.00", "-")]


def test_plan_equals_the_plain_version(spark):
    import random

    r = random.Random(5)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (1, 37, 64, 150)]
    ms = {"a": "ACGTAC", "b": "GGT", "c": "TTACA", "p": "ACGT"}
    options = Options(part_size=40, overlap=15)
    got = {}
    for row in decompose(reads(spark, *seqs), monomers(spark, **ms), options).raw.orderBy("read_ordinal", "block_idx").collect():
        got.setdefault(row["read_name"], []).append((row["monomer"], row["start"], row["end"], row["score"]))
    rc = {n + "'": s[::-1].translate(str.maketrans("ACGT", "TGCA")) for n, s in ms.items()}
    names, templates = [*ms, *rc], [*ms.values(), *rc.values()]
    for k, s in enumerate(seqs):
        blocks = []
        for o in range(0, len(s), 40):
            if len(s) - o >= 15 or len(s) < 15:
                blocks += [(a + o, b + o, names[j], float(v)) for j, a, b, v in plain.segment(s[o : o + 55], templates)]
        kept, rest = [], list(blocks)
        for a, b in plain.fold([x[:2] for x in blocks]):
            while rest[0][:2] != (a, b):
                rest.pop(0)
            kept.append(rest.pop(0))
        assert got[f"r{k}"] == [(n, a, b, v) for a, b, n, v in kept]


def test_ed_thr_and_partitions_do_not_matter(spark):
    rs, ms = reads(spark, "ACGTTGCA" * 30, "GGGG"), monomers(spark, a="ACGT", b="TTGC", c="AAAA")
    one = decompose(rs.repartition(1), ms, Options(part_size=50, overlap=10, ed_thr=1)).raw.collect()
    many = decompose(rs.repartition(4), ms, Options(part_size=50, overlap=10, ed_thr=1)).raw.collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and one


def test_bad_inputs_fail(spark):
    with pytest.raises(PySparkException):
        decompose(reads(spark, "ACgT"), monomers(spark, m="AC")).raw.collect()
    with pytest.raises(ValueError):
        decompose(reads(spark, "AC"), monomers(spark)).raw.collect()
    twice = spark.createDataFrame([(0, "x", "A"), (1, "x", "C")], READS)
    with pytest.raises(ValueError):
        decompose(twice, monomers(spark, m="AC"))
    for bad in ({"part_size": 0}, {"overlap": -1}, {"part_size": 1 << 20}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        Scoring.parse("1,2,3")


def test_min_identity_and_reliability(spark):
    rows = decompose(reads(spark, "ACGTAA"), monomers(spark, m="ACGT"), Options(min_identity=60)).final.collect()
    assert all(r["identity"] >= 60 for r in rows) and rows
    from strandweave.operators.scoring import reliability
    from strandweave.params import RELIABILITY

    got = spark.createDataFrame([(27.74,), (27.75,)], "s double").select(reliability(F.col("s"), F.lit(-1.0), RELIABILITY)).collect()
    assert [r[0] for r in got] == ["?", "+"]


def test_fasta_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 some text\nACG\nTT\n\n>r2\nGG\n")
    for read in (read_fasta, read_fasta_text):
        assert [(r["name"], r["seq"]) for r in read(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()] == [("r1", "ACGTT"), ("r2", "GG")]
    assert decompose(as_reads(read_fasta(spark, str(tmp_path / "a.fa"))), as_monomers(read_fasta(spark, str(tmp_path / "a.fa")))).raw.count() >= 2


def test_fasta_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = ">a one\nACGT\nAC\n>b\r\nGG\r\n\n>c\n>d x\nTTTTTTTTTTTTTTTTTTTTTTTT\nN\n>e\nC"
    want = [("a", "ACGTAC"), ("b", "GG"), ("c", ""), ("d", "T" * 24 + "N"), ("e", "C")]
    (tmp_path / "in" / "1.fa").write_bytes(text.encode())
    (tmp_path / "in" / "2.fa").write_bytes(text.encode())
    for size in (1, 2, 3, 7, 8, 19, 1000):
        rows = read_fasta(spark, str(tmp_path / "in"), size).orderBy("ordinal").collect()
        assert [(r["name"], r["seq"]) for r in rows] == want * 2, size
        assert len({r["ordinal"] for r in rows}) == 10
    assert read_fasta(spark, str(tmp_path / "in"), 20).rdd.getNumPartitions() > 4
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nA\n")
    (tmp_path / "none.fa").write_text("> \nACGT\n")
    for name in ("bad.fa", "none.fa"):
        with pytest.raises(PySparkException):
            read_fasta(spark, str(tmp_path / name)).collect()


def test_command_line(spark, tmp_path):
    from strandweave import __main__ as cli

    (tmp_path / "r.fa").write_text(">r1 some\nACGTacgt\n>r2\nAC\n")
    (tmp_path / "m.fa").write_text(">m1\nAC\n")
    args = [str(tmp_path / "r.fa"), str(tmp_path / "m.fa"), "-o", str(tmp_path / "out"), "--out-file", "t", "--second-best"]
    with pytest.raises(PySparkException):
        cli.main(args)
    log = tmp_path / "out" / cli.LOG
    assert cli.FINISHED not in log.read_text()
    cli.main([*args, "--upper"])
    assert cli.FINISHED in log.read_text().splitlines()[-1]
    lines = {n: (tmp_path / "out" / n).read_text().splitlines() for n in ("t_raw.tsv", "t.tsv", "t_alt.tsv")}
    assert sorted(lines["t_raw.tsv"]) == sorted(["r1\tm1'\t2\t3\t2.000000\t1\t1", "r1\tm1'\t6\t7\t2.000000\t1\t1", "r1\tm1\t0\t1\t2.000000\t0\t1", "r1\tm1\t4\t5\t2.000000\t1\t1", "r2\tm1\t0\t1\t2.000000\t0\t1"])
    assert [x.split("\t")[:1] + x.split("\t")[2:4] for x in lines["t_raw.tsv"]] == [["r1", "0", "1"], ["r1", "2", "3"], ["r1", "4", "5"], ["r1", "6", "7"], ["r2", "0", "1"]]
    assert len(lines["t.tsv"]) == 5 and len(lines["t_alt.tsv"]) == 10
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == sorted(["t_raw.tsv", "t.tsv", "t_alt.tsv", cli.LOG])


def test_plans_segment_once_and_score_in_place(spark):
    found = decompose(reads(spark, "ACGT" * 9), monomers(spark, m1="AC", m2="GGT"), Options(second_best=True), keep=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert found.raw.count() and all(plan(t).count("InMemoryRelation") == 1 for t in (found.raw, found.final, found.alt))
    found.blocks.unpersist()
    found = decompose(reads(spark, "ACGT" * 9), monomers(spark, m1="AC", m2="GGT"), Options(second_best=True))
    physical = found.final._jdf.queryExecution().executedPlan().toString()
    # chunks are dealt once, their blocks once for both passes of the fold; only the runs' entries are joined
    assert physical.count("Join") == 1 and "Aggregate" not in physical
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        reused = decompose(reads(spark, "ACGT" * 9), monomers(spark, m1="AC", m2="GGT"), Options(second_best=True)).final._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in reused
    final = found.final.collect()  # a stage for each exchange that runs: the adaptive plan reuses it as well
    after = found.final._jdf.queryExecution().executedPlan().toString()
    assert final and ("ReusedExchange" in after or "ReusedExchange" in reused)


def test_chunking_costs_the_length(spark):
    """Twice the read takes about twice the time, and no chunk is lost."""
    import time

    took = []
    chunk_reads(reads(spark, "ACGT" * 1000)).count()
    for size in (8 << 20, 16 << 20, 32 << 20):
        spark.createDataFrame([(0, "r", size)], "read_ordinal long, read_name string, n long").selectExpr("read_ordinal", "read_name", "repeat('ACGT', cast(n / 4 as int)) seq").createOrReplaceTempView("long_read")
        began = time.time()
        row = chunk_reads(spark.table("long_read")).selectExpr("count(*) n", "sum(length(chunk_seq)) s", "max(chunk_offset) o").first()
        took.append(time.time() - began)
        assert row["n"] == sum(1 for o in range(0, size, 5000) if size - o >= 500) and row["o"] == (row["n"] - 1) * 5000
        assert row["s"] == sum(min(5500, size - o) for o in range(0, size, 5000) if size - o >= 500)
    assert took[1] < 3 * took[0] + 1 and took[2] < 3 * took[1] + 1 and took[2] < 15


def test_fasta_chunks_equal_chunked_records(spark, tmp_path):
    import random

    r = random.Random(9)
    (tmp_path / "in").mkdir()
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    wrapped = lambda s, w, end: end.join(s[i : i + w] for i in range(0, len(s), w)) + end
    files = [
        "".join(f">{'n' * r.randrange(1, 30)}{k} about it\n" + wrapped(text(r.randrange(0, 90)), r.choice((7, 20)), "\n") for k in range(6)),
        "\n\n>one line, and long\n" + text(400) + "\n>x\r\n" + wrapped(text(75), 9, "\r\n") + ">none\n>last\n" + text(33),
        ">" + "h" * 50 + "\n" + wrapped(text(200), 60, "\n"),
    ]
    for k, f in enumerate(files):
        (tmp_path / "in" / f"{k}.fa").write_bytes(f.encode())
    path = str(tmp_path / "in")
    whole = read_fasta(spark, path).collect()
    assert read_fasta(spark, path).count() == 11
    key = lambda df: sorted(tuple(x) for x in df.collect())
    for part, overlap in ((10, 4), (25, 40)):
        want = key(chunk_reads(as_reads(read_fasta(spark, path)), part, overlap))
        for size in (13, 10_000) if part == 10 else (41,):
            assert key(read_fasta_chunks(spark, path, part, overlap, size)) == want, (part, size)
    for size in (37, 64):
        assert key(fasta_names(spark, path, size)) == sorted((x["ordinal"], x["name"]) for x in whole)
    assert fasta_summaries(spark, path).agg(F.sum("total")).first()[0] == sum(len(x["seq"]) for x in whole)
    (tmp_path / "bad.fa").write_text("\nACGT\n>a\nA\n")
    with pytest.raises(PySparkException):
        read_fasta_chunks(spark, str(tmp_path / "bad.fa"), 10, 2, 3).collect()
    (tmp_path / "empty.fa").write_text("")
    assert read_fasta_chunks(spark, str(tmp_path / "empty.fa")).collect() == []
    write_fasta(as_reads(read_fasta(spark, path)), str(tmp_path / "back"), 11)
    assert sorted((x["name"], x["seq"]) for x in read_fasta(spark, str(tmp_path / "back")).collect()) == sorted((x["name"], x["seq"]) for x in whole)


def test_a_long_record_is_cut_by_many_tasks(spark, tmp_path):
    import time

    line = "ACGTTGCAGT" * 6 + "\n"
    (tmp_path / "long.fa").write_text(">contig one\n" + line * 700_000)  # 42 MB of bases
    began = time.time()
    chunks = read_fasta_chunks(spark, str(tmp_path / "long.fa"), split_bytes=4 << 20)
    row = chunks.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.sum(F.length("chunk_seq")).alias("s")).first()
    took = time.time() - began
    size = 42_000_000
    assert (row["n"], row["tasks"]) == (size // 5000, 11) and row["s"] == sum(min(5500, size - o) for o in range(0, size, 5000)) and took < 30


def test_one_read_is_folded_in_many_tasks(spark):
    import random

    r = random.Random(2)
    rows, at = [], 0
    for chunk in range(90):
        for block in range(r.choice((1, 1, 2, 5, 9))):
            start = max(0, at - r.choice((0, 0, 0, 3, 9, 20)))
            at = start + r.randrange(1, 12)
            rows.append((0, "r", chunk, block, "m", start, at, 1.0, f"s{len(rows)}"))
    short = [(7, "q", 0, 0, "m", 0, 9, 1.0, "a"), (7, "q", 0, 1, "m", 2, 4, 1.0, "b"), (7, "q", 0, 2, "m", 10, 12, 1.0, "c")]
    blocks = spark.createDataFrame(rows + short, segmentation.BLOCKS).repartition(5)
    kept = plain.fold([x[5:7] for x in rows])
    for run_chunks in (6, 7, 30, 256):
        got = sorted((tuple(x) for x in segmentation.drop_overlaps(blocks, run_chunks).collect()), key=lambda x: (x[0], x[2]))
        own = [x for x in got if x[0] == 0]
        assert [x[4:6] for x in own] == kept and [x[2] for x in own] == list(range(len(kept)))
        assert [x[8] for x in own] == [0, *(b for _, b in kept[:-1])]
        left = iter(rows)
        assert all(any(x[7] == y[8] and x[4:6] == y[5:7] for y in left) for x in own)  # with their own segments, in order
        assert [(x[4], x[5], x[8]) for x in got if x[0] == 7] == [(0, 9, 0), (10, 12, 9)]
    with pytest.raises(ValueError):
        segmentation.drop_overlaps(blocks, 5)


def test_tsv_is_one_file_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 7).selectExpr("3000 - id read_ordinal", "id % 3 block_idx", "concat('r', id) name", "id * id square").orderBy(F.rand(3))
    for _ in range(2):  # and replaces what is there
        tsv.write_tsv_file(rows, str(tmp_path / "out.tsv"))
    want = "".join(f"r{i}\t{i * i}\n" for i in range(2999, -1, -1))
    assert (tmp_path / "out.tsv").read_text() == want
    tsv.write_tsv_file(rows.where("false"), str(tmp_path / "none.tsv"))
    assert (tmp_path / "none.tsv").read_text() == ""
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["none.tsv", "out.tsv"]


def test_chosen_monomers_decide_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "LEAST_CELLS", 1)
    monkeypatch.setattr(segmentation, "TASK_CELLS", 5_000)
    chunks = chunk_reads(reads(spark, "ACGTTGCA" * 400, "GATTACA" * 300), 200, 20)
    monomer = lambda n, s: {"name": n, "seq": s, "dp_ordinal": 0}
    ms = [monomer("a", "ACGTTGCA"), monomer("b", "GATTACA"), monomer("c", "TTTTTTTTTTTT")]
    tasks = [segmentation.segment_chunks(chunks, ms, Scoring(), e).rdd.getNumPartitions() for e in (-1, 0)]
    assert tasks[0] >= 2 * tasks[1] > 2 and segmentation.segment_chunks(chunks, ms, Scoring(), letters=1).rdd.getNumPartitions() == 4
    own = segmentation.with_candidates(chunks, ms, 0).collect()
    assert all(r["cells"] == len(r["chunk_seq"]) * sum(len(ms[k]["seq"]) for k in r["chosen"]) for r in own)


def test_second_best_equals_a_plain_version(spark):
    """Two monomers of one name, a palindrome, lengths across 64 and 128, against loops over every pair."""
    import random
    import re

    r = random.Random(11)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    half = text(33)
    ms = [("a", text(170)), ("b", text(70)), ("a", text(131)), ("p", half + half[::-1].translate(str.maketrans("ACGT", "TGCA")))]
    read = "".join(r.choice(ms)[1] for _ in range(9))
    rows = [(0, "r0", "".join(c if r.random() > 0.08 else r.choice("ACGT") for c in read)), (1, "r1", text(300))]
    found = decompose(spark.createDataFrame(rows, READS), spark.createDataFrame([(k, *m) for k, m in enumerate(ms)], MONOMERS), Options(second_best=True))
    alt = {}
    for x in found.alt.collect():
        alt.setdefault((x["read_name"], x["block_idx"]), []).append((x["alt_idx"], x["monomer"], x["identity"], x["star"]))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pairs = [p for n, s in ms for p in ((n, s), (n + "'", rc(s)))]

    def score(a, b):
        path = plain.path(a, b)
        return path.count("=") / len(path) * 100

    compress = lambda s: re.sub(r"(.)\1+", r"\1", s)
    seqs = {n: s for _, n, s in rows}
    for x in found.final.collect():
        part = seqs[x["read_name"]][x["start"] : x["end"] + 1]
        known, homo = {}, []
        for n, s in pairs:
            known[n] = score(part, s)
            homo.append((score(compress(part), compress(s)), n))
        others = [(n, v) for n, v in known.items() if n != x["monomer"]]
        second = max(others, key=lambda p: p[1])
        homo.sort(key=lambda p: -p[0])
        got = (x["identity"], x["second_best"], x["second_best_identity"], x["homo_best"], x["homo_best_identity"], x["homo_second_best"], x["homo_second_best_identity"])
        assert got == (known[x["monomer"]], second[0], second[1], homo[0][1], homo[0][0], homo[1][1], homo[1][0])
        assert sorted(alt[x["read_name"], x["block_idx"]]) == [(k, n, v, "*" if n == x["monomer"] else "-") for k, (n, v) in enumerate(known.items())]


def test_sql_functions(spark):
    align.register(spark)
    row = spark.sql("SELECT seq_align_nw('AG', 'GA').cigar AS c, seq_infix_distance('CG', 'AACGT') AS d").first()
    assert (row["c"], row["d"]) == ("1D1=1I", 0)
    assert [tuple(r) for r in spark.sql("SELECT * FROM seq_decompose('ACGT', array('AC', 'GT'))").collect()] == [(0, 0, 1, 2), (1, 2, 3, 2)]


def test_stream_equals_batch(spark, tmp_path):
    rs, ms = reads(spark, "ACGTACGT", "GTAC", "CCCC"), monomers(spark, a="ACG", b="CC")
    rs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    decompose_stream(stream, ms, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = decompose(rs, ms).final
    key = lambda df: sorted((r["read_name"], r["block_idx"], r["monomer"], r["start"], r["identity"]) for r in df.collect())
    assert key(got) == key(want)


def _literal_raw(seq, part, overlap, names, templates):
    """(monomer, start, end) of the blocks that stay, by the plain versions."""
    blocks = []
    for o in range(0, len(seq), part):
        if len(seq) - o >= overlap or len(seq) < overlap:
            blocks += [(a + o, b + o, names[j]) for j, a, b, _ in plain.segment(seq[o : o + part + overlap], templates)]
    left = iter(blocks)
    return [next((n, a, b) for a, b, n in left if (a, b) == k) for k in plain.fold([x[:2] for x in blocks])]


def test_documents_equal_the_plain_version(spark):
    """Whole documents of the smallest table at the queries' chunks, blocks and final rows."""
    from pathlib import Path

    from strandweave import queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables")
    rows, letters = [], 0
    for x in queries.reads_of(spark, str(data)).where("length(seq) between 10 and 1500").orderBy(F.length("seq").desc(), "read_ordinal").collect():
        if letters < 9000:
            rows.append(tuple(x))
            letters += len(x["seq"])
    assert any(len(s) > 600 for *_, s in rows)  # several chunks
    strands = [(x["name"], x["seq"]) for x in both_strands(queries.monomers_of(spark, str(data))).orderBy("dp_ordinal").collect()]
    found = decompose(spark.createDataFrame(rows, READS), queries.monomers_of(spark, str(data)), queries.OPTIONS)
    got = {}
    for x in found.final.orderBy("read_ordinal", "block_idx").collect():
        got.setdefault(x["read_name"], []).append((x["monomer"], x["start"], x["end"]))
        seq, monomer = next(s for _, n, s in rows if n == x["read_name"]), dict(strands)[x["monomer"]]
        ops = plain.path(seq[x["start"] : x["end"] + 1], monomer)
        assert x["identity"] == ops.count("=") / len(ops) * 100
    for _, name, seq in rows:
        assert got.get(name, []) == _literal_raw(seq, queries.PART_SIZE, queries.OVERLAP, [n for n, _ in strands], [s for _, s in strands]), name


def test_files_at_default_chunks(spark):
    """$BENCH_READS by $BENCH_MONOMERS, where they are set: chunks and blocks tile the reads, and stretches equal the plain version."""
    import os

    paths = os.environ.get("BENCH_READS"), os.environ.get("BENCH_MONOMERS")
    if not all(paths):
        pytest.skip("no files are named")
    ms = as_monomers(read_fasta(spark, paths[1]))
    found = decompose_files(spark, paths[0], ms, Options(second_best=True), split_bytes=1 << 15)
    reads_ = {x["name"]: x["seq"] for x in read_fasta(spark, paths[0]).collect()}
    strands = both_strands(ms).orderBy("dp_ordinal").collect()
    last = {}
    for x in found.final.orderBy("read_ordinal", "block_idx").collect():
        assert x["start"] <= last.get(x["read_name"], -1) + 1 + 200 and 0 <= x["end"] < len(reads_[x["read_name"]])
        last[x["read_name"]] = x["end"]
        assert x["second_best_identity"] <= 100 and x["identity"] <= 100 and x["homo_best_identity"] >= x["homo_second_best_identity"]
    assert all(last[n] == len(s) - 1 for n, s in reads_.items())
    name, seq = next(iter(reads_.items()))
    for at in (0, 40_000 % max(1, len(seq) - 400)):
        part = seq[at : at + 400]
        got = decompose(spark.createDataFrame([(0, name, part)], READS), ms, Options()).raw.orderBy("block_idx").collect()
        assert [(x["monomer"], x["start"], x["end"]) for x in got] == _literal_raw(part, 5000, 500, [s["name"] for s in strands], [s["seq"] for s in strands])


def test_chunks_equal_the_cut_of_pieces(spark):
    lengths = [1, 2, 6, 7, 8, 14, 15, 16, 40, 41, 55, 99, 100, 101, 250]
    seqs = [("ACGTTGCAN" * 30)[:n] for n in lengths]
    rows = spark.createDataFrame([*((i, f"r{i}", s) for i, s in enumerate(seqs)), (90, "none", None), (91, "empty", "")], READS)
    for part, overlap in ((1, 0), (7, 0), (7, 1), (7, 7), (3, 8), (40, 15), (500, 100)):
        want = sorted((i, f"r{i}", k, o, c.decode()) for i, s in enumerate(seqs) for k, o, c in cut_up([(s.encode(), True)], part, overlap))
        assert sorted(map(tuple, chunk_reads(rows, part, overlap).collect())) == want


def test_distances_of_reads_keep_one_python_process_a_task(spark):
    order = both_strands(monomers(spark, a="ACGTTG", b="TTGCAA")).orderBy("dp_ordinal").collect()
    seqs = ["ACGTTGCA" * 70, "GATTACA" * 50, "N"]
    found = segmentation.monomer_distances(chunk_reads(reads(spark, *seqs), 50, 10), order)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    want = [
        (i, k, m["dp_ordinal"], min(plain.matrix(m["seq"], c.decode(), True)[-1]))
        for i, s in enumerate(seqs) for k, _, c in cut_up([(s.encode(), True)], 50, 10) for m in order
    ]
    assert sorted(map(tuple, found.collect())) == sorted(want)
