"""One query opN_<name> for each operator, its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, scope, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_regions

    return find_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, ToxicityModel

    docs = table(spark, sf_dir, "documents")
    with scope(spark, "toxicity"):
        model = ToxicityModel.fit(ToxicityModel.training_rows(docs, table(spark, sf_dir, "labels")))
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import ByteBpe

    bpe = ByteBpe(spark, tokenizer_path("byte_bpe_50k.tiktoken"))
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text").alias("coded"))
    return coded.select("doc_id", "coded.ids", "coded.decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_archives

    path, index = archive(table(spark, sf_dir, "pages"))
    return read_archives(index, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import encode_to_records, read_records

    path, index = encode_to_records(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read_records(index, path).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, scan_documents
    from .spans import counted, joined

    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_documents
    from .spans import counted, joined

    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
     p AS (SELECT q.vec_id AS query_id, r.vec_id,
                  CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
           FROM c q JOIN c r ON q.vec_id % 20 = 0),
     t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM t WHERE rank <= 10
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "n_links", "n_text_links")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import count_words, variant_groups

    return variant_groups(count_words(table(spark, sf_dir, "documents")))


#: Checksums of strings (``id``, ``bytes``: hexadecimal digits) as a relation (id, crc).
CRC_SQL = """
    crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
    {name} AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(bytes, '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                  lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM ({rows}), crc_table)"""

#: Near words share a word with one letter out, or one is the other with one letter out.
OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
     FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
    keyed AS (SELECT row_number() OVER () AS id, *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs WHERE length(run) >= 6),
    {CRC_SQL.format(name="crcs", rows="SELECT id, bytes FROM keyed")},
    results AS (SELECT CASE WHEN crc % 199 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, c FROM keyed JOIN crcs USING (id)),
    words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    outs AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)),
    pairs AS (SELECT DISTINCT * FROM (
        SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM outs a JOIN outs b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
        UNION ALL SELECT a.word, a.n, b.word, b.n FROM outs a JOIN words b ON a.rest = b.word
        UNION ALL SELECT b.word, b.n, a.word, a.n FROM outs a JOIN words b ON a.rest = b.word)),
    nears AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN nears USING (word)),
    chain AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM forms
              UNION ALL SELECT c.word, coalesce(f.form, c.root), f.form IS NULL FROM chain c JOIN forms f ON f.word = c.root WHERE NOT c.ended)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE ended
"""


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


#: A key jumps from shard count to shard count while the next one is not beyond 8, then 9; products wrap at 64 bits.
OP12_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS bytes, CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS HUGEINT) AS key FROM documents),
    {CRC_SQL.format(name="crcs", rows="SELECT id, bytes FROM docs")},
    jumps AS (SELECT id, key, CAST(-1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS ahead FROM docs
              UNION ALL SELECT id, k, ahead, CAST(trunc((ahead + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT)
              FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE ahead < 9)),
    placed AS (SELECT id, max(CASE WHEN place < 8 THEN place END) AS shard, max(CASE WHEN place < 9 THEN place END) AS grown FROM jumps GROUP BY id),
    rows AS (SELECT doc_id, length(bytes) // 2 + 1 AS size, crc AS text_crc32, CAST(shard AS INTEGER) AS shard, CAST(grown AS INTEGER) AS grown_shard FROM docs JOIN placed USING (id) JOIN crcs USING (id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM rows
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    docs, name = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = docs.select("doc_id", f"{name}.*")
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
     h AS (SELECT *, len(tokens) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(hash, 8 * k + 1, 8) AS BIGINT)) AS h FROM d),
     f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
     p AS (SELECT *, array_to_string(tokens[1 : a], '') AS prefix, array_to_string(tokens[a + 1 : b], '') AS middle, array_to_string(tokens[b + 1 :], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_token_records": op5_token_records,
    "op6_lm_score": op6_lm_score,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_hamming_top_k": op9_hamming_top_k,
    "op10_ngram_join": op10_ngram_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_jump_shards": op12_jump_shards,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op9_hamming_top_k": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_jump_shards": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
