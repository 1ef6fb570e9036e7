"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, token ids.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; each result is written as Parquet
and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.bpe import ByteBpe
from strandweave.llm.common import bounded_batches, clash_free, discard, materialize, scope, shared_dir, small, table
from strandweave.llm.decontaminate import without_contaminated
from strandweave.llm.ngram_join import BROADCAST_IDS, near_duplicates, text_hash_of
from strandweave.llm.queries import tokenizer_path
from strandweave.llm.secret_scan import redact
from strandweave.llm.toxicity import THRESHOLD, ToxicityModel


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents of a score of 0.7 or more go."""
    with scope(spark, "toxicity"):
        model = ToxicityModel.fit(ToxicityModel.training_rows(docs, table(spark, sf_dir, "labels")))
    score = clash_free(docs, "toxicity")
    return model.score(docs, score=score).where(F.col(score) < THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class of near duplicates the row of the smallest (id, hash of the text) stays.

    Rows without an id stay. Of rows that share id and text one stays; other texts of an id are
    documents of their own.
    """
    found = materialize(near_duplicates(docs).where("doc_id is not null").select("doc_id", "text_hash", "is_first"), "classes")
    code = clash_free(docs, "text_hash")
    pair = [F.col("doc_id").alias("doc_id"), F.col("text_hash").alias(code)]
    goes = found.where("not is_first").select(*pair).distinct()
    coded = docs.withColumn(code, text_hash_of(F.col("text")))
    kept = coded.join(small(goes, BROADCAST_IDS), ["doc_id", code], "left_anti")
    repeated = materialize(found.where("is_first").select(*pair).groupBy("doc_id", code).count().where("count > 1").select("doc_id", code), "repeated")
    if repeated.limit(1).count() == 0:
        return kept.select(*docs.columns)
    repeated = small(repeated, BROADCAST_IDS)
    one = kept.join(repeated, ["doc_id", code], "left_semi").dropDuplicates(["doc_id", code])
    return kept.join(repeated, ["doc_id", code], "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that repeat a stretch of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each secret becomes a sign; ``n_chars`` counts the new text."""
    bounded_batches(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ids of every document, and digests of the ids and of the text decoded from them."""
    bounded_batches(spark)
    bpe = ByteBpe(spark, tokenizer_path("byte_bpe_50k.tiktoken"))
    coded = docs.select("doc_id", "lang", "source", "n_chars", bpe.round_trip("text").alias("coded"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
        F.col("coded.ids").alias("ids"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]

#: Learned scores, MinHash, alignment and merges have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes when its result is written, and that when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scope(spark, f"work-{name}"):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            discard(before)
        before = docs
    return docs
