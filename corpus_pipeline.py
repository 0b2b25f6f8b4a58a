"""Documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import bpe, decontaminate, language, pii, simhash
from evigraph.llm.common import few_rows, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in a learnt language stay; null texts, texts without a letter and texts strange to every learnt
    language go.  Rows are judged one by one: repeats and null ids stay."""
    few_rows(spark)  # results are lazy, so the setting stays, here and in the other stages
    return language.accept(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 (five-word shingles) the smallest doc_id stays.  Pairs come
    from the index of SimHash fingerprints, and from that of sketches where fingerprints differ in more than three bits."""
    few_rows(spark)
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, or an edited copy of one, go.

    The text decides, so rows without doc_id are judged and rows that share one are judged apart; null texts stay.
    """
    few_rows(spark)
    keyed = docs.withColumns({"__text_hash": F.xxhash64("text")})
    found = decontaminate.contaminated(keyed.select(F.col("__text_hash").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.select(F.col("doc_id").alias("__found")).distinct()
    return keyed.join(dirty, keyed["__text_hash"] == dirty["__found"], "left_anti").drop("__text_hash")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes <KIND>; every document stays, null texts stay null.  n_chars follows the new text."""
    few_rows(spark)
    out = pii.redact(docs, pii.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, beside the columns of documents without text; a null text has no tokens."""
    few_rows(spark)
    encoded = bpe.encode(docs)
    return encoded.drop("text").withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", tokens),
]

#: The language model, the alignments and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
