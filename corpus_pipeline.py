"""From raw documents to token ids: five stages, each stored before the next one reads it.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Rows are judged one by one: where a
verdict does not come with its row, it is joined back by id and text hash (null-safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.bpe import encode_decode
from fleetlens.llm.decontaminate import find_leaks
from fleetlens.llm.line_dedup import dedup_lines
from fleetlens.llm.native import keyed, stored
from fleetlens.llm.ngram_join import ngram_join
from fleetlens.llm.queries import TOKENIZER, table
from fleetlens.llm.quality_rules import judged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return judged(docs, trusted).filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document keeps its row, even if no line is left."""
    kept = dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the least id, and one row of it. Groups link five-word shingle sets of Jaccard 0.8 or more.

    Documents without words belong to no group and stay, as does a group none of whose rows has an id.
    """
    found = ngram_join(docs, width=5, percent=80)
    grouped = F.col("n_shingles") > 0
    first = found.filter(grouped & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    alone = found.filter(~grouped | F.col("component_id").isNull()).select("doc_id", "text_hash", F.lit(False).alias("grouped"))
    keep = stored(first.withColumn("grouped", F.lit(True)).unionAll(alone).distinct(), "kept-rows")
    rows, k = keyed(docs), keep.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "grouped")
    joined = rows.join(k, rows.doc_id.eqNullSafe(k.k_id) & (rows.text_hash == k.k_hash))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
    return joined.withColumn("copy", copy).filter("copy = 1 or not grouped").select("row.*")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, with or without an id; rows that share an id are judged apart."""
    leaked = find_leaks(docs, table(spark, sf_dir, "benchmark"), rows=True).select(
        F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).distinct()
    rows = keyed(docs)
    return rows.join(leaked, rows.doc_id.eqNullSafe(leaked.l_id) & (rows.text_hash == leaked.l_hash), "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document; ids are joined by commas."""
    coded = encode_decode(docs, TOKENIZER)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontaminate", leaks),
    ("bpe", tokens),
]
# Byte-pair encoding cannot be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
