"""The corpus pipeline: toxic texts, repeated lines, near duplicates and benchmark leaks go, and the rest is mixed.

In every stage each row is judged by itself, also rows without an id; repeated rows are rows of their own until the
near-duplicate stage keeps one of them; columns other than doc_id, text, source and n_chars are carried along; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, mixing, simhash, toxicity
from tidemark.llm.common import spool


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half go. The labels of labelled documents outside the held-out fold train the model.

    Null and empty texts have no windows and get the score of such texts. Without labels of both kinds nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text. No row goes: null texts and those that lose all lines become empty.

    Columns named n_lines or n_dropped are the documents' own and are carried along.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = lines.drop_repeated_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()})
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays; null ids come last. Null and empty texts are one group; of repeated rows one stays."""
    return simhash.one_of_each(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. They are told by id and content, so that rows without an id are judged each. Null and empty texts stay."""
    keyed = docs.withColumn("__key", F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256))
    leaks = decontam.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key").select(F.col("id").alias("__key")).distinct()
    return keyed.join(leaks, "__key", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix to target weights takes, with how often (copies, which replaces a column of that name). Texts without words are never taken; a null source is a source."""
    return mixing.take(docs).select(*(c for c in docs.columns if c != "copies"), "copies")


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("mixing", mix)]

#: A trained score and near duplicates can't be had in SQL; tests/llm compares each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
