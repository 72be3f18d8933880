"""The registered corpus queries: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, infill, lines, lm, mixing, passages, phrases, pii, secrets, simhash, toxicity, warc
from .common import documents, fresh_dir


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(documents(spark, sf_dir, "doc_id", "text"), words=3, radius=2)
    return grouped.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "matched", "item_words")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(spark, f"{sf_dir}/documents.parquet").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"), fresh_dir(spark, "secrets"))
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = {f"n_{r.kind}": F.size(F.filter("found", lambda s: s["kind"] == r.kind)).cast("long") for r in secrets.RULES}  # noqa: B023
    return found.select(F.col("id").alias("doc_id"), *(c.alias(n) for n, c in count.items()), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("found", lambda s: ~s["disguised"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]  # noqa: B023
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir, "doc_id", "text")).withColumnsRenamed({"doc": "doc_id", "start": "start_word", "end": "end_word", "partner": "partner_id"})


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.ranked(*phrases.collocations(documents(spark, sf_dir, "doc_id", "lang", "text")), 2000)


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = lm.train(docs.filter(~lm.held_out()))
    scored = lm.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(infill.store(documents(spark, sf_dir, "doc_id", "text")), output=False).withColumnRenamed("id", "doc_id")


QUERIES = (op1_mix_sources, op2_toxicity, op3_simhash, op4_decontaminate, op5_line_dedup, op6_exact_dedup, op7_warc, op8_secret_scan, op9_pii, op10_repeated_passages, op11_collocations, op12_lm_score, op13_fill_in_middle)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    from . import sql

    numbered = {f.__name__: getattr(sql, f.__name__.split("_")[0].upper(), None) for f in QUERIES}
    return {k: v for k, v in numbered.items() if v}
