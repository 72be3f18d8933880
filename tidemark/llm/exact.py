"""Exact deduplication as a stateful stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, is_empty, spool

#: Settings of the stream: state on disk, and a store closed once its part of a batch is committed, so
#: that the open stores of many partitions don't fill the disks at once.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Digests of hits that are broadcast at most, 64 bytes each.
BROADCAST = 200_000


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(raw: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """id, text, digest and locator (file and row in it) of each row."""
    return (
        raw.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))
        .withColumn("digest", digest(F.col("body")))
    )


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream reads a plain path only if it is a folder."""
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def update_state(spark: SparkSession, path: str, state_dir: str, *, id_col: str = "doc_id", text_col: str = "text", digest=_sha256) -> DataFrame:
    """Run the stream over what is new under path, and return (digest, n, first.id, first.locator).

    The state is keyed by digest, held on disk by RocksDB, and never expires. It keeps the
    number of rows, the smallest id and that row's locator. Each micro-batch writes the keys
    it changed; a batch that is run again after a failure overwrites its own folder, and as n only
    grows and the id only falls, the latest state is their maximum and minimum. Call it again
    with the same state_dir to take in files that came since.
    """
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    keyed = _rows(spark.readStream.schema(schema).parquet(_as_glob(path)), id_col, text_col, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{state_dir}/changes/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(f"digest string, n long, first {keyed.schema['first'].dataType.simpleString()}").parquet(f"{state_dir}/changes").groupBy("digest").agg(F.max("n").alias("n"), F.min("first").alias("first"))


def exact_dedup(spark: SparkSession, path: str, *, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest=_sha256) -> DataFrame:
    """One row per row of the Parquet table at path: id, keep_id, group_size, kept, digest, locator.

    Texts are equal when their normalised bytes are. The row with the smallest id stays
    (null ids come last); of rows with one id and text, exactly one stays, the first by locator.
    Every hit that the state reports (a digest of two rows or more) is checked on its full bytes: the texts of these
    rows alone are grouped by digest and content, and where one digest has several contents its rows are grouped by
    content instead. The digests of the hits are broadcast up to BROADCAST of them, else joined. An empty
    table gives no rows. Other columns are neither read nor returned.
    """
    state = spool(update_state(spark, path, state_dir or fresh_dir(spark, "exact"), id_col=id_col, text_col=text_col, digest=digest), "exact-state")
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    by_state = (
        rows.select("id", "digest", "locator")
        .join(state, "digest")
        .select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), "digest", "locator")
    )
    hits = state.filter("n > 1").select("digest")
    held = rows.join(F.broadcast(hits) if hits.count() <= BROADCAST else hits, "digest", "left_semi")
    contents = held.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    mixed = spool(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest"), "exact-mixed")
    if is_empty(mixed):
        return by_state
    again = held.join(mixed, "digest", "left_semi")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    groups = again.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    split = again.join(groups, ["digest", "body"]).select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), "digest", "locator")
    return by_state.join(mixed, "digest", "left_anti").select(split.columns).unionByName(split)
