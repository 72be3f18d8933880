"""Sources are mixed to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, spool

#: Rows that one task sorts at once, about.
RUN = 4096


def words(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources(source, source_size) with weight and target.

    Sources by code point, null last, take the weights in turn. Together they are to give as many
    words as there are; none gives more than most times its size, and what it can't give goes
    to the others by weight. Filling up in the order of most * size / weight finds that level
    in one pass: a source is full if the level reached without those before it is above its own.
    """
    ordered, filling = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fill", "turn")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    turn = F.row_number().over(ordered)
    whole = W.partitionBy()
    cap = F.lit(most) * F.col("source_size")
    return (
        sources.withColumn("turn", turn)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("fill", cap.cast("double") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("among", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.col("among"))
        .withColumn("open", F.col("fill") > F.col("level"))
        .withColumn("common", F.min(F.when(F.col("open"), F.struct("fill", "turn", "level"))).over(whole)["level"])
        .withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("common")).otherwise(cap.cast("double")))
        .select("source", "turn", "source_size", "weight", "target")
    )


def shuffle_key(id_col: str, text_col: str, seed: int) -> Column:
    """60 bits that depend on seed, id and text alone, so that rows without an id are spread too."""
    named = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """Per row of docs: id, content (64-bit digest of its text), size, source, source_size, target, copies, taken.

    Each source's documents stand in an order drawn from seed, id and text, up to most times over. A copy's
    virtual start and finish are its source's words before and after it, divided by the
    source's target; it is eligible if it starts before 1, when the source's share is used
    up. Eligible copies of all sources are sorted by finish and taken while their words
    fit into the budget, which is the number of words of docs. So a source is less than one
    document away from its target, but for those cut at the very end.

    Null and blank texts have size 0 and take no words; null ids and sources are values like any
    other; repeated rows are rows of their own. Both running sums, within a source and over the
    global order, are taken per range of the order and then over the ranges' totals, so neither a large
    source nor the global sort comes into one task. Only ids and sizes are shuffled.
    """
    size = words(F.col(text_col))
    rows = spool(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), shuffle_key(id_col, text_col, seed).alias("key"), F.xxhash64(text_col).alias("content")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    named = spool(source_targets(totals.select("source", "source_size"), weights=weights, most=most).join(totals.select(F.col("source").alias("named"), "rows"), F.col("source").eqNullSafe(F.col("named"))).drop("named"), "mix-sources")
    n_rows, budget = named.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()

    # words before each row in its source: within a range of the order, then over the ranges
    ranges = F.shiftright(F.shiftright("key", 28) * (1 + F.floor(F.col("rows") / RUN)), 32)  # of 32 bits of the key, so that the product fits
    dealt = rows.withColumnRenamed("source", "of").join(named.drop("weight"), F.col("of").eqNullSafe(F.col("source"))).drop("of").withColumn("range", ranges)
    at = W.partitionBy("turn", "range").orderBy("key", "id", "size", "content")
    dealt = dealt.withColumns({"place": F.row_number().over(at), "upto": F.sum("size").over(at.rowsBetween(W.unboundedPreceding, 0))})
    earlier = W.partitionBy("turn").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.withColumnRenamed("source", "of").join(named.select("source", "turn", "rows"), F.col("of").eqNullSafe(F.col("source"))).groupBy("turn", ranges.alias("range")).agg(F.sum("size").alias("words")).select("turn", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    placed = spool(dealt.join(offsets, ["turn", "range"]).withColumn("upto", F.col("upto") + F.col("offset")).drop("offset", "rows"), "mix-placed")

    # the global order of the copies, by ranges of virtual finish time
    bins = 1 + n_rows // RUN
    copies = (
        placed.filter("size > 0")
        .select("turn", "range", "place", "key", "size", "target", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * F.col("source_size") + F.col("upto"))).alias("upto"))
        .filter(F.col("upto") - F.col("size") < F.col("target"))
        .withColumn("finish", F.col("upto") / F.col("target"))
        .withColumn("bin", F.least(F.lit(bins), F.floor(F.col("finish") * bins)))
    )
    order = W.partitionBy("bin").orderBy("finish", "turn", "upto")
    bin_offsets = copies.groupBy("bin").agg(F.sum("size").alias("words")).select("bin", F.coalesce(F.sum("words").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    taken = (
        copies.withColumn("running", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .join(bin_offsets, "bin")
        .filter(F.col("running") + F.col("offset") <= budget)
        .groupBy("turn", "range", "place")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    copies = F.coalesce(F.col("copies"), F.lit(0))
    return placed.join(taken, ["turn", "range", "place"], "left").select("id", "content", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the mix takes, with how often in copies (a column of this name is replaced)."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, **options).filter("copies > 0")
    same = ["__id", "__content", "__nth"]
    nth = F.row_number().over(W.partitionBy(*same[:2]).orderBy("__content"))
    chosen = mixed.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("__id"), F.col("content").alias("__content"), F.col("copies").alias("__copies")).withColumn("__nth", nth)
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "__content": F.xxhash64(text_col)}).withColumn("__nth", nth)
    return rows.join(chosen, same).withColumn("copies", F.col("__copies")).drop(*same, "__copies")
