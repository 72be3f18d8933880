"""Lines that many documents share are dropped everywhere but in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower


def line_key(line: Column) -> Column:
    """A line as it is compared: blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _digest(key: Column) -> list[Column]:
    """128 bits of a key: two XXH64 of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, id) of each long line of each document, and (h1, h2, n_docs, keeper) of those in min_docs documents or more.

    The first grouping is by line and document, so a line that a third of all documents hold
    is spread over all tasks; the second adds up partial counts before it shuffles.
    """
    line = F.col("line")
    held = (
        docs.select(F.col(id_col).alias("id"), F.explode(_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line"))
        .filter(F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars)
        .select("id", *_digest(line_key(line)))
        .distinct()
    )
    common = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    return held, common


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the kept text in text_col, and n_lines, n_dropped (columns of these names are replaced).

    A text is split at \\n; a null or empty text is one empty line. A line whose key has at
    least min_chars code points and stands in at least min_docs documents goes, with all its
    repeats, from every document but the one with the largest id. Rows with a null id count
    as one document, smaller than all others; rows of one id count as one document too.
    Order, number and other columns of the rows stay, and a text that loses every line
    becomes empty. Only the ids and digests of lines are shuffled for the counts; each text
    is shuffled once, with the set of lines it loses.
    """
    held, common = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    lost = (
        held.join(common.select("h1", "h2", "keeper"), ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_list(F.struct("h1", "h2")).alias("__lost"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))

    def stays(line: Column) -> Column:
        return (F.length(F.btrim(line, F.lit(BLANKS))) < min_chars) | ~F.array_contains(F.col("__lost"), F.struct(*_digest(line_key(line))))

    joined = docs.join(lost, docs[id_col].eqNullSafe(lost["__id"]), "left")
    kept = F.when(F.col("__lost").isNull(), _lines(text)).otherwise(F.filter(_lines(text), stays))
    return (
        joined.withColumn("__n", F.size(_lines(text)))
        .withColumn("__kept", kept)
        .withColumns({text_col: F.array_join("__kept", "\n"), "n_lines": F.col("__n").cast("long"), "n_dropped": (F.col("__n") - F.size("__kept")).cast("long")})
        .drop("__id", "__lost", "__n", "__kept")
    )
