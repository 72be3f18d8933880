"""What the corpus operators share: shared folders, intermediate tables, text rules."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as Spark's trim and Java's regexes take them.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that deletes the shuffle files of a finished query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the cluster names in spark.checkpoint.dir; only where that is unset and the session
    is local is a temporary folder made and set. On a cluster without it, this raises.
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def spool(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    It cuts the lineage at a table that outlives any executor, and what is expensive to
    compute is computed once. The shuffle files of the writing job are deleted when it ends.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    with _cleaned(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.spooled_at = path
    if blocks := Scratch.open.get():
        blocks[-1].append(found)
    return found


_writing, _lock = {}, threading.Lock()


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """While any thread writes, the session deletes the shuffle files of queries that have ended; the last one puts the setting back."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _writing.get(key, (0, None))
        if not n:
            before = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writing[key] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing lazy reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.spooled_at)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Scratch:
    """A block at whose end the tables spooled inside by its own thread are deleted, but for those that keep was called with."""

    open: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("open", default=())

    def __enter__(self) -> Scratch:
        self.kept: list[DataFrame] = []
        self.made: list[DataFrame] = []
        self.token = Scratch.open.set((*Scratch.open.get(), self.made))
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table

    def __exit__(self, kind, *_) -> None:
        Scratch.open.reset(self.token)
        kept = {t.spooled_at for t in self.kept}
        if kind is None:
            discard(*(t for t in self.made if t.spooled_at not in kept))
        if blocks := Scratch.open.get():
            blocks[-1].extend(self.kept)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and all else as it is; plain ASCII takes the fast road."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return found.select(*names) if names else found
