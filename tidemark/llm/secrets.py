"""Secrets are searched for once in every version of every text, and found again at all its paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, text_or_empty

MARK, STAND_IN = "\x01", "\x02"
SPANS = "array<struct<start:int,end:int>>"
#: Findings are gathered in blocks of so many, as each that is added copies its block.
BLOCK = 256

#: The patterns of the base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a match of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"  # a match of [0-9a-f]+ with 24 characters or more


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A new version makes every text be scanned for it again. Patterns must not match U+0001 or U+0002."""

    kind: str
    version: int
    pattern: str
    keep: Callable[[Column], Column] | None = None


RULES = (
    Rule("assign", 1, ASSIGN, lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6),
    Rule("access", 1, ACCESS),
    Rule("hex", 1, HEX),
)


def spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of the leftmost non-overlapping matches that the rule keeps.

    Matches are fenced with a mark and the text is split there, so that every second part is a match and
    the lengths of the parts add up to offsets. A mark that the text itself has is first
    replaced by another character that no pattern matches.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    parts = F.split(F.regexp_replace(clean, rule.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    none, no_blocks = F.array().cast(SPANS), F.array().cast(f"array<{SPANS}>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("block"), no_blocks.alias("blocks"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        kept = acc["match"] if rule.keep is None else acc["match"] & rule.keep(part)
        more = F.concat(acc["block"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))
        full = kept & (F.size(acc["block"]) >= BLOCK - 1)
        block = F.when(full, none).when(kept, more).otherwise(acc["block"])
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), block.alias("block"), F.when(full, F.concat(acc["blocks"], F.array(more))).otherwise(acc["blocks"]).alias("blocks"))

    return F.aggregate(parts, start, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["block"]))))


def _ledger(spark, ledger_dir: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger_dir)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):  # nothing has been scanned yet
        return None
    return spark.read.schema(f"blob string, kind string, version int, spans {SPANS}").parquet(f"{ledger_dir}/*")


def scan_new(docs: DataFrame, ledger_dir: str, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan each text that docs holds for each rule version that the ledger has no row of, once, and add the rows.

    Texts are named by their SHA-256. Of equal texts, one is kept before they are shuffled. The
    ledger's rows hold the findings themselves and are committed together, so a lost job leaves nothing half
    done and is simply run again.
    """
    blobs = docs.select(F.sha2(text_or_empty(text_col), 256).alias("blob"), text_or_empty(text_col).alias("body"))
    known = _ledger(docs.sparkSession, ledger_dir)
    if known is not None:
        wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        todo = blobs.select("blob").distinct().select("blob", F.inline(wanted)).join(known, ["blob", "kind", "version"], "left_anti").groupBy("blob").agg(F.collect_set("kind").alias("kinds"))
        blobs = blobs.join(todo, "blob")
    else:
        blobs = blobs.withColumn("kinds", F.array(*(F.lit(r.kind) for r in rules)))
    unseen = blobs.dropDuplicates(["blob"])
    found = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("kinds", r.kind), spans(F.col("body"), r)).alias("spans")) for r in rules))
    unseen.select("blob", F.inline(found)).filter("spans IS NOT NULL").write.parquet(fresh_run(docs, ledger_dir))


def fresh_run(docs: DataFrame, ledger_dir: str) -> str:
    return f"{ledger_dir}/run-{fresh_dir(docs.sparkSession, '').rpartition('-')[2]}"


def scan(docs: DataFrame, ledger_dir: str, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: id, blob, and found: all findings (start, turn, end, kind) in order of start, then of the rules.

    Null texts count as empty; repeated rows and texts share one scan and each get its findings; an empty
    table gives no rows. Offsets are code points, the end is exclusive. Other columns are
    not returned.
    """
    scan_new(docs, ledger_dir, text_col=text_col, rules=rules)
    turn = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))))
    rows = (
        _ledger(docs.sparkSession, ledger_dir)
        .filter(F.size("spans") > 0)
        .withColumn("turn", turn[F.concat_ws(":", "kind", "version")])
        .filter("turn IS NOT NULL")
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("turn").alias("turn"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("part"))
    )
    per_blob = rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("part")))).alias("found"))
    paths = docs.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    empty = F.array().cast("array<struct<start:int,turn:int,end:int,kind:string>>")
    return paths.join(per_blob, "blob", "left").select("id", "blob", F.coalesce("found", empty).alias("found"))
