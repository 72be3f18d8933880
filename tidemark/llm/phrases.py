"""Phrases whose words keep company, found by Rabin-Karp fingerprints of every n-gram."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, is_empty, spool
from .ngrams import WORD_BASE_2, Block, blocks, fingerprints, identify, mask
from .tokens import mixed

#: Between words; also between pieces, over which no phrase reaches.
BLANKS, BREAKS = mask(b" \t"), mask(b".,;:!?\n\x0b\f\r")
#: Words of the longest phrase.
LONGEST = 4
#: Fingerprints that are gathered before they are counted.
GATHERED = 1 << 21
#: Bits of a filter per entry, and bits of the largest filter (16 MiB).
BITS_EACH, MOST_BITS = 32, 1 << 27


class Filter:
    """Two bits per entry, from either end of the fingerprint: no frequent one is missed, and what passes by chance falls out when it is counted.

    Its size follows the number of entries up to a fixed bound; beyond that more passes, and results stay the same.
    """

    def __init__(self, frequent: DataFrame):
        entries = frequent.count()
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (max(1, entries) * BITS_EACH - 1).bit_length())).bit_length() - 1
        place = F.explode(F.array(F.shiftrightunsigned("fp", 64 - self.bits), F.col("fp").bitwiseAND(F.lit((1 << self.bits) - 1).cast("long"))))
        words = frequent.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        found = np.zeros(1 << (self.bits - 6), np.int64)
        found[words.column("word").to_numpy()] = words.column("set").to_numpy()
        self.shared = frequent.sparkSession.sparkContext.broadcast(found.view(np.uint8))

    def has(self, fps: np.ndarray) -> np.ndarray:
        held, found = self.shared.value, np.ones(len(fps), np.uint8)
        for place in (fps >> np.uint64(64 - self.bits), fps & np.uint64((1 << self.bits) - 1)):
            found &= held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)
        return found & np.uint8(1) == 1


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x or "und") for x in langs], np.uint64)


def _grams(block: Block, salts: np.ndarray, n: int) -> np.ndarray:
    """The language's fingerprint of the n words from each position."""
    fps = fingerprints(block.hashes, n)
    return mixed(fps ^ salts[block.rows[: len(fps)]])


def _whole(block: Block, n: int) -> np.ndarray:
    """Where n words from a position stand in one piece, and the last of them is new in this block."""
    m = max(0, len(block.pieces) - n + 1)
    return (block.pieces[:m] == block.pieces[n - 1 : n - 1 + m]) & (np.arange(m) >= block.carried - n + 1)


def _mark(block: Block) -> np.uint64:
    """What a block is told by: its words, so that a later pass knows it again."""
    return np.bitwise_xor.reduce(mixed(block.hashes + np.arange(len(block.hashes), dtype=np.uint64))) if len(block.hashes) else np.uint64(0)


def counts(docs: DataFrame, sizes: tuple[int, ...], parts: Filter | None, part: int) -> DataFrame:
    """(fp, n, at, check) of the phrases of docs(id, lang, text) with these numbers of words, all of whose parts of `part` words pass the filter.

    at points to the block of an occurrence; check is half of a second hash. Occurrences whose second hash differs from that of the first have rows of their own.
    """

    def run(batches):
        gathered, held = [], 0

        def told():
            fps, checks, marks = (np.concatenate(x) for x in zip(*((f, c, np.full(len(f), m)) for f, c, m in gathered), strict=True))
            found, first, number, n = np.unique(fps, return_index=True, return_inverse=True, return_counts=True)
            other = np.flatnonzero(checks != checks[first][number])
            if len(other):
                n = n - np.bincount(number[other], minlength=len(n))
            rows = np.concatenate([first, other])
            return pa.RecordBatch.from_arrays([pa.array(fps[rows].view(np.int64)), pa.array(np.concatenate([n, np.ones(len(other), np.int64)])), pa.array(marks[rows].view(np.int64)), pa.array(checks[rows])], names=["fp", "n", "at", "check"])

        for batch in batches:
            salts = _salts(batch.column(1).to_pylist())
            for block in blocks(batch.column(2), BLANKS, BREAKS, checked=True):
                passed = parts.has(_grams(block, salts, part)) if parts else None
                mark = _mark(block)
                for n in sizes:
                    whole = _whole(block, n)
                    for k in range(n - part + 1) if parts else ():
                        whole &= passed[k : k + len(whole)]
                    checks = (fingerprints(block.checks, n, WORD_BASE_2) ^ salts[block.rows[: len(whole)]]) >> np.uint64(33)
                    gathered.append((_grams(block, salts, n)[whole], checks[whole].astype(np.int32), mark))
                    held += len(gathered[-1][0])
                if held >= GATHERED:
                    yield told()
                    gathered, held = [], 0
        if held:
            yield told()

    return docs.mapInArrow(run, "fp long, n long, at long, check int")


def pointed(docs: DataFrame, frequent: Filter, owners: Filter) -> DataFrame:
    """(fp, lang, phrase, id) of the phrases that the occurrences in owners point to, cut from the text where they stand.

    A row without fp tells the number of all words per language, as n. Rows of what passes a filter by chance are to be dropped.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, langs = batch.column(0), [x if x is not None else "und" for x in batch.column(1).to_pylist()]
            salts, words = _salts(batch.column(1).to_pylist()), np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch.column(2), BLANKS, BREAKS):
                words += np.bincount(block.rows[block.carried :], minlength=batch.num_rows)
                mark, passed = _mark(block), np.ones(len(block.hashes) + 1, bool)
                found: list[tuple[int, int, int]] = []
                for n in range(1, LONGEST + 1):
                    fps, at, passed = _passing(block, salts, n, passed, frequent)
                    own = at[owners.has(fps[at] ^ mark)]
                    _, first = np.unique(fps[own], return_index=True)
                    found += [(n, p, f) for p, f in zip(own[first].tolist(), fps[own[first]].view(np.int64).tolist(), strict=True)]
                text = [b" ".join([block.word(p + k) for k in range(n)]).decode() for n, p, _ in found]
                rows = block.rows[[p for _, p, _ in found]].tolist() if found else []
                yield pa.RecordBatch.from_arrays([pa.array([f for _, _, f in found], pa.int64()), pa.array([langs[r] for r in rows], pa.string()), pa.array(text, pa.string()), ids.take(pa.array(rows, pa.int64())), pa.nulls(len(found), pa.int64())], names=["fp", "lang", "phrase", "id", "n"])
            total = defaultdict(int)
            for lang, c in zip(langs, words.tolist(), strict=True):
                total[lang] += c
            yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.nulls(len(total), ids.type), pa.array(list(total.values()), pa.int64())], names=["fp", "lang", "phrase", "id", "n"])

    return docs.mapInArrow(run, f"fp long, lang string, phrase string, id {kind}, n long")


def _passing(block: Block, salts: np.ndarray, n: int, passed: np.ndarray, filtered: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of n words, the places that are new in this block and pass, all that pass); passed are those of n - 1 words, as a longer phrase's parts are as frequent."""
    fps = _grams(block, salts, n)
    m = len(fps)
    at = np.flatnonzero((block.pieces[:m] == block.pieces[n - 1 : n - 1 + m]) & passed[:m] & passed[1 : m + 1])
    at = at[filtered.has(fps[at])]
    passed = np.zeros(len(block.hashes) + 1, bool)
    passed[at] = True
    return fps, at[at >= block.carried - n + 1], passed


def _found(block: Block, salts: np.ndarray, langs: list[str], filtered: Filter) -> dict[tuple[str, bytes], list]:
    """(lang, phrase) -> [occurrences, row of the first, fingerprint] of a block, for phrases that pass the filter.

    Occurrences of a fingerprint are held against the words of the first; those that differ are phrases of their own.
    """
    found: dict[tuple[str, bytes], list] = {}
    firsts, numbers = identify(block)
    names = [block.word(k) for k in firsts.tolist()]
    codes = {x: k for k, x in enumerate(dict.fromkeys(langs))}
    row_lang = np.array([codes[x] for x in langs], np.int64)[block.rows]
    for n in range(1, LONGEST + 1):
        fps, at, _ = _passing(block, salts, n, np.ones(len(block.hashes) + 1, bool), filtered)
        _, first, number, times = np.unique(fps[at], return_index=True, return_inverse=True, return_counts=True)
        rep = at[first][number]
        same = row_lang[at] == row_lang[rep]
        for k in range(n):
            same &= numbers[at + k] == numbers[rep + k]
        if not same.all():
            times = np.bincount(number[same], minlength=len(first))
        for p, c, row, f in zip(at[first].tolist(), times.tolist(), block.rows[at[first]].tolist(), fps[at[first]].view(np.int64).tolist(), strict=True):
            found[langs[row], b" ".join([names[numbers[p + k]] for k in range(n)])] = [c, row, f]
        for p in at[~same].tolist():
            entry = found.setdefault((langs[block.rows[p]], b" ".join(names[numbers[p + k]] for k in range(n))), [0, int(block.rows[p]), int(fps[p : p + 1].view(np.int64)[0])])
            entry[0] += 1
    return found


def recounted(docs: DataFrame, filtered: Filter) -> DataFrame:
    """(fp, lang, phrase, id, n) of the phrases of docs(id, lang, text) that pass the filter, counted by their words per block. Rows of one phrase are still to be added up."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, langs = batch.column(0), [x if x is not None else "und" for x in batch.column(1).to_pylist()]
            salts = _salts(batch.column(1).to_pylist())
            for block in blocks(batch.column(2), BLANKS, BREAKS):
                found = _found(block, salts, langs, filtered)
                values = list(found.values())
                columns = [pa.array([v[2] for v in values], pa.int64()), pa.array([k[0] for k in found], pa.string()), pa.array([k[1].decode() for k in found], pa.string()), ids.take(pa.array([v[1] for v in values], pa.int64())), pa.array([v[0] for v in values], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "lang", "phrase", "id", "n"])

    return docs.mapInArrow(run, f"fp long, lang string, phrase string, id {kind}, n long")


def exact_counts(docs: DataFrame, frequent: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n, id) of the phrases behind frequent(fp, n, at, same) with at least `least` occurrences, (lang, n) of all words).

    One pass cuts each phrase from the text that its pointer leads to. A fingerprint whose second hashes differ belongs to several phrases; it, and
    one whose block wasn't found again because the rows came in another order, is counted anew by the words themselves.
    """
    texts = spool(pointed(docs, Filter(frequent.select("fp")), Filter(frequent.select(F.col("fp").bitwiseXOR(F.col("at")).alias("fp")))), "phrases-texts")
    words = texts.filter("fp IS NULL").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")
    cut = texts.filter("fp IS NOT NULL").groupBy("fp").agg(F.min_by(F.struct("lang", "phrase", "id"), F.struct("lang", "phrase")).alias("p"), F.min("phrase").alias("x"), F.max("phrase").alias("y"))
    known = spool(frequent.join(cut, "fp", "left").select("fp", frequent["n"], "p.lang", "p.phrase", "p.id", (F.col("same") & F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("plain")), "phrases-known")
    out = known.filter("plain").select("lang", "phrase", "n", "id")
    doubtful = known.filter("NOT plain").select("fp")
    if not is_empty(doubtful):
        again = recounted(docs, Filter(doubtful)).join(doubtful, "fp", "left_semi").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
        out = out.unionByName(again.filter(F.col("n") >= least))
    return out, words


def collocations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 30, inside: int = 80, scale: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to 4 words that stand at least `least` times in a language, scored by their weakest cut, and the words per language.

    The first frame is (lang, phrase, a, l, r, score, id): a counts the phrase, l and r the two parts of the cut with
    the lowest score floor(scale * a / (l + r)), id is a document that holds it. Phrases inside a longer one that has `inside`
    percent of their occurrences are left out. The second is (lang, n).

    A phrase is frequent only if its parts are. So words, then pairs, then what has three and four words are
    counted by fingerprints, each level only where the one before allows; a task adds up its own first, and keeps a pointer to one occurrence. What is frequent is then
    cut from the text that its pointer leads to; where a second hash tells that a fingerprint has several phrases, they are counted by their words.

    A-Z are taken in lower case; `[.,;:!?\\x0A-\\x0D]` end a piece, blanks and tabs part words. A null language is und, null
    texts are empty, null ids are kept as ids; repeated rows count each. An empty table gives empty frames. Very long texts are read in blocks.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    with Scratch() as scratch:
        whole = lambda df: df.groupBy("fp").agg(F.sum("n").alias("n"), F.min("at").alias("at"), (F.min("check") == F.max("check")).alias("same"))
        level = lambda what, *how: spool(whole(counts(docs, *how)).filter(F.col("n") >= least), what)
        ones = level("phrases-1", (1,), None, 1)
        pairs = level("phrases-2", (2,), Filter(ones.select("fp")), 1)
        longer = level("phrases-3", tuple(range(3, LONGEST + 1)), Filter(pairs.select("fp")), 2)
        exact, words = exact_counts(docs, ones.unionByName(pairs).unionByName(longer), least)
        exact, words = scratch.keep(spool(exact, "phrases")), scratch.keep(spool(words, "phrases-words"))
    known = exact.select("lang", "phrase", F.col("n").alias("a"), "id", F.split("phrase", " ").alias("words"))
    candidates = known.filter(F.size("words") > 1)
    joined = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select("lang", "phrase", "a", "id", "k", joined(1, F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("words")).alias("tail"))
    weighed = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = weighed.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "id")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score", "cut.id")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda s: F.array_join(F.slice("words", s, n), " "))))
    within = candidates.filter(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(within, ["lang", "phrase"], "left").filter(f"longer IS NULL OR cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {inside}").drop("longer")
    return kept, words


def ranked(kept: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """Each language's first phrases with their rank from 1, by score and count descending, then by the phrase's bytes, with n words in all."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= most).join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
