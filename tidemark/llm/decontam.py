"""Benchmark passages in training text, found by spaced seeds and checked with substitutions allowed."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool
from .tokens import combined, hashed

#: The positions that each seed compares. In every passage of 8 to 20 words of which a
#: fifth at most are substituted, at least one of them fits (see the tests).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
#: Words of a window that is compared, and the part of them that must agree.
WINDOW, AGREE, LEAST = 20, 0.8, 8
#: The filter that all tasks get has 2^FILTER_BITS bits by the number of seeds, from the first (2 MB) to the last (32 MB), and so many probes per hash.
FILTER_BITS, PROBES = (24, 28), 4

SEGMENTS = "segment string, id {}, start long, tokens array<long>, hits array<struct<at:int,seed:long>>"


def _seeds(h: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per mask: the hash at each position of each text where the mask fits, and those positions."""
    out = []
    for k, mask in enumerate(MASKS):
        values = combined(h, mask, k + 1)
        ends = np.repeat(starts[1:], np.diff(starts))[: len(values)]
        at = np.flatnonzero(np.arange(len(values)) + mask[-1] < ends)
        out.append((values[at].view(np.int64), at))
    return out


def _probe(seed: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The filter's bit for the k-th probe of each hash."""
    return ((seed.view(np.uint64) * np.uint64(2 * k + 3)) >> np.uint64(64 - bits)).astype(np.int64)


def _set(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these bits are set."""
    return (filled[at >> 6] >> (at & 63)) & 1 == 1


def benchmark_seeds(bench: DataFrame, *, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, tokens) and (item, seed, at) of the items that have LEAST words or more."""
    kind = bench.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            items = [h[a:b].view(np.int64) for _, h, starts in hashed((t.as_py() for t in batch.column(1)), strip=True) for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], names=["item", "tokens"])

    def cut(batches):
        for batch in batches:
            for item, tokens in zip(batch.column(0), batch.column(1), strict=True):
                h = np.array(tokens.as_py(), dtype=np.int64).view(np.uint64)
                for values, at in _seeds(h, np.array([0, len(h)])):
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(at), batch.schema.field(0).type), pa.array(values), pa.array(at)], names=["item", "seed", "at"])

    items = spool(bench.select(F.col(id_col).alias("item"), F.col(text_col).cast("string")).mapInArrow(run, f"item {kind}, tokens array<long>").filter(F.size("tokens") >= LEAST).distinct(), "bench-items")
    return items, spool(items.mapInArrow(cut, f"item {kind}, seed long, at long"), "bench-seeds")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of all seeds, in words of 64 bits. It has 64 bits a seed, so that hardly any other position passes, up to a size that no benchmark exceeds."""
    low, high = FILTER_BITS
    size = min(high, max(low, (64 * seeds.count()).bit_length()))

    def run(batches):
        for batch in batches:
            bits = np.unique(np.concatenate([_probe(batch.column(0).to_numpy(zero_copy_only=False), k, size) for k in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(np.int64(1), bits & 63))], names=["word", "bits"])

    words = seeds.select("seed").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (size - 6), dtype=np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def segments_of(h: np.ndarray, starts: np.ndarray, filled: np.ndarray) -> list[tuple]:
    """(name, text, start, tokens, hits) of each stretch of a text round the positions that pass the filter."""
    found, bits = [], len(filled).bit_length() + 5
    for values, at in _seeds(h, starts):
        for k in range(PROBES):  # most positions go at the first probe
            keep = _set(filled, _probe(values, k, bits))
            values, at = values[keep], at[keep]
        found.append((values, at))
    values, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    values, at = values[order], at[order]
    text = np.searchsorted(starts, at, side="right") - 1
    cuts = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(text) > 0)) + 1
    rows = []
    for part in np.split(np.arange(len(at)), cuts) if len(at) else ():
        t = text[part[0]]
        first, last = max(starts[t], at[part[0]] - WINDOW), min(starts[t + 1], at[part[-1]] + WINDOW + 8)
        rows.append((uuid.uuid4().hex, int(t), int(first - starts[t]), h[first:last].view(np.int64), [{"at": int(a - first), "seed": int(v)} for a, v in zip(at[part], values[part], strict=True)]))
    return rows


def find_leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start, end, matched, item_words) per text and item that it holds a passage of.

    Words are blank-separated, A-Z in lower case, without punctuation at their ends. A passage leaks when,
    word laid on word, a window of WINDOW of the item's words (or the whole item, if shorter) agrees in at least AGREE of
    them; a passage that the text cuts off may lack the rest. start and end are word positions in the text that the leaking windows span, matched is the number of
    the item's words found there. Items under LEAST words are no evidence and match nothing;
    null and empty texts leak nothing; repeated items and rows count once; an empty
    table on either side gives no rows.

    Every position of every text is hashed under every mask. What passes the filter is kept with
    WINDOW words on both sides, all that a check of the windows round it needs, and joined with the
    benchmark's hashes; neither the texts nor the benchmark are sent about.
    """
    spark = docs.sparkSession
    items, seeds = benchmark_seeds(bench, id_col=item_col, text_col=item_text_col)
    known = spark.sparkContext.broadcast(seed_filter(seeds))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        filled = known.value
        for batch in batches:
            rows = [(r, first + t, *rest) for first, h, starts in hashed((t.as_py() for t in batch.column(1)), strip=True) for r, t, *rest in segments_of(h, starts, filled)]
            if rows:
                names, t, start, tokens, hits = zip(*rows, strict=True)
                struct = pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(0).take(pa.array(t)), pa.array(start), pa.array(tokens, pa.list_(pa.int64())), pa.array(hits, struct)], names=["segment", "id", "start", "tokens", "hits"])

    segments = spool(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(scan, SEGMENTS.format(kind)), "leak-segments")
    lined_up = segments.select("segment", F.inline("hits")).withColumnRenamed("at", "pos").join(seeds, "seed").select("segment", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    item_kind = items.schema["item"].dataType.simpleString()

    def verify(batches):
        for batch in batches:
            rows = []
            for doc, item, start, shift, tokens, words in zip(*(batch.column(k) for k in range(6)), strict=True):
                if found := overlap(np.array(tokens.as_py()), np.array(words.as_py()), shift.as_py()):
                    rows.append((doc.as_py(), item.as_py(), start.as_py() + found[0], start.as_py() + found[1], len(words), found[2]))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "item", "start", "end", "item_words", "places"])

    checked = lined_up.join(segments.drop("hits"), "segment").join(items.withColumnRenamed("tokens", "words"), "item").select("id", "item", "start", "shift", "tokens", "words")
    passages = checked.mapInArrow(verify, f"id {kind}, item {item_kind}, start long, end long, item_words long, places array<long>")
    spans = passages.groupBy("id", "item").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("item_words").alias("item_words"), F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    return spans.select("id", "item", "start", "end", F.size("places").cast("long").alias("matched"), "item_words")


def overlap(tokens: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, list[int]] | None:
    """Where the item, laid on the tokens from shift on, agrees in windows: start, end, and places in the item that match.

    What lies beyond the text's first or last word doesn't agree.
    """
    width = min(WINDOW, len(item))
    at = np.arange(len(item)) + shift
    there = np.flatnonzero((at >= 0) & (at < len(tokens)))
    same = np.zeros(len(item), bool)
    same[there] = tokens[at[there]] == item[there]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= AGREE * width - 1e-9)
    if not len(good):
        return None
    inside = np.zeros(len(item), bool)
    for k in good:
        inside[k : k + width] = True
    places = np.flatnonzero(inside & same)
    return int(shift + places[0]), int(shift + places[-1] + 1), places.tolist()
