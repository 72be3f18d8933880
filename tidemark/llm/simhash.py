"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, is_empty, spool
from .components import components, rooted, stars
from .tokens import combined, hash_words, mixed
from .tokens import words as text_words

BITS = 64
#: XXH64 seed of the shingle hashes.
SEED = 42
#: Distinct fingerprints of a bucket that are compared pair by pair.
PAIRWISE = 24


def fingerprint(text: str | None, words: int) -> int:
    """A bit is set where over half of the shingle hashes have it; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    counts, n = np.zeros(BITS, np.int64), 0
    block: list[int] = []
    for s in shingles:
        block.append(xxhash.xxh64_intdigest(s, SEED))
        if len(block) == 1 << 16:
            counts, n, block = counts + _bit_counts(block), n + len(block), []
    counts, n = counts + _bit_counts(block), n + len(block)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) per row of docs. fp is the signed 64-bit fingerprint. A task holds one batch of texts."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


@functools.cache
def covering_masks(radius: int, level: int = 0) -> tuple[int, ...]:
    """2^(radius+1) - 1 bit masks such that for any radius bits, some mask has none of them.

    Bit i gets a non-zero vector phi(i) of radius+1 bits; mask v holds the bits with an odd inner product
    of phi(i) and v. radius vectors leave some v orthogonal to them all, whatever phi is, so of
    a few drawn ones that is taken whose smallest mask is largest. Levels have different phi.
    """
    n = (1 << (radius + 1)) - 1

    def draw(seed: int) -> tuple[int, ...]:
        rng = random.Random(1000 * level + seed)
        phi = (rng.sample(range(1, n + 1), n) * BITS)[:BITS] if n < BITS else rng.sample(range(1, n + 1), BITS)
        return tuple(sum((p & v).bit_count() % 2 << i for i, p in enumerate(phi)) for v in range(1, n + 1))

    return max((draw(seed) for seed in range(40)), key=lambda masks: min(m.bit_count() for m in masks))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that join all fingerprints fps(fp, comp), distinct, within radius bits and of different comp, directly or over others.

    Each fingerprint enters one bucket per covering mask. Buckets that hold one comp alone need no
    link; small ones are compared pair by pair. In a larger one pairs would grow with the square. At radius 2 its
    fingerprints are then entered under all fingerprints one bit away: two within 2 bits meet
    under some centre, and all that meet there, 65 at most, are within 2 bits of each other, so each is linked to the
    smallest. At another radius the bucket is dealt again by other masks, which also cover every
    pair; after three levels hardly a bit is free, so the last buckets are small by themselves.
    """
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, now = [], fps.select("fp", F.lit(0).cast("long").alias("key"))
    for level in range(1 if radius == 2 else 3):
        masked = F.array(*(F.xxhash64("key", F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for t, m in enumerate(covering_masks(radius, level))))
        tables = now.repartition(spread, "fp").select("fp", F.explode(masked).alias("key"))
        met = spool(tables.join(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"), "simhash-met").join(fps.select("fp", "comp"), "fp")
        mixed = met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        shared = spool(met.join(mixed, "key"), "simhash-buckets")
        small, last = PAIRWISE if radius == 2 else 16 * PAIRWISE, level == 2
        found.append(_pairs(shared if last else shared.filter(F.col("n") <= small), radius, once=level == 0))
        now = shared.filter(F.col("n") > small).select("fp", "key")
        if last or is_empty(now):
            break
    else:
        found.append(_by_centres(now.select("fp").distinct()))
    return functools.reduce(DataFrame.unionByName, found).distinct()


def _pairs(buckets: DataFrame, radius: int, once: bool) -> DataFrame:
    """Pairs of each bucket within the radius; with once only in the bucket of the first mask that the two agree under."""
    a, b = buckets.alias("a"), buckets.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.comp") != F.col("b.comp")) & (_distance(F.col("a.fp"), F.col("b.fp")) <= radius)
    if once:
        masks = F.array(*(F.lit(_signed(m)).cast("long") for m in covering_masks(radius)))
        apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        first = F.array_position(F.transform(masks, lambda m: apart.bitwiseAND(m) == 0), True).cast("int")
        near &= F.col("a.key") == F.xxhash64(F.lit(0).cast("long"), first - 1, F.col("a.fp").bitwiseAND(F.try_element_at(masks, F.greatest(first, F.lit(1)))))
    return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _by_centres(fps: DataFrame) -> DataFrame:
    flips = [0, *(1 << i for i in range(BITS))]
    near = fps.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(f)).cast("long")) for f in flips))).alias("centre"))
    least = near.groupBy("centre").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).filter("u <> top").select("centre", "u")
    return near.join(least, "centre").filter("fp <> u").select("u", F.col("fp").alias("v"))


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) per row of docs: the smallest id that links of at most radius bits reach.

    Texts are compared by their blank-separated words with A-Z in lower case; fewer words than a
    shingle has are one shingle, and texts without words (null and empty ones too) share the fingerprint
    0. Null ids belong to groups, but are a group's id only if all its ids are null; repeated rows
    are in one group. An empty table gives no rows. Copies share a fingerprint and are one node;
    only fingerprints that have a link enter the search for components.
    """
    kept = spool(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash-fps")
    nodes = spool(kept.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    edges = spool(links(nodes.select("fp", F.col("fp").alias("comp")), radius), "simhash-links")
    if is_empty(edges):
        reached = nodes.select("fp", F.col("least").alias("component_id"))
    else:
        member = spool(components(edges), "simhash-components")
        known = nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        tops = known.groupBy("root").agg(F.min("least").alias("component_id"))
        reached = known.join(tops, "root").select("fp", "component_id")
    return kept.join(reached, "fp").select("id", "fp", "component_id")


#: Shingles of a sketch: a text with no more has its exact set there.
SKETCH = 128


#: Bands of the shingle sets and min-hashes of each: two sets at 0.8 share a band with a probability of 99.98 %.
BANDS, ROWS = 16, 4


def band_keys(shingles: np.ndarray) -> list[int]:
    """A hash of the min-hashes of each band; those of all sets without shingles are alike."""
    least = np.array([mixed(shingles ^ mixed(np.array([k + 1], np.uint64))).min(initial=np.uint64((1 << 64) - 1)) for k in range(BANDS * ROWS)], np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return key.view(np.int64).tolist()


def sketches(docs: DataFrame, *, text_col: str = "text", keep: list[str], words: int, shingle: int) -> DataFrame:
    """The kept columns with the fingerprint over shingles of so many words, the SKETCH smallest 32-bit hashes of longer shingles, and their bands."""
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            fps, low, bands = [], [], []
            for text in batch.column(batch.num_columns - 1):
                fps.append(fingerprint(text.as_py(), words))
                found = text_words(text.as_py())
                hashes = combined(hash_words(found), tuple(range(shingle if len(found) >= shingle else max(1, len(found)))), 0)
                low.append(np.unique((hashes >> np.uint64(32)).astype(np.int64))[:SKETCH])
                bands.append(band_keys(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(low, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=[*keep, "fp", "low", "bands"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, fp long, low array<long>, bands array<long>")


def sketch_similarity(a: Column, b: Column) -> Column:
    """The Jaccard index of two sets from their smallest hashes; exact if both fit into a sketch, 1 for two empty sets."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(F.array_intersect(a, b), union)), F.size(union)))


#: Pairs whose sketches say less are ruled out; that is over five standard deviations under 0.8.
FAR = 0.2


def shingle_similarity(a: str | None, b: str | None, shingle: int) -> float:
    """The Jaccard index of the whole sets of shingles; 1 for two empty sets."""
    x, y = (np.unique(combined(hash_words(w), tuple(range(shingle if len(w) >= shingle else max(1, len(w)))), 0)) for w in (text_words(a), text_words(b)))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs(u, v) of digests whose texts(__digest, __body) have the similarity, compared in whole."""

    def run(batches):
        for batch in batches:
            keep = [shingle_similarity(a.as_py(), b.as_py(), shingle) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    ends = pairs.select(F.explode(F.array("u", "v")).alias("__digest")).distinct()
    texts = texts.join(ends, "__digest", "left_semi").dropDuplicates(["__digest"])
    body = lambda end: texts.select(F.col("__digest").alias(end), F.col("__body").alias(f"body_{end}"))
    return pairs.join(body("u"), "u").join(body("v"), "v").select("u", "v", "body_u", "body_v").mapInArrow(run, "u string, v string")


#: Rounds in which a bucket's smallest node is compared with the others before those left are compared pair by pair.
ROUNDS = 3
#: Pairs per node of the table that are compared outright. If there are more, only buckets of CROWD nodes or fewer are; a larger one is dealt
#: into FINER bands of FINER_ROWS min-hashes, and those again, LEVELS times at most.
PAIRS, CROWD, FINER, FINER_ROWS, LEVELS = 8, 32, 6, 3, 5


def refined(crowded: DataFrame, sketch: DataFrame, level: int) -> DataFrame:
    """(key, node): the nodes of crowded(key, node) dealt by further min-hashes of their sketch(node, low), within their bucket.

    Two sets that hardly share a shingle but those of a common header part with each level; two that are
    similar share many finer buckets: with those of all bands 99.9 % of the pairs at 0.8 stay together through the levels.
    """
    seeds = mixed(np.arange(1, FINER * FINER_ROWS + 1, dtype=np.uint64) + np.uint64(level << 32))

    def run(batches):
        for batch in batches:
            lows = batch.column(2)
            sizes = np.diff(np.asarray(lows.offsets))
            values = lows.flatten().to_numpy().astype(np.uint64)
            full = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[full]
            parent = mixed(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
            values ^= np.repeat(parent, sizes)  # other functions in each bucket, so that a pair's chances in its buckets are independent
            out = []
            for k in range(FINER):
                key = mixed(parent ^ seeds[k])
                for r in range(FINER_ROWS):
                    least = np.zeros(len(sizes), np.uint64)
                    if len(starts):
                        least[full] = np.minimum.reduceat(mixed(values ^ seeds[k * FINER_ROWS + r]), starts)
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
                out.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.concat_arrays([batch.column(1)] * FINER)], names=["key", "node"])

    kind = crowded.schema["node"].dataType.simpleString()
    return crowded.join(sketch, "node").select("key", "node", "low").mapInArrow(run, f"key long, node {kind}")


def _compared(buckets: DataFrame, hung: DataFrame, similar, sketch: DataFrame) -> DataFrame:
    """The stars of hung and of the edges among the nodes of each bucket of buckets(key, node), until no two nodes of one are unlinked and uncompared.

    Nodes that are in one component already need no comparison, so that a group of n copies costs n
    comparisons. Nodes that are unlike the first few of their bucket meet pair by pair; where that would be more than so many pairs per node, those of a crowded bucket
    are dealt into finer buckets first. So pairs grow in proportion to the nodes, also where very many unlike texts share
    a header. What stays crowded through all levels is nearly similar throughout, and its pairs are compared.
    """
    most = PAIRS * sketch.count()
    for level in range(LEVELS + 1):
        rounds = 0 if level else ROUNDS
        for turn in range(rounds + 1):
            with Scratch() as scratch:
                labelled = buckets.join(rooted(hung), "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
                several = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("node", "comp")).alias("head"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
                live = scratch.keep(spool(labelled.join(several.select("key", "head", "n"), "key"), "near-buckets"))
                if is_empty(live):
                    return hung
                if turn < rounds:
                    met = live.filter("node <> head.node AND comp <> head.comp").select(F.col("head.node").alias("u"), F.col("node").alias("v"))
                else:
                    every = level == LEVELS or (live.agg(F.sum(F.col("n") - 1)).first()[0] or 0) <= 2 * most
                    few = live if every else live.filter(F.col("n") <= CROWD)
                    a, b = few.alias("a"), few.alias("b")
                    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
                hung = _joined(scratch, hung, similar(met))
            buckets = live.filter("node <> head.node").select("key", "node")
        crowded = live.filter(F.col("n") > CROWD)
        if every or is_empty(crowded):
            return hung
        with Scratch() as scratch:
            buckets = scratch.keep(spool(refined(crowded.select("key", "node"), sketch, level), "near-finer"))
    return hung


def _joined(scratch: Scratch, hung: DataFrame, edges: DataFrame) -> DataFrame:
    """The stars of hung, which are stars already, and edges. Only what is new is worked on: without new edges they are hung itself."""
    fresh = spool(edges, "near-edges")
    return hung if is_empty(fresh) else scratch.keep(stars(hung.unionByName(fresh)))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 2, radii: tuple[int, ...] = (2, 3), shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates, that with the smallest id, all columns as they were.

    Exact copies are one node. Nodes whose fingerprints (over pairs of words, so that a changed word touches
    few features) lie within the largest radius are candidates, found by covering masks; those farther apart are candidates
    if they share a band of min-hashes. Candidates are linked if the Jaccard index of their sets of
    5-word shingles is similarity or more; sketches only rule out pairs far below it, or hold the whole sets. Groups are the components. Nodes of one
    fingerprint or band are compared until none is left. The smaller radii come first only to join what they can: within
    a component no pair needs to be looked at again, so that thousands of near copies of one text don't
    make millions of pairs. Null and empty texts are one group; null ids come last; of
    repeated rows one stays.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    with Scratch() as scratch:
        stays = scratch.keep(spool(_first_of_each(docs, digest, key, text_col, words, radii, shingle, similarity), "near-stays"))
    nth = F.row_number().over(W.partitionBy("__digest").orderBy("__digest"))
    return docs.withColumn("__digest", digest).join(stays, "__digest").filter(key == F.col("__key")).withColumn("__nth", nth).filter("__nth = 1").drop("__digest", "__key", "__nth")


def _first_of_each(docs: DataFrame, digest: Column, key: Column, text_col: str, words: int, radii: tuple[int, ...], shingle: int, similarity: float) -> DataFrame:
    """(__digest, __key) of the text that stays of each group. Tables of a step are deleted once the next has read them."""
    every = spool(sketches(docs.select(digest.alias("__digest"), key.alias("__key"), F.col(text_col).alias("__body")), text_col="__body", keep=["__digest", "__key"], words=words, shingle=shingle), "near-rows")
    told = spool(every.groupBy("__digest").agg(F.min("__key").alias("__key"), F.first("fp").alias("fp"), F.first("low").alias("low"), F.first("bands").alias("bands")), "near-nodes")
    heads = spool(told.groupBy("fp").agg(F.min("__digest").alias("head")), "near-heads")
    texts = docs.select(digest.alias("__digest"), F.col(text_col).cast("string").alias("__body"))

    def similar(edges: DataFrame) -> DataFrame:
        low = lambda end: told.select(F.col("__digest").alias(end), F.col("low").alias(f"low_{end}"))
        told_of = edges.distinct().join(low("u"), "u").join(low("v"), "v").select("u", "v", sketch_similarity(F.col("low_u"), F.col("low_v")).alias("near"), (F.greatest(F.size("low_u"), F.size("low_v")) < SKETCH).alias("whole"))
        met = spool(told_of.filter(F.col("near") >= F.when(F.col("whole"), similarity).otherwise(similarity - FAR)), "near-met")
        return met.filter("whole").select("u", "v").unionByName(confirmed(met.filter("NOT whole").select("u", "v"), texts, shingle, similarity))

    head = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"h{end}"))
    within = told.select("fp", F.col("__digest").alias("v")).join(heads.select("fp", F.col("head").alias("u")), "fp").filter("u <> v").select("u", "v")
    with Scratch() as scratch:
        hung = scratch.keep(stars(similar(within)))
    for radius in radii:
        with Scratch() as scratch:
            # a root is the smallest of its fingerprint too, so that fingerprint can stand for the component
            of_root = heads.select(F.col("head").alias("root"), F.col("fp").alias("root_fp"))
            labelled = spool(heads.join(rooted(hung).join(of_root, "root"), F.col("head") == F.col("node"), "left").select("fp", F.coalesce("root_fp", "fp").alias("comp")), "near-labels")
            across = links(labelled, radius).join(head("u"), "u").join(head("v"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
            hung = _joined(scratch, hung, similar(across))
    keys = F.explode(F.concat(F.array("fp"), "bands")).alias("key")
    hung = _compared(told.select(keys, F.col("__digest").alias("node")), hung, similar, told.select(F.col("__digest").alias("node"), "low"))
    member = rooted(hung)
    grouped = told.select("__digest", "__key").join(member, F.col("__digest") == F.col("node"), "left").select("__digest", "__key", F.coalesce("root", "__digest").alias("root"))
    return grouped.groupBy("root").agg(F.min(F.struct("__key", "__digest")).alias("first")).select(F.col("first.__digest").alias("__digest"), F.col("first.__key").alias("__key"))
