import itertools
import random
import re

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(fps):
    """(id, fp) to the smallest id reachable."""
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i, _ in fps}


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for bits in itertools.combinations(range(64), 2):
        assert any(not m & (1 << bits[0] | 1 << bits[1]) for m in masks)
    assert all(30 <= m.bit_count() <= 40 for m in masks)


def test_groups_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_groups(rows)
    got = simhash.group(docs).collect()
    assert {(r.id, r.fp & (1 << 64) - 1) for r in got} == set(rows)
    assert {r.id: r.component_id for r in got} == want


def test_links_of_crowded_and_small_buckets_match_brute_force(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)}
    rows = sorted(enumerate(fps))
    signed = [(int(np.uint64(f).view(np.int64)),) for _, f in rows]
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f, f) for (f,) in signed], "fp long, comp long"), 2).collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in edges)
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    mine, want = {}, brute_groups(rows)
    for (i, _), (f,) in zip(rows, signed, strict=True):
        mine.setdefault(root.get(f, f), set()).add(i)
    theirs = {}
    for i, r in want.items():
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_nulls_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(5, None, "x"), (7, "", "y"), (None, " \t", "z"), (9, "one two", "q"), (9, "One  TWO", "q"), (11, "other", None)], "doc_id long, text string, fp string")
    got = sorted((r.id if r.id is not None else -1, r.fp == 0, r.component_id) for r in simhash.group(docs).collect())
    assert got == [(-1, True, 5), (5, True, 5), (7, True, 5), (9, False, 9), (9, False, 9), (11, False, 11)]
    assert simhash.group(docs.limit(0)).count() == 0


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_stars_and_one_more_edge_take_few_rounds(spark, monkeypatch):
    """Stars are told without a round; an edge between two joins them. Before, each call began anew and its last round changed nothing."""
    from tidemark.llm import components as module

    written = []
    monkeypatch.setattr(module, "spool", lambda df, what, spool=module.spool: written.append(what) or spool(df, what))
    found = module.stars(spark.createDataFrame([(2, 1), (3, 1), (1, 4), (9, 8), (7, 7), (None, 5)], "u long, v long"))
    assert {(r.u, r.v) for r in found.collect()} == {(2, 1), (3, 1), (4, 1), (9, 8)} and len(written) == 1
    written.clear()
    found = module.stars(found.unionByName(spark.createDataFrame([(3, 9)], "u long, v long")))
    assert {(r.u, r.v) for r in found.collect()} == {(2, 1), (3, 1), (4, 1), (9, 1), (8, 1)} and len(written) <= 3
    assert {(r.node, r.root) for r in module.rooted(found).collect()} == {(k, 1) for k in (1, 2, 3, 4, 8, 9)}
    assert module.stars(found.limit(0)).count() == 0
