import itertools
import random

import numpy as np

from tidemark.llm import decontam
from tidemark.llm.tokens import PUNCTUATION, words

DATA = "/root/testdata/sf0.001"


def tokens(text):
    return [w.strip(PUNCTUATION) or w for w in words(text)]


def brute(docs, items):
    """(doc, item) pairs that share a window, by trying all alignments."""
    found = set()
    codes = {}
    code = lambda ws: np.array([codes.setdefault(w, len(codes)) for w in ws])
    coded = [(i, code(tokens(t))) for i, t in items]
    for d, text in docs:
        doc = code(tokens(text))
        for i, item in coded:
            width = min(20, len(item))
            if len(item) < 8:
                continue
            for shift in range(-len(item) + 1, len(doc)):
                a, b = max(0, -shift), min(len(item), len(doc) - shift)
                same = np.zeros(len(item), bool)
                same[a:b] = doc[a + shift : b + shift] == item[a:b]
                sums = np.concatenate([[0], np.cumsum(same)])
                if (sums[width:] - sums[:-width]).max() >= 0.8 * width - 1e-9:
                    found.add((d, i))
                    break
    return found


def test_masks_fit_every_passage_with_a_fifth_substituted():
    for n in range(8, 21):
        for wrong in itertools.combinations(range(n), int(0.2 * n + 1e-9)):
            assert any(all(s + k not in wrong for k in m) for m in decontam.MASKS for s in range(n - m[-1])), (n, wrong)


def test_matches_brute_force_on_the_table_and_on_substituted_passages(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()][:12]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    for k, (_, text) in enumerate(items):
        for share in (0, 0.1, 0.2, 0.35):
            ws = text.split()
            for j in rng.sample(range(len(ws)), int(share * len(ws))):
                ws[j] = f"new{j}"
            docs.append((10_000 + len(docs), f"before {k} words " + " ".join(ws).upper() + " and after"))
    docs.append((20_000, " ".join(items[0][1].split()[1:])))
    docs.append((20_001, "start " + " ".join(items[1][1].split()[:-2])))
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 30
    assert {(r.id, r.item) for r in got} == want
    text = dict(docs)
    for r in got:
        assert 0 <= r.start < r.end <= len(text[r.id].split()) and r.matched <= r.item_words


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, "too short", "y"), (3, None, "z"), (None, "", "z")], "item_id long, text string, seed string")
    docs = spark.createDataFrame([(1, item.upper() + ".", 0), (1, item.upper() + ".", 0), (None, f"a {item}! b", 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (5, "word " * 100_000 + item, 0)], "doc_id long, text string, item long")
    got = sorted((r.id or 0, r.item, r.start, r.end, r.matched) for r in decontam.find_leaks(docs, bench).collect())
    assert got == [(0, 1, 1, 11, 10), (1, 1, 0, 10, 10), (5, 1, 100_000, 100_010, 10)]
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
