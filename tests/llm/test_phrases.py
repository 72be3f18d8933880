"""Phrase collocations against a brute-force count."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngrams, phrases
from tidemark.llm.phrases import BLANKS, BREAKS


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces_of(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(docs, least, most):
    f, n = Counter(), Counter()
    for _, lang, text in docs:
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                f.update((lang or "und", tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for s in range(len(p) - size + 1):
                inside[lang, p[s : s + size]] = max(inside[lang, p[s : s + size]], a)
    rows = []
    for (lang, p), a in candidates.items():
        if 100 * inside[lang, p] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, left, right, n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        out += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(out)


def got(spark, docs, least, most=2000):
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string, n int, fp string")
    return sorted(map(tuple, phrases.ranked(*phrases.collocations(df, least=least), most).collect()))


def test_phrases_match_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect()
    docs = [(r.doc_id, r.lang, r.text) for r in table]
    docs += [(None, None, "Alpha beta, gamma DELTA É one two\tthree  four five\x0bone two three four five"), (None, None, None), (7, "en", ""), (7, None, " .,\n")] * 6
    want = brute(docs, 5, 2000)
    assert len(want) > 100 and any(r[0] == "und" for r in want)
    assert got(spark, [(*d, 1, "x") for d in docs], 5) == want
    assert got(spark, [(*d, 1, "x") for d in docs], 5, 7) == [r for r in want if r[1] <= 7]
    assert got(spark, [], 5) == []


def test_a_very_long_text_is_cut_between_words_without_loss(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{k}" if k else "x." for k in rng.integers(0, 60, 900_000).tolist())
    assert len(text) > ngrams.BLOCK
    docs = [(1, "en", text), (2, "en", "y" * (3 << 20)), (3, "en", text[:3000])]
    assert got(spark, [(*d, 1, "x") for d in docs], 4000) == brute(docs, 4000, 2000)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_blocks_have_every_word_and_row_once(block):
    texts = ["", None, "a b,c\n\n", " Éa  ", "x" * 40, "", "the END. the end", "  ", None]
    words, closed = [], []
    for b in ngrams.blocks(pa.array(texts, pa.string()), BLANKS, BREAKS, block):
        words += [(int(b.rows[k]), b.word(k).decode()) for k in range(b.carried, len(b.starts))]
        closed += range(b.first, b.last)
        grams = ngrams.fingerprints(b.hashes, 2)
        assert all(grams[k] == grams[m] for k in range(len(grams)) for m in range(len(grams)) if (b.word(k), b.word(k + 1)) == (b.word(m), b.word(m + 1)))
    assert words == [(r, w) for r, t in enumerate(texts) for p in pieces_of(t) for w in p]
    assert closed == list(range(len(texts)))


def test_words_whose_hashes_collide_are_told_apart(monkeypatch, spark):
    whole = next(ngrams.blocks(pa.array(["ab cd ab ef cd"]), BLANKS, BREAKS))
    alike = whole._replace(hashes=np.zeros(5, np.uint64))
    firsts, numbers = ngrams.identify(alike)
    assert [alike.word(firsts[n]) for n in numbers] == [b"ab", b"cd", b"ab", b"ef", b"cd"]
    everything = type("F", (), {"has": lambda self, fps: np.ones(len(fps), bool)})()
    monkeypatch.setattr(phrases, "_grams", lambda block, salts, n: np.zeros(max(0, len(block.hashes) - n + 1), np.uint64))
    found = phrases._found(alike, np.zeros(1, np.uint64), ["en"], everything)
    assert {k[1]: v[0] for k, v in found.items()} == Counter(" ".join(p).encode() for n in range(1, 5) for p in zip(*("ab cd ab ef cd".split()[k:] for k in range(n)), strict=False))


def test_fingerprints_of_several_phrases_are_counted_by_words(spark):
    """Doubtful are those whose second hashes differ and those whose pointer leads nowhere."""
    docs = [(k, "en", f"one two three. four five {'six' if k % 2 else 'seven'}") for k in range(40)]
    df = spark.createDataFrame(docs, "id long, lang string, text string")
    for same, moved in ((False, 0), (True, 12345)):
        table = phrases.spool(phrases.counts(df, (1, 2, 3, 4), None, 1).groupBy("fp").agg(F.sum("n").alias("n"), (F.min("at") + moved).alias("at")).withColumn("same", F.lit(same)).filter("n >= 20"), "t")
        exact, words = phrases.exact_counts(df, table, 20)
        got = {(r.lang, r.phrase): r.n for r in exact.collect()}
        want = Counter(("en", " ".join(w[k : k + n])) for _, _, t in docs for w in pieces_of(t) for n in range(1, 5) for k in range(len(w) - n + 1))
        assert got == {k: n for k, n in want.items() if n >= 20}
        assert {r.lang: r.n for r in words.collect()} == {"en": 240}


def test_second_hashes_tell_phrases_of_one_fingerprint_apart():
    block = next(ngrams.blocks(pa.array(["ab cd ab ef cd"]), BLANKS, BREAKS, checked=True))
    assert len(set(block.checks.tolist())) == 3 and block.checks[0] == block.checks[2]
    a, b = ngrams.fingerprints(block.hashes, 2), ngrams.fingerprints(block.checks, 2, ngrams.WORD_BASE_2)
    assert len(set(a.tolist())) == len(set(b.tolist())) == 4 and not set(a.tolist()) & set(b.tolist())
