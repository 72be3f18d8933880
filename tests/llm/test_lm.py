"""The language model against one of plain dictionaries, and its sequences against plain lists."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import lm, ngrams
from tidemark.llm.eliasfano import EliasFano, Lists, Mapped, packed

D = 0.75


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    def __init__(self, texts, least=2):
        self.c, self.g, self.ctx = Counter(), Counter(), Counter()
        for text in texts:
            seq = ["<s>", "<s>", *tokens(text), "</s>"]
            self.c.update(seq[2:])
            for k in range(2, len(seq)):
                for context in ((seq[k - 1],), (seq[k - 2], seq[k - 1])):
                    self.g[context, seq[k]] += 1
                    self.ctx[context] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.kept = {k: n for k, n in self.g.items() if n >= least}
        self.left = {context: 1.0 for context in self.ctx}
        for (context, _), n in self.kept.items():
            self.left[context] -= (n - D) / self.ctx[context]

    def once(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, w, *contexts):
        if not contexts:
            return self.once(w)
        lower = self.p(w, *contexts[1:])
        context = contexts[0]
        return (max(0, self.kept.get((context, w), 0) - D) / self.ctx[context] if context in self.ctx else 0) + self.left.get(context, 1.0) * lower

    def score(self, text):
        seq = ["<s>", "<s>", *tokens(text), "</s>"]
        at = range(2, len(seq))
        return len(at), sum(self.c[seq[k]] > 0 for k in at), sum(math.log10(self.once(seq[k])) for k in at), sum(math.log10(self.p(seq[k], (seq[k - 2], seq[k - 1]), (seq[k - 1],))) for k in at)


def agrees(spark, train, texts, **options):
    plain = Plain(train, options.get("least", 2))
    df = lambda rows: spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, hash string, n long")
    model = lm.train(df(list(enumerate(train))), **options)
    assert (model.tokens, model.kinds, model.texts) == (plain.n, plain.v, len(train))
    got = {r.id: r for r in lm.score(df(list(enumerate(texts))), model).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        n, known, base, whole = plain.score(text)
        r = got[k]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(whole, abs=3e-4 * n)
    return plain, model


def test_scores_match_plain_dictionaries_over_many_shards(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    train = [r.text for r in rows if r.doc_id % 3] + [None, "", "the The THE", "a b a b a b"]
    texts = [r.text for r in rows] + [None, "", " \n", "zzz unseen words", "the", "É é", "a b a b"]
    plain, model = agrees(spark, train, texts, shard_tokens=3000)
    assert model.shards > 10 and max(plain.c.values()) > model.shard_tokens / 2
    for context in [("the",), ("<s>",), ("a", "b"), ("<s>", "<s>")]:
        assert sum(plain.p(w, *(context[k:] for k in range(len(context)))) for w in [*plain.c, "unseen"]) == pytest.approx(1)
    agrees(spark, train[:50], texts[:60], least=1)


def test_no_rows_and_one_row(spark):
    agrees(spark, [], ["a b", ""])
    agrees(spark, ["only"], ["only", None])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, lm.train(empty)).count() == 0


def test_a_text_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"word{k}" for k in rng.zipf(1.3, 700_000) % 50_000)
    assert len(text) > lm.BLOCK
    agrees(spark, [text, "word1 word2"], [text, text + " new", "word1"])


def test_words_with_one_hash_are_told_apart(tmp_path, monkeypatch):
    words = ["ab", "cd", "ef", "gh"]
    table = pa.table({"hash": pa.array([7, 7, 7, 9], pa.int64()), "word": pa.array([w.encode() for w in words]), "n": pa.array([1, 2, 3, 4], pa.int64())})
    (tmp_path / "words-0").write_bytes(lm._word_file(table, 0)[0])
    model = lm.Model(f"file://{tmp_path}", 0, [0], 1, 1, 10, 4, 1)
    block = next(ngrams.blocks(pa.array(["ef xx cd ab gh yy"]), lm.BLANK))._replace(hashes=np.array([7, 7, 7, 7, 9, 8], np.uint64))
    numbers, counts = lm.word_numbers(model, block, np.arange(6))
    assert numbers.tolist() == [4, -1, 3, 2, 5, -1] and counts.tolist() == [3, 0, 2, 1, 4, 0]


@pytest.mark.parametrize("top", [1, 5, 1000, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 3000])
def test_sequences(tmp_path, top, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    (tmp_path / "f").write_bytes(packed({"s": EliasFano.arrays(values)}))
    s = Mapped(f"{tmp_path}/f").sequence("s")
    assert (s.get(np.arange(n)) == values).all()
    asked = np.unique(np.concatenate([values, rng.integers(0, top, 200, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)]))
    assert (s.successor(asked) == np.searchsorted(values, asked)).all()
    first = np.searchsorted(values, asked)
    assert (s.find(asked) == np.where(np.isin(asked, values), first, -1)).all()
    bits = sum(a.nbytes for k, a in EliasFano.arrays(values).items() if k) * 8
    assert bits <= n * (6 + max(0, math.log2(max(1, top / n)))) + 600


def test_lists(tmp_path):
    rng = np.random.default_rng(2)
    held = [np.unique(rng.integers(0, 50, rng.integers(1, 20))) for _ in range(200)]
    (tmp_path / "f").write_bytes(packed({"x": Lists.arrays(np.array([len(v) for v in held]), np.concatenate(held))}))
    lists = Mapped(f"{tmp_path}/f").lists("x")
    which, value = np.repeat(np.arange(200), 60), np.tile(np.arange(60), 200)
    at, place = lists.find(which, value)
    starts = np.cumsum([0, *map(len, held)])
    for w, v, a, p in zip(which.tolist(), value.tolist(), at.tolist(), place.tolist(), strict=True):
        assert (a, p) == (starts[w] + held[w].tolist().index(v), held[w].tolist().index(v)) if v in held[w] else a == -1


def test_a_shard_is_built_within_a_few_copies_of_its_ngrams():
    """Runs of a shard were unpacked, put together and sorted as tables side by side, 112 bytes for an n-gram of 32."""
    rng = np.random.default_rng(4)
    pack = zstandard.ZstdCompressor(level=1)
    parts = [np.stack([*(rng.integers(0, 1 << 20, 50_000) for _ in range(3)), (rng.random(50_000) < 0.2) + 1]) for _ in range(8)]
    runs = pa.chunked_array([pa.array([pack.compress(t.view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes()) for t in parts], pa.binary())])
    table = np.concatenate(parts, axis=1)
    assert (lm._unpacked(runs, zstandard.ZstdDecompressor()) == table).all()
    tracemalloc.start()
    lm.gram_file(*lm._unpacked(runs, zstandard.ZstdDecompressor()), 2)
    assert tracemalloc.get_traced_memory()[1] < 90 * table.shape[1]
    tracemalloc.stop()


@pytest.mark.parametrize("top", [1, 1 << 10, 1 << 21, 1 << 32, 1 << 62])
def test_rows_are_ordered_by_columns(top):
    columns = np.random.default_rng(top % 97).integers(0, top, (3, 2000))
    columns[:, 1000:] = columns[:, :1000]
    assert (lm.ordered(*columns) == np.lexsort(columns[::-1])).all()
    assert len(lm.ordered(*columns[:, :0])) == 0
