import random
import zlib

import corpus_pipeline
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import toxicity

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id", F.col("toxic")), "doc_id"), model).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert sum(r.predicted for r in held if r.toxic == 0) / sum(r.toxic == 0 for r in held) < 0.02


def prose(rng, n, toxic):
    words = [f"w{rng.randrange(400)}" for _ in range(n)]
    if toxic:
        for k in rng.sample(range(n), max(2, n // 12)):
            words[k] = rng.choice(["dreadful", "vermin", "filthy", "scoundrel"])
    return " ".join(words)


def test_score_depends_on_the_text_alone_and_edges(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 60, k % 4 == 0), "en", "s", int(k % 4 == 0)) for k in range(600)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(0, None), (1, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(1, prose(rng, 50, True), 5), (2, prose(rng, 50, False), 5), (3, None, 5), (4, "", 5), (None, "vermin filthy dreadful " * 4, 5), (6, "w1 " * 50_000, 5)], "doc_id long, text string, score int")
    got = {r.id: r for r in toxicity.score(probe, model).collect()}
    assert [got[k].predicted for k in (1, 2, 3, 4, None, 6)] == [1, 0, 0, 0, 1, 0]
    assert got[3].score == got[4].score and not got[None].held_out
    kept = toxicity.reject(probe, model)
    assert kept.columns == probe.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert {r.score for r in toxicity.score(probe, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(probe.limit(0), model).count() == 0


def test_margins_and_counts_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 60, k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))

    def length(own, window):
        made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own + model.shared, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=toxicity._parameters())
        return len(made.compress(model.shared[-toxicity.FRAME :] + b" " + window + b" " + model.shared[-2 * toxicity.FRAME : -toxicity.FRAME + 1]))

    got = {r.doc_id: r.counts for r in toxicity.measure(docs, model, keep=["doc_id"]).collect()}
    for k, text, _ in rows[::20]:
        margins = [length(model.ordinary, w.encode()) - length(model.toxic, w.encode()) for w in text.split()]
        assert got[k] == [len(margins), *(sum(m >= q for m in margins) for q in toxicity.MARGINS)]
    assert toxicity.train(docs.select("doc_id", "text").repartition(3), docs.select("doc_id", "toxic")).key == model.key


def test_telling_words_late_in_a_long_text_are_learned(spark):
    rng = random.Random(5)
    rows = [(k, " ".join([prose(rng, 5000, False), prose(rng, 30, k % 4 == 0)]), int(k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert b"vermin" in model.toxic


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"] and corpus_pipeline.ORACLE_SQL is None
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, DATA).collect(), docs.schema)
        assert now.columns == columns, name
    left = {r.doc_id for r in now.collect()}
    assert left < set(before)
    texts = [r.text for r in now.collect()]
    assert len(set(texts)) == len(texts)
    mixed = corpus_pipeline.run(spark, DATA)
    assert mixed.columns == [*columns, "copies"]
    assert {r.doc_id for r in mixed.collect()} <= left and all(1 <= r.copies <= 3 for r in mixed.collect())


def test_pipeline_stages_take_nulls_and_nothing(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "some words here", None, "s", 15), (2, "some words here", None, "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, DATA).count() <= 4, name
        assert stage(spark, odd.limit(0), DATA).count() == 0, name


def tables(spark, folder, rows, labels, bench):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_each_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows, labels, plain = [], [], lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared = [plain(12) for _ in range(4)]
    bench = [(k, plain(30)) for k in range(10)]
    for k in range(240):
        toxic = k % 6 == 0
        lines = [prose(rng, 40, toxic), plain(60)]
        lines += [shared[j] for j in range(4) if rng.random() < 0.1 * j]
        if k % 20 == 7:
            item = bench[k % 10][1].split()
            item[rng.randrange(30)] = "other"
            lines.append(" ".join(item))
        rows.append((k, "\n".join(lines), "en", f"s{k % 3}", 0))
        labels.append((k, int(toxic)))
    for k in range(240, 280):  # near copies
        words = rows[k - 240][1].replace("\n", " \n ").split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "en", None, 0))
    rows += [(300, None, "en", "s0", 0), (None, "", "en", "s1", 0), (None, plain(50), "en", "s1", 0)]
    docs = tables(spark, str(tmp_path), rows, labels, bench)
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())

    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    # toxicity: the score of each row by itself
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    meter = toxicity.Meter(model)
    score = lambda text: float(toxicity._scores(model, toxicity.np.array([meter.count(text)]))[0])
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == sorted(key(r) for r in rows if score(r[1]) < 0.5)
    # lines
    where = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            where.setdefault(line.strip(" \t\n\x0b\f\r").lower(), set()).add(r[0])
    lost = lambda r, line: len(k := line.strip(" \t\n\x0b\f\r").lower()) >= 40 and len(where[k]) >= 5 and r[0] != max(i if i is not None else -1 for i in where[k])
    want = sorted((r[0] is None, r[0] or 0, "\n".join(x for x in (r[1] or "").split("\n") if not lost(r, x))) for r in rows)
    assert ids(stages["line_dedup"](spark, docs, str(tmp_path))) == want
    # near duplicates: components of the Jaccard index
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    sets = [cut(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8):
                a, b = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
                root[b] = a
    assert ids(stages["near_dedup"](spark, docs, str(tmp_path))) == sorted(key(r) for i, r in enumerate(rows) if find(i) == i)
    # benchmark passages: a window of 20 words with four fifths alike
    def leaks(text):
        w = (text or "").lower().split()
        for _, item in bench:
            m = item.lower().split()
            for shift in range(-len(m), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == m[k] for k in range(len(m))]
                if sum(same) >= 16 and any(sum(same[k : k + 20]) >= 16 for k in range(len(m) - 19)):
                    return True
        return False

    assert ids(stages["decontamination"](spark, docs, str(tmp_path))) == sorted(key(r) for r in rows if not leaks(r[1]))
    # mixing: whole copies, near the targets
    got = stages["mixing"](spark, docs, str(tmp_path)).collect()
    size = lambda t: len((t or "").split())
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in ("s0", "s1", "s2", None)}
    taken = {s: sum(r.copies * size(r.text) for r in got if r.source == s) for s in sizes}
    total, weights = sum(sizes.values()), {"s0": 5, "s1": 2, "s2": 1, None: 5}
    targets, left = {}, set(sizes)
    while True:  # what a source can't give goes to the others
        share = (total - sum(targets.values())) / sum(weights[s] for s in left)
        if not (full := {s for s in left if weights[s] * share > 3 * sizes[s]}):
            break
        targets |= {s: 3 * sizes[s] for s in full}
        left -= full
    targets |= {s: weights[s] * share for s in left}
    assert all(abs(taken[s] - targets[s]) <= 200 for s in sizes) and all(1 <= r.copies <= 3 for r in got)


def test_near_duplicates_of_the_table_against_brute_force(spark):
    """Recall of pairs of different texts with a Jaccard index of 0.8 or more over 5-word shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sets, holders = {}, {}
    for k, text in rows.items():
        w = text.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    pairs = {}
    for held in holders.values():
        for i in held:
            for j in held:
                if i < j:
                    pairs[i, j] = pairs.get((i, j), 0) + 1
    near = [p for p, n in pairs.items() if rows[p[0]] != rows[p[1]] and n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8]
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").select("doc_id").collect()}
    lost = [p for p in near if p[0] in kept and p[1] in kept]
    print(f"near pairs {len(near)}, left in {len(lost)}")
    assert near and len(lost) <= 0.02 * len(near)


def test_stages_and_columns_with_their_own_names(spark):
    line = "this line is long enough to be looked at by the stage"
    rows = [(k, f"{line}\nown text number {k} of the few", "en", "s", 1, "mine", 7, 9) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped int, copies int")
    kept = corpus_pipeline.dedup_lines(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert all(r.n_lines == "mine" and r.n_dropped == 7 and r.n_chars == len(r.text) for r in got.values()) and got[0].text == "own text number 0 of the few" and got[5].text.startswith(line)
    mixed = corpus_pipeline.mix(spark, docs, DATA)
    assert mixed.columns == [*(c for c in docs.columns if c != "copies"), "copies"] and {r.copies for r in mixed.collect()} <= {1, 2, 3}
    near = corpus_pipeline.dedup_near(spark, docs, DATA)
    assert near.columns == docs.columns and near.count() == 6


def test_sample_has_all_rows_asked_for(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    at_hand = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    first = [str(r.doc_id) for r in at_hand.collect()]
    for rows in (1, 2, 3, 5, 8, 13, 21, 34, 1000):
        drawn = toxicity.labelled_sample(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", rows=rows)
        assert sorted(r.text for r in drawn.collect()) == sorted(first[:rows])


def test_all_labelled_rows_are_learned(spark):
    """Of over 12,000 labelled rows, a telling word that stands only in the last ones by hash is learned too."""
    ids = spark.range(16_000).select(F.col("id").alias("doc_id")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    order = [r.doc_id for r in ids.collect()]
    assert len(order) > 12_500
    rng = random.Random(6)
    rows = [(i, f"w{rng.randrange(50)} w{rng.randrange(50)} " + (("vermin" if k < 12_000 else "scoundrel") if k % 4 == 0 else "person") + f" w{rng.randrange(50)}", int(k % 4 == 0)) for k, i in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert b" vermin " in model.toxic and b" scoundrel " in model.toxic


def test_calibration_by_sums_is_at_the_least_loss(spark):
    rng = random.Random(7)
    rows = [([n, *sorted((rng.randrange(4 + 4 * (k % 3 == 0)) for _ in toxicity.MARGINS), reverse=True)], int((k + rng.randrange(4) // 3) % 3 == 0)) for k in range(600) for n in [rng.randrange(10, 90)]]
    model = toxicity.Model()
    toxicity._calibrate(model, spark.createDataFrame(rows, "counts array<long>, label int").repartition(3))
    np = toxicity.np
    raw, label = toxicity.features(np.array([r[0] for r in rows], dtype=float)), np.array([r[1] for r in rows])
    assert np.allclose(model.centre, raw.mean(0)) and np.allclose(model.scale, raw.std(0))
    x = np.hstack([np.ones((len(raw), 1)), (raw - raw.mean(0)) / raw.std(0)])
    w = np.array(model.weights)
    slope = x.T @ (label - 1 / (1 + np.exp(-(x @ w)))) - np.array([1e-6] + [1.0] * raw.shape[1]) * w
    assert np.abs(slope).max() < 1e-5


def test_neighbours_are_counted_once_over_all_runs(spark, monkeypatch):
    """Runs of few words, in which pairs of neighbours come again, and words long and short."""
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["a", "b", "of", "longer", "words"]) for _ in range(rng.randrange(12))), k % 2) for k in range(60)]
    want = {}
    for text, label in rows:
        w = text.split()
        for k, x in enumerate(w):
            want.setdefault(x.encode(), set()).add((w[k - 1] if k else None, w[k + 1] if k + 1 < len(w) else None, label))
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "RUN", 20)
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows], pa.int32())], names=["text", "label"])]
    made, got = list(toxicity._neighbours(iter(batches))), {}
    assert len(made) > 5
    for b in made:
        for word, part, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert near == sorted(set(near)) and all(x % (16 if len(word) <= 3 else 1) == part for x in near)
            got.setdefault(word, set()).update(near)
    assert {w: len(v) for w, v in got.items()} == {w: len(v) for w, v in want.items()}
    assert {w: sum(x & 1 for x in v) for w, v in got.items()} == {w: sum(x[2] for x in v) for w, v in want.items()}
