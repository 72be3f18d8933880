import random
import threading

from tidemark.llm import simhash
from tidemark.llm.common import Scratch, spool


def jaccard(a, b):
    cut = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_one_of_each_group_stays(spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(3000)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    rows, near = [], []
    for g in range(40):
        text = prose(rng.randint(100, 120))
        rows.append((10 * g, " ".join(text)))
        rows.append((10 * g + 1, " ".join(text)))
        changed = list(text)
        changed[50] = "changed"
        assert jaccard(text, changed) >= 0.8
        rows.append((10 * g + 2, " ".join(changed)))
        near.append(10 * g + 2)
        far = list(text)
        for j in range(0, len(far), 6):
            far[j] = f"far{j}"
        rows.append((10 * g + 3, " ".join(far)))
    rng.shuffle(rows)
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(i % 10 == 1 for i in got)
    assert {i for i in got if i % 10 in (0, 3)} == {10 * g + k for g in range(40) for k in (0, 3)}
    assert len(got & set(near)) <= 4  # over the radius


def test_many_near_copies_and_edges(spark):
    rng = random.Random(2)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(300):
        copy = list(text)
        copy[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(copy), "s"))
    rows += [(1000, None, "s"), (1001, "", "t"), (None, "", "u"), (2000, "one", "v"), (2000, "one", "v"), (None, "only here", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    assert ids == [-1, 0, 1000, 2000]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_crowded_buckets_at_a_larger_radius_lose_no_link(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f, f) for (f,) in signed], "fp long, comp long"), 4).collect()}
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


def test_long_texts_at_the_threshold_are_told_by_whole_sets(spark):
    rng = random.Random(5)
    rows, stays = [], set()
    for g in range(60):
        text = [f"w{rng.randrange(10**7)}" for _ in range(400)]
        cut = (70, 94, 80)[g % 3]  # what is left has 0.823, 0.763 or 0.798 of the shingles
        part = text[cut:]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(part))]
        if jaccard(text, part) < 0.8:
            stays.add(2 * g + 1)
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in got if i % 2} >= stays and len(stays) > 30


def test_whole_sets_decide():
    a = [f"w{i}" for i in range(1000)]
    assert simhash.shingle_similarity(" ".join(a), " ".join(a[:798]), 5) < 0.8 <= simhash.shingle_similarity(" ".join(a), " ".join(a[:802]), 5)
    assert simhash.shingle_similarity(None, "", 5) == 1.0


def test_copies_in_one_fingerprint_unlike_its_smallest_node(spark):
    rng = random.Random(3)
    line = [f"line{i}" for i in range(11)] * 200
    rows = []
    for g in range(12):
        tail = [f"t{rng.randrange(10**7)}" for _ in range(100)]
        rows += [(2 * g, " ".join(line + tail)), (2 * g + 1, " ".join([*line, *tail[:50], "changed", *tail[51:]]))]
    assert len({simhash.fingerprint(t, 2) for _, t in rows}) == 1
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [2 * g for g in range(12)]


def test_every_near_copy_goes_whatever_its_fingerprint(spark):
    rng = random.Random(6)
    rows = []
    for g in range(60):
        text = rng.choices([f"word{i}" for i in range(3000)], k=100)
        changed = [f"changed{j}" if j in (30, 70) else w for j, w in enumerate(text)]
        assert 0.8 <= jaccard(text, changed) < 0.83
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(changed))]
    far = [(simhash.fingerprint(a, 2) ^ simhash.fingerprint(b, 2)).bit_count() > 6 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert any(far)
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [2 * g for g in range(60)]


def pairs_met(spark, n):
    """How many pairs the bands of n unlike texts with a common header are compared in."""
    rng = random.Random(5)
    header = " ".join(f"h{k}" for k in range(60))
    rows = [(k, header + " " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(100))) for k in range(n)]
    docs = spark.createDataFrame(rows, "id long, text string")
    told = spool(simhash.sketches(docs, keep=["id"], words=2, shingle=5), "t")
    buckets = told.select("bands", told["id"].alias("node")).selectExpr("explode(bands) AS key", "node")
    met = []

    def similar(edges):
        met.append(edges.distinct().count())
        return edges.limit(0)

    none = spark.createDataFrame([], "u long, v long")
    simhash._compared(buckets, none, similar, told.selectExpr("id AS node", "low"))
    return sum(met)


def test_pairs_grow_in_proportion_where_unlike_texts_share_a_header(spark):
    small, middle, large = (pairs_met(spark, n) for n in (500, 1000, 2000))
    assert middle < 2.6 * small and large < 2.6 * middle, (small, middle, large)


def test_similar_texts_stay_together_in_finer_bands(spark, monkeypatch):
    rng = random.Random(3)
    rows, want = [], 0
    for k in range(150):  # pairs of texts of over 128 shingles at about 0.8
        text = [f"w{rng.randrange(10**7)}" for _ in range(300)]
        other = list(text)
        for _ in range(6):
            other[rng.randrange(300)] = f"x{rng.randrange(10**7)}"
        want += jaccard(text, other) >= 0.8
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    told = spool(simhash.sketches(spark.createDataFrame(rows, "id long, text string"), keep=["id"], words=2, shingle=5), "t")
    buckets, sketch = told.selectExpr("explode(bands) AS key", "id AS node"), told.selectExpr("id AS node", "low")
    for level in range(3):
        buckets = simhash.refined(buckets, sketch, level)
    keys = {}
    for r in buckets.collect():
        keys.setdefault(r.key, set()).add(r.node)
    together = {n // 2 for nodes in keys.values() for n in nodes if n ^ 1 in nodes}
    assert len(together) >= 0.99 * want


def test_blocks_of_two_threads_do_not_delete_each_others_tables(spark):
    inside, done = threading.Event(), threading.Event()
    found = {}

    def outer():
        with Scratch():
            spool(spark.range(3), "a")
            inside.set()
            done.wait(60)

    def other():
        inside.wait(60)
        found["table"] = spool(spark.range(7), "b")
        done.set()

    threads = [threading.Thread(target=f) for f in (outer, other)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found["table"].count() == 7
