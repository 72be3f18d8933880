import hashlib
import re
from collections import defaultdict

from tidemark.llm import exact, lines

DATA = "/root/testdata/sf0.001"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def brute_lines(docs):
    held = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d)
    keeper = {k: max(ds, key=lambda d: (d is not None, d or 0)) for k, ds in held.items() if len(ds) >= 5}
    return sorted((str(d), "\n".join(x for x in (text or "").split("\n") if key(x) not in keeper or keeper[key(x)] == d)) for d, text in docs)


def test_lines_match_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    got = lines.drop_repeated_lines(table).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == brute_lines(docs)
    assert sum(r.n_dropped for r in got) > 0


def test_lines_edges(spark):
    x = "This line is long enough to be looked at, É and all."
    docs = [(k, f"{x}\n\tshort\n  {x.upper().replace('É', 'É')} \n") for k in range(6)] + [(3, x), (None, x), (None, x), (9, None), (10, ""), (11, "\n\n")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_lines int")
    got = lines.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == brute_lines(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert (by[9].n_lines, by[9].text, by[11].n_lines) == (1, "", 3)
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def rows_of(path, spark, tmp_path, **options):
    return spark.createDataFrame(sorted(map(tuple, exact.exact_dedup(spark, path, state_dir=f"file://{tmp_path}/state", **options).select("id", "keep_id", "group_size", "kept", "digest").collect()), key=str), "id long, keep_id long, group_size long, kept boolean, digest string").collect()


DOCS = [(5, "a  b"), (3, "a b"), (3, "a b"), (8, "a\t\nb"), (7, "c"), (None, "c"), (9, None), (2, ""), (None, "only"), (6, " ")]


def test_exact_matches_brute_force_even_with_colliding_digests(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, digest string").repartition(3).write.parquet(path)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in DOCS:
        groups[norm(t)].append(d)
    from pyspark.sql import functions as F

    for n, digest in enumerate((None, lambda body: F.lit("same"), lambda body: F.substring(F.sha2(body, 256), 1, 1))):
        got = exact.exact_dedup(spark, path, state_dir=f"file://{tmp_path}/s{n}", **({"digest": digest} if digest else {})).collect()
        assert len(got) == len(DOCS)
        assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == sorted((str(d), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)])) for d, t in DOCS)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.id == r.keep_id for r in got if r.kept)
        if digest is None:
            assert {r.digest for r in got} == {hashlib.sha256(k.encode()).hexdigest() for k in groups}


def test_state_takes_in_new_files(spark, tmp_path):
    path, state = f"{tmp_path}/docs", f"file://{tmp_path}/state"
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    write([(5, "x"), (6, "y")])
    assert {(r.id, r.keep_id) for r in exact.exact_dedup(spark, path, state_dir=state).collect()} == {(5, 5), (6, 6)}
    write([(2, "x"), (9, "y")])
    got = exact.exact_dedup(spark, path, state_dir=state).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in got} == {(5, 2, 2, False), (2, 2, 2, True), (6, 6, 2, True), (9, 6, 2, False)}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert exact.exact_dedup(spark, f"{tmp_path}/none", state_dir=f"file://{tmp_path}/state0").count() == 0
