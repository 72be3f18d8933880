"""Very long texts, columns with clashing names, rows without ids, and the contracts' own columns."""

import base64
import hashlib
import random

import xxhash

from tidemark.llm import exact, lines, mixing, pii, queries, secrets, simhash, warc

LONG = 300_000


def long_text(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(LONG))


def test_long_texts_in_every_operator(spark, tmp_path):
    a, b = long_text(1), long_text(2)
    repeated = "this line is long enough to be counted as one of many"
    rows = [(1, a, "s"), (2, b + " ", "s"), (3, a.replace(" ", "\n"), "t"), (4, "\n".join([repeated] * 20_000), "t"), *((5 + k, repeated, "t") for k in range(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {r.id: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes[1] == sizes[2] == sizes[3] == LONG and sizes[4] == 20_000 * len(repeated.split())
    groups = {r.id: r.component_id for r in simhash.group(docs).collect()}
    assert groups[3] == groups[1] == 1 and groups[2] != 1
    kept = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert kept[4].n_dropped == 20_000 and kept[4].text == "" and kept[3].n_lines == LONG and kept[10].text == repeated
    docs.write.parquet(f"{tmp_path}/d")
    same = {r.id: r.keep_id for r in exact.exact_dedup(spark, f"{tmp_path}/d").collect()}
    assert same[3] == 1 and same[2] == 2
    pages = docs.select("doc_id", "source", "text")
    back = {r.page_id: r for r in warc.round_trip(pages, id_col="doc_id", url_col="source", text_col="text").collect()}
    assert back[1].payload_bytes == len(a) and back[1].payload_digest == base64.b32encode(hashlib.sha1(a.encode()).digest()).decode()
    hidden = spark.createDataFrame([(1, ("x " * 50 + "token: abcdef1\n") * 3000)], "doc_id long, text string")
    found = secrets.scan(hidden, f"file://{tmp_path}/l").first().found
    assert len(found) == 3000 and [s.start for s in found] == [100 + 115 * k for k in range(3000)]


def test_columns_with_the_operators_own_names(spark, tmp_path):
    rows = [(1, "token = secret1", "x", 1, "q"), (2, "token = secret1", "y", 2, "q"), (None, "token = secret1", "z", 3, None), (None, None, "z", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n long, locator string")
    docs.write.parquet(f"{tmp_path}/d")
    got = sorted((r.id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.exact_dedup(spark, f"{tmp_path}/d").collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False)]
    clash = docs.withColumnsRenamed({"digest": "blob", "locator": "found"}).withColumn("kinds", docs["n"])
    found = sorted((r.id or 0, len(r.found)) for r in secrets.scan(clash, f"file://{tmp_path}/l").collect())
    assert found == [(0, 0), (0, 1), (1, 1), (2, 1)]
    pages = docs.select("doc_id", "digest", "text", "n").withColumnsRenamed({"n": "payload", "digest": "first"})
    back = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages, id_col="doc_id", url_col="first", text_col="text").collect())
    assert back == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (2, "revisit", 1)]


def test_pages_of_one_id_with_other_payloads_have_other_record_ids():
    ids = {warc.decode_record(warc.encode_record(7, None, payload, None, False, "2026-01-01T00:00:00Z"))[0]["warc-record-id"] for payload in (b"a", b"b")}
    assert len(ids) == 2
    first = warc.decode_record(warc.encode_record(7, None, b"a", None, False, "2026-01-01T00:00:00Z"))[0]
    again = warc.decode_record(warc.encode_record(9, None, b"a", 7, True, "2026-01-01T00:00:00Z"))[0]
    assert again["warc-refers-to"] == first["warc-record-id"] != again["warc-record-id"]


def test_contract_columns_of_fingerprints_and_personal_data(spark, tmp_path):
    texts = ["One two three four", "write to jane@example.com or 10.0.0.1, +1 555 123 4567", "", None, "card 4111 1111 1111 1111 and 300.1.1.1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_simhash(spark, str(tmp_path)).collect()}
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("one two three", "two three four")]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 2)
    assert got[0].fingerprint == f"{want:016x}" and got[2].fingerprint == got[3].fingerprint == "0" * 16 and got[3].component_id == 2
    found = {r.doc_id: r for r in queries.op9_pii(spark, str(tmp_path)).collect()}
    spans = "email:9:25,ip:29:37,phone:39:54"
    assert found[1].spans == spans and found[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert (found[1].n_email, found[1].n_ip, found[1].n_card, found[1].n_phone) == (1, 1, 0, 1)
    assert (found[4].n_card, found[4].n_ip) == (1, 0) and found[3].spans == "" and found[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(texts[1])[1] == {k: [] for k in pii.KINDS}
