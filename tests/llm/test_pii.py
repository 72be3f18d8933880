import random
import re

import pytest

from tidemark.llm import pii

DATA = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text or "") if keep[k](m[0])] for k, p in BASE.items()}


def test_base_spans_match_the_plain_patterns_on_random_texts():
    rng = random.Random(5)
    alphabet = ["a", "b.c", "@", "@x.y", ".", "1", "22", "255", "256", "1.2.3.4", "+", "+1", " ", "-", "(", ")", "é", "4111111111111111", "%"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        assert pii.detect(text)[0] == brute(text), text


def test_base_spans_match_the_plain_patterns_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        got = {k: [(s.start, s.end) for s in r.found if s.kind == k and not s.disguised] for k in pii.KINDS}
        assert got == brute(texts[r.id])


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail jane.doe [at] mail dot example dot com now", "email", "jane.doe [at] mail dot example dot com"),
        ("mail jane (at) example (dot) org.", "email", "jane (at) example (dot) org"),
        ("mail jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
        ("write jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("write ja​ne@exam­ple.com", "email", "ja​ne@exam­ple.com"),
        ("write ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("host 10[dot]0[dot]0[dot]7 is up", "ip", "10[dot]0[dot]0[dot]7"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one five five five two three four five now", "phone", "plus one five five five two three four five"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    _, more = pii.detect(text)
    assert [text[s:e] for s, e in more[kind]] == [source]
    assert not any(v for k, v in more.items() if k != kind)


def test_plain_prose_has_no_disguised_spans():
    text = "He met one or two, at noon. The dot on the map (at the end) was one three-pointed star; one two three, he said."
    base, more = pii.detect(text)
    assert not any(base.values()) and not any(more.values())


def test_nulls_long_texts_and_repeats(spark):
    long = "1" * 200_000 + " a@b.co " + "x" * 200_000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a@b.co", 0), (3, long, 1), (3, long, 1)], "doc_id long, text string, found int")
    got = sorted(((r.id or 0), [(s.kind, s.start, s.end) for s in r.found]) for r in pii.find_pii(docs).collect())
    assert got == [(0, [("email", 0, 6)]), (1, []), (2, []), (3, [("email", 200_001, 200_007)]), (3, [("email", 200_001, 200_007)])]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_redact():
    assert pii.redact("to a@b.co, 1.2.3.4", [("ip", 11, 18), ("email", 3, 9)]) == "to [EMAIL], [IP]"


def test_spelled_digits_among_groups_of_digits():
    text = "call +1 555 one two three 4567 today"
    base, more = pii.detect(text)
    assert [text[a:b] for a, b in more["phone"]] == ["+1 555 one two three 4567"] or [text[a:b] for a, b in base["phone"]] == ["+1 555 one two three 4567"]
    assert pii.detect("in 2024 one of two or three 10 year plans")[1] == {k: [] for k in pii.KINDS}
