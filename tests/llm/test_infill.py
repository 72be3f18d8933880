"""Fill-in-the-middle by a plain version on whole strings."""

import hashlib
import random
import re

import pytest

from tidemark.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(key, text):
    units = UNIT.findall(text or "")
    text, n = text or "", len(units)
    h1, h2, h3, h4 = (int(sha(f"42:{'' if key is None else key}")[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, sha(text), sha(text), text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return key, n, "spm" if h4 % 100 < 80 else "psm", len(p), len(m), sha(out), sha(text), out


def texts():
    rng = random.Random(5)
    some = ["", None, " ", "\n\t x", "x ", "é  ü\x0bß ", "<P> a b c", "a <M", "< <S <M P> M> S>", "no<S>good", "<", "日本 語 テキスト 😀 🎉", "a\xa0b"]
    some += ["".join(rng.choice("ab é<PSM>\n 😀\t") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*enumerate(some), (None, "null id but words"), (7, "again"), (7, "again"), (900, " ".join(f"w{k}é" for k in range(200_000))), (901, "z" * 300_000), (904, "y " * 100_000 + "z" * 200_000)]


@pytest.mark.parametrize("frame_bytes", [1, 9, infill.FRAME])
def test_forms_match_the_plain_version(spark, frame_bytes):
    rows = [r for r in texts() if frame_bytes > 9 or len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, form string, n int")
    stored = infill.store(docs, frame_bytes=frame_bytes)
    got = sorted(map(tuple, infill.fill_in_middle(stored).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"} and all(g[6] == sha(t or "") for g, t in zip(sorted(got, key=str), [r[1] for r in sorted(rows, key=lambda r: str(plain(*r)))], strict=True))
    assert infill.fill_in_middle(stored, output=False).columns == [c for c in infill.fill_in_middle(stored).columns if c != "output"]


def test_no_rows(spark):
    assert infill.fill_in_middle(infill.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_only_frames_of_a_cut_are_read():
    text = " ".join(f"word{k}" for k in range(100_000)).encode()
    made, _ = infill.framed(text)
    assert len(made.frames) > 10
    reads = []
    read, made.read = made.read, lambda k: reads.append(k) or read(k)
    at, chars = made.cut(50_000)
    assert len(reads) == 1 and text[:at].decode().split()[-1] == "word49999" and chars == at
    assert made.cut(made.total("units")) == (len(text), len(text)) and len(reads) == 1
    assert b"".join(made.stream(at, at + 100)) == text[at : at + 100] and len(reads) == 2


def test_every_cut_of_small_texts_is_restored():
    for text in ("a<", "<P<S <M", "< P> <", "é 😀 x "):
        made, _ = infill.framed(text.encode(), 2)
        n = made.total("units")
        for a in range(n + 1):
            for b in range(a, n + 1):
                for form in ("psm", "spm"):
                    out = infill.Frames()
                    for piece in infill.arranged(form, made, made.cut(a)[0], made.cut(b)[0]):
                        out.add(piece)
                    assert b"".join(infill.restored(form, out)).decode() == text
