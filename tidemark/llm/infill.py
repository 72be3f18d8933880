"""Fill-in-the-middle examples from texts that are kept as seekable compressed frames."""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, spool
from .ngrams import mask

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text in a frame; a frame ends with a unit. Rows that are worked on at once.
FRAME, ROWS = 64 << 10, 512
BLANK = mask(BLANKS.encode())
FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))
FRAMES_SQL = "array<struct<units: long, chars: long, bytes: long, data: binary>>"


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Where the units of a text end: a word with the blanks before it is a unit, and so are blanks at the end."""
    blank = BLANK[text]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(text)) if len(text) and blank[-1] else ends


def code_points(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()


class Frames:
    """A text in independent Zstandard frames, with the units, characters and bytes up to the end of each."""

    def __init__(self, frames: Iterable[dict] = ()):
        self.frames = list(frames)

    def add(self, piece: bytes, units: int = 0, chars: int = 0) -> None:
        last = self.frames[-1] if self.frames else {"units": 0, "chars": 0, "bytes": 0}
        self.frames.append({"units": last["units"] + units, "chars": last["chars"] + chars, "bytes": last["bytes"] + len(piece), "data": _codec()[0].compress(piece)})

    def total(self, what: str) -> int:
        return self.frames[-1][what] if self.frames else 0

    def before(self, k: int, what: str) -> int:
        return self.frames[k - 1][what] if k else 0

    def read(self, k: int) -> bytes:
        return _codec()[1].decompress(self.frames[k]["data"])

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, characters) up to the end of so many units; only the frame that holds the cut is read."""
        k = bisect_right(self.frames, units, key=lambda f: f["units"])
        inside = units - self.before(k, "units")
        if not inside:
            return self.before(k, "bytes"), self.before(k, "chars")
        text = np.frombuffer(self.read(k), np.uint8)
        at = int(unit_ends(text)[inside - 1])
        return self.before(k, "bytes") + at, self.before(k, "chars") + code_points(text[:at])

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        k = bisect_right(self.frames, start, key=lambda f: f["bytes"])
        while start < end:
            first, last = self.before(k, "bytes"), self.frames[k]["bytes"]
            piece = self.read(k)
            yield piece[start - first : end - first] if start > first or end < last else piece
            start, k = min(end, last), k + 1


def framed(text: bytes, size: int = FRAME) -> tuple[Frames, bool]:
    """(frames of the text, whether it holds a marker)."""
    made, values = Frames(), np.frombuffer(text, np.uint8)
    ends, start, seen = unit_ends(values), 0, 0
    while seen < len(ends):
        upto = max(seen + 1, int(np.searchsorted(ends, start + size, "right")))
        end = int(ends[upto - 1])
        made.add(text[start:end], upto - seen, code_points(values[start:end]))
        start, seen = end, upto
    return made, any(m in text for m in (PREFIX, SUFFIX, MIDDLE))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME) -> DataFrame:
    """(id, marked, frames) per row of docs, in the shared folder. Null and empty texts have no frames; marked texts hold a marker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            made = [framed((t.as_py() or "").encode(), frame_bytes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for _, m in made], pa.bool_()), pa.array([f.frames for f, _ in made], FRAMES)], names=["id", "marked", "frames"])

    return spool(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, marked boolean, frames {FRAMES_SQL}"), "infill-store")


def arranged(form: str, text: Frames, first: int, second: int) -> Iterator[bytes]:
    """The output of a form, in order: text up to byte first is the prefix, up to second the middle."""
    end = text.total("bytes")
    prefix, middle, suffix = (0, first), (first, second), (second, end)
    order = {"plain": [(b"", (0, end))], "psm": [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)], "spm": [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]}
    for marker, span in order[form]:
        if marker:
            yield marker
        yield from text.stream(*span)


def restored(form: str, output: Frames) -> Iterator[bytes]:
    """The text in order, from an output and its form alone: markers part the output, as a text that holds one is plain."""
    end = output.total("bytes")
    if form == "plain":
        yield from output.stream(0, end)
        return
    at, tail, seen = {}, b"", 0
    for piece in output.stream(0, end):
        window = tail + piece
        for m in (PREFIX, SUFFIX, MIDDLE):
            if m not in at and (k := window.find(m)) >= 0:
                at[m] = seen - len(tail) + k
        seen, tail = seen + len(piece), window[-2:]
    stops = sorted([*at.values(), end])
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(at[m] + len(m), stops[stops.index(at[m]) + 1])


def draws(seed: int, key) -> list[int]:
    """Four numbers below 2^32 that depend on the seed and the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def fill_in_middle(stored: DataFrame, *, seed: int = 42, share: int = 50, spm: int = 80, output: bool = True) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output) per row of a store.

    share percent of the texts are rearranged, spm percent of those with the suffix first (spm), the others with the prefix first
    (psm); the rest is plain. The cuts lie after whole units and are drawn by seed and id, so reruns agree, and rows with one id have one draw.
    The cuts read one frame each; output and restored text pass through the digests frame by frame. The restored text is made
    from the output and its form. With output=False the output's text isn't returned, so that no whole text is held.

    Null and empty texts and those that hold a marker are plain; plain rows have null counts of characters. An empty store gives no rows.
    """
    kind = stored.schema["id"].dataType.simpleString()
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string())])

    def one(key, marked: bool, frames: list[dict]) -> tuple:
        text = Frames(frames)
        n, (h1, h2, h3, h4) = text.total("units"), draws(seed, key)
        form = "plain" if not n or marked or h3 % 100 >= share else "spm" if h4 % 100 < spm else "psm"
        (first, chars), (second, upto) = (text.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))) if form != "plain" else ((0, None), (0, None))
        made, told, again = Frames(), hashlib.sha256(), hashlib.sha256()
        whole: list[bytes] = []
        for piece in arranged(form, text, first, second):
            told.update(piece)
            made.add(piece)
            if output:
                whole.append(piece)
        for piece in restored(form, made):
            again.update(piece)
        return n, form, chars, upto if chars is None else upto - chars, told.hexdigest(), again.hexdigest(), b"".join(whole).decode() if output else None

    def run(batches):
        for batch in slices(batches):
            rows = [one(k.as_py(), m.as_py(), f.as_py() or []) for k, m, f in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema))], names=["id", *schema.names])

    found = stored.select("id", "marked", "frames").mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string")
    return found if output else found.drop("output")
