"""Toxicity by compression distance: what do two dictionaries make of the same windows?"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, spool
from .tokens import combined, hash_words, words

#: Margins in bytes at which windows are counted.
MARGINS = (2, 3, 4, 5)
#: Both dictionaries end alike, and each window stands between two pieces of that common part, so that
#: their encodings differ in the window only, and even a short one takes part in the compression.
FRAME = 33
#: Windows that a Python worker remembers.
REMEMBERED = 300_000
#: Words of texts whose neighbours are told apart together before they are shuffled.
RUN = 1 << 21


@dataclass
class Model:
    """Two dictionaries of one size, with a common end, and the calibration of the score."""

    toxic: bytes = b""
    ordinary: bytes = b""
    shared: bytes = b""
    weights: list[float] = field(default_factory=list)  # of the constant and the features
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    @property
    def key(self) -> int:
        return xxhash.xxh64_intdigest(b"\0".join((self.toxic, self.ordinary, self.shared)))


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False)


class Meter:
    """Measures windows against both dictionaries. The shorter the toxic encoding, the larger the margin."""

    def __init__(self, model: Model):
        self.before, self.after = model.shared[-FRAME:], model.shared[-2 * FRAME : -FRAME + 1]
        self.known: dict[bytes, int] = {}
        self.toxic, self.ordinary = (self._compressor(own + model.shared) for own in (model.toxic, model.ordinary))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=_parameters())
        return zstandard.ZstdCompressor(dict_data=made, compression_params=_parameters())

    def margin(self, window: bytes) -> int:
        if (found := self.known.get(window)) is None:
            framed = b"%b %b %b" % (self.before, window, self.after)
            found = len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[window] = found
        return found

    def count(self, text: str | None) -> list[int]:
        """The number of windows, and how many reach each of MARGINS. A window is a word."""
        found = words(text)
        margins = np.fromiter(map(self.margin, found), dtype=np.int64, count=len(found))
        return [len(found), *(int((margins >= m).sum()) for m in MARGINS)]


_METERS: dict[int, Meter] = {}


def _meter(model: Model) -> Meter:
    """The worker's meter for this model; it outlives the task."""
    if model.key not in _METERS:
        _METERS.clear()
        _METERS[model.key] = Meter(model)
    return _METERS[model.key]


def features(counts: np.ndarray) -> np.ndarray:
    """For each margin: the logarithm of the windows that reach it, and their share."""
    n, hits = counts[:, :1], counts[:, 1:]
    return np.hstack([np.log1p(hits), hits / (n + 20)])


def _scores(model: Model, counts: np.ndarray) -> np.ndarray:
    if not model.weights:
        return np.zeros(len(counts))
    x = (features(counts) - np.array(model.centre)) / np.array(model.scale)
    z = np.clip(x @ np.array(model.weights[1:]) + model.weights[0], -30, 30)
    return 1 / (1 + np.exp(-z))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def _pack(found: list[bytes], size: int) -> bytes:
    """Words with blanks round them, up to size bytes, the first last: the end of a dictionary is the cheapest to refer to."""
    out, used = [], 1
    for w in found:
        if used + len(w) + 1 > size:
            break
        out.append(w)
        used += len(w) + 1
    return b" " + b" ".join(reversed(out)) + b" "


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int | None = None) -> DataFrame:
    """(text, label) of all labelled rows outside the held-out fold, or of the first rows of them by a hash of the id; whole texts."""
    told = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("label")).filter(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    if rows is None:
        return texts.join(told.hint("shuffle_hash"), "__id").select("text", "label")
    told = told.withColumn("__h", F.pmod(F.xxhash64("__id"), F.lit(1 << 30)))
    # counts by ranges of the hash tell exactly how far the first rows go, so that partitions send few others to the driver
    counts = told.groupBy(F.shiftright("__h", 14).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(W.orderBy("bin")))
    last = F.broadcast(counts.filter(F.col("n") >= rows).agg(F.coalesce(F.min("bin"), F.lit(1 << 16)).alias("last")))
    drawn = told.crossJoin(last).filter(F.shiftright("__h", 14) <= F.col("last")).orderBy("__h", "__id").limit(rows).select("__id", "label")
    return texts.join(F.broadcast(drawn), "__id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int | None = None, dict_bytes: int = 4096, evidence: float = 16.0, ratio: float = 4.0) -> Model:
    """Train the dictionaries and the score on all labelled documents outside the held-out fold, or on the first rows of them by hash.

    Dictionaries that zstandard trains by itself don't tell these kinds apart, since it seeks what is frequent and not
    what is telling (see the README), so their content is chosen by evidence.
    Words are counted by the different pairs of neighbours they stand between, so that copies of a text
    count once. The toxic dictionary gets the words whose share among toxic texts is ratio times
    their share overall with a log-likelihood ratio of evidence or more; the ordinary one gets as many bytes of
    frequent ordinary words; both end with the most frequent ordinary words. The score is a
    logistic regression on how many windows the toxic dictionary encodes shorter, and by how much; its sums are made in tasks.
    Without labelled rows of both kinds the model scores all texts 0.
    """
    sample = spool(labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows), "toxicity-texts")
    try:
        return _train(sample, dict_bytes, evidence, ratio)
    finally:
        discard(sample)


def _neighbours(batches):
    """(word, part, near) per run of texts: the hashes of the different pairs of neighbours that a word stands between, with the label as last bit.

    Short words are the frequent ones, so their neighbours are dealt into parts, of which no task gets many.
    """

    def made(found: list[bytes], h: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        part = near % np.where(np.fromiter(map(len, found), np.int64, len(found)) <= 3, 16, 1)
        order = np.lexsort((near, part, h))
        h, near, part = h[order], near[order], part[order]
        begins = np.r_[True, (np.diff(h) != 0) | (np.diff(part) != 0)]
        fresh = begins | np.r_[True, np.diff(near) != 0]
        at = np.flatnonzero(begins)
        offsets = np.r_[np.flatnonzero(begins[fresh]), fresh.sum()].astype(np.int32)
        columns = [pa.array([found[k] for k in order[at].tolist()], pa.binary()), pa.array(part[at], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(near[fresh], pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "part", "near"])

    found, parts = [], []
    for batch in batches:
        for text, label in zip(*(batch.column(k) for k in (0, 1)), strict=True):
            own = words(text.as_py())
            if not own:
                continue
            h = hash_words(own)
            near = combined(np.concatenate([[np.uint64(0)], h, [np.uint64(0)]]), (0, 2), 0) & ~np.uint64(1) | np.uint64(label.as_py())
            found += own
            parts.append((h, near.view(np.int64)))
            if len(found) >= RUN:
                yield made(found, *(np.concatenate(x) for x in zip(*parts, strict=True)))
                found, parts = [], []
    if found:
        yield made(found, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _train(sample: DataFrame, dict_bytes: int, evidence: float, ratio: float) -> Model:
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Model()
    sample = sample.select("text", F.col("label").cast("int"))
    stands = sample.mapInArrow(_neighbours, "word binary, part int, near array<long>").repartition("word", "part").select("word", "part", F.explode("near").alias("near")).distinct()
    label = F.col("near").bitwiseAND(F.lit(1))
    seen = spool(stands.groupBy("word").agg(F.sum(label).alias("t"), F.sum(1 - label).alias("o")), "toxicity-words")
    t_all, o_all = (int(x or 0) for x in seen.agg(F.sum("t"), F.sum("o")).first())
    common = [bytes(r["word"]) for r in seen.filter(F.col("o") >= _reaching(seen, 4000)).orderBy(F.desc("o"), "word").limit(4000).collect()]
    share = t_all / max(1, t_all + o_all)
    q = F.col("t") / (F.col("t") + F.col("o"))
    likelihood = F.col("t") * F.log(q / share) + F.when(F.col("o") > 0, F.col("o") * F.log((1 - q) / (1 - share))).otherwise(0.0)
    telling = seen.filter((F.col("t") >= 3) & (q > share) & (F.col("t") > ratio * share * F.col("o"))).withColumn("g", likelihood).filter(F.col("g") >= evidence)
    toxic = [bytes(r["word"]) for r in telling.orderBy(F.desc("g"), "word").limit(1000).collect()]
    discard(seen)
    kept = set(toxic)
    common = [w for w in common if w not in kept]
    own = _pack(toxic, dict_bytes)
    shared = _pack(common, dict_bytes)
    model = Model(own, _pack(common[len(shared.split()) :], len(own)), shared.rjust(3 * FRAME))
    counts = spool(measure(sample, model, keep=["label"]).select("counts", "label"), "toxicity-counts")
    _calibrate(model, counts)
    discard(counts)
    return model


def _reaching(seen: DataFrame, most: int) -> int:
    """A power of two that at least most of seen.o reach, or 1: so partitions send hardly more rows than are kept."""
    sizes = {r["bits"]: r["n"] for r in seen.filter("o > 0").groupBy(F.floor(F.log2("o")).cast("int").alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    above = 0
    for bits in sorted(sizes, reverse=True):
        above += sizes[bits]
        if above >= most:
            return 1 << bits
    return 1


def _summed(counts: DataFrame, function) -> np.ndarray:
    """The sum of function(counts, label), a vector, over the rows of counts(counts, label). Each task sends its own sum."""

    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, 1 + len(MARGINS)).astype(float)
                total = total + function(x, batch.column(1).to_numpy().astype(float))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum([r["sums"] for r in counts.mapInArrow(run, "sums array<double>").collect()], axis=0)


def _calibrate(model: Model, counts: DataFrame, penalty: float = 1.0, rounds: int = 60) -> None:
    """Ridge logistic regression by damped Newton steps on counts(counts, label)."""
    n, *sums = _summed(counts, lambda c, _: np.r_[len(c), features(c).sum(0)])
    centre = np.array(sums) / n
    scale = np.maximum(np.sqrt(_summed(counts, lambda c, _: ((features(c) - centre) ** 2).sum(0)) / n), 1e-9)
    model.centre, model.scale = centre.tolist(), scale.tolist()
    size = len(centre) + 1
    ridge = np.diag([1e-6] + [penalty] * (size - 1))

    def at(w):
        def parts(c, label):
            x = np.hstack([np.ones((len(c), 1)), (features(c) - centre) / scale])
            z = x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return np.r_[np.logaddexp(0, z).sum() - label @ z, x.T @ (label - p), ((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel()]

        found = _summed(counts, parts)
        return found[0] + w @ ridge @ w / 2, found[1 : size + 1] - ridge @ w, found[size + 1 :].reshape(size, size) + ridge

    w = np.zeros(size)
    loss, slope, curve = at(w)
    for _ in range(rounds):
        step, pace = np.linalg.solve(curve, slope), 1.0
        if np.abs(step).max() < 1e-8:
            break
        before, (loss, slope, curve) = loss, at(w + step)
        while pace > 1e-6 and loss > before:
            pace /= 2
            loss, slope, curve = at(w + pace * step)
        w = w + pace * step
        if pace * np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()


def measure(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The kept columns with counts (windows, and windows by margin) and the score."""
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        meter = _meter(model)
        for batch in batches:
            counts = np.array([meter.count(t.as_py()) for t in batch.column(batch.num_columns - 1)], dtype=np.int64).reshape(batch.num_rows, 1 + len(MARGINS))
            score = _scores(model, counts)
            out = [*batch.columns[:-1], pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "counts", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields + ', ' if fields else ''}counts array<long>, score double")


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row of docs; the text is all that a score depends on.

    Null and empty texts get the score of a text without windows; repeated rows are scored
    each; a null id counts as not held out; an empty table gives no rows. Nothing is shuffled.
    """
    out = measure(docs.withColumn("__id", F.col(id_col)), model, text_col=text_col, keep=["__id"])
    return out.select(F.col("__id").alias("id"), F.coalesce(fold("__id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold, all columns as they were."""
    names = docs.columns
    numbered = docs.select(*(F.col(n).alias(f"__{k}") for k, n in enumerate(names)))
    passed = measure(numbered, model, text_col=f"__{names.index(text_col)}", keep=numbered.columns).filter(F.col("score") < threshold)
    return passed.select(*(F.col(f"__{k}").alias(n) for k, n in enumerate(names)))
