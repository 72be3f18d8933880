"""Scores of texts by an n-gram model of the corpus: Elias-Fano tries in mapped files, one per shard."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow.fs import FileSystem
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, fresh_dir, spool
from .eliasfano import EliasFano, Lists, Mapped, packed
from .ngrams import Block, blocks, identify, mask, same_bytes
from .tokens import mixed

BLANK = mask(BLANKS.encode())
#: Bytes of text that are worked on at once, and words that a task adds up before it sends them.
BLOCK, SENT = 4 << 20, 1 << 18
#: Fixed numbers of tokens: the end of a text, and what stands before its first word. Words follow.
END, START, FIRST = 0, 1, 2
#: What is taken from each count, and what is added to each count of a single token.
DISCOUNT, ADDED = 0.75, 0.1
#: Steps of a stored probability per decade.
STEPS = 4096
#: Bits of a token's number within a block; a block's different words are fewer, as each but a few takes four bytes with its blank.
LOCAL = 21


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


def unquantised(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -STEPS)


@dataclass
class Model:
    """Where the shards are, and the corpus's totals. tokens: all, kinds: different ones, texts: ends, in training."""

    base: str
    word_bits: int
    word_starts: list[int]
    shards: int
    shard_tokens: int
    tokens: int
    kinds: int
    texts: int

    def opened(self, name: str):
        """A shard's file: mapped where it lies if tasks see it there, else Spark's copy of it."""
        path = f"{self.base.removeprefix('file://')}/{name}" if self.base.startswith("file:") else SparkFiles.get(self.written(name))
        return _words(path) if name.startswith("words") else _shard(path)

    def ship(self, spark: SparkSession, what: str, number: int) -> None:
        """Has Spark fetch such files to each executor where tasks can't map them from the shared folder."""
        if not self.base.startswith("file:"):
            for k in range(number):
                spark.sparkContext.addFile(f"{self.base}/{self.written(f'{what}-{k}')}")

    def written(self, name: str) -> str:
        return name if self.base.startswith("file:") else f"{os.path.basename(self.base)}-{name}"

    def once(self, counts: np.ndarray) -> np.ndarray:
        """The probability of a token of such a count by itself."""
        return (counts + ADDED) / (self.tokens + ADDED * (self.kinds + 1))

    def shard(self, second: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The shard of a context (first + 1 or 0 for any, second). A frequent second word's contexts are dealt over several."""
        spread = np.maximum(1, -(-2 * counts // self.shard_tokens)).astype(np.uint64)
        return mixed(mixed(second.astype(np.uint64)) + mixed(first.astype(np.uint64)) % spread) % np.uint64(self.shards)


@functools.lru_cache(4096)
def _words(path: str):
    file = Mapped(path)
    return file.sequence("hashes"), file.sequence("offsets"), file["blob"], file["counts"]


@functools.lru_cache(4096)
def _shard(path: str):
    file = Mapped(path)
    return file.sequence("seconds"), file.lists("contexts"), file.lists("words"), file.lists("next"), file["left"], file["share"]


def word_numbers(model: Model, block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, count) of the words at these places of a block; -1 and 0 for words that training doesn't hold. Bytes decide, not hashes."""
    numbers, counts = np.full(len(which), -1, np.int64), np.zeros(len(which), np.int64)
    hashes = block.hashes[which]
    bits = np.uint64(64 - model.word_bits)
    shards = (hashes >> bits).astype(np.int64) if model.word_bits else np.zeros(len(which), np.int64)
    order = np.argsort(shards, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else ():
        shard = int(shards[some[0]])
        known, offsets, blob, totals = model.opened(f"words-{shard}")
        at = known.find(hashes[some])
        some, at = some[at >= 0], at[at >= 0]
        while len(some):  # once, but for words with one hash
            start, end = np.split(offsets.get(np.concatenate([at, at + 1])).astype(np.int64), 2)
            sizes = block.ends[which[some]] - block.starts[which[some]]
            same = (end - start == sizes) & same_bytes(block.text, block.starts[which[some]], blob, start, np.minimum(sizes, end - start))
            numbers[some[same]], counts[some[same]] = FIRST + model.word_starts[shard] + at[same], totals[at[same]]
            some, at = some[~same], at[~same] + 1
            more = at < known.n
            some, at = some[more], at[more]
            more = known.get(at) == hashes[some]
            some, at = some[more], at[more]
    return numbers, counts


class Tokens:
    """The tokens of a column of texts: per block the number of each token's kind within the block, and the row of each token.

    Kinds are END, START and the block's words from FIRST on. A text begins with START twice. The first two tokens stand before the block's own.
    """

    def __init__(self, rows: int):
        self.rows, self.begun, self.tail = rows, -1, []

    def of(self, block: Block, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = min(block.last, self.rows - 1)
        touched = np.arange(block.first, top + 1)
        began, closed = 2 * (touched > self.begun), (touched < block.last).astype(np.int64)
        rows = block.rows[block.carried :] - block.first
        words = np.bincount(rows, minlength=len(touched)) if len(touched) else np.zeros(0, np.int64)
        sizes = began + words + closed
        offsets = np.cumsum(sizes) - sizes
        found = np.full(int(sizes.sum()), START, np.int64)
        found[(offsets + began - (np.cumsum(words) - words))[rows] + np.arange(len(rows))] = numbers[block.carried :] + FIRST
        found[(offsets + began + words)[closed == 1]] = END
        self.begun = top
        return found, np.repeat(touched, sizes)


def _sequences(batch_texts: pa.Array, model: Model, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kinds, rows, number of each kind, count of each kind) per block; kinds and rows have two tokens in front that don't count."""
    state, tail = Tokens(len(batch_texts)), None
    for block in blocks(batch_texts, BLANK, block=size):
        firsts, numbers = identify(block)
        known, counts = word_numbers(model, block, firsts)
        kinds, rows = state.of(block, numbers)
        known, counts = np.concatenate([[END, START], known]), np.concatenate([[model.texts, model.texts], counts])
        # the last two tokens of a text that goes on get kinds of their own
        before = tail if tail is not None else (np.array([START, START]), np.array([model.texts] * 2))
        kinds = np.concatenate([len(known) + np.arange(2), kinds])
        known, counts = np.concatenate([known, before[0]]), np.concatenate([counts, before[1]])
        tail = known[kinds[-2:]], counts[kinds[-2:]]
        yield kinds, rows, known, counts


def _keys(kinds: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the real tokens (places), the keys (second, any, token) and (second, first, token), which sort by context."""
    second, token, first = kinds[real - 1] << 2 * LOCAL, kinds[real], kinds[real - 2] + 1 << LOCAL
    return second | token, second | first | token


def _parts(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(second, first + 1 or 0 for any or -1 for an unknown first, token, kind of the second) of keys."""
    local = keys >> LOCAL & (1 << LOCAL) - 1
    kind = keys >> 2 * LOCAL
    first = np.where(local == 0, 0, known[np.maximum(local - 1, 0)] + 1)
    first[(local > 0) & (first == 0)] = -1
    return known[kind], first, known[keys & (1 << LOCAL) - 1], kind


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows that come sorted by their first column, one table per value of it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b > a:
                if held and keys[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(keys[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _write(base: str, name: str, content: bytes) -> None:
    """Under another name first, so that a task that is lost or runs twice leaves whole files only."""
    store, root = FileSystem.from_uri(base)
    beside = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(content)
    store.move(beside, f"{root}/{name}")


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(hash, word, n) of the words of docs(text)."""

    def run(batches):
        total: dict[bytes, list[int]] = {}

        def told():
            out = pa.RecordBatch.from_arrays([pa.array([v[0] for v in total.values()], pa.uint64()).view(pa.int64()), pa.array(list(total), pa.binary()), pa.array([v[1] for v in total.values()], pa.int64())], names=["hash", "word", "n"])
            total.clear()
            return out

        for batch in batches:
            for block in blocks(batch.column(0), BLANK, block=BLOCK):
                firsts, numbers = identify(block)
                times = np.bincount(numbers[block.carried :], minlength=len(firsts))
                for k, h, n in zip(firsts.tolist(), block.hashes[firsts].tolist(), times.tolist(), strict=True):
                    if (entry := total.get(word := block.word(k))) is None:
                        total[word] = [h, n]
                    else:
                        entry[1] += n
                if len(total) >= SENT:
                    yield told()
        if total:
            yield told()

    return docs.mapInArrow(run, "hash long, word binary, n long").filter("n > 0").groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _word_file(table: pa.Table, bits: int) -> tuple[bytes, int]:
    table = pa.table({"hash": table.column("hash").to_numpy().view(np.uint64), "word": table.column("word").cast(pa.large_binary()), "n": table.column("n")})
    table = table.take(pc.sort_indices(table, sort_keys=[("hash", "ascending"), ("word", "ascending")]))
    sizes = pc.binary_length(table.column("word")).to_numpy()
    words = table.column("word").combine_chunks() if table.num_rows else None
    blob = memoryview(words.buffers()[2])[: int(sizes.sum())] if sizes.sum() else b""
    tree = {"hashes": EliasFano.arrays(table.column("hash").to_numpy()), "offsets": EliasFano.arrays(np.concatenate([[0], sizes]).astype(np.int64).cumsum()), "blob": np.frombuffer(blob, np.uint8), "counts": table.column("n").to_numpy()}
    return packed(tree), table.num_rows


def ordered(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by these columns, none of them negative; columns that fit into 63 bits side by side are sorted as one."""
    keys, room = [], 0
    for column in reversed(columns):
        bits = int(column.max(initial=0)).bit_length()
        if keys and room + bits <= 63:
            keys[-1] = keys[-1] | column << room
            room += bits
        else:
            keys.append(column)
            room = bits
    return np.lexsort(keys)


def gram_file(second: np.ndarray, first: np.ndarray, token: np.ndarray, n: np.ndarray, least: int) -> bytes:
    """The trie of a shard's n-grams (second, first + 1 or 0 for any, token, occurrences); repeated ones are added up.

    A context's successors are told by their place among all words that follow its second word in this shard. share is what the
    counts less the discount give each successor, left is what the others keep. The arrays given are sorted where they are, as a shard's take most of a task's memory.
    """
    order = ordered(second, first, token)
    for column in (second, first, token, n):
        column[:] = column[order]
    del order
    new = lambda *columns: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.zeros(0, np.int64)
    grams = new(second, first, token)
    n = np.add.reduceat(n, grams) if len(grams) else n
    for column in (second, first, token):
        column[: len(grams)] = column[grams]
    second, first, token = (column[: len(grams)] for column in (second, first, token))
    del grams
    contexts = new(second, first)
    total = np.add.reduceat(n, contexts) if len(contexts) else n
    total = np.repeat(total, np.diff(np.append(contexts, len(n))))
    keep = n >= least
    second, first, token, n, total = second[keep], first[keep], token[keep], n[keep], total[keep]
    share, contexts, tops = (n - DISCOUNT) / total, new(second, first), new(second)
    left = 1 - (np.add.reduceat(share, contexts) if len(contexts) else share)
    group = np.repeat(np.arange(len(tops)), np.diff(np.append(tops, len(n))))
    by_word = ordered(group, token)
    other = new(group[by_word], token[by_word])
    words_of, words = group[by_word][other], token[by_word][other]
    place = np.empty(len(n), np.int64)
    place[by_word] = np.repeat(np.arange(len(other)), np.diff(np.append(other, len(n))))
    firsts = np.searchsorted(words_of, np.arange(len(tops)))
    sizes = lambda starts, end: np.diff(np.append(starts, end))
    tree = {
        "seconds": EliasFano.arrays(second[tops]), "contexts": Lists.arrays(sizes(np.searchsorted(contexts, tops), len(contexts)), first[contexts]),
        "words": Lists.arrays(np.bincount(words_of, minlength=len(tops)) if len(tops) else np.zeros(0, np.int64), words),
        "next": Lists.arrays(sizes(contexts, len(n)), place - firsts[group] if len(n) else place), "left": quantised(left), "share": quantised(share),
    }
    return packed(tree)


def _grams(docs: DataFrame, model: Model) -> DataFrame:
    """(shard, grams) of docs(text): per block and shard its n-grams of two and three tokens, sorted, as compressed columns."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for kinds, _, known, counts in _sequences(batch.column(0), model, BLOCK // 2):  # a block's n-grams take some sixty bytes for one of text
                real = 2 + np.flatnonzero(kinds[2:] != START)
                keys, n = zip(*(np.unique(k, return_counts=True) for k in _keys(kinds, real)), strict=True)
                second, first, token, kind = _parts(np.concatenate(keys), known)
                shards = model.shard(second, first, counts[kind])
                order = np.argsort(shards.astype(np.uint16) if model.shards < 1 << 16 else shards, kind="stable")
                table, shards = np.stack([second, first, token, np.concatenate(n)])[:, order], shards[order].astype(np.int64)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]]) if len(shards) else np.zeros(1, np.int64)
                runs = [pack.compress(np.ascontiguousarray(table[:, a:b]).view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shards[starts[:-1]]), pa.array(runs, pa.binary())], names=["shard", "grams"])

    return docs.mapInArrow(run, "shard long, grams binary")


def _unpacked(runs: pa.ChunkedArray, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    """(second, first, token, n) of compressed runs of n-grams, put one after the other into one table, so that none is there twice."""
    sizes = np.array([zstandard.frame_content_size(x.as_buffer()) // 32 for x in runs], np.int64)
    out, at = np.empty((4, int(sizes.sum())), np.int64), 0
    for x, n in zip(runs, sizes.tolist(), strict=True):
        out[:, at : at + n].view(np.uint8).reshape(4, n, 8)[:] = np.frombuffer(unpack.decompress(x.as_buffer()), np.uint8).reshape(4, 8, n).transpose(0, 2, 1)
        at += n
    return out


def train(docs: DataFrame, *, text_col: str = "text", least: int = 2, shard_tokens: int = 1 << 21) -> Model:
    """A model of two words' context over all texts of docs, in a folder of shards.

    Words are counted first and numbered by the range of their hash; then every n-gram is counted. A block adds up its own and sends
    them, sorted, to the shards of their contexts; a shard holds about shard_tokens tokens, as a frequent word's contexts are dealt over several, and
    is built by one task. N-grams of fewer than `least` occurrences aren't kept; what they had goes to the shorter context, so
    that the probabilities of a context still sum to 1. Repeated rows count each; null texts are empty ones, whose only token is the end.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(text_col).cast("string").alias("text"))
    base = fresh_dir(spark, "lm")
    store, root = FileSystem.from_uri(base if "://" in base else f"file://{base}")
    store.create_dir(root)
    base = base if "://" in base else f"file://{base}"
    with Scratch():
        words = spool(_vocabulary(docs), "lm-words")
        kinds, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        texts, bits = docs.count(), max(0, (kinds >> 19).bit_length())
        model = Model(base, bits, [0] * (1 << bits), max(1, -(-(tokens + texts) // shard_tokens)), shard_tokens, tokens + texts, kinds + (texts > 0), texts)

        def word_files(batches):
            for shard, table in gathered(batches):
                content, n = _word_file(table, bits)
                _write(base, model.written(f"words-{shard}"), content)
                yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [n]}, pa.schema([("shard", pa.int64()), ("n", pa.int64())]))

        dealt = lambda df: df.repartition("shard").sortWithinPartitions("shard")
        made = dict(map(tuple, dealt(words.select((F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0)).cast("long").alias("shard"), "hash", "word", "n")).mapInArrow(word_files, "shard long, n long").collect()))
    for shard in range(1 << bits):
        if shard not in made:
            _write(base, model.written(f"words-{shard}"), _word_file(pa.table({"hash": pa.array([], pa.int64()), "word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())}), bits)[0])
    model.word_starts = np.cumsum([0, *(made.get(k, 0) for k in range(1 << bits))])[:-1].tolist()
    model.ship(spark, "words", 1 << bits)

    def gram_files(batches):
        unpack = zstandard.ZstdDecompressor()
        for shard, table in gathered(batches):
            _write(base, model.written(f"grams-{shard}"), gram_file(*_unpacked(table.column("grams"), unpack), least))
            yield pa.RecordBatch.from_pydict({"shard": [shard]}, pa.schema([("shard", pa.int64())]))

    there = {r.shard for r in dealt(_grams(docs, model)).mapInArrow(gram_files, "shard long").collect()}
    none = np.zeros(0, np.int64)
    for shard in set(range(model.shards)) - there:
        _write(base, model.written(f"grams-{shard}"), gram_file(none, none, none, none, least))
    model.ship(spark, "grams", model.shards)
    return model


def _by_shard(model: Model, second: np.ndarray, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in the arrays) of contexts."""
    shards = model.shard(second, first, counts)
    order = np.argsort(shards.astype(np.uint16) if model.shards < 1 << 16 else shards, kind="stable")
    shards = shards[order]
    starts = np.flatnonzero(np.concatenate([[len(shards) > 0], shards[1:] != shards[:-1]]))
    yield from zip(shards[starts].tolist(), np.split(order, starts[1:]), strict=False)


class Contexts:
    """The contexts (first + 1 or 0 for any, second) as the shards hold them: what each leaves, and where its successors are."""

    def __init__(self, model: Model, second: np.ndarray, first: np.ndarray, counts: np.ndarray):
        self.model, self.left = model, np.ones(len(second))
        self.shard, self.group, self.at = (np.full(len(second), -1, np.int64) for _ in range(3))
        asked = np.flatnonzero((second >= 0) & (first >= 0))
        for shard, some in _by_shard(model, second[asked], first[asked], counts[asked]):
            seconds, contexts, _, _, lefts, _ = model.opened(f"grams-{shard}")
            some = asked[some]
            group = seconds.find(second[some])
            some, group = some[group >= 0], group[group >= 0]
            at = contexts.find(group, first[some])[0]
            some, group, at = some[at >= 0], group[at >= 0], at[at >= 0]
            self.shard[some], self.group[some], self.at[some] = shard, group, at
            self.left[some] = unquantised(lefts[at])

    def shares(self, which: np.ndarray, token: np.ndarray) -> np.ndarray:
        """What each token has after the named context, 0 if the model doesn't hold it. The token's place among the words after the second one leads to it."""
        out = np.zeros(len(which))
        asked = np.flatnonzero((self.at[which] >= 0) & (token >= 0))
        shards = self.shard[which[asked]]
        order = np.argsort(shards.astype(np.uint16) if self.model.shards < 1 << 16 else shards, kind="stable")
        asked, shards = asked[order], shards[order]
        starts = np.flatnonzero(np.concatenate([[len(shards) > 0], shards[1:] != shards[:-1]]))
        for shard, some in zip(shards[starts].tolist(), np.split(asked, starts[1:]), strict=False):
            _, _, words, following, _, shares = self.model.opened(f"grams-{shard}")
            whole, place = words.find(self.group[which[some]], token[some])
            some, place = some[whole >= 0], place[whole >= 0]
            where = following.find(self.at[which[some]], place)[0]
            out[some[where >= 0]] = unquantised(shares[where[where >= 0]])
        return out


def probabilities(model: Model, kinds: np.ndarray, real: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The probability of each real token (places in kinds) after the two before it.

    Whatever the model keeps of a longer n-gram it keeps of its parts. So pairs are looked up first, then the contexts that are
    kept pairs, then the triples both of whose pairs are kept.
    """
    token = kinds[real]
    pairs, pair = np.unique(kinds[real - 1] << LOCAL | token, return_inverse=True)
    pair_second, pair_token = pairs >> LOCAL, pairs & (1 << LOCAL) - 1
    heads, head = np.unique(pair_second, return_inverse=True)
    single = Contexts(model, known[heads], np.zeros(len(heads), np.int64), counts[heads])
    share = single.shares(head, known[pair_token])
    p = share[pair] + single.left[head[pair]] * model.once(counts[token])
    # the pair before a token: that of the token before, which the first token of a text or block has none of
    before = kinds[real - 2] << LOCAL | kinds[real - 1]
    follows = np.flatnonzero((real[1:] == real[:-1] + 1))
    previous = np.full(len(real), -1, np.int64)
    previous[follows + 1] = pair[follows]
    other = np.flatnonzero(previous < 0)
    more, extra = np.unique(before[other], return_inverse=True)
    previous[other] = len(pairs) + extra
    pairs, held = np.concatenate([pairs, more]), np.concatenate([share > 0, np.ones(len(more), bool)])
    asked = np.flatnonzero(held)
    second = pairs[asked] & (1 << LOCAL) - 1
    first = known[pairs[asked] >> LOCAL]
    double = Contexts(model, known[second], np.where(first >= 0, first + 1, -1), counts[second])
    number = np.full(len(pairs), -1, np.int64)
    number[asked] = np.where(double.at >= 0, np.arange(len(asked)), -1)
    context = number[previous]
    some = np.flatnonzero(context >= 0)
    p[some] *= double.left[context[some]]
    both = some[share[pair[some]] > 0]
    triples, triple = np.unique(context[both] << LOCAL | token[both], return_inverse=True)
    p[both] += double.shares(triples >> LOCAL, known[triples & (1 << LOCAL) - 1])[triple]
    return p


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per row of docs.

    Tokens are the blank-separated words with A-Z in lower case and one end. base_score adds up log10 of each token's probability by
    itself, score that after the two tokens before it: the share of the longest context, and what it leaves times that of the shorter one. Null texts
    are empty; rows without an id and repeated rows are scored each; an empty table gives no rows. Long texts are scored in blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows_n = batch.num_rows
            n, found, base, whole = np.zeros(rows_n, np.int64), np.zeros(rows_n, np.int64), np.zeros(rows_n), np.zeros(rows_n)
            for kinds, rows, known, counts in _sequences(batch.column(1), model):
                real = 2 + np.flatnonzero(kinds[2:] != START)
                p = probabilities(model, kinds, real, known, counts)
                here = rows[real - 2]
                add = lambda values: np.bincount(here, values, rows_n)  # noqa: B023, E731
                n += np.bincount(here, minlength=rows_n)
                found += np.bincount(here[counts[kinds[real]] > 0], minlength=rows_n)
                base += add(np.log10(model.once(counts))[kinds[real]])
                whole += add(np.log10(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(found), pa.array(base), pa.array(whole)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    """Whether crc32 of the id as text leaves 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
