"""Language-model scoring by online logistic context mixing.

A text is a run of bytes and an end byte; each byte is eight binary decisions from its
highest bit down.  For every decision several predictors, one for each context length
in ``ORDERS``, look up the statistics of (hashed preceding bytes, bits so far) in the
training corpus.  Their log odds are combined by weights that the bit's place selects
(the gate), and after each decision the weights move along the gradient, so the mix
adapts to the text.  The sum of the decisions' log probabilities scores the text; over
its length it gives bits per byte.

* Statistics cover every training document.  Tasks add up tables of fixed size, and the
  tables of all tasks are summed block by block; the bit predictors, one signed byte for
  each cell, are broadcast (``ORDERS`` times ``CONTEXTS`` times 256 bytes, whatever the
  input).
* What grows with the corpus is the dictionary: the training count of every word, never
  cut.  A last, adaptive stage refines the mix of bits: each word of a text is given by
  the bits' probability or by the dictionary's (its count over all tokens, times the
  chance of its capitals).  The share of the dictionary is its mean responsibility for
  the words before, over the whole text; responsibilities follow from shares, in
  ``ROUNDS`` rounds.
* Start weights follow from the same statistics, so from every training document: the
  less an order alone loses on a place of the byte, the more of ``START`` it gets.
* The odds of a byte's eight decisions follow from the text alone, and each has weights
  of its own: all eight are mixed side by side.
* Texts are mixed in segments of ``SEGMENT`` bytes side by side; contexts reach across
  the borders of segments, weights start anew.  A text's score depends on the text and
  the model only, not on its neighbours.

Base score and dictionary need the training count of every token.  A task packs
documents in chunks and sends each distinct word of a chunk once: words are counted over
all chunks, and the counts go back to the chunks, where the texts are scored.  A word
that all texts share has one row for each chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.arrow import give_back, pieces
from lexiforge.llm.common import materialise

ORDERS = (1, 2, 3, 5)
CONTEXT_BITS = 14
CONTEXTS = 1 << CONTEXT_BITS
CELLS = CONTEXTS * 256
BLOCKS = 64
SCALE = 12.0
SMOOTHING = 0.3
RATE = 0.015
SEGMENT = 1024
#: Steps of a segment whose bytes and contexts are read at once.
STRIP = 16
MIX_BYTES = 2_000_000
#: Sum of the start weights of a bit's place, and the power by which a loss lowers a share.
START = 1.2
SHARPNESS = 4
#: Text refined by the dictionary at once, in bytes; its arrays take some 30 times as much.
REFINE_BYTES = 500_000
#: Text counted at once, in bytes.
COUNT_BYTES = 1_000_000
#: A chunk ends with this many distinct words or bytes of text.
CHUNK_WORDS = 400_000
CHUNK_BYTES = 24_000_000
#: Stands for the end of a text among the words; no word has a space.
END = b" end"
#: Chances of a word without capitals, with its first letter, with all letters, with others as capitals.
CAPITALS = (0.8, 0.15, 0.04, 0.01)
#: The dictionary's share before the first word, and how often responsibilities and shares are found from one another.
FIRST_SHARE = 0.1
ROUNDS = 4
#: Tasks that score chunks at most.
TASKS = 50_000
PAD = max(ORDERS)
#: For each bit of a byte: the cell that has its odds, and a row of signs by byte.
PATHS = np.array([[(byte | 256) >> (8 - j) for byte in range(256)] for j in range(8)])
SIGNS = np.array([[1 if byte >> (7 - j) & 1 else -1 for byte in range(256)] for j in range(8)], np.float32)


def held_out() -> Column:
    """crc32(doc_id as text) mod 7 is 2; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2


# --- bytes, contexts and statistics


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with zeros before and an end byte after each; start and length (with end) of each."""
    gap = bytes(PAD)
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t, b"\0")), np.uint8)
    length = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(length + PAD) - length
    return data, start, length


def contexts(data: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """The hashed context of every place of ``data``, a row for each order; found block by block."""
    out = np.empty((len(ORDERS), len(data)), np.uint16)
    padded = np.concatenate([np.zeros(PAD, np.uint8), data])
    for at in range(0, len(data), block):
        n = min(block, len(data) - at)
        key = np.zeros(n, np.uint64)
        for k in range(1, PAD + 1):
            key |= padded[at + PAD - k : at + PAD - k + n].astype(np.uint64) << np.uint64(8 * (k - 1))
            if k in ORDERS:
                mixed = (key + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                out[ORDERS.index(k), at : at + n] = mixed >> np.uint64(64 - CONTEXT_BITS)
    return out


def count(texts: list[bytes], into: np.ndarray) -> None:
    """Add the (context, byte) counts of ``texts`` to ``into``, a row of cells for each order."""
    data, start, length = laid_out(texts)
    used = np.ones(len(data), bool)
    for back in range(1, PAD + 1):
        used[start - back] = False
    byte = data[used]
    for row, context in zip(into, contexts(data)):
        cell = np.left_shift(context[used], 8, dtype=np.int64)
        cell |= byte
        np.add.at(row, cell, row.dtype.type(1))


def odds(counts: np.ndarray) -> np.ndarray:
    """Scaled log odds of a set bit by (context, bits so far) from counts by (context, byte)."""
    counts = counts.reshape(-1, 256).astype(np.float64)
    out = np.zeros(counts.shape, np.int8)
    for depth in range(8):
        halves = counts.reshape(len(counts), 1 << depth, 2, -1).sum(3)
        value = SCALE * np.log((halves[:, :, 1] + SMOOTHING) / (halves[:, :, 0] + SMOOTHING))
        out[:, 1 << depth : 2 << depth] = np.clip(np.rint(value), -127, 127)
    return out.reshape(-1)


def losses(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the scaled log odds ``table`` lose on the bits of ``counts`` by (context, byte), in nats, a sum for each place."""
    counts, out = counts.reshape(-1, 256), np.zeros(8)
    x = table.reshape(-1, 256) / SCALE
    for depth in range(8):
        halves = counts.reshape(len(counts), 1 << depth, 2, -1).sum(3)
        s = x[:, 1 << depth : 2 << depth]
        out[depth] = (halves[:, :, 1] * np.log1p(np.exp(-s)) + halves[:, :, 0] * np.log1p(np.exp(s))).sum()
    return out


def start_weights(lost: np.ndarray) -> np.ndarray:
    """Start weights by bit and order from the ``losses`` of all orders (a row each); even without any."""
    lost = np.maximum(lost.T, 1e-9)
    share = (lost.min(1, keepdims=True) / lost) ** SHARPNESS
    return (START * share / share.sum(1, keepdims=True)).astype(np.float32)


# --- mixing


def mix(tables: np.ndarray, weights: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each text by its bits, and the mean of the segments' last weights."""
    data, start, length = laid_out(texts)
    logs, last = places(tables, weights, data, start, length)
    return np.add.reduceat(logs, start) if texts else np.zeros(0), last


def places(tables: np.ndarray, weights: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each byte of texts that are ``laid_out`` (0 between them), and the mean of the segments' last weights.

    ``tables`` has the log odds by order and cell, ``weights`` the start weights by bit
    and order.  A bit has weights of its own and its odds follow from the text alone, so
    the eight decisions of a byte are mixed at once: arrays have eight rows of lanes.
    """
    hashed = contexts(data)
    parts = -(-length // SEGMENT)
    owner = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = start[owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, length[owner] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    lanes, k = len(first), len(ORDERS)
    active = lanes - np.searchsorted(size[::-1], np.arange(SEGMENT), side="right")
    # weights of the scaled odds; arrays of the loop are kept, a view for each number of lanes
    unit = np.float32(1 / SCALE)
    w = np.repeat((weights.astype(np.float32).T * unit)[:, :, None], lanes, axis=2)
    logs = np.zeros(len(data))
    rate = np.float32(RATE) * unit * unit
    flat, rows = tables.reshape(-1), (np.arange(k) * CELLS)[:, None, None]
    room = [np.empty(8 * k * lanes, x) for x in (np.int64, np.int8, np.float32)]
    lane = [np.empty(8 * lanes, np.float32) for _ in range(3)]
    for t0 in range(0, int(size.max(initial=0)), STRIP):
        # a strip of all lanes is read in the order of the text, then turned
        m = int(active[t0])
        at = (first[:m] + t0)[:, None] + np.arange(STRIP)
        base = np.left_shift(hashed.take(at, axis=1, mode="clip"), 8, dtype=np.int64)
        base += rows
        base = np.ascontiguousarray(base.transpose(2, 0, 1))
        byte = np.ascontiguousarray(data.take(at, mode="clip").T)
        chance = np.ones((STRIP, m), np.float32)
        for t in range(t0, min(t0 + STRIP, SEGMENT)):
            m = int(active[t])
            if not m:
                break
            cell, stored, s = (x[: 8 * k * m].reshape(k, 8, m) for x in room)
            dot, sign, other = (x[: 8 * m].reshape(8, m) for x in lane)
            came = byte[t - t0, :m]
            PATHS.take(came, axis=1, out=cell[0], mode="clip")
            SIGNS.take(came, axis=1, out=sign, mode="clip")
            for i in range(k - 1, -1, -1):
                np.add(cell[0], base[t - t0, i, :m], out=cell[i])
            flat.take(cell, out=stored, mode="clip")
            np.copyto(s, stored)
            now = w[:, :, :m]
            np.einsum("ijl,ijl->jl", now, s, out=dot)
            dot *= sign
            np.clip(dot, -11, 11, out=dot)
            np.exp(dot, out=dot)  # odds of the bit that came
            np.add(dot, 1, out=other)
            np.reciprocal(other, out=other)  # chance of the other bit: the error
            dot *= other
            sign *= rate
            other *= sign
            s *= other
            now += s
            np.multiply.reduce(dot, axis=0, out=chance[t - t0, :m])
        inside = np.arange(t0, t0 + STRIP) < size[: len(at), None]
        logs[at[inside]] = (np.log(chance) * np.float32(np.log10(np.e))).T[inside]
    return logs, w.mean(2).T / unit if lanes else weights


def capitals(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The chance of the capitals of each word, by ``CAPITALS``."""
    chance = np.full(len(begin), CAPITALS[0])
    capital = (data >= 65) & (data <= 90)
    if not capital.any():
        return chance
    sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(capital, dtype=np.int32)])
    n = sums[stop] - sums[begin]
    some = np.flatnonzero(n)
    n = n[some]
    sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(capital | ((data >= 97) & (data <= 122)), dtype=np.int32)])
    letters = sums[stop[some]] - sums[begin[some]]
    rest = np.where(n == letters, CAPITALS[2], CAPITALS[3] * 0.5 ** np.minimum(letters, 1000))
    chance[some] = np.where((n == 1) & capital[begin[some]], CAPITALS[1], rest)
    return chance


def refine(logs: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """log10 probability of each text after mixing the bits' ``logs`` with the dictionary.

    ``listed`` has the dictionary's log (base e) probability of every word of the texts,
    in order, without that of its capitals.  A text is a run of words, perhaps empty, each with the white space or end
    that follows.  The dictionary gives a word that isn't empty, the bits give any; what
    follows is given by the bits.  With the dictionary's share g, a word has (1 - g) times
    the bits' probability and g times the dictionary's.
    """
    total = np.add.reduceat(logs, start) if len(start) else np.zeros(0)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length - 1, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    word = inside & ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.concatenate([[False], word[:-1]])
    begin = np.flatnonzero(word & ~before)
    stop = np.flatnonzero(before & ~word)
    # places where an empty word is followed by white space or the end
    inside[start + length - 1] = True
    empty = np.flatnonzero(inside & ~word & ~before)
    known = np.searchsorted(begin, start)  # words before each text
    ends = np.empty(2 * len(begin), np.int64)
    ends[::2], ends[1::2] = begin, stop
    bits = np.add.reduceat(logs, ends)[::2] * np.log(10) if len(ends) else np.zeros(0)
    listed = listed + np.log(capitals(data, begin, stop))
    sums = np.zeros(len(begin) + 1)

    def share(at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The dictionary's share before word number ``at`` of all, in the text ``owner``."""
        return (FIRST_SHARE + sums[at] - sums[known[owner]]) / (1 + at - known[owner])

    owner = np.searchsorted(start, begin, side="right") - 1
    g = np.full(len(begin), 0.5)
    for _ in range(ROUNDS):
        odds = np.log(g) - np.log1p(-g) + listed - bits
        np.cumsum(1 / (1 + np.exp(np.clip(-odds, -700, 700))), out=sums[1:])
        g = share(np.arange(len(begin)), owner)
    gain = np.logaddexp(np.log1p(-g), np.log(g) + listed - bits)
    total += np.bincount(owner, weights=gain, minlength=len(start)) / np.log(10)
    owner = np.searchsorted(start, empty, side="right") - 1
    gain = np.log1p(-share(np.searchsorted(begin, empty), owner))
    return total + np.bincount(owner, weights=gain, minlength=len(start)) / np.log(10)


# --- the passes over the documents

_ROWS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("word", pa.binary()), ("idx", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
_ROWS_DDL = "kind int, chunk long, word binary, idx int, n long, data binary"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all lowest ones first: they compress better."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def numbers() -> defaultdict[bytes, int]:
    """Numbers of distinct tokens as they come; the end has the first."""
    known: defaultdict[bytes, int] = defaultdict(count_up().__next__)
    known[END]
    return known


def numbered(text: bytes, known: defaultdict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; new words go to ``known``."""
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _runs(texts: list[bytes], limit: int = MIX_BYTES) -> Iterator[slice]:
    """Runs of texts with at most ``limit`` bytes, or one text."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if texts:
        yield slice(start, len(texts))


class _Chunk:
    """Some documents, and the numbers of their distinct words."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.words = numbers()
        self.learned = [np.zeros(0, np.int32)]
        self.ids: list[int | None] = []
        self.texts: list[bytes] = []
        self.train: list[bool] = []

    def add(self, doc_id: int | None, text: bytes, train: bool) -> None:
        words = numbered(text, self.words)
        if train:
            self.learned.append(words)
        self.ids.append(doc_id)
        self.texts.append(text)
        self.train.append(train)
        self.bytes += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.words)
        learned = np.bincount(np.concatenate(self.learned), minlength=n).astype(np.int64)
        learned[0] = sum(self.train)
        head = [
            np.array([len(self.ids)], np.int64),
            np.array([i or 0 for i in self.ids], np.int64),
            np.array([len(t) for t in self.texts], np.int64),
            np.array([i is None for i in self.ids]),
            np.array(self.train, np.bool_),
        ]
        head = b"".join(x.tobytes() for x in head)
        press = zstandard.ZstdCompressor(level=1).compressobj(size=len(head) + self.bytes)
        packed = [press.compress(head), *map(press.compress, self.texts), press.flush()]
        self.texts, self.learned = [], []  # a chunk gives its rows once
        yield _row(0, self.number, b"".join(packed))
        del packed
        columns = [pa.array(np.ones(n, np.int32)), pa.array(np.full(n, self.number)), pa.array(list(self.words), pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(learned), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def _unpack(data: bytes) -> tuple[list[int | None], list[bytes], list[bool]]:
    """Ids, texts and training marks of a packed chunk."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, length = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    nulls, train = np.frombuffer(raw, np.bool_, 2 * n, 8 + 16 * n).reshape(2, n)
    ends = 8 + 18 * n + np.cumsum(length)
    texts = [raw[e - k : e] for e, k in zip(ends.tolist(), length.tolist())]
    return [None if x else i for i, x in zip(ids.tolist(), nulls.tolist())], texts, train.tolist()


def _row(kind: int, number: int, data: bytes) -> pa.RecordBatch:
    values = (kind, number, None, None, None, data)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ROWS)], schema=_ROWS)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of tokens (kind 0), their words (kind 1) and blocks of byte statistics (kind 2)."""
    give_back()  # what an earlier stage has left
    task, chunks = TaskContext.get().partitionId(), 0
    tables = np.zeros((len(ORDERS), CELLS), np.int32)
    chunk = _Chunk(task << 20)
    for rows, texts in pieces(batches, limit=COUNT_BYTES):
        ids, train = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "train"))
        count([t for t, x in zip(texts, train) if x], tables) if any(train) else None
        for text, i, learn in zip(texts, ids, train):
            chunk.add(i, text, learn)
            if len(chunk.words) >= CHUNK_WORDS or chunk.bytes >= CHUNK_BYTES:
                yield from chunk.rows()
                chunks += 1
                chunk = _Chunk((task << 20) + chunks)
                give_back()
    if chunk.ids:
        yield from chunk.rows()
    del chunk
    give_back()
    press = zstandard.ZstdCompressor(level=1)
    for i, row in enumerate(tables):
        for j, block in enumerate(row.reshape(BLOCKS, -1)):
            if block.any():
                yield _row(2, i * BLOCKS + j, press.compress(_planes(block)))


def _add_blocks(table: pa.Table) -> pa.Table:
    """Log odds of one block from the sum of its tables, and what they lose on it."""
    total = np.zeros(CELLS // BLOCKS, np.int64)
    unpack = zstandard.ZstdDecompressor()
    for data in table.column("data"):
        total += _numbers(unpack.decompress(data.as_py()))
    found = odds(total)
    return pa.table([table.column("chunk").slice(0, 1).combine_chunks(), pa.array([found.tobytes()], pa.binary()), pa.array([losses(total, found).tobytes()], pa.binary())], names=["chunk", "odds", "lost"])


def corpus_words(gathered: DataFrame) -> tuple[DataFrame, int, int]:
    """(chunk, idx, c): the training count of each word of each chunk; the numbers of training tokens and of distinct ones."""
    word = Window.partitionBy("word")
    words = gathered.where("kind = 1").select("word", "chunk", "idx", "n")
    words = words.withColumn("c", F.sum("n").over(word)).withColumn("one", F.row_number().over(word.orderBy("chunk")) == 1)
    words = materialise(words.select("chunk", "idx", "c", "one"), "lm-words")
    sums = words.where("one").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    return words.select("chunk", "idx", "c"), int(sums["n"] or 0), int(sums["v"] or 0)


def score_texts(tables: np.ndarray, weights: np.ndarray, texts: list[bytes], words: list[np.ndarray], chance: np.ndarray) -> np.ndarray:
    """log10 probability of each text; ``words`` are its words as numbers, ``chance`` the dictionary's log (base e) by number.

    Texts are mixed in long runs, for speed, and refined in short ones, for memory.
    """
    out = [np.zeros(0)]
    for run in _runs(texts):
        data, start, length = laid_out(texts[run])
        logs, _ = places(tables, weights, data, start, length)
        for part in _runs(texts[run], REFINE_BYTES):
            low, high = int(start[part][0]) - PAD, int(start[part][-1] + length[part][-1])
            listed = chance[np.concatenate(words[run][part])]
            out.append(refine(logs[low:high], data[low:high], start[part] - low, length[part], listed))
    return np.concatenate(out)


def model(gathered: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log odds by order and cell, and start weights by bit and order, from the statistics of all tasks."""
    blocks = gathered.where("kind = 2").select("chunk", "data").groupBy("chunk").applyInArrow(_add_blocks, "chunk long, odds binary, lost binary")
    tables = np.zeros((len(ORDERS) * BLOCKS, CELLS // BLOCKS), np.int8)
    lost = np.zeros((len(ORDERS), BLOCKS, 8))
    for row in blocks.toLocalIterator():  # ORDERS times BLOCKS rows
        tables[row["chunk"]] = np.frombuffer(row["odds"], np.int8)
        lost[divmod(row["chunk"], BLOCKS)] = np.frombuffer(row["lost"])
    return tables.reshape(len(ORDERS), CELLS), start_weights(lost.sum(1))


SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learned from the rows that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10
    probability of the text and its end) and bits_per_byte.  A null text counts as empty,
    null ids are training documents, repeated rows score alike and are learned each
    time; other columns are ignored; an empty table gives no rows, and without training
    rows all odds are even.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out()).alias("train"), F.col("text").cast("string").alias("text"))
    gathered = materialise(rows.mapInArrow(_gather, _ROWS_DDL), "lm", partition_by=["kind"])
    words, tokens, kinds = corpus_words(gathered)
    tables, weights = model(gathered)
    sent = spark.sparkContext.broadcast(tables)

    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        idx, c = counts.column("idx").to_numpy(), counts.column("c").to_numpy()
        of = np.zeros(len(idx), np.int64)
        of[idx] = c
        ids, texts, train = _unpack(chunk.column("data")[0].as_py())
        known = numbers()
        words = [numbered(t, known) for t in texts]
        del known
        give_back()
        n = np.array([len(x) + 1 for x in words])
        hits = np.array([np.count_nonzero(of[x]) for x in words]) + (of[0] > 0)
        logs = np.log10(of + 1.0)
        base = np.array([logs[x].sum() for x in words]) + logs[0] - n * np.log10(float(tokens + kinds + 1))
        with np.errstate(divide="ignore"):
            chance = np.log(of / (tokens + 1.0))
        logs = score_texts(sent.value, weights, texts, words, chance)
        bits = -logs / np.log10(2) / np.array([len(t) + 1 for t in texts])
        give_back()
        values = [pa.array(ids, pa.int64()), pa.array([not x for x in train]), pa.array(n), pa.array(hits), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(logs), pa.array(bits)]
        return pa.table(values, names=[f.split()[0] for f in SCORED_DDL.split(", ")])

    chunks = gathered.where("kind = 0").select("chunk", "data")
    parts = min(TASKS, 2 * chunks.count() + 1)
    return chunks.repartition(parts, "chunk").groupBy("chunk").cogroup(words.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(run, SCORED_DDL)
