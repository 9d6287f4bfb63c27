"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

A text is cut by the tokenizer's pattern; each distinct word starts as an array of
single bytes, and ranked merges are folded over it: the adjacent pair with the lowest
rank, the leftmost at a tie, becomes one piece until no pair has a rank.  Decoding
concatenates the binary pieces of the ids.

Two forms give the same ids:

* ``encode_words`` folds with Spark's higher-order functions over a table of distinct
  words, with the ranks as a literal map (hash buckets in an array, as a lookup in
  Spark's own map type passes all its keys).
* ``encode`` and ``digests`` fold over the distinct words of a task, in Arrow batches,
  and put the results straight back into the texts.  This is a map without any shuffle;
  the first form would have to send every word of every text to the word's entry and
  back.  The README has the figures.

Ranks are read on the driver, where ``path`` is a file of the tokenizer package, and
broadcast; their number is fixed by the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrow import batch_of, give_back, pieces

#: Distinct words whose ids a task keeps in each of two generations: when the younger
#: is full it becomes the older, whose words are forgotten and, if met again, found anew.
MEMO_WORDS = 150_000
#: More than any rank: the pair isn't a token.
NONE = 1 << 60
BUCKETS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: ranked merges folded over its bytes."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(word) > 200:
        return _merge_long(parts, ranks)
    get = ranks.get
    pairs = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) != NONE:
        at = pairs.index(best)
        parts[at] += parts.pop(at + 1)
        del pairs[at]
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], NONE)
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], NONE)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of pairs: long runs need no scan for each merge."""
    from heapq import heapify, heappop, heappush

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    piece: list[bytes | None] = list(parts)
    heap = [(rank, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)
    while heap:
        _, i, joined = heappop(heap)
        j = after[i] if piece[i] is not None else n
        if j >= n or piece[i] + piece[j] != joined:  # one of the two has changed since
            continue
        piece[i], piece[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (rank := ranks.get(piece[a] + piece[b])) is not None:
                heappush(heap, (rank, a, piece[a] + piece[b]))
    return [ranks[p] for p in piece if p is not None]


class Encoder:
    """Encodes texts, keeping the ids of the distinct words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.ids: dict[str, list[int]] = {}
        self.memo = MEMO_WORDS
        self.written: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens."""
        out: list[int] = []
        for word in self.find(text):
            ids = self.ids.get(word)
            if ids is None:
                if len(self.ids) >= self.memo:
                    self.ids.clear()
                ids = self.ids[word] = merge(word.encode(), self.ranks)
            out += ids
        return out

    def forget(self) -> None:
        """Drop the words met, so that an idle worker holds no more than the ranks."""
        self.ids, self.written, self.older = {}, {}, {}

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the pieces, concatenated."""
        return b"".join(map(self.pieces.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded bytes."""
        words = self.find(text)
        known = self.written
        for word in set(words).difference(known):
            if (old := self.older.get(word)) is None:
                ids = merge(word.encode(), self.ranks)
                old = (",".join(map(str, ids)).encode(), self.decode(ids))
            known[word] = old
        found = [known[w] for w in words]
        ids = b",".join([a for a, _ in found])
        decoded = b"".join([b for _, b in found])
        if len(known) > self.memo:
            self.older, self.written = known, {}
        return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=1)
def _encoder(key: object) -> Encoder:
    ranks, pattern = key.value
    return Encoder(ranks, pattern)


class _Key:
    """A broadcast variable that compares by its id, so that a worker keeps one encoder for many tasks."""

    def __init__(self, sent) -> None:
        self.sent, self.id = sent, sent._jbroadcast.id() if sent._jbroadcast is not None else None

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)

    @property
    def value(self):
        return self.sent.value

    def __hash__(self) -> int:
        return hash(self.id)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Key) and other.id == self.id


def _packed(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key), F.col("text").cast("string").alias("text"))


def _kind(docs: DataFrame, key: str) -> str:
    return docs.select(key).schema[0].dataType.simpleString()


def digests(docs: DataFrame, path: str, pattern: str, memo: int = MEMO_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    A null text counts as empty (no ids); rows may repeat; other columns are ignored;
    an empty table gives no rows; texts of any length are encoded whole.  ``memo`` is the
    number of words kept in a generation; it changes memory and time, not the result.
    """
    sent = _Key(docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        encoder.memo = memo
        for rows, texts in pieces(batches):
            n, ids, decoded = zip(*(encoder.digest(t.decode("utf-8", "replace")) for t in texts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        encoder.forget()
        give_back()

    ddl = f"doc_id {_kind(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _packed(docs, "doc_id").mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has no ids."""
    sent = _Key(docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        for rows, texts in pieces(batches):
            ids = pa.array([encoder.encode(t.decode("utf-8", "replace")) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], names=["doc_id", "ids"])
        encoder.forget()
        give_back()

    return _packed(docs, "doc_id").mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of ids; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sent.value
        schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield batch_of(schema, batch.column(0), texts)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: hash buckets, each a text of ",hash:rank" entries."""
    buckets = [""] * BUCKETS
    for token, rank in ranks.items():
        key = xxhash.xxh64_intdigest(token, 42)
        key -= (1 << 64) if key >> 63 else 0
        buckets[key % BUCKETS] += f",{key}:{rank}"
    return F.split(F.lit(";".join(buckets)), ";")


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Column ids (array of bigint) added to a table of distinct words (column ``word``).

    Built-in functions only; a null word has null ids, an empty one none.
    """
    known = rank_map(ranks)

    def rank(piece: Column) -> Column:
        key = F.xxhash64(piece)
        bucket = F.element_at(known, (F.pmod(key, F.lit(BUCKETS)) + 1).cast("int"))
        after = F.split_part(bucket, F.concat(F.lit(","), key.cast("string"), F.lit(":")), F.lit(2))
        return F.nullif(F.split_part(after, F.lit(","), F.lit(1)), F.lit("")).cast("bigint")

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, 1, F.size(parts) - 1),
            lambda left, i: F.struct(rank(F.concat(left, F.get(parts, i + 1))).alias("rank"), i.alias("at")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))["at"]
        merged = F.concat(
            F.slice(parts, F.lit(1), best),
            F.array(F.concat(F.get(parts, best), F.get(parts, best + 1))),
            F.slice(parts, best + 3, F.size(parts)),
        )
        return F.when((F.size(parts) < 2) | best.isNull(), parts).otherwise(merged)

    raw = F.encode("word", "UTF-8")
    n = F.octet_length(raw)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    single = F.transform(places, lambda i: F.substring(raw, i, F.lit(1)))
    folded = F.aggregate(F.slice(places, 2, F.greatest(n, F.lit(1))), single, step, lambda parts: F.transform(parts, rank))
    return words.withColumn("ids", F.when(F.col("word").isNotNull(), folded))


def decode_words(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Column bytes added to a table with ids: the binary pieces, concatenated."""
    tokens = ",".join(token.hex() for token, _ in sorted(ranks.items(), key=lambda x: x[1]))
    known = F.transform(F.split(F.lit(tokens), ","), lambda x: F.unhex(x))
    piece = lambda i: F.element_at(known, (i + 1).cast("int"))
    return encoded.withColumn("bytes", F.aggregate("ids", F.lit(b"").cast("binary"), lambda out, i: F.concat(out, piece(i))))
