"""Language identification of mixed texts.

Words are runs of letters.  The script of a word, from Unicode ranges, narrows the
candidate languages to those that write it; a naive Bayes model over hashed character
trigrams, word edges included, scores the word for each candidate; Viterbi over the
words with a penalty for each switch labels spans.  The language of a document is the
one with most letters in its spans.

The model is fitted on at most about ``SAMPLE_DOCS`` labelled documents of each
language, chosen by a hash of their ids; everything else runs over all rows.  It has
``BUCKETS`` counts for each language, whatever the input, and is broadcast.  Prediction
is a map without any shuffle, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrow import batch_of, give_back, pieces
from lexiforge.llm.common import materialise, met

SAMPLE_DOCS = 2000
BUCKETS = 1 << 17
#: Text scored at once, in bytes; it takes some sixty times as much memory.
SCORE_BYTES = 1_500_000
SMOOTHING = 0.5
SWITCH_PENALTY = 8.0
#: A language writes the scripts with at least this share of its letters.
SCRIPT_SHARE = 0.02
#: Score of a word for a language that doesn't write its script.
FOREIGN = -60.0
UNKNOWN = "und"

#: First code points of the scripts' Unicode ranges; 0 stands for letters of any other script.
SCRIPTS = ("other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian", "hangul", "kana", "han")
RANGES = (
    (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8),
    (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 0), (0x20000, 14), (0x30000, 0),
)

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else 1 plus its script."""
    global _LETTER
    if _LETTER is None:
        starts = np.array([a for a, _ in RANGES])
        kinds = np.array([k for _, k in RANGES], dtype=np.uint8)
        points = np.arange(0x110000)
        script = np.where(points < starts[0], 0, kinds[np.maximum(np.searchsorted(starts, points, side="right") - 1, 0)])
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _LETTER = np.where(letter, script + 1, 0).astype(np.uint8)
    return _LETTER


@dataclass
class Words:
    """The letters of a piece: hashed trigrams, and the words they belong to."""

    bucket: np.ndarray  # of each letter
    first: np.ndarray  # index of each word's first letter
    script: np.ndarray  # of each word
    doc: np.ndarray  # of each word


def words_of(texts: list[bytes]) -> Words:
    """Find the words of ``texts``; a feed of nulls keeps texts apart."""
    joined = "\0".join(t.decode("utf-8", "replace").replace("\0", " ").lower() for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letters()[points]
    at = np.flatnonzero(kind)
    doc_of = np.cumsum(points == 0, dtype=np.int32)
    c = np.where(kind > 0, points, 0).astype(np.uint64)
    before, after = c[at - 1], c[at + 1]  # the last character is no letter, and index -1 finds it
    key = (before << np.uint64(42)) | (c[at] << np.uint64(21)) | after
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)  # 17 bits
    first = np.flatnonzero(before == 0)
    return Words(bucket, first, kind[at[first]] - 1, doc_of[at[first]])


@dataclass
class Model:
    """Log probabilities by bucket and language, and the scripts each language writes."""

    langs: list[str]
    logp: np.ndarray
    writes: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    for rows, texts in pieces(batches, limit=SCORE_BYTES):
        langs = rows.column(rows.schema.get_field_index("lang")).to_pylist()
        for lang in sorted(set(langs)):
            words = words_of([t for t, x in zip(texts, langs) if x == lang])
            sizes = np.diff(np.append(words.first, len(words.bucket)))
            counts = np.bincount(words.bucket, minlength=BUCKETS)
            scripts = np.bincount(words.script, weights=sizes, minlength=len(SCRIPTS)).astype(np.int64)
            counts = np.concatenate([counts, scripts])
            found = np.flatnonzero(counts)
            yield batch_of(schema, pa.array([lang] * len(found), pa.string()), found, counts[found])


def labelled(docs: DataFrame) -> DataFrame:
    """The rows to learn from: a language, and crc32(doc_id as text) mod 3 other than 1."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    """crc32(doc_id as text) mod 3 is 1; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a sample of about ``sample_docs`` documents of each language."""
    rows = labelled(docs).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, sample_docs / n)])
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    counted = rows.where(chosen).select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    pdf = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    langs = sorted(sizes)
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    counts[pdf["bucket"], [langs.index(x) for x in pdf["lang"]]] = pdf["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    kinds = max(1, int((grams.sum(1) > 0).sum()))
    logp = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * kinds))
    return Model(langs, logp.astype(np.float32), scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0)))


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Score of each word for each language."""
    scores = np.add.reduceat(model.logp[words.bucket], words.first, axis=0)
    writes = model.writes[words.script]
    known = writes.any(1)
    return np.where(known[:, None], np.where(writes, scores, FOREIGN), 0).astype(np.float32)


def viterbi(scores: np.ndarray, start: np.ndarray, count: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of each word; the words of text i are the ``count[i]`` from ``start[i]`` on.

    All texts advance together, the longest first: step t handles the t-th word of
    those that have one.  Ties go to the word's own language, then to the first one.
    """
    n, k = scores.shape
    path = np.zeros(n, dtype=np.uint8)
    if not n:
        return path
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    start, count = start[order], count[order]
    steps = int(count[0])
    active = len(count) - np.searchsorted(count[::-1], np.arange(steps), side="right")  # texts with a t-th word
    back = np.empty((n, k), dtype=np.uint8)
    langs = np.arange(k, dtype=np.uint8)
    ends = np.empty((len(count), k), dtype=np.float32)
    value = scores[start]
    for t in range(1, steps):
        m = active[t]
        ends[m : len(value)] = value[m:]
        value, at = value[:m], start[:m] + t
        best = value.argmax(1)
        jump = value[np.arange(m), best][:, None] - np.float32(penalty)
        stay = value >= jump
        back[at] = np.where(stay, langs, best[:, None])
        value = np.where(stay, value, jump) + scores[at]
    ends[: len(value)] = value
    state = np.zeros(len(count), dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        more = active[t + 1] if t + 1 < steps else 0
        state[more:m] = ends[more:m].argmax(1)  # texts that end here
        at = start[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return path


@dataclass
class Labels:
    """Language index by word, with the letters of the words and the texts they belong to."""

    words: Words
    letters: np.ndarray
    path: np.ndarray


def label(model: Model, texts: list[bytes], penalty: float = SWITCH_PENALTY) -> Labels:
    """Viterbi labels of all words of ``texts``."""
    words = words_of(texts)
    letters = np.diff(np.append(words.first, len(words.bucket)))
    count = np.bincount(words.doc, minlength=len(texts))
    start = np.cumsum(count) - count
    scores = word_scores(model, words) if len(words.first) else np.zeros((0, len(model.langs)), np.float32)
    return Labels(words, letters, viterbi(scores, start, count, penalty))


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(first word, words, language) of each span of one text."""
    path = label(model, [text.encode()]).path
    cuts = np.flatnonzero(np.diff(path)) + 1
    starts = np.concatenate([[0], cuts]).astype(int) if len(path) else np.zeros(0, int)
    ends = np.append(cuts, len(path)).astype(int)
    return [(int(a), int(b - a), model.langs[path[a]]) for a, b in zip(starts, ends)]


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(model.langs)
    for rows, texts in pieces(batches, limit=SCORE_BYTES):
        n = len(texts)
        if not k:
            pred, share, runs = [UNKNOWN] * n, np.zeros(n), np.zeros(n, int)
        else:
            found = label(model, texts)
            doc = found.words.doc.astype(np.int64)
            mass = np.bincount(doc * k + found.path, weights=found.letters, minlength=n * k).reshape(n, k)
            total = mass.sum(1)
            top = mass.argmax(1)
            pred = [model.langs[i] if t else UNKNOWN for i, t in zip(top, total)]
            share = np.where(total > 0, mass.max(1) / np.maximum(total, 1), 0.0)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (found.path[1:] != found.path[:-1])
            runs = np.bincount(doc[new], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [rows.column(i) for i, f in enumerate(rows.schema) if f.name != "text"]
            + [pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(runs, pa.int64())],
            names=[f.name for f in rows.schema if f.name != "text"] + ["lang_pred", "score", "n_spans"],
        )
    give_back()


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (a text column and any others) without text, with lang_pred, score and n_spans.

    lang_pred is ``und`` if the text is null or has no letter; score is the share of
    the letters in spans of the predicted language.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)  # BUCKETS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict(sent.value, batches)

    others = [f for f in rows.schema.fields if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{ddl}, lang_pred string, score double, n_spans long")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans of every row of ``docs``.

    Null ids, texts and languages are allowed (null languages teach nothing), repeated
    rows give repeated results, other columns are ignored, and an empty table gives no
    rows.  Without any labelled row every prediction is ``und``.
    """
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, fit(docs, sample_docs))


def keep(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language in spans of at least ``least_score`` of the letters, with all columns.

    A null text or one without letters goes, and so do all its repeats; a null id is an
    id like others; columns may have any names; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("__key"), F.col("text").cast("string").alias("text"))
    bad = predict(rows, fit(docs)).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_score))
    bad = materialise(bad.select(F.col("doc_id").alias("__id"), "__key").distinct(), "language-rejects")
    return met(docs, bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")
