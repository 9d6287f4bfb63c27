"""Quality rules: base measures of a text, and lines that many documents share.

Lines are normalised (ASCII lower case, digits as 0, white space squeezed) and hashed.
For each host, the table's ``source``, the distinct documents of a line are counted;
lines in more than ``LINE_DOCS`` of them are above the limit, whatever the size of the
host, and a document that loses most of its words to them is rejected as depleted.

Exact copies of a text count as one document, so a page that was copied a thousand
times is not taken for boilerplate.  The document with the smallest id that has a line
keeps it: of a large family of near copies the first one stays whole.

Scale: texts are read once and give a slim table of hashes.  The count is a distinct
over (host, line, text), which spreads a hot line over many tasks, then a count
with partial sums.  Only lines above a limit are joined back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.llm.arrow import batch_of, give_back, pieces
from lexiforge.llm.common import materialise, met

MIN_WORDS = 50
#: A line is above the limit of its host in more than this many distinct documents.
LINE_DOCS = 20
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"123456789", b"000000000")

LINE = pa.struct([("line", pa.int64()), ("words", pa.int64())])
MEASURES = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("source", pa.string()),
        ("text_key", pa.int64()),
        *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("lines", pa.list_(LINE)),
    ]
)
MEASURES_DDL = (
    "row long, doc_id long, source string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line: long, words: long>>"
)


def line_key(line: bytes) -> int:
    """Signed hash of a normalised line."""
    key = xxhash.xxh64_intdigest(b" ".join(line.lower().translate(DIGITS).split()))
    return key - (1 << 64) if key >> 63 else key


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    count = covered = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            count += i + 3 - max(covered, i)
            covered = i + 3
    return count


def measure(text: bytes) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words by distinct line."""
    words = text.split()
    seen: set[bytes] = set()
    dups, lines = 0, {}
    for line in text.split(b"\n"):
        if n := len(line.split()):
            dups += line in seen
            seen.add(line)
            key = line_key(line)
            lines[key] = lines.get(key, 0) + n
    return (
        len(words),
        len(text.translate(None, SPACES).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        dups,
        repeated_words(words),
        lines,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in pieces(batches):
        n_words, chars, symbols, dups, repeats, lines = zip(*map(measure, texts))
        found = pa.array([[{"line": key, "words": n} for key, n in x.items()] for x in lines], type=MEASURES.field("lines").type)
        kept = [rows.column(rows.schema.get_field_index(c)) for c in ("row", "doc_id", "source", "text_key")]
        yield batch_of(MEASURES, *kept, n_words, chars, symbols, dups, repeats, found)
    give_back()


def measured(docs: DataFrame) -> DataFrame:
    """The base measures and line hashes of every row, as a written table."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )
    return materialise(rows.mapInArrow(_measure, MEASURES_DDL), "quality")


def common_lines(rows: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """source, line, first (the smallest id that has it): the lines above the limit of their host."""
    lines = rows.select("source", "text_key", "doc_id", F.explode("lines.line").alias("line"))
    texts = lines.groupBy("source", "line", "text_key").agg(F.min("doc_id").alias("first"))
    counts = texts.groupBy("source", "line").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
    return counts.where(F.col("docs") > line_docs).select("source", "line", "first")


def judge(docs: DataFrame) -> DataFrame:
    """Measures, base_failed, n_removed (words in common lines), removed (these lines) and kept of every row.

    A null text has no words and fails; a null source is a host of its own; repeated
    rows are judged one by one; other columns are ignored; an empty table gives no rows.
    """
    rows = measured(docs)
    common = materialise(common_lines(rows), "quality-lines")
    lines = rows.select("row", "doc_id", "source", F.explode("lines").alias("l")).select("row", "doc_id", "source", "l.line", "l.words")
    hit = F.col("l.source").eqNullSafe(F.col("c.source")) & (F.col("l.line") == F.col("c.line"))
    later = lines.alias("l").join(common.alias("c"), hit).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    removed = later.groupBy("row").agg(F.sum("words").alias("n_removed"), F.collect_list("c.line").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed")
    return (
        rows.drop("lines")
        .join(removed, "row", "left")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= LEAST_LEFT * F.col("n_words")))
    )


def strip(text: bytes, common: set[int]) -> bytes:
    """``text`` without the lines whose keys are in ``common``."""
    return b"\n".join(x for x in text.split(b"\n") if not x.split() or line_key(x) not in common)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the lines of the last column, ``__removed``, taken out of ``text``; the column goes."""
    for batch in batches:
        at, n = batch.schema.get_field_index("text"), batch.num_columns - 1
        for rows, texts in pieces(iter([batch])):
            gone = rows.column(n)
            if gone.null_count < len(gone):
                old = rows.column(at)
                left = [strip(t, set(g.as_py())).decode() if g.is_valid else o.as_py() for t, g, o in zip(texts, gone, old)]
                rows = rows.set_column(at, batch.schema.field(at), pa.array(left, old.type))
            yield rows.select(range(n))
    give_back()


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; common lines are taken out of their texts.

    A column ``n_chars`` follows the text that is left.  A null text has no words and
    goes; null ids and sources are values like others; repeated rows have one verdict
    and lose the same lines; columns may have any names; an empty table gives no rows.
    """
    names = ("doc_id", "source", "text_key")
    keys = [F.col(c).alias(f"__{c}") for c in names]
    hit = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__text_key"))
    verdicts = materialise(judge(docs).select(*names, "kept", "removed").dropDuplicates(list(names)), "quality-verdicts")
    bad = verdicts.where("not kept").select(*keys)
    cut = verdicts.where("kept and removed is not null").select(*keys, F.col("removed").alias("__removed"))
    kept = met(met(docs, bad, hit, "left_anti"), cut, hit, "left", weight=F.size("__removed"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("__stripped", F.col("__removed").isNotNull())
        flagged = kept.select(*docs.columns, "__stripped", "__removed").mapInArrow(_strip, T.StructType([*docs.schema, T.StructField("__stripped", T.BooleanType())]))
        count = F.when(F.col("__stripped"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return flagged.withColumn("n_chars", count).drop("__stripped")
    return kept.select(*docs.columns, "__removed").mapInArrow(_strip, docs.schema)
