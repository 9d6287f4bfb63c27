"""Document fingerprints that subtract: an invertible Bloom lookup sketch of paragraphs.

A text is cut into paragraphs (lines, and sentences at places that the text itself
marks); the distinct paragraph digests are spread over the cells of a sketch, one cell
in each of three parts.  A cell has a signed count, the xor of its digests and the xor
of their checks.  Subtracting the cells of two versions cancels what they share;
peeling takes cells that hold one digest, removes it from its other cells and so
recovers the digests that differ.  If the fingerprint's own size is too small for that,
a sketch that is larger by fours, sized by the two versions' paragraphs, is tried; if
that fails too, the digests are compared themselves.  Likeness is the Jaccard index
that follows from the counts and the number of recovered digests.

Only built-in functions are used.  Texts are shuffled once, by ranges of ids, to stand
next to the following document.  All that follows groups rows by that range first: cells
are rows, subtracting and peeling are hash aggregations, and none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import materialise, text_of

#: Cells of the fingerprint, a multiple of three.
CELLS = 24
#: Rounds of peeling, each over one part of the sketch, before it counts as too small.
ROUNDS = 18
#: Documents whose ids share a range of this width are ordered in one task.
RANGE = 1024
#: Tasks that the ranges are dealt over at most; below that about one range each, so
#: that the cells of a task's texts stay in memory.
TASKS = 100_000
#: Cuts of a text into paragraphs: lines, and marks that follow one of some letters.
#: The space is matched before what precedes it, which is costly to look at.
CUT = r"\n+| (?<=[A-Ha-h][.!?,;#*$%&<>]{1,4} )| \| "

#: Kinds of rows: what is compared, or what a fingerprint is made of.
TO_EDITED, TO_NEXT, OWN, EDITED, INFO = 1, 2, 3, 4, 0
#: Cells that count: digests recovered by peeling, and digests that differ outright.
RECOVERED, DIFFERENT = -1, -2

_CHECK = "pmod(xxhash64(k, 9), 4294967296)"


def _cell(i: int) -> str:
    """SQL: the cell of digest ``k`` in part ``i`` of a sketch of ``m`` cells."""
    return f"{i} * (m div 3) + pmod(xxhash64(k, {i}), m div 3)"


def _entries(kind: int, m: str, sign: int) -> str:
    """SQL: the three entries of digest ``k`` in a sketch of ``m`` cells."""
    return ", ".join(
        f"named_struct('kind', {kind}, 'm', {m}, 'cell', {_cell(i).replace('m div', f'{m} div')}, 'n', {sign}, 'k', k, 'c', {_CHECK})" for i in range(3)
    )


def _compared(kind: int, sign: int) -> str:
    """SQL: the entries of digest ``k`` in one comparison: both sizes, and the digest itself."""
    plain = f"named_struct('kind', {kind}, 'm', 0L, 'cell', k, 'n', {sign}, 'k', 0L, 'c', 0L)"
    return f"{_entries(kind, f'{CELLS}L', sign)}, {_entries(kind, f'm{kind}', sign)}, {plain}"


#: What each version's digests add to: the text itself, the edited text, the next text.
_BY_VERSION = f"""
CASE version
  WHEN 0 THEN array({_compared(TO_EDITED, 1)}, {_compared(TO_NEXT, 1)}, {_entries(OWN, f'{CELLS}L', 1)})
  WHEN 1 THEN array({_compared(TO_EDITED, -1)}, {_entries(EDITED, f'{CELLS}L', 1)})
  WHEN 2 THEN array({_compared(TO_NEXT, -1)})
  ELSE array(named_struct('kind', {INFO}, 'm', 0L, 'cell', 0L, 'n', 1, 'k', 0L, 'c', 0L))
END"""


def _retry(a: str, b: str) -> Column:
    """Cells of the larger sketch: fours times the fingerprint's, twice the paragraphs at least."""
    steps = F.ceil(F.log(4.0, F.greatest(F.lit(4.0), 2.0 * (F.size(a) + F.size(b)) / CELLS)))
    return (F.pow(F.lit(4.0), steps) * CELLS).cast("long")


def _added(rows: DataFrame) -> DataFrame:
    """Entries of equal cells added up; cells that come to nothing are left out."""
    sums = rows.groupBy("span", "nth", "info", "kind", "m", "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return sums.where("n <> 0 or k <> 0 or c <> 0")


def _peeled(rows: DataFrame, part: int) -> DataFrame:
    """One round: digests alone in a cell of this part leave all their cells and are counted."""
    self = "named_struct('cell', cell, 'n', n, 'k', k, 'c', c)"
    others = ", ".join(f"named_struct('cell', {_cell(i)}, 'n', -n, 'k', k, 'c', c)" for i in range(3) if i != part)
    out = f"""
    CASE WHEN m > 0 AND kind IN ({TO_EDITED}, {TO_NEXT}) AND cell >= 0 AND cell div greatest(m div 3, 1L) = {part} AND abs(n) = 1 AND c = {_CHECK}
      THEN array({others}, named_struct('cell', {RECOVERED}L, 'n', 1, 'k', 0L, 'c', 0L))
      ELSE array({self}) END"""
    return _added(rows.select("span", "nth", "info", "kind", "m", F.inline(F.expr(out))))


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    parts = F.filter(F.split(text, CUT), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next, the text of the next row in descending id (the first follows the last), with their digests a and b.

    span and nth, the range of the id and the place in it, tell the rows apart.

    Rows of one range of ids are ordered in a task; the first row of each range is
    joined to the last of the range before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    span = F.coalesce(F.expr(f"doc_id div {RANGE}"), F.lit(-(1 << 62)))
    rows = rows.withColumn("span", span).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text")]
    tops = materialise(rows.groupBy("span").agg(F.max("doc_id").alias("top")), "fingerprint-spans")
    heads = rows.alias("r").join(tops.alias("t"), (F.col("r.span") == F.col("t.span")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.select("r.span", "text").groupBy("span").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("head"))
    down = Window.orderBy(F.col("span").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = tops.select("span", F.coalesce(F.lead("span").over(down), F.max("span").over(whole)).alias("after"))
    ends = following.join(heads.withColumnRenamed("span", "after"), "after").select("span", "head")
    near = Window.partitionBy("span").orderBy(*order)
    rows = rows.repartition(max(1, min(tops.count(), TASKS)), "span")
    rows = rows.withColumn("a", digests(F.col("text")))  # a text is cut once, for itself and as the next one
    placed = rows.select("*", F.lead("text").over(near).alias("next"), F.lead("a").over(near).alias("b"), F.row_number().over(near).alias("nth"))
    # merged, not broadcast: the rows stay dealt by span, and nothing after this shuffles
    return placed.join(ends.hint("merge"), "span").select("span", "nth", "doc_id", "text", F.coalesce("next", "head").alias("next"), "a", F.coalesce("b", digests(F.col("head"))).alias("b"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` and of its edited text, and their likeness.

    The edited text has the last half of the code points replaced by the first as many
    of the next document (descending id), or all of them.  A null text counts as empty;
    two empty texts are alike; null ids are the last and rows of equal ids stand in the
    order of their texts' hashes; other columns are ignored; an empty table gives no rows.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half)))
    rows = rows.select(
        "span",
        "nth",
        F.struct("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")).alias("doc"),
        "a",
        digests(F.col("edited")).alias("e"),
        "b",
    )
    info = F.struct("doc.*", F.size("a").alias("a"), F.size("e").alias("e"), F.size("b").alias("b"))
    nothing = F.lit(None).cast(rows.select(info.alias("i")).schema["i"].dataType)
    versions = F.array(
        *[F.struct(F.lit(i).alias("version"), keys.alias("keys"), held.alias("info")) for i, (keys, held) in enumerate(((F.col("a"), nothing), (F.col("e"), nothing), (F.col("b"), nothing), (F.array(F.lit(0).cast("long")), info)))]
    )
    rows = rows.select("span", "nth", _retry("a", "e").alias("m1"), _retry("a", "b").alias("m2"), F.inline(versions))
    rows = rows.select("span", "nth", "m1", "m2", "version", "info", F.explode("keys").alias("k"))
    cells = _added(rows.select("span", "nth", "info", F.inline(F.expr(_BY_VERSION))))
    # digests that differ outright become one count
    outright = (F.col("m") == 0) & (F.col("kind") != INFO)
    cells = _added(
        cells.select("span", "nth", "info", "kind", "m", F.when(outright, F.lit(DIFFERENT).cast("long")).otherwise(F.col("cell")).alias("cell"), F.when(outright, F.lit(1)).otherwise(F.col("n")).alias("n"), "k", "c")
    )
    for i in range(ROUNDS):
        cells = _peeled(cells, i % 3)

    def differ(kind: int) -> Column:
        """Recovered by the fingerprint's size, cells left of it, the same for the larger one, and outright."""
        mine, own = F.col("kind") == kind, F.col("m") == CELLS
        count = lambda where: F.sum(F.when(mine & where, F.col("n")).otherwise(0))
        left = lambda where: F.count_if(mine & where & (F.col("cell") >= 0))
        found = F.col("cell") == RECOVERED
        small, large = (F.col("m") > 0) & own, (F.col("m") > 0) & ~own
        out = F.when(left(small) == 0, count(small & found)).when(left(large) == 0, count(large & found)).otherwise(count(F.col("cell") == DIFFERENT))
        return out.alias(f"differ{kind}")

    shown = F.concat_ws(".", F.col("cell").cast("string"), F.col("n").cast("string"), F.hex("k"), F.hex("c"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("cell", shown.alias("shown")))))
    out = cells.groupBy("span", "nth").agg(
        F.max("info").alias("info"), listed(OWN).alias("own"), listed(EDITED).alias("other"), differ(TO_EDITED), differ(TO_NEXT)
    )

    def written(n: Column, cells: str) -> Column:
        return F.concat_ws("-", n.cast("string"), F.array_join(F.col(f"{cells}.shown"), "-"))

    def likeness(n: Column, differ: Column) -> Column:
        return F.when(n == 0, 1.0).otherwise((n - differ) / (n + differ))

    return out.select(
        "info.doc_id",
        "info.n_chars",
        "info.edited_sha256",
        written(F.col("info.a"), "own").alias("fingerprint"),
        written(F.col("info.e"), "other").alias("edited_fingerprint"),
        likeness(F.col("info.a") + F.col("info.e"), F.col(f"differ{TO_EDITED}")).alias("near_edited"),
        likeness(F.col("info.a") + F.col("info.b"), F.col(f"differ{TO_NEXT}")).alias("near_next"),
    )
