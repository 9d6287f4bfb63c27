"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources get a target number of words from their weights; a target stops at
   ``MAX_REPEAT`` times the source's size and the excess is reshared by weight.
2. The documents of a source are dealt into blocks by a hash, ``BLOCKS`` or, in a large
   corpus, as many more as it has ``BLOCK_WORDS``.  A target is turned into an exact
   quota of blocks: whole passes over the source, then as many blocks as the rest asks
   for.
3. The vector of quotas is split recursively among the output shards.  Each split
   draws half of a node's blocks without replacement, so the counts of the sources in
   a half follow the multivariate hypergeometric distribution and add up exactly.
4. Each shard takes its quota as a run of the source's permuted blocks; the runs are
   disjoint.  The passes over a block follow one another, so all but a block at the
   border of two runs go to one shard, and their texts are sent once.  Rows of a shard
   are then shuffled locally.  The number of shards follows
   the size of the mix (``SHARD_WORDS``).

Only DataFrame and SQL functions are used.  The texts are read once for their sizes;
all that follows handles (source, block) rows, so a source that holds a third of all
rows costs no more than another.  Hashes take the place of a random generator: reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WORD, materialise, text_of

#: Blocks of a source at least, and words of the corpus that ask for one more.
BLOCKS = 512
BLOCK_WORDS = 1 << 22
#: Shards at least, and words of the mix that ask for one more.
SHARDS = 16
SHARD_WORDS = 1 << 21
MAX_REPEAT = 2
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
FILL_ROUNDS = 3


def place_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that deals a document to a block of its source."""
    return F.xxhash64(F.col(doc_id), F.length(F.col(text)))


def block_of(place: Column, blocks: int) -> Column:
    """The block of a place."""
    return F.pmod(place, F.lit(blocks)).cast("int")


def sizes(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, source, block and size in words of every row, from a written table, and the number of blocks."""
    rows = materialise(docs.select("doc_id", "source", place_of().alias("place"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")), "mixing")
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = max(BLOCKS, _power(total // BLOCK_WORDS))
    return rows.select("doc_id", "source", block_of(F.col("place"), blocks).alias("block"), "size"), blocks


def _power(n: int) -> int:
    """The least power of two that isn't below ``n``."""
    return 1 << max(0, n - 1).bit_length()


def targets(blocks: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL) -> DataFrame:
    """source, nth (order of the source, from 0), source_size and target.

    ``weights`` repeat over the sources by code point, null last; their sum shares
    ``total`` times all words.  With sources in the order of cap by weight, the level
    that the uncapped ones share is that of the first source whose cap it doesn't pass.
    """
    by_source = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        by_source.withColumn("nth", nth)
        .withColumn("weight", F.element_at(cycle, F.col("nth") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * float(MAX_REPEAT))
        .withColumn("bar", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("bar", "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("bar", "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(whole) * total - F.col("capped")) / F.sum("weight").over(onward))
        .withColumn("share", F.min(F.when(F.col("level") <= F.col("bar"), F.struct("bar", "nth", "level"))).over(whole)["level"])
        .select(
            "source",
            "nth",
            "source_size",
            F.when(F.col("share").isNull() | (F.col("bar") < F.col("share")), F.col("cap"))
            .otherwise(F.col("share") * F.col("weight"))
            .alias("target"),
        )
    )


def quotas(blocks: DataFrame, aims: DataFrame) -> DataFrame:
    """Blocks with ``times``, how often the mix takes each.

    Whole passes come first.  For the rest of a target, blocks in permuted order are
    taken as far as their words fit, in ``FILL_ROUNDS`` rounds, then one more if it
    brings the sum nearer to the target.
    """
    source = Window.partitionBy("nth")
    run = source.orderBy("place", "block").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        blocks.alias("b")
        .join(aims.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")))
        .select("b.source", "block", "words", "nth", "source_size", "target")
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("place", F.xxhash64(F.lit("block order"), "source", "block"))
        .withColumn("picked", F.lit(False))
    )
    for _ in range(FILL_ROUNDS):
        room = F.col("rest") - F.sum(F.when(F.col("picked"), F.col("words")).otherwise(0)).over(source)
        out = out.withColumn("room", room)
        fits = ~F.col("picked") & (F.col("words") > 0) & (F.col("words") <= F.col("room"))
        out = out.withColumn("fits", fits)
        reach = F.sum(F.when(F.col("fits"), F.col("words")).otherwise(0)).over(run)
        out = out.withColumn("picked", F.col("picked") | (F.col("fits") & (reach <= F.col("room"))))
    room = F.col("rest") - F.sum(F.when(F.col("picked"), F.col("words")).otherwise(0)).over(source)
    out = out.withColumn("room", room)
    miss = F.abs(F.col("room") - F.col("words"))
    best = F.min(F.when(~F.col("picked") & (miss < F.col("room")), F.struct(miss.alias("miss"), "place", "block"))).over(source)
    out = out.withColumn("best", best["block"])
    return out.select(
        "source",
        "nth",
        "block",
        (F.col("passes") + (F.col("picked") | F.coalesce(F.col("best") == F.col("block"), F.lit(False))).cast("int")).cast("int").alias("times"),
    )


def _split(level: int) -> str:
    """SQL for the counts by source of the left half of a node.

    Selection sampling: the blocks of the node are passed one by one, and each goes
    left with the probability (places left on the left) / (blocks left).
    """
    return f"""
    aggregate(
      sequence(0, size(counts) - 1),
      named_struct('n', total, 'l', (total + 1) div 2, 'taken', cast(array() as array<bigint>)),
      (acc, i) -> named_struct(
        'step', aggregate(
          if(counts[i] > 0, sequence(1L, counts[i]), cast(array() as array<bigint>)),
          named_struct('n', acc.n, 'l', acc.l, 'x', 0L),
          (s, j) -> if(
            pmod(xxhash64('split', {level}, shard, i, j), 2147483648L) * s.n < s.l * 2147483648L,
            named_struct('n', s.n - 1, 'l', s.l - 1, 'x', s.x + 1),
            named_struct('n', s.n - 1, 'l', s.l, 'x', s.x)
          ),
          s -> named_struct('n', s.n, 'l', s.l, 'taken', array_append(acc.taken, s.x))
        )
      ).step,
      acc -> acc.taken
    )"""


def split_tree(counts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard, nth, quota: the blocks of each source that each shard takes.

    ``counts`` has nth and blocks.  ``shards`` is a power of two; the shards' totals
    differ by one at most on every level of the tree.
    """
    node = counts.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "blocks"))), lambda x: x["blocks"]).alias("counts"))
    node = node.select(F.lit(0).alias("shard"), "counts").where(F.size("counts") > 0)
    for level in range(shards.bit_length() - 1):
        left = node.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("left", F.expr(_split(level)))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("counts")),
        )
        node = left.select(F.inline(halves))
    return node.select("shard", F.posexplode("counts").alias("nth", "quota"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, shards: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(targets by source, draws, shards): a draw is source, block, pass and its shard."""
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = materialise(blocks, "mixing-blocks")
    aims = materialise(targets(blocks, weights, total), "mixing-targets")
    if shards is None:
        shards = max(SHARDS, _power(int(aims.agg(F.sum("target")).first()[0] or 0) // SHARD_WORDS))
    taken = quotas(blocks, aims).where("times > 0")
    taken = taken.select("source", "nth", "block", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass"))
    order = Window.partitionBy("nth").orderBy(F.xxhash64(F.lit("draw"), "source", "block"), "block", "pass")
    taken = materialise(taken.withColumn("draw", F.row_number().over(order)), "mixing-draws")
    shares = split_tree(taken.groupBy("nth").agg(F.count("*").alias("blocks")), shards)
    # a source without draws has no entry in the tree: nth here is the order among those that have
    listed = taken.select("nth").distinct().withColumn("entry", F.row_number().over(Window.orderBy("nth")) - 1)
    start = F.coalesce(F.sum("quota").over(Window.partitionBy("nth").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = (
        shares.withColumn("start", start)
        .where("quota > 0")
        .select("shard", F.col("nth").alias("entry"), F.explode(F.expr("transform(sequence(start + 1, start + quota), d -> int(d))")).alias("draw"))
        .join(listed, "entry")
    )
    return aims, taken.join(runs, ["nth", "draw"]).select("source", "block", "pass", "shard"), shards


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and shards of each row.

    ``shards`` lists the output shards that draw the row.  A null text has no words; a
    null source is a source of its own, the last; repeated rows are mixed one by one;
    other columns are ignored; an empty table gives no rows.
    """
    rows, _ = sizes(docs)
    aims, draws, _ = plan(rows)
    # every row of a block is taken by the shards that drew it: MAX_REPEAT at most
    drawn = draws.groupBy("source", "block").agg(F.array_sort(F.collect_list("shard")).alias("in"))
    return (
        rows.alias("r")
        .join(aims.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")))
        .join(drawn.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.block") == F.col("t.block")), "left")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.coalesce(F.size("in"), F.lit(0))).alias("taken"),
            F.coalesce(F.array_join(F.transform("in", lambda s: s.cast("string")), ","), F.lit("")).alias("shards"),
        )
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, shards: int | None = None) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, a row for each time it is taken.

    Rows of an output shard stand in one partition in a shuffled order.  A null text has
    no words, a null source is the last one, repeated rows are mixed one by one; columns
    of ``docs`` may have any names; an empty table gives no rows.
    """
    rows, blocks = sizes(docs)
    _, draws, shards = plan(rows, weights, total, shards)
    drawn = draws.groupBy("source", "block", "shard").agg(F.collect_list("pass").alias("passes"))  # MAX_REPEAT entries at most
    drawn = drawn.groupBy("source", "block").agg(F.collect_list(F.struct("passes", "shard")).alias("draws"))
    packed = docs.select(F.struct("*").alias("row"), "source", block_of(place_of(), blocks).alias("block"), F.col("doc_id").alias("id"))
    rows = packed.alias("p").join(drawn.alias("d"), F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.block") == F.col("d.block")))
    rows = rows.select("row", "id", F.inline("draws"))
    return (
        rows.repartitionById(shards, F.col("shard").cast("int"))
        .select("row", "id", "shard", F.explode("passes").alias("pass"))  # repeated only where they are mixed
        .sortWithinPartitions("shard", F.xxhash64(F.lit("local order"), "id", "pass"))
        .select("row.*")
    )
