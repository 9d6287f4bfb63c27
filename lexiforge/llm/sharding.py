"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` places on a ring of ``POINTS`` points.  A row's key hashes
to a point and belongs to the first virtual node at or after it.  A shard takes no
more rows than its capacity; what overflows a full shard continues clockwise to the
next virtual node whose shard has room.  The capacities add up to the number of rows
and differ by one at most, so balance is guaranteed, and only the overflow leaves its
place on the ring.

Scale: rows are counted by point (at most ``POINTS`` rows reach the driver, whatever
the input), the walk round the ring is simulated on those counts, and the resulting
ranges, at most ``POINTS`` plus the number of shards, are broadcast.  The rank of a
row at its point comes from bins of about ``BIN_ROWS`` rows, so a point that holds a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexiforge.llm.common import materialise, text_of

POINTS = 16384
VNODES = 128
BIN_ROWS = 8192


def ring(n_shards: int, vnodes: int = VNODES, points: int = POINTS) -> list[tuple[int, int]]:
    """Virtual nodes as (point, shard) in clockwise order; the same for every run."""
    places = (
        (xxhash.xxh64_intdigest(f"shard {s} node {v}") % points, xxhash.xxh64_intdigest(f"{v}:{s}"), s)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    return [(point, shard) for point, _, shard in sorted(places)]


def walk(counts: dict[int, int], n_shards: int, vnodes: int = VNODES, points: int = POINTS) -> list[tuple]:
    """Where the rows of each point go.

    ``counts`` has the rows by point.  Returns (point, from_rank, to_rank, shard, slot)
    with half-open rank ranges; ``slot`` is the place in the shard of the first of them.
    """
    nodes = ring(n_shards, vnodes, points)
    at = [point for point, _ in nodes]
    home = {p: bisect_left(at, p) % len(nodes) for p in counts}
    natural = [0] * n_shards
    for p, c in counts.items():
        natural[nodes[home[p]][1]] += c
    share, extra = divmod(sum(counts.values()), n_shards)
    room = [share] * n_shards
    for shard in sorted(range(n_shards), key=lambda s: (-natural[s], s))[:extra]:
        room[shard] += 1
    capacity = list(room)
    moves, left = [], []

    def place(point: int, start: int, rows: int, shard: int) -> int:
        take = min(rows, room[shard])
        if take:
            moves.append((point, start, start + take, shard, capacity[shard] - room[shard]))
            room[shard] -= take
        return take

    for p in sorted(counts):
        took = place(p, 0, counts[p], nodes[home[p]][1])
        if took < counts[p]:
            left.append((p, took))
    for p, start in left:
        node = home[p]
        while start < counts[p]:
            node = (node + 1) % len(nodes)
            start += place(p, start, counts[p] - start, nodes[node][1])
    return moves


def shard(docs: DataFrame, n_shards: int = 24, vnodes: int = VNODES) -> DataFrame:
    """Shard and slot of every row of ``docs`` (``doc_id``, ``text``).

    The ring key is the text, so equal texts share a point and stay together unless
    their shard is full.  Null texts count as empty, a null id is ordered before the
    others, repeated rows each get a slot of their own; other columns are ignored.
    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, shard, slot; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text_of()) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
            F.pmod(F.xxhash64(text_of()), F.lit(POINTS)).cast("int").alias("point"),
        ),
        "sharding",
    )
    counts = {r["point"]: r["count"] for r in rows.groupBy("point").count().collect()}  # POINTS rows at most
    bins = spark.createDataFrame([(p, -(-c // BIN_ROWS)) for p, c in counts.items()], "point int, bins int")
    moves = spark.createDataFrame(
        walk(counts, n_shards, vnodes), "point int, from_rank long, to_rank long, shard int, first_slot long"
    )
    binned = rows.join(F.broadcast(bins), "point").withColumn(
        "bin", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("bins")).cast("int")
    )
    before = Window.partitionBy("point").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        binned.groupBy("point", "bin")
        .agg(F.count("*").alias("n"))
        .select("point", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("point", "bin").orderBy("doc_id", "text_crc32", "size")
    ranked = (
        binned.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["point", "bin"])
        .withColumn("rank", F.col("start") + F.col("nth"))
    )
    hit = (F.col("m.point") == F.col("r.point")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return (
        ranked.alias("r")
        .join(F.broadcast(moves).alias("m"), hit)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first_slot") + F.col("rank") - F.col("from_rank")).alias("slot"),
        )
    )
