"""Exact Jaccard self-join of word shingle sets, by skipping over set relations.

Sets of word shingles link when intersection >= threshold * union; a ``Rule`` has the
width and the threshold (``OP6``: 3 words and 0.9, ``NEAR``: 5 words and 0.8).  The
result is a row for each document with the smallest id that it reaches by links.

*The index.*  Shingles have one order for the whole corpus, the rarest first.  A set of
n can only link with sets that hold one of its first n - ceil(threshold n) + 1 shingles,
and only shingles that occur elsewhere have a list, so a text of its own is in no list,
whatever passages it shares.  A list is cut into blocks by the size of its sets and by
the position that the shingle has in them: a set whose shingle stands at position p
links with sets up to (n - p) (1 + threshold) / threshold - n.  Sets are posted only to
the blocks that this bound and the smallest partner reach; all other blocks are skipped.

*Order without a dictionary.*  A task collects its sets in chunks and sends the sorted
distinct shingle keys of a chunk, packed, to their key ranges; the ranges add up how
often a key occurs and send a level (the logarithm) for each key back.  Keys are hashes
as long as the size of the corpus asks for; equal keys of different shingles only make
more candidates.  A ``share`` of the keys stands first in the order.  A set that has
enough of these for its prefix sends no others.

*Candidates without pairs.*  The sets of a block are tied to its least member, not to
each other, so candidates grow with the lists, not with their squares.  Connected ties
make families; a linked pair is always inside one family.

*Answers from a similar set.*  Inside a family sets are passed in the order of their
least hashes, so that similar sets follow one another.  The overlaps of a set with all
others are derived from those of the set before: less the sets that hold a shingle that
is gone, more those that hold one that came.  Only the first is computed in full, or one
that has little in common with the set before.  Links are decided on the whole hashes.

Equal sets are one class from the start, so thousands of exact copies cost as much as
two.  A family larger than a block is dealt over several tasks: blocks are solved first,
then the leaders of what they found, and only components that still differ are compared
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrow import give_back, pieces
from lexiforge.llm.common import attach, hot_keys, materialise, met, with_ids

#: Sets compared at once in one task, and bytes of their hashes.
BLOCK = 1500
BLOCK_BYTES = 24_000_000
#: A size level of the lists ends at this many times its start.
SPAN = 1.5
#: Keys of a chunk, and bytes of text that make a key range.
CHUNK_KEYS = 1_200_000
RANGE_BYTES = 32_000_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; two sets link when num * union <= den * intersection.

    ``share`` is the part of the keys, in quarters, that stands first in the order.  A
    set whose own shingles make up more than (1 - threshold) / share has no list.
    """

    width: int
    num: int
    den: int
    share: int


OP6 = Rule(3, 90, 100, 1)
NEAR = Rule(5, 80, 100, 2)


@cache
def levels(rule: Rule = OP6, limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each level; a linked pair lies in one level or in two neighbours."""
    out = [1]
    while out[-1] < limit:
        at = out[-1]
        reach = (at - 1) * rule.den // rule.num  # sets of the level before link up to this size
        out.append(max(at + 1, reach + 1, int(at * SPAN)))
    return np.array(out, dtype=np.int64)


def prefix(n: np.ndarray, rule: Rule) -> np.ndarray:
    """How many of the first shingles of a set of ``n`` a linked set must meet."""
    return n - -(-n * rule.num // rule.den) + 1


def shingles(text: bytes, width: int = OP6.width) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        key = _mixed(h[:n])
        for k in range(1, width):
            key = _mixed(key + np.uint64(2 * k + 1) * h[k : k + n])
    return np.unique(key)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(keys: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(keys.tobytes()), np.int64))


# --- the order of the shingles


@dataclass(frozen=True)
class Scale:
    """Bits of a key and bits of its range, from the size of the corpus."""

    bits: int
    ranges: int

    @staticmethod
    def of(docs: DataFrame) -> Scale:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        return Scale(min(60, max(30, size.bit_length() + 6)), max(4, (size // RANGE_BYTES).bit_length()))


def known_keys(found: np.ndarray, rule: Rule, scale: Scale) -> np.ndarray:
    """Sorted keys of a set that its prefix lies in: those of the share if they are enough, else all.

    The lowest bit of a key tells the shingles outside the share, which come last in the order.
    """
    late = (found & np.uint64(3)) >= np.uint64(rule.share)
    key = ((found >> np.uint64(64 - scale.bits)) << np.uint64(1)) | late.astype(np.uint64)
    early = key[~late]
    return (early if len(early) >= prefix(np.int64(len(found)), rule) else key).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all lowest ones first, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


_ROWS = pa.schema(
    [("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n_shingles", "d1", "d2")), ("data", pa.list_(pa.binary()))]
)
_ROWS_DDL = "kind int, chunk long, part int, doc_id long, n_shingles long, d1 long, d2 long, data array<binary>"


def _row(kind: int, chunk: int, part: int, *data: bytes) -> pa.RecordBatch:
    values = (kind, chunk, part, None, None, None, None, list(data))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ROWS)], schema=_ROWS)


class _Chunk:
    """Distinct sets of a task, until their keys are many."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.sets: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def add(self, digest: tuple[int, int], n: int, keys: np.ndarray) -> None:
        self.sets[digest] = (n, keys)
        self.size += len(keys)

    def rows(self, scale: Scale) -> Iterator[pa.RecordBatch]:
        """The chunk itself (kind 1) and its distinct keys with their counts, by range (kind 2)."""
        keys = [k for _, k in self.sets.values()]
        size = np.array([len(k) for k in keys], np.int64)
        flat = np.concatenate(keys)
        first = np.cumsum(size) - size
        steps = np.diff(flat, prepend=0)
        steps[first] = flat[first]
        firsts = np.array([d for d, _ in self.sets], np.int64)
        yield _row(1, self.number, 0, _planes(firsts), _planes(np.array([n for n, _ in self.sets.values()])), _planes(size), _planes(steps))
        flat, count = np.unique(flat, return_counts=True)
        cuts = np.searchsorted(flat, np.arange((1 << scale.ranges) + 1, dtype=np.int64) << np.int64(scale.bits + 1 - scale.ranges))
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                yield _row(2, self.number, part, _planes(np.diff(flat[a:b], prepend=0)), _planes(count[a:b]))


def _gather(batches: Iterator[pa.RecordBatch], rule: Rule, scale: Scale) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0), and the chunks of the sets of the task."""
    number = TaskContext.get().partitionId() << 24
    chunk = _Chunk(number)
    for rows, texts in pieces(batches):
        found = [shingles(t, rule.width) for t in texts]
        digests = [_digest(k) for k in found]
        n = len(texts)
        d1, d2 = zip(*digests)
        columns = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), rows.column(0), pa.array([len(k) for k in found], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(n, _ROWS.field("data").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)
        for digest, keys in zip(digests, found):
            if len(keys) and digest not in chunk.sets:
                chunk.add(digest, len(keys), known_keys(keys, rule, scale))
                if chunk.size >= CHUNK_KEYS:
                    yield from chunk.rows(scale)
                    number += 1
                    chunk = _Chunk(number)
    if chunk.sets:
        yield from chunk.rows(scale)
    give_back()


def _add_up(table: pa.Table) -> pa.Table:
    """The level of every key of one range, for each chunk that sent it."""
    parts = [tuple(map(_numbers, x)) for x in table.column("data").to_pylist()]
    keys = [np.cumsum(steps) for steps, _ in parts]
    flat, count = np.concatenate(keys), np.concatenate([c for _, c in parts])
    order = np.argsort(flat, kind="stable")
    flat, count = flat[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    level = np.log2(np.add.reduceat(count, first)).astype(np.uint8)
    flat = flat[first]
    press = zstandard.ZstdCompressor(level=1).compress
    out = [press(level[np.searchsorted(flat, k)].tobytes()) for k in keys]
    return pa.table([table.column("chunk").combine_chunks(), table.column("part").combine_chunks(), pa.array(out, pa.binary())], names=["chunk", "part", "levels"])


# --- the lists


def posted(owner: np.ndarray, key: np.ndarray, level: np.ndarray, n: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(set, block) of every posting of the sets of ``n`` shingles with the keys and levels given.

    A block of a key's list is a level of sizes, for pairs inside it, or a border, for
    pairs of it and the level before.
    """
    order = np.lexsort((key, level, key & 1, owner))
    owner, key, level = owner[order], key[order], level[order]
    size = np.bincount(owner, minlength=len(n))
    place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    used = (place < prefix(n, rule)[owner]) & (level > 0)  # a key that occurs once meets nothing
    owner, key, place = owner[used], key[used], place[used]
    starts = levels(rule)
    own = np.searchsorted(starts, n, side="right") - 1
    most = (n[owner] - place) * (rule.den + rule.num) // rule.num - n[owner]
    least = -(-n * rule.num // rule.den)
    at = own[owner]
    inside = most >= starts[at]
    below = least[owner] < starts[at]
    above = most >= starts[at + 1]
    owners = np.concatenate([owner[inside], owner[below], owner[above]])
    keys = np.concatenate([key[inside], key[below], key[above]]).astype(np.uint64)
    block = np.concatenate([at[inside] * 2, at[below] * 2 - 1, at[above] * 2 + 1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return owners, (_mixed(_mixed(keys + np.uint64(0x5BD1E995)) ^ _mixed(block + np.uint64(1 << 40)))).view(np.int64)


def _led(d1: np.ndarray, owner: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk's postings the leaders' (set, block), and the ties (set, leader) of the others.

    Only a leader's posting leaves the chunk: a block that very many sets are in has a
    row for each chunk, not for each set.
    """
    order = np.lexsort((d1[owner], post))
    post, owner = post[order], owner[order]
    first = np.concatenate([[True], post[1:] != post[:-1]]) if len(post) else np.zeros(0, bool)
    leader = owner[np.flatnonzero(first)][np.cumsum(first) - 1] if len(post) else owner
    tied = np.unique(np.stack([owner, leader])[:, d1[owner] != d1[leader]], axis=1)
    return d1[owner[first]], post[first], d1[tied[0]], d1[tied[1]]


POSTS_DDL = "a long, post long, b long"


def _post(chunk: pa.Table, found: pa.Table, rule: Rule) -> pa.Table:
    """Postings (a, post) and ties (a, b) of the sets of one chunk."""
    d1, n, size, steps = map(_numbers, chunk.column("data")[0].as_py())
    owner = np.repeat(np.arange(len(n)), size)
    total = np.cumsum(steps)
    first = np.cumsum(size) - size
    key = total - (total[first] - steps[first])[owner]
    unpack = zstandard.ZstdDecompressor().decompress
    part, raw = found.column("part").to_numpy(), found.column("levels").to_pylist()
    known = np.concatenate([np.frombuffer(unpack(raw[i]), np.uint8) for i in np.argsort(part)])
    level = known[np.unique(key, return_inverse=True)[1]]
    a, post, x, y = _led(d1, *posted(owner, key, level, n, rule))
    none = lambda k: pa.nulls(k, pa.int64())
    posts = pa.table([pa.array(a), pa.array(post), none(len(a))], names=["a", "post", "b"])
    give_back()
    return pa.concat_tables([posts, pa.table([pa.array(x), none(len(x)), pa.array(y)], names=["a", "post", "b"])])


def ties(rows: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) between class keys: each block's members to its least one.

    Members were tied to their chunk's leader already; here the leaders of a block meet.
    """
    counted = rows.where("kind = 2").select("part", "chunk", "data").groupBy("part").applyInArrow(_add_up, "chunk long, part int, levels binary")
    chunks = rows.where("kind = 1").select("chunk", "data").groupBy("chunk")

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        return _post(chunk, found, rule)

    posts = materialise(chunks.cogroup(counted.groupBy("chunk")).applyInArrow(run, POSTS_DDL), "jaccard-posts")
    posted_by = posts.where("post is not null").select("post", "a")
    least = posted_by.groupBy("post").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("post", "b")
    across = posted_by.join(least, "post").where("a <> b").select("a", "b")
    return across.unionByName(posts.where("post is null").select("a", "b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root, the least node that it reaches, of all nodes of ``edges`` (a, b).

    A node takes the least label of its neighbours, a root the least that a node of its
    label meets, and labels jump to the label of the label, until none changes: the
    rounds grow with the logarithm of the longest chain.  Every round is written to the
    shared folder.  Nodes with very many edges and labels of very many nodes are spread
    over tasks (``attach``).
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), name)
    hubs = hot_keys(both, ["b"], name)
    while True:
        near = attach(both, labels.withColumnRenamed("node", "b"), ["b"], hubs).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        pairs = labels.join(near, "node")
        hooks = pairs.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        step = pairs.join(hooks, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near", "hook").alias("root"))
        step = materialise(step, name)
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        fresh = materialise(attach(step, jump, ["root"], hot_keys(step, ["root"], name)).select("node", "old", F.least("root", "far").alias("root")), name)
        labels = fresh.select("node", "root")
        if fresh.where("old != root").isEmpty():
            return labels


def members(docs: DataFrame, wanted: DataFrame, rule: Rule = OP6) -> DataFrame:
    """doc_id, d1, d2 and the set (bytes) of the rows of ``docs`` whose id is in ``wanted`` (id); repeated rows once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for rows, texts in pieces(batches):
            found = [shingles(t, rule.width) for t in texts]
            digests = [_digest(k) for k in found]
            fresh = []
            for i, key in enumerate(zip(rows.column(0).to_pylist(), digests)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            d1, d2 = (pa.array([digests[i][k] for i in fresh], pa.int64()) for k in (0, 1))
            sets = pa.array([found[i].tobytes() for i in fresh], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(fresh, pa.int64())), d1, d2, sets], names=["doc_id", "d1", "d2", "shingles"])
        give_back()

    return with_ids(_plain(docs), wanted).mapInArrow(run, "doc_id long, d1 long, d2 long, shingles binary")


# --- the families


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def linked(sets: list[np.ndarray], rule: Rule = OP6) -> np.ndarray:
    """Which of ``sets`` link; the overlaps of a set are derived from those of a similar one before it."""
    k = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    kinds, of = np.unique(np.concatenate(sets), return_inverse=True)
    # only shingles that two sets hold count
    count = np.bincount(of, minlength=len(kinds))
    shared = count > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(k), size)[shared[of]]
    of = number[of[shared[of]]]
    length = count[shared]
    start = np.cumsum(length) - length
    lists = owner[np.argsort(of, kind="stable")]
    parts = np.split(of, np.cumsum(np.bincount(owner, minlength=k))[:-1])

    def held(what: np.ndarray) -> np.ndarray:
        return np.bincount(lists[_ranges(start[what], length[what])], minlength=k) if len(what) else np.zeros(k, np.int64)

    overlap = np.zeros((k, k), np.int32)
    before = -1
    for i in sorted(range(k), key=lambda i: sets[i][:4].tolist()):
        mine = parts[i]
        if before >= 0:
            gone = np.setdiff1d(parts[before], mine, assume_unique=True)
            came = np.setdiff1d(mine, parts[before], assume_unique=True)
        if before >= 0 and len(gone) + len(came) < len(mine):
            overlap[i] = overlap[before] - held(gone) + held(came)
        else:
            overlap[i] = held(mine)
        before = i
    np.fill_diagonal(overlap, size)
    union = size[:, None] + size[None, :] - overlap
    return rule.den * overlap.astype(np.int64) >= rule.num * union


def roots(link: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least start label that each row reaches over ``link`` and over equal labels."""
    label = start.copy()
    while True:
        near = np.where(link, label[None, :], np.iinfo(np.int64).max).min(1)
        near = np.minimum(near, label)
        kinds, of = np.unique(start, return_inverse=True)
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(least, of, near)
        near = least[of]
        if (near == label).all():
            return label
        label = near


SOLVED = "f long, d1 long, d2 long, old long, root long"


def _solve(table: pa.Table, rule: Rule) -> pa.Table:
    """Rows (f, d1, d2, label, shingles) with the labels that links join, family by family."""
    table = table.sort_by("f")
    f, d1, d2, old = (table.column(c).to_numpy() for c in ("f", "d1", "d2", "label"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    root = old.copy()
    cuts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1], [True]])) if len(f) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1 and len(np.unique(old[a:b])) > 1:
            root[a:b] = roots(linked(sets[a:b], rule), old[a:b])
    give_back()
    return pa.table([pa.array(x) for x in (f, d1, d2, old, root)], names=["f", "d1", "d2", "old", "root"])


def _merged(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with labels replaced by the root of what ``joined`` (old, root) ties together."""
    edges = joined.where("old != root").select(F.col("old").alias("a"), F.col("root").alias("b")).distinct()
    if edges.isEmpty():
        return rows
    found = components(edges, "jaccard-labels").select(F.col("node").alias("label"), "root")
    return materialise(
        attach(rows, found, ["label"], hot_keys(rows, ["label"], "jaccard-merged")).withColumn("label", F.coalesce("root", "label")).drop("root"), "jaccard-labelled"
    )


def solve(family: DataFrame, rule: Rule = OP6) -> DataFrame:
    """d1, d2, label of every set of ``family`` (f, d1, d2, shingles): equal labels, one component.

    ``label`` starts as a number for each set.  Small families are dealt over tasks many
    at a time, by their bytes; a large one is cut into blocks by its sets and bytes.
    """

    def solved(table: pa.Table) -> pa.Table:
        return _solve(table, rule)

    numbered = materialise(family.withColumn("label", F.monotonically_increasing_id()), "jaccard-sets")
    weight = F.sum(F.octet_length("shingles").cast("long"))
    counted = materialise(numbered.groupBy("f").agg(F.count("*").alias("sets"), weight.alias("bytes")), "jaccard-counts")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    total = counted.where(blocks == 1).agg(F.sum("bytes"), F.sum("sets")).first()
    deals = max(1, -(-int(total[0] or 0) // BLOCK_BYTES), -(-int(total[1] or 0) // BLOCK))
    rows = attach(numbered, counted.select("f", blocks.alias("blocks")), ["f"], hot_keys(numbered, ["f"], "jaccard-blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("deal", F.when(F.col("blocks") > 1, F.xxhash64("f", "block")).otherwise(F.pmod(F.xxhash64("f"), F.lit(deals))))
    rows = materialise(rows, "jaccard-family")
    first = rows.select("deal", "f", "d1", "d2", "label", "shingles").groupBy("deal").applyInArrow(solved, SOLVED)
    rows = _merged(rows, materialise(first, "jaccard-first"))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return rows.select("d1", "d2", "label")
    # the leaders of what the blocks found, in blocks again
    leaders = large.groupBy("f", "block", "label").agg(F.min_by(F.struct("d1", "d2", "shingles"), F.struct("d1", "d2")).alias("s"))
    leaders = materialise(leaders.select("f", "label", "s.*"), "jaccard-leaders")
    deals = leaders.groupBy("f").agg(F.ceil(F.greatest(F.count("*") / BLOCK, weight / BLOCK_BYTES)).alias("deals"))
    leaders = attach(leaders, deals, ["f"], hot_keys(leaders, ["f"], "jaccard-leaders")).withColumn("deal", F.pmod(F.xxhash64("label"), F.col("deals")))
    second = leaders.select("f", "deal", "d1", "d2", "label", "shingles").groupBy("f", "deal").applyInArrow(solved, SOLVED)
    rows = _merged(rows, materialise(second, "jaccard-leaders"))
    # families that still differ: every pair of blocks
    differ = rows.where("blocks > 1").groupBy("f").agg((F.min("label") != F.max("label")).alias("differs"))
    differ = materialise(differ.where("differs"), "jaccard-differ")
    if differ.isEmpty():
        return rows.select("d1", "d2", "label")
    left = attach(rows, differ, ["f"], hot_keys(rows, ["f"], "jaccard-differ")).where("differs").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    third = left.select("f", "i", "j", "d1", "d2", "label", "shingles").groupBy("f", "i", "j").applyInArrow(solved, SOLVED)
    return _merged(rows, materialise(third, "jaccard-pairs")).select("d1", "d2", "label")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def join(docs: DataFrame, rule: Rule = OP6) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    A null text or one without words has an empty set, links with nothing and is its own
    component.  Null ids come after all others; rows with the same id are told apart by
    their sets; repeated rows link; other columns are ignored; an empty table gives no rows.
    """
    scale = Scale.of(_plain(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gather(batches, rule, scale)

    rows = materialise(_plain(docs).mapInArrow(run, _ROWS_DDL), "jaccard", partition_by=["kind"])
    sets = rows.where("kind = 0").select("doc_id", "n_shingles", "d1", "d2")
    classes = materialise(sets.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first")), "jaccard-classes")
    families = components(materialise(ties(rows, rule), "jaccard-ties"), "jaccard-families")
    near = materialise(classes.join(families.select(F.col("node").alias("d1"), F.col("root").alias("f")), "d1"), "jaccard-near")
    own = near.select("f", "first", F.col("d1").alias("n1"), F.col("d2").alias("n2"))
    hit = (F.col("d1") == F.col("n1")) & (F.col("d2") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("first"))
    chosen = met(members(docs, near.select(F.col("first").alias("id")), rule), own, hit, "inner").select("f", "d1", "d2", "shingles")
    labels = solve(chosen, rule).dropDuplicates(["d1", "d2"])  # repeated rows have one label
    labelled = materialise(near.join(labels, ["d1", "d2"]).select("d1", "d2", "first", "label"), "jaccard-found")
    least = labelled.groupBy("label").agg(F.min("first").alias("least"))
    moved = attach(labelled, least, ["label"], hot_keys(labelled, ["label"], "jaccard-least")).select("d1", "d2", "least")
    found = materialise(classes.join(moved, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "first").alias("component_id")), "jaccard-components")
    full = sets.where("n_shingles > 0")
    full = attach(full, found, ["d1", "d2"], hot_keys(full, ["d1", "d2"], "jaccard-rows")).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep(docs: DataFrame, rule: Rule = OP6) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns.

    Of repeated rows (same id and text) one stays; rows of one id with different texts
    all stay, as does a null or empty text, which is its own component.  Null ids come
    after all others.  Columns may have any names; an empty table gives no rows.
    """
    found = materialise(join(docs, rule), "jaccard-kept")
    later = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"))
    again = materialise(first.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "jaccard-again")
    # an id can stand in both: rows of one id that belong to different components
    gone = materialise(later.join(first, later["id"].eqNullSafe(first["id"]), "left_anti"), "jaccard-gone")
    kept = with_ids(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    once = with_ids(kept, again).dropDuplicates(["doc_id", "text"])
    return with_ids(kept, again, "left_anti").unionByName(once)
