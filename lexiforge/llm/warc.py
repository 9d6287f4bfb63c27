"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``.  A bundle is the
frames one after another and a footer: a skippable frame with the seek table, in the
seekable format (for each frame its compressed and decompressed size, then the number
of frames, a descriptor byte and the magic number).  Any Zstandard reader can read a
bundle as one stream; a record's identifier maps to its frame and to its offset inside
the decompressed frame, so one record costs one frame.

Bundles are rows (bundle, content, index) of a table in the shared folder, so that
they can be in any store that Spark writes; ``export`` writes them as .warc.zst files.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes: the one with the
smallest id is a response, the others revisit it and carry no payload.  A record's
identifier is made of its page id, or, where an id stands in several rows, of that and
its task and number there, so that identifiers never repeat.

Scale: the payload digests, 40 bytes a row, are grouped with partial sums; only digests
that occur twice or more are joined back.  They are broadcast if they are few
(``SENT_IDS``), so that the pages stay where they are; beyond that the join shuffles
the pages.  A writer holds one bundle of at most ``BUNDLE_BYTES`` plus a frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrow import batch_of, give_back, pieces
from lexiforge.llm.common import materialise, met

REVISIT_BYTES = 100
BUNDLE_BYTES = 8_000_000
#: A frame ends with the record that brings it to this size.
FRAME_BYTES = 64_000
LEVEL = 3
#: WARC-Date of all records: the table has no time of the visit, and reruns agree.
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def record_id(page_id: int | None, nth: str = "") -> str:
    """The WARC-Record-ID of a page; ``nth`` tells rows of one id apart."""
    return f"<urn:page:{page_id}{':' * bool(nth)}{nth}>"


def page_of(identifier: str) -> int | None:
    """The page of a WARC-Record-ID."""
    value = identifier.split(":")[2].rstrip(">")
    return None if value == "None" else int(value)


def record(identifier: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit (``refers_to``) has the digest and length of the payload, not the payload."""
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", identifier),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    lines = b"".join(f"{k}: {v}".encode() + CRLF for k, v in head)
    return b"WARC/1.1" + CRLF + lines + CRLF + payload + CRLF + CRLF


def parse(raw: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``offset``, and where the next one starts."""
    end = raw.index(CRLF + CRLF, offset)
    version, *lines = raw[offset:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    after = start + int(headers["Content-Length"])
    if raw[after : after + 4] != CRLF + CRLF:
        raise ValueError("a record's length doesn't match its block")
    return headers, raw[start:after], after + 4


class Bundle:
    """Collects records into one seekable bundle."""

    def __init__(self, level: int = LEVEL) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        #: record id, frame and offset in the decompressed frame
        self.places: list[tuple[str, int, int]] = []
        self.bytes = 0
        self._open: list[bytes] = []
        self._held = 0
        self._compressor = zstandard.ZstdCompressor(level=level)

    def add(self, identifier: str, raw: bytes) -> None:
        self.places.append((identifier, len(self.frames), self._held))
        self._open.append(raw)
        self._held += len(raw)
        if self._held >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._compressor.compress(b"".join(self._open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self._held))
            self.bytes += len(frame)
            self._open, self._held = [], 0

    def content(self) -> bytes:
        """The frames and the seek table."""
        self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    offset, table = 0, []
    for compressed, size in struct.iter_unpack("<II", content[-9 - 8 * n : -9]):
        table.append((offset, compressed, size))
        offset += compressed
    return table


def frame_at(content: bytes, entry: tuple[int, int, int]) -> bytes:
    """One frame, by its entry in the seek table."""
    offset, compressed, size = entry
    return zstandard.ZstdDecompressor().decompress(content[offset : offset + compressed], max_output_size=size)


PLACE = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])
BUNDLES = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("places", pa.list_(PLACE))])
BUNDLES_DDL = "bundle string, content binary, places array<struct<record_id: string, frame: int, offset: long>>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def closed(bundle: Bundle) -> pa.RecordBatch:
        content = bundle.content()
        places = [dict(zip(("record_id", "frame", "offset"), p)) for p in bundle.places]
        return batch_of(BUNDLES, [hashlib.sha256(content).hexdigest()[:32]], [content], [places])

    bundle, task, nth = Bundle(), TaskContext.get().partitionId(), 0
    for rows, payloads in pieces(batches, "html"):
        columns = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "first", "first_again", "again"))
        for payload, page, url, digest, first, first_again, again in zip(payloads, *columns):
            nth += 1
            revisit = first is not None and len(payload) >= REVISIT_BYTES and page != first
            # a response whose id stands in several rows can't be named; its page can
            target = record_id(first, "any" if first_again else "") if revisit else None
            name = record_id(page, f"{task}-{nth}" if again else "")
            bundle.add(name, record(name, url, payload, digest, target))
            if bundle.bytes >= BUNDLE_BYTES:
                yield closed(bundle)
                bundle = Bundle()
    if bundle.places:
        yield closed(bundle)
    give_back()


def write(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html); returns the written table of bundles.

    A null html is an empty payload, a null url leaves out the target, a null page_id
    comes after all others; rows with the same page_id and payload are a response each;
    other columns are ignored; an empty table gives no bundles.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), digest.alias("digest"))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    again = materialise(rows.groupBy(F.col("page_id").alias("__page")).agg(F.count("*").alias("n")).where("n > 1").select("__page", F.lit(True).alias("again")), "warc-again")
    firsts = large.groupBy(F.col("digest").alias("__digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    named = again.select(F.col("__page").alias("first"), F.col("again").alias("first_again"))
    firsts = materialise(firsts.join(named, "first", "left").select("__digest", "first", "first_again"), "warc-firsts")
    rows = met(rows, firsts, F.col("digest") == F.col("__digest"), "left")
    rows = met(rows, again, F.col("page_id").eqNullSafe(F.col("__page")), "left")
    rows = rows.select("page_id", "url", "html", "digest", "first", "first_again", "again")
    return materialise(rows.mapInArrow(_write, BUNDLES_DDL), "warc")


RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame int, offset long"
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("offset", pa.int64()),
    ]
)


def described(content: bytes, bundle: str) -> Iterator[tuple]:
    """The rows of ``read`` for one bundle; payload digests are computed anew."""
    for number, entry in enumerate(seek_table(content)):
        raw, offset = frame_at(content, entry), 0
        while offset < len(raw):
            headers, block, after = parse(raw, offset)
            kind, known = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
            size = int(headers["X-Payload-Length"])
            refers = headers.get("WARC-Refers-To")
            if kind == "response":
                found = hashlib.sha256(block).hexdigest()
                if found != known or len(block) != size:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
            yield (
                page_of(headers["WARC-Record-ID"]), size, known, kind, page_of(refers) if refers else None, headers.get("WARC-Target-URI"), bundle, number, offset,
            )
            offset = after


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = list(described(content.as_py(), bundle))
            yield batch_of(RECORDS, *map(list, zip(*rows)))
    give_back()


def read(bundles: DataFrame) -> DataFrame:
    """A row for each record of the bundles, found through their seek tables."""
    return bundles.select("bundle", "content").mapInArrow(_read, RECORDS_DDL)


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame (its number in the seek table) and offset in the decompressed frame."""
    return bundles.select("bundle", F.inline("places"))


def fetch(bundles: DataFrame, page_ids: list[int]) -> DataFrame:
    """page_id and payload of single pages (revisits: empty); only their frames are decompressed."""
    found = index(bundles).where(F.split_part(F.rtrim(F.col("record_id"), F.lit(">")), F.lit(":"), F.lit(3)).isin([str(p) for p in page_ids]))
    found = found.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("at"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = content.as_py()
                table = seek_table(raw)
                blocks = [parse(frame_at(raw, table[a["frame"]]), a["offset"]) for a in at]
                yield batch_of(schema, [page_of(h["WARC-Record-ID"]) for h, _, _ in blocks], [b for _, b, _ in blocks])

    return bundles.join(found, "bundle").select("content", "at").mapInArrow(run, "page_id long, payload binary")


def export(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as a file ``folder``/<bundle>.warc.zst on any file system that Spark knows, one after another."""
    jvm, spark = bundles.sparkSession.sparkContext._jvm, bundles.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in bundles.select("bundle", "content").toLocalIterator():  # one bundle at a time
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['bundle']}.warc.zst")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytes(row["content"]))
        out.close()
