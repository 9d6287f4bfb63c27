"""Arrow batches to and from Python, in pieces of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Text handled at once, in bytes; a single longer text makes a piece of its own.
PIECE_BYTES = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with at most ``limit`` bytes of text, with the texts as UTF-8 (null: empty).

    The runs of a batch are about equally long, so that none is left over with a few rows.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        runs = -(-column.nbytes // limit) or 1
        most = min(limit, column.nbytes // runs + 1)
        start, held, rows = 0, 0, []
        for i, value in enumerate(column):
            value = value.as_py() or b""
            # a run ends before a text that passes the limit, or once it has its share
            if rows and (held >= most or held + len(value) > limit):
                yield batch.slice(start, i - start), rows
                start, held, rows = i, 0, []
            rows.append(value)
            held += len(value)
        if rows:
            yield batch.slice(start, len(rows)), rows


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    """A record batch from columns (arrays, NumPy arrays or lists) in the order of ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
