"""Helpers shared by the training-data operators: shared storage, words, hashes and packed blobs."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, stored

#: Fixed: ASCII white space that separates words, as a Java / RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed: an id that stands for a null doc_id inside packed blobs; it sorts after every other id.
NULL_ID = np.iinfo(np.int64).max


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: Column) -> Column:
    """With doc_id, tells rows apart that repeat an id with another text; equal rows share it, and their results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Several arrays as one zstandard frame; multi-byte items go as byte planes, which compress better."""
    parts = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.dtype.str.encode().ljust(8) + np.array([a.size], "<u8").tobytes())
        parts.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size else b"")
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = np.frombuffer(raw, "<u4", 1), 4, []
    for _ in range(n):
        kind = np.dtype(raw[at : at + 8].strip().decode())
        (size,) = np.frombuffer(raw, "<u8", 1, at + 8)
        at, size = at + 16, int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def trim() -> None:
    """Gives freed memory back to the system, where the C library can; a reused worker otherwise keeps its peak."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _libc = int
    _libc(0)


_libc = None


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of equal key from a stream of batches that is sorted by it; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if held and keys[s] != now:
                done, held = [pa.Table.from_batches(held)], []
                yield now, done.pop()  # nothing here keeps what the caller is done with
            now = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        done, held = [pa.Table.from_batches(held)], []
        del b
        yield now, done.pop()


__all__ = ["NULL_ID", "SPACE", "batch", "by_group", "new_path", "pack", "partitions", "row_key", "stored", "trim", "unpack"]
