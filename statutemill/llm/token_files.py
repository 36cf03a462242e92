"""Token-id files: fixed-size id blocks cut into bit or byte planes, each plane compressed with zstandard, found by a chunk index.

A file: the magic, then for each block its planes as zstandard frames (plane 0 holds the lowest bit or byte of all ids),
then a zstandard frame of JSON-described arrays (the index), its length as u64, and the magic again. The index has, for
each block, where it starts, its number of ids and the length of each plane's frame; and for each document, in file
order, its id (null: NULL_ID), key and number of ids. Ids of a document follow each other and may cross blocks. Files
are numbered in ascending doc_id order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import NULL_ID, batch, pack, partitions, row_key, stored, unpack

MAGIC = b"IDPLANE1"
BLOCK, LEVEL = 1 << 16, 3

_FILE = pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_FILE_SQL = "file long, path string, n_docs long, n_ids long, n_bytes long"


def split_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes of u32 ids, as few as the largest needs: of bits (packed eight ids a byte) or of bytes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = max(1, int(ids.max(initial=0)).bit_length())
    if unit == "byte":
        return [raw[:, b].tobytes() for b in range(-(-top // 8))]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(top)]


def join_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for b, p in enumerate(planes):
            raw[:, b] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for b, p in enumerate(planes):
        bits[:, b] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file; holds a block of ids at most, besides the index."""

    def __init__(self, path: str, unit: str) -> None:
        self.fs, self.path = pa.fs.FileSystem.from_uri(path)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"  # a second attempt at the same task does not disturb the first
        self.out, self.unit, self.at = self.fs.open_output_stream(self.draft), unit, 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[tuple[int, int, int]] = []
        self.blocks: list[tuple[int, int]] = []
        self.frames: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in split_planes(ids, self.unit)]
        self.blocks.append((self.at, len(ids)))
        self.frames += [len(planes), *map(len, planes)]
        for p in planes:
            self._put(p)

    def add(self, doc_id: int, key: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, key, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            flat, at = np.concatenate(self.held), 0
            while len(flat) - at >= BLOCK:
                self._block(flat[at : at + BLOCK])
                at += BLOCK
            self.held, self.n_held = [flat[at:].copy()], len(flat) - at

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = pack(np.frombuffer(self.unit.encode(), np.uint8), np.array(self.blocks, "<i8").reshape(-1), np.array(self.frames, "<i8"), np.array(self.docs, "<i8").reshape(-1))
        self._put(index + np.array([len(index)], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.path)


class Reader:
    """Reads one file by its index; holds a block of ids at most."""

    def __init__(self, path: str) -> None:
        fs, path = pa.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        n = int(np.frombuffer(tail, "<u8", 1)[0])
        unit, blocks, self.frames, docs = unpack(self.file.read_at(n, size - 16 - n))
        self.unit, self.blocks, self.docs = unit.tobytes().decode(), blocks.reshape(-1, 2), docs.reshape(-1, 3)

    def blocks_of_ids(self) -> Iterator[np.ndarray]:
        at, opened = 0, zstandard.ZstdDecompressor()
        for start, n in self.blocks.tolist():
            sizes = self.frames[at + 1 : at + 1 + int(self.frames[at])].tolist()
            at += 1 + len(sizes)
            raw, p, planes = self.file.read_at(sum(sizes), start), 0, []
            for s in sizes:
                planes.append(opened.decompress(raw[p : p + s]))
                p += s
            yield join_planes(planes, n, self.unit)

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """doc_id, key and pieces of ids of each document, in file order."""
        blocks, now, at = self.blocks_of_ids(), np.empty(0, "<u4"), 0
        for doc_id, key, n in self.docs.tolist():
            pieces = []
            while n:
                if at == len(now):
                    now, at = next(blocks), 0
                take = min(n, len(now) - at)
                pieces.append(now[at : at + take])
                at, n = at + take, n - take
            yield doc_id, key, pieces


def in_order(docs: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id (null: NULL_ID), key, text of docs, range-partitioned and sorted by id; rows of one id by their text's hash."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), row_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange(n or partitions(docs), "doc_id", "key").sortWithinPartitions("doc_id", "key")


def write(ordered: DataFrame, folder: str, encoder: Callable[[], Callable[[str | None], np.ndarray]], unit: str = "byte", end_id: int | None = 0) -> DataFrame:
    """Encodes the rows of in_order() and writes a file for each of its partitions; returns a row for each file.

    encoder is called once a task and gives the function from text to u32 ids; end_id is added to each document. A task
    that runs again writes the same bytes under a draft name and moves them into place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, out, encode = TaskContext.get().partitionId(), None, None
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            if out is None and len(b):
                fs, at = pa.fs.FileSystem.from_uri(folder)
                fs.create_dir(at, recursive=True)
                path, encode = f"{folder}/ids-{number:07d}.bin", encoder()
                out = Writer(path, unit)
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text")):
                out.add(doc_id, key, np.concatenate([encode(text.as_py()), end]))
        if out is not None:
            out.close()
            yield batch(_FILE, file=[number], path=[path], n_docs=[len(out.docs)], n_ids=[out.n_ids], n_bytes=[out.at])

    return stored(ordered.mapInArrow(run, _FILE_SQL), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 of every document in the files of write()."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    # one row a file: the number of ids in earlier files
    based = files.withColumn("base", F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                ids, starts, sizes, sums = [], [], [], []
                for doc_id, _, pieces in Reader(path).documents():
                    crc, n = 0, 0
                    for p in pieces:
                        crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                    ids.append(None if doc_id == NULL_ID else doc_id)
                    starts.append(start)
                    sizes.append(n)
                    sums.append(crc)
                    start += n
                    if len(ids) == 20_000:
                        yield batch(out, doc_id=ids, start=starts, n_tokens=sizes, ids_crc32=sums)
                        ids, starts, sizes, sums = [], [], [], []
                if ids:
                    yield batch(out, doc_id=ids, start=starts, n_tokens=sizes, ids_crc32=sums)

    spread = based.select("path", F.coalesce("base", F.lit(0)).alias("base")).repartition(partitions(files), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
