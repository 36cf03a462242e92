"""BPE encoding and decoding by a table of distinct words.

Texts are split at ASCII white space, which no token crosses. Documents are taken in chunks; each chunk sends its
distinct words, dealt by word, to the distinct-word table, where each is encoded once however many chunks hold it. The
ids travel back to the chunks, where they take the words' positions. Decoding joins ids to the vocabulary's pieces; the
vocabulary bounds that side.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_group, pack, partitions, unpack
from .super_kmers import word_hashes

#: Bytes of text in a chunk.
CHUNK_BYTES = 24 << 20
#: Parts of the word table that one task takes in turn, so that its words in memory stay few.
PARTS_PER_TASK = 4

_PART = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
_PART_SQL = "part long, chunk long, data binary"
_SIDE = pa.schema([("chunk", pa.int64()), ("side", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])
_SIDE_SQL = "chunk long, side int, data binary, ids array<long>"
_WORDS, _TEXTS = 0, 1


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _closing(path: str) -> np.ndarray | None:
    """Which ids close a word; None for a vocabulary that marks no word ends."""
    spec = json.loads(_tokenizer(path).to_str())
    suffix = spec["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    table = pieces(path)
    out = np.zeros(max(table) + 1, bool)
    out[[i for i, p in table.items() if p.endswith(suffix)]] = True
    return out


#: Words that the library encodes in one call, as one text.
_TOGETHER = 2000


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian u32.

    Words of letters alone are one unit each to the tokenizer, so many go in one text and their ids part at closing ids;
    others go one by one.
    """
    texts = [w.decode("utf-8", "replace") for w in words]
    closing, out = _closing(path), [b""] * len(words)
    plain = [i for i, t in enumerate(texts) if t.isalpha() and t.lower().isalpha()] if closing is not None else []
    rest = set(range(len(words))).difference(plain)
    for s in range(0, len(plain), _TOGETHER):
        part = plain[s : s + _TOGETHER]
        (found,) = _tokenizer(path).encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(closing[ids]) + 1
        if len(ends) != len(part):
            rest.update(part)
            continue
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        for i, a, z in zip(part, [0, *ends], ends):
            out[i] = raw[a:z]
    order = sorted(rest)
    for i, e in zip(order, _tokenizer(path).encode_batch_fast([texts[i] for i in order], add_special_tokens=False)):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


_MARKS = b".,!*$%&#|;:?\"()[]-_/+=~^`@{}\\<>"


def split_word(word: bytes) -> tuple[bytes, bytes]:
    """A word's core and the marks at its end, where the tokenizer parts them too: the table then holds cores, in lower case if ASCII.

    A mark after a letter or digit always begins a new unit. Words that may hold a special token, or whose core ends
    otherwise, stay whole.
    """
    if word.isalpha():  # ASCII letters alone
        return word.lower(), b""
    core = word.rstrip(_MARKS)
    if not core or b"<|" in word or b"|>" in word:
        return word, b""
    if len(core) == len(word) and not word.isascii():
        return word, b""
    if core.isascii():
        return (core.lower(), word[len(core) :]) if core[-1:].isalnum() else (word, b"")
    return (core, word[len(core) :]) if core.decode("utf-8", "replace").lower()[-1].isalpha() else (word, b"")


def pieces(path: str) -> dict[int, str]:
    """The id-to-piece table of a vocabulary, added tokens included."""
    return {i: piece for piece, i in _tokenizer(path).get_vocab(with_added_tokens=True).items()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(chunk, doc ids, texts); numbers hang on docs' own partition (column pid) alone, so that both passes over docs agree."""
    base, made, held, ids, size = 0, 0, [], [], 0
    for b in batches:
        if len(b):
            base = b.column("pid")[0].as_py() << 32
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if held and size + len(raw) > CHUNK_BYTES:
                yield base + made, ids, held
                made, held, ids, size = made + 1, [], [], 0
            held.append(raw)
            ids.append(doc_id)
            size += len(raw)
    if held:
        yield base + made, ids, held


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian u32) and text_bytes of every row of docs: the ids of its whole text.

    Null and empty texts, and those of white space, have no ids; a null doc_id stays null; repeated rows each get a row.
    docs must come in the same partitions when it is read twice, as tables do; where it does not, a chunk encodes the
    words that it lacks itself, so that results stay right.
    """
    return _joined(docs, path, False)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs: encode(), then decoding by the id-to-piece table."""
    return _joined(docs, path, True)


#: Bytes of whole texts whose ids are put in place at a time.
_JOIN_BYTES = 4 << 20
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _placed(texts: list[bytes], table: dict[bytes, bytes]) -> tuple[np.ndarray, list[int]]:
    """Ids of all texts, one after another, and where each text's begin and end: words are told apart once, then ids go to their places."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        return np.empty(0, "<u4"), [0] * (len(texts) + 1)
    _, first, of = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    same = (ends - starts == (ends - starts)[first][of]) & (buf[starts] == buf[starts[first]][of]) & (buf[ends - 1] == buf[ends[first] - 1][of])
    raw = buf.tobytes()
    if same.all():
        words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    else:  # a hash stood for two words: each place for itself
        of = np.arange(len(starts))
        words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    found = [table[w] for w in words]
    size = np.array([len(x) // 4 for x in found], np.int64)
    flat = np.frombuffer(b"".join(found), "<u4")
    n = size[of]
    ids = flat[_stretches((np.cumsum(size) - size)[of], n)]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.concatenate([[0], np.cumsum(n)])
    return ids, [0, *upto[np.searchsorted(starts, text_ends)].tolist()]


def _stretches(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the stretches first .. first + n, one after another; a block's bytes need 32 bits at most."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    return np.repeat((first - (ends - n)).astype(kind), n) + np.arange(total, dtype=kind)


class _Joiner:
    """The id-to-piece table as one run of bytes, joined by index; pieces are parted by a space, as without a decoder."""

    def __init__(self, path: str) -> None:
        table = pieces(path)
        parts = [(table[i] + " ").encode() if i in table else b"" for i in range(max(table) + 1)]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decoded(self, ids: np.ndarray, bounds: list[int]) -> Iterator[bytes]:
        n = self.size[ids]
        raw = self.flat[_stretches(self.start[ids], n)].tobytes()
        upto = np.concatenate([[0], np.cumsum(n)])[bounds].tolist()
        for s, e in zip(upto, upto[1:]):
            yield raw[s : max(s, e - 1)]


def _joined(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    n = partitions(docs)
    n_parts = n * PARTS_PER_TASK
    # not the task's number: below a union that is another one than docs' partition
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("pid"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _chunks(batches):
            seen: set[bytes] = set()
            for t in texts:
                seen.update(t.split())
            by_part: dict[int, list[bytes]] = {}
            for w in {split_word(w)[0] for w in seen}:
                by_part.setdefault(zlib.crc32(w) % n_parts, []).append(w)
            del seen
            shrink = zstandard.ZstdCompressor(level=3)
            parts = sorted(by_part)
            yield batch(_PART, part=parts, chunk=[chunk] * len(parts), data=[shrink.compress(b"\n".join(sorted(by_part.pop(p)))) for p in parts])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, "part"):
            chunks, blobs = group.column("chunk").to_pylist(), group.column("data").to_pylist()
            opened = zstandard.ZstdDecompressor()
            lists = [opened.decompress(x).split(b"\n") for x in blobs]
            distinct = list(set().union(*lists))
            table: dict[bytes, bytes] = {}
            for i in range(0, len(distinct), 20_000):
                table.update(zip(distinct[i : i + 20_000], encode_words(path, distinct[i : i + 20_000])))
            for chunk, mine in zip(chunks, lists):
                ids = [table[w] for w in mine]
                data = pack(np.frombuffer(b"\n".join(mine), np.uint8), np.array([len(x) // 4 for x in ids], "<u2" if max(map(len, ids)) < 4 << 16 else "<u4"), np.frombuffer(b"".join(ids), "<u4"))
                yield batch(_SIDE, chunk=[chunk], side=[_WORDS], data=[data], ids=[None])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, held in _chunks(batches):
            data = pack(np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held], "<u8"))
            yield batch(_SIDE, chunk=[chunk], side=[_TEXTS], data=[data], ids=[ids])

    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())] + ([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.binary()), ("text_bytes", pa.int64())]))

    class Cores(dict):
        """Ids of cores; those that no part sent, and marks, are encoded here."""

        def __missing__(self, word: bytes) -> bytes:
            self[word] = encode_words(path, [word])[0]
            return self[word]

    class Words(dict):
        """Ids of the words of a chunk, each put together once from its core and marks."""

        def __init__(self) -> None:
            self.cores = Cores()

        def __missing__(self, word: bytes) -> bytes:
            core, marks = split_word(word)
            self[word] = ids = self.cores[core] + self.cores[marks] if marks else self.cores[core]
            return ids

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _Joiner(path) if digest else None
        table, now = Words(), None
        for b in batches:  # sorted by chunk, a chunk's words before its texts
            for r in b.to_pylist():
                if r["chunk"] != now:
                    table, now = Words(), r["chunk"]
                if r["side"] == _WORDS:
                    text, counts, flat = unpack(r["data"])
                    raw, ends = flat.tobytes(), np.cumsum(counts.astype(np.int64)) * 4
                    starts = ends - counts.astype(np.int64) * 4
                    table.cores.update(zip(text.tobytes().split(b"\n"), (raw[s:e] for s, e in zip(starts.tolist(), ends.tolist()))))
                    continue
                flat, sizes = unpack(r["data"])
                raw, stops = flat.tobytes(), np.cumsum(sizes.astype(np.int64)).tolist()
                at, first = 0, 0
                while first < len(stops):  # whole texts, _JOIN_BYTES at a time
                    last = first + 1
                    while last < len(stops) and stops[last] - at <= _JOIN_BYTES:
                        last += 1
                    texts = [raw[s:e] for s, e in zip([at, *stops[first : last - 1]], stops[first:last])]
                    ids, bounds = _placed(texts, table)
                    each = [ids[s:e].tobytes() for s, e in zip(bounds, bounds[1:])]
                    cols = {"doc_id": r["ids"][first:last], "n_tokens": np.diff(bounds)}
                    if digest:
                        cols["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in each]
                        cols["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in join.decoded(ids, bounds)]
                    else:
                        cols |= {"ids": each, "text_bytes": [len(t) for t in texts]}
                    yield batch(out, **cols)
                    at, first = stops[last - 1], last

    dealt = rows.mapInArrow(words, _PART_SQL).repartition(n, "part").sortWithinPartitions("part")
    sides = dealt.mapInArrow(encoded, _SIDE_SQL).unionByName(rows.mapInArrow(texts, _SIDE_SQL))
    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, text_bytes long")
    return sides.repartition(n, "chunk").sortWithinPartitions("chunk", "side").mapInArrow(joined, kinds)


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id and decoded of rows (doc_id, ids array<int>): ids joined to table (id, piece), pieces joined by a space in order.

    table is a vocabulary, which bounds it. Ids that it lacks give nothing; null or empty ids give ''. Rows are told
    apart by their own number, so repeated ids stay apart.
    """
    rows = encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    each = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(table.select("id", "piece")), "id", "left")
    found = F.filter(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"].isNotNull())
    return each.groupBy("row", "doc_id").agg(found.alias("found")).select("doc_id", F.array_join(F.transform("found", lambda x: x["piece"]), " ").alias("decoded"))


def piece_table(spark, path: str) -> DataFrame:
    return spark.createDataFrame(sorted(pieces(path).items()), "id int, piece string")
