"""Repeated word windows by super-k-mers.

A window is `width` consecutive words of a document. Its minimiser is the least hash of the word grams in it. Consecutive
windows that share a minimiser travel as one packed string to its bucket; there, sorting brings equal windows together,
words are compared byte by byte, and each window learns the smallest doc_id it starts in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import batch, by_group, pack, partitions, unpack
from .spans import SPAN, SPAN_SQL, apply_spans, common_grams, demoted, flagged_spans, keyed, measured, mix, runs, sliding_min

WIDTH, GRAM = 13, 3
#: Bytes of text cut into runs at a time.
BLOCK = 8 << 20

_RUNS = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
_LONG_WORD = 48
_FACTOR = np.uint64(0x100000001B3)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes; its place does not matter."""
    size = ends - starts
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    live = np.arange(len(starts))
    for j in range(min(_LONG_WORD, int(size.max(initial=0)))):
        live = live[size[live] > j]
        h[live] = (h[live] ^ buf[starts[live] + j]) * _FACTOR
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return mix(h)


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in lines of words joined by single spaces, and each word's line."""
    line_ends = buf == 10
    seps = np.flatnonzero(line_ends | (buf == 32))
    starts, ends = np.concatenate([[0], seps + 1]), np.concatenate([seps, [len(buf)]])
    return starts, ends, np.concatenate([[0], np.cumsum(line_ends[seps])])


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(out)]
    return mix(out)


def _low_grams(texts: list[bytes], gram: int) -> np.ndarray:
    """Hashes of word grams of texts that are low enough to be the least of a window, but for few; a few cross from one text to the next."""
    line = b" ".join(b" ".join(texts).split())
    buf = np.frombuffer(line, np.uint8)
    starts, ends, _ = _words(buf)
    h = _grams(word_hashes(buf, starts, ends), gram) if line else np.empty(0, np.uint64)
    return h[h < np.uint64(1 << 63)]


def _packed(lines: list[bytes], doc: list[tuple[int, int]], offset: list[int], width: int, gram: int, buckets: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of a block of lines (normalised stretches of documents), by bucket."""
    text = b"\n".join(lines)
    buf = np.frombuffer(text, np.uint8)
    starts, ends, line = _words(buf)
    if len(starts) < width:
        return
    least = sliding_min(demoted(_grams(word_hashes(buf, starts, ends), gram), common), width - gram + 1)
    valid = line[: len(least)] == line[width - 1 : width - 1 + len(least)]
    first, last = runs(least, valid)
    if not len(first):
        return
    bucket = (mix(least[first]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, last, bucket = first[order], last[order], bucket[order]
    of = line[first]
    line_first = np.searchsorted(line, np.arange(len(lines)))
    place = first - line_first[of] + np.array(offset, np.int64)[of]
    begin, stop = starts[first].tolist(), ends[last + width - 1].tolist()
    ids, keys = np.array([d[0] for d in doc], np.int64), np.array([d[1] for d in doc], np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    rows, data = [], []
    for s, e in zip(cuts, cuts[1:]):
        used, local = np.unique(of[s:e], return_inverse=True)
        deltas = np.diff(ids[used], prepend=0)
        data.append(pack(np.frombuffer(b"\n".join([text[a:z] for a, z in zip(begin[s:e], stop[s:e])]), np.uint8), deltas, keys[used].astype(np.uint32), local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), place[s:e].astype(np.int64)))
        rows.append(int(bucket[s]))
    yield batch(_RUNS, bucket=rows, data=data)


def _equal_windows(blobs: list[bytes], width: int) -> pa.RecordBatch | None:
    """Spans of a bucket's windows that also start in a document of smaller id."""
    texts, ids, keys, places = [], [], [], []
    for b in blobs:
        text, deltas, key, local, place = unpack(b)
        texts.append(text.tobytes())
        ids.append(np.cumsum(deltas)[local])
        keys.append(key[local].astype(np.int64))
        places.append(place)
    text = b"\n".join(texts)
    del texts
    buf = np.frombuffer(text, np.uint8)
    run_id, run_key, run_place = np.concatenate(ids), np.concatenate(keys), np.concatenate(places)
    starts, ends, line = _words(buf)
    h = word_hashes(buf, starts, ends)
    windows = _grams(h, width)
    del h
    at = np.flatnonzero(line[: len(windows)] == line[width - 1 : width - 1 + len(windows)])
    value = windows[at]
    order = np.argsort(value, kind="stable")
    value = value[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    place_in, group = order[many], group[many]  # windows whose hash is not alone
    if not len(place_in):
        return None
    doc = run_id[line[at[place_in]]]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(head, len(group)))
    flag = doc > np.repeat(np.minimum.reduceat(doc, head), size)
    # words are compared themselves: a flagged window must equal one of smaller id; equal hashes alone do not count
    begin, stop = starts[at[place_in]].tolist(), ends[at[place_in] + width - 1].tolist()
    for g in np.flatnonzero(np.add.reduceat(flag, head)).tolist():
        a, z = int(head[g]), int(head[g] + size[g])
        one = text[begin[a] : stop[a]]
        if all(text[x:y] == one for x, y in zip(begin[a:z], stop[a:z])):
            continue
        least: dict[bytes, int] = {}
        for i in range(a, z):
            w = text[begin[i] : stop[i]]
            least[w] = min(least.get(w, int(doc[i])), int(doc[i]))
        for i in range(a, z):
            flag[i] = doc[i] > least[text[begin[i] : stop[i]]]
    flags = np.zeros(len(at), bool)
    flags[place_in[flag]] = True
    run = line[at]
    where = run_place[run] + (at - np.searchsorted(line, np.arange(len(run_id)))[run])
    # stretches must not cross runs: a run's own number breaks the count
    a, z = flagged_spans(flags, where + run * (1 << 40), width)
    if not len(a):
        return None
    return batch(SPAN, doc_id=run_id[run[a]], key=run_key[run[a]], start=where[a], end=where[z] + width)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, start, end) in words, for rows of keyed(): stretches of windows that also start in a smaller doc_id."""
    n, buckets = measured(docs)
    common = common_grams(docs, n, lambda texts: _low_grams(texts, gram))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, doc, offset, size = [], [], [], 0
        for b in batches:
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text")):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                step = 1 << 20  # words of a very long text go in stretches that share all but one word of a window
                for s in range(0, max(0, len(words) - width + 1), step):
                    line = b" ".join(words[s : s + step + width - 1])
                    lines.append(line)
                    doc.append((i, k))
                    offset.append(s)
                    size += len(line)
                    if size > BLOCK:
                        yield from _packed(lines, doc, offset, width, gram, buckets, common)
                        lines, doc, offset, size = [], [], [], 0
        if lines:
            yield from _packed(lines, doc, offset, width, gram, buckets, common)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, "bucket"):
            found = _equal_windows(group.column("data").to_pylist(), width)
            if found is not None:
                yield found

    return docs.mapInArrow(cut, "bucket long, data binary").repartition(partitions(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, SPAN_SQL)


def _rest(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    words, kept, at = raw.split(), [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    Words covered by a window that also starts in a document of smaller id go; windows are judged on the input. Null and
    empty texts have no words; texts shorter than a window lose none. A null doc_id counts as larger than every other.
    Rows of one id never remove each other's words, so repeated rows lose the same. An empty table gives an empty result.
    """
    rows = keyed(docs)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return apply_spans(rows, repeated_spans(rows, width, gram), _rest, out, "doc_id long, n_words long, n_removed long, kept_sha256 string")
