"""Repeated byte strings by suffix order and longest-previous-factor arrays.

Windows of `length` bytes are dealt to buckets by their minimiser (see spans), so all places where a string of that
length starts meet in one bucket. There the suffixes that start windows are put in order, with the common prefix of each
two neighbours; windows with a hash that no other has are left out before, since they equal none. The previous and next
smaller position in suffix order are the earlier places that share most with a suffix; the longer of the two common
prefixes is its longest previous factor. Where that reaches `length`, the string starts earlier; by the same array over
positions counted backwards, it starts later.

Shorter strings (`passage`) can be looked for in the same pass: windows are then dealt by the minimiser of their first
`passage` bytes, so that equal strings of either length meet, and the factors are held against both lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_group, pack, partitions, unpack
from .spans import KIND_BITS, SPAN, SPAN_SQL, apply_spans, common_grams, demoted, flagged_spans, keyed, measured, mix, runs, sliding_min

LENGTH, GRAM = 400, 32
#: A passage of over 50 words, at five bytes a word.
PASSAGE, PASSAGE_GRAM = 250, 16
BLOCK = 3 << 20
#: Of zstandard, for the strings that travel, which are most of what is shuffled.
TEXT_LEVEL = 5
#: Follows texts whose last windows are cut short; no byte of UTF-8 equals it.
_PAD = b"\xff"

#: Places within a block of texts fit in so many bits.
_PLACE_BITS = 24
_RUNS = pa.schema([("bucket", pa.int64()), ("data", pa.binary()), ("text", pa.binary())])
#: A fixed random number for each byte value.
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of width bytes, by doubling."""
    out, done = _BYTE[buf], 1
    while done < width:
        step = min(done, width - done)
        out = out[: len(out) - step] * np.uint64(0xD6E8FEB86659FD93 + 2 * done) + out[step:]
        done += step
    return mix(out)


def _low_grams(texts: list[bytes], gram: int) -> np.ndarray:
    """Hashes of grams of texts that are low enough to be the least of a window; a few cross from one text to the next."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(buf, gram) if len(buf) >= gram else np.empty(0, np.uint64)
    return h[h < np.uint64(1 << 59)]


def _packed(texts: list[bytes], doc: list[tuple[int, int]], offset: list[int], length: int, least_length: int, gram: int, buckets: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    text = b"".join(texts)
    if len(text) < length:
        return
    buf = np.frombuffer(text, np.uint8)
    # a hash and, below it, the gram's place: of equal grams the first counts
    hashes = demoted(gram_hashes(buf, gram), common)
    placed = sliding_min((hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64), least_length - gram + 1)
    placed = placed[: len(buf) - length + 1]
    least = placed >> np.uint64(_PLACE_BITS)
    del hashes
    ends = np.cumsum([len(t) for t in texts])
    valid = np.zeros(len(least), bool)
    begins = ends - [len(t) for t in texts]
    for s, e in zip(begins.tolist(), ends.tolist()):
        valid[s : max(s, e - length + 1)] = True
    first, last = runs(least, valid)
    if not len(first):
        return
    # a valid window never lies next to one of another text, unless windows are single bytes
    of = np.searchsorted(ends, first, "right")
    # a run whose minimiser moves holds it more than once, and so may hold equal windows itself
    moves = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
    inner = (moves[last] > moves[first]).astype(np.uint8)
    value = least[first]
    del least, placed, moves, valid
    bucket = (mix(value) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, last, of, value, bucket, inner = first[order], last[order], of[order], value[order], bucket[order], inner[order]
    place = first - begins[of] + np.array(offset, np.int64)[of]
    ids, keys = np.array([d[0] for d in doc], np.int64)[of], np.array([d[1] for d in doc], np.uint32)[of]
    begin, stop = first.tolist(), (last + length).tolist()
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    rows, data, strings = [], [], []
    for s, e in zip(cuts, cuts[1:]):
        data.append(pack(value[s:e], ids[s:e], keys[s:e], place[s:e], (last[s:e] + length - first[s:e]).astype(np.uint32), inner[s:e]))
        strings.append(pack(np.frombuffer(b"".join([text[a:z] for a, z in zip(begin[s:e], stop[s:e])]), np.uint8), level=TEXT_LEVEL))
        rows.append(int(bucket[s]))
    yield batch(_RUNS, bucket=rows, data=data, text=strings)


def suffix_order(text: bytes, at: np.ndarray, length: int, hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at the places `at` by their first length bytes, and each one's common prefix with the one before, length at most.

    Splits groups of suffixes by eight bytes at a time, where their members differ. With hashed, stretches that all
    members share are passed over by a hash of any substring (differences of running sums mod 2^64); equal strings are
    compared byte by byte afterwards, and should a hash have lied, all is done again without it.
    """
    whole = np.frombuffer(text + bytes(8), np.uint8)
    view = np.lib.stride_tricks.as_strided(whole, (len(text) + 1, 8), (1, 1))
    order = np.arange(len(at))
    common = np.zeros(len(at), np.int64)
    if hashed:
        step = np.full(len(text), 0xD6E8FEB86659FD93, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[whole[: len(text)]] * np.cumprod(step))])
        back = np.cumprod(np.full(len(text) + 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))

        def same(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
            return (sums[a + n] - sums[a]) * back[a] == (sums[b + n] - sums[b]) * back[b]

    live, start, depth = np.arange(len(at)), np.zeros(len(at), bool), np.zeros(1, np.int64)
    start[:1] = True
    early = False
    while len(live):
        head = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        if hashed and len(head) < len(live) and depth[0]:
            place = at[order[live]]
            first, done = place[head][group], depth[group]
            whole_rest = np.logical_and.reduceat(same(place + done, first + done, length - done), head)
            if whole_rest.any():  # these are equal to the end
                early = True
                common[live[~start & whole_rest[group]]] = length
                stay = ~whole_rest[group]
                live, start, depth = live[stay], start[stay], depth[~whole_rest]
                if not len(live):
                    break
                place, first = place[stay], first[stay]
                head, group = np.flatnonzero(start), np.cumsum(start) - 1
            stride = 1 << max(3, (length - 1).bit_length() - 1)
            while stride >= 8:
                done = depth[group]
                fits = depth + stride < length
                n = np.where(fits, stride, 0)[group]
                depth = depth + stride * (fits & np.logical_and.reduceat(same(place + done, first + done, n), head))
                stride //= 2
        place, done = at[order[live]], depth[group]
        spare = np.maximum(done + 8 - length, 0)
        key = view[place + done].reshape(-1, 8).view(">u8").reshape(-1).astype(np.uint64) >> (8 * spare).astype(np.uint64)
        inner = np.lexsort((key, group)) if len(head) > 1 else np.argsort(key)
        order[live] = order[live][inner]
        key = key[inner]
        differ = np.concatenate([[False], key[1:] != key[:-1]]) & ~start
        where = np.flatnonzero(differ)
        bits = (key[where] ^ key[where - 1]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        common[live[where]] = done[where] + bits.argmax(1) - spare[where]
        # groups of equal keys go on from there; those at the full length are done
        split = start | differ
        after = np.minimum(done + 8, length)
        full = after == length
        common[live[full & ~split]] = length
        stay = ~(split & np.append(split[1:], True)) & ~full
        live, start = live[stay], split[stay]
        depth = after[stay][start]
    if early and not _blocks_hold(text, whole, at[order], common < length, length):
        return suffix_order(text, at, length, False)
    return order, common


def _blocks_hold(text: bytes, whole: np.ndarray, places: np.ndarray, new: np.ndarray, length: int) -> bool:
    """Whether each place holds the same bytes as the least of its block.

    Where the place before is also in a block, and its least lies just before this one's, only the last byte is new.
    """
    head = np.minimum.reduceat(places, np.flatnonzero(new))[np.cumsum(new) - 1]
    of = np.full(len(text) + 1, -2, np.int64)
    of[places] = head
    after = (places > 0) & (of[places - 1] == head - 1)
    if (whole[places[after] + length - 1] != whole[head[after] + length - 1]).any():
        return False
    rest = ~after & (places != head)
    return all(text.startswith(text[h : h + length], p) for p, h in zip(places[rest].tolist(), head[rest].tolist()))


def _nearest_smaller(position: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, its common prefix with the nearest one before it in suffix order of smaller position.

    Candidates are passed on along the candidates' own, all suffixes at once. Common prefixes below least end the search as 0.
    """
    nearest, shared = np.arange(-1, len(position) - 1), common.copy()
    shared[:1] = 0
    todo = np.flatnonzero(shared >= max(1, least))
    todo = todo[position[nearest[todo]] > position[todo]]
    while len(todo):
        via = nearest[todo]
        nearest[todo], shared[todo] = nearest[via], np.minimum(shared[todo], shared[via])
        todo = todo[(nearest[todo] >= 0) & (shared[todo] >= max(1, least))]
        todo = todo[position[nearest[todo]] > position[todo]]
    found = (nearest >= 0) & (shared >= least)
    found[found] = position[nearest[found]] < position[found]
    return np.where(found, shared, 0)


def previous_factors(position: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """The longest previous factor of each suffix: most bytes shared with one of smaller position; lengths below least count as 0.

    position (all different) and common (with the suffix before) are in suffix order.
    """
    before = _nearest_smaller(position, common, least)
    turned = np.append(common[1:], 0)[::-1]  # from the other end: common prefix with the suffix after
    return np.maximum(before, _nearest_smaller(position[::-1], turned, least)[::-1])


def _met_twice(text: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of length bytes at these places have the hash (running sums mod 2^64) of another; equal ones always have."""
    step = np.full(len(text), 0xD6E8FEB86659FD93, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(text, np.uint8)] * np.cumprod(step))])
    back = np.cumprod(np.full(len(text) + 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))
    hashes = (sums[at + length] - sums[at]) * back[at]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(at), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _repeats(blobs: list[tuple[bytes, bytes]], lengths: list[int], keep_first: bool) -> pa.RecordBatch | None:
    """Spans of a bucket's windows that start elsewhere too, by each of lengths, the greatest first; with keep_first, only of those that start earlier."""
    length, least = lengths[0], lengths[-1]
    meta = [unpack(d) for d, _ in blobs]
    values, counts = np.unique(np.concatenate([m[0] for m in meta]), return_counts=True)
    often = values[counts > 1]  # a minimiser met once has no equal windows, unless inside its run
    pieces: dict[bytes, int] = {}
    piece, ids, keys, places = [], [], [], []
    for (value, i, k, p, size, inner), (_, packed) in zip(meta, blobs):
        hit = np.flatnonzero(np.isin(value, often) | (inner > 0))
        if not len(hit):
            continue
        raw, ends = unpack(packed)[0].tobytes(), np.cumsum(size.astype(np.int64))
        for e, n in zip(ends[hit].tolist(), size[hit].tolist()):
            piece.append(pieces.setdefault(raw[e - n : e], len(pieces)))
        ids.append(i[hit])
        keys.append(k[hit].astype(np.int64))
        places.append(p[hit])
    del meta
    if not piece:
        return None
    piece, ids, keys, places = np.array(piece), np.concatenate(ids), np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((piece, places, keys, ids))
    if keep_first:  # repeated rows are one place
        same = np.concatenate([[False], np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (piece, places, keys, ids)])])
        order = order[~same]
    piece, ids, keys, places = piece[order], ids[order], keys[order], places[order]
    text = b"".join(pieces)
    sizes = np.array([len(x) for x in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    n_windows = sizes - length + 1
    copies = np.bincount(piece, minlength=len(pieces))
    head = np.full(len(pieces), -1, np.int64)
    head[piece[::-1]] = np.arange(len(piece))[::-1]  # each string's first place
    of = np.repeat(np.arange(len(pieces)), n_windows)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    # positions in the order of documents, so that smaller means earlier
    doc_rank = np.cumsum(np.concatenate([[0], (np.diff(ids) != 0) | (np.diff(keys) != 0)]))
    position = (doc_rank[head[of]] << 40) + places[head[of]] + within
    before, after = np.zeros(len(of), np.int32), np.zeros(len(of), np.int32)
    met = np.flatnonzero(_met_twice(text, begins[of] + within, least))  # no other has a factor of least bytes
    if len(met):
        order, common = suffix_order(text, (begins[of] + within)[met], length)
        met = met[order]
        before[met] = previous_factors(position[met], common, least)
        after[met] = previous_factors(-position[met], common, least)
    out: list[tuple[np.ndarray, ...]] = []
    count = of * (1 << 40) + within

    def emit(flags: np.ndarray, chosen: np.ndarray, kind: int, width: int) -> None:
        """Spans of flagged windows at the chosen places of their strings."""
        a, z = flagged_spans(flags, count, width)
        if not len(a) or not len(chosen):
            return
        owner = of[a]
        lo, hi = np.searchsorted(owner, piece[chosen], "left"), np.searchsorted(owner, piece[chosen], "right")
        reps = hi - lo
        at = np.repeat(chosen, reps)
        span = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out.append((ids[at], keys[at] + (kind << KIND_BITS), places[at] + within[a[span]], places[at] + within[z[span]] + width))

    is_head = np.zeros(len(piece), bool)
    is_head[head] = True
    for kind, width in enumerate(lengths):
        earlier, elsewhere = before >= width, (before >= width) | (after >= width) | (copies[of] > 1)
        if width > least:  # some windows hold fewer bytes of their text
            whole = np.frombuffer(text, np.uint8)[begins[of] + within + width - 1] != _PAD[0]
            earlier, elsewhere = earlier & whole, elsewhere & whole
        if keep_first:
            emit(elsewhere, np.flatnonzero(~is_head), kind, width)
            emit(earlier, np.flatnonzero(is_head), kind, width)
        else:
            emit(elsewhere, np.arange(len(piece)), kind, width)
    if not out:
        return None
    cols = [np.concatenate(c) for c in zip(*out)]
    return batch(SPAN, doc_id=cols[0], key=cols[1], start=cols[2], end=cols[3])


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """(doc_id, key, start, end) in bytes, for rows of keyed(): stretches covered by strings of length bytes that repeat.

    With keep_first, the earliest place of each string (by doc_id, then place) stays; else no place does. Rows equal in
    doc_id and text are one place to the former and two to the latter. A passage, at most length, gives the stretches
    covered by strings of so many bytes too, as spans of kind 1 (see apply_spans).
    """
    lengths = [length] if passage is None else [length, passage]
    least = lengths[-1]
    if not 0 < least <= length:
        raise ValueError("a passage has at least one byte and at most length bytes")
    gram, pad = min(gram, least), _PAD * (length - least)
    n, buckets = measured(docs)
    common = common_grams(docs, n, lambda texts: _low_grams(texts, gram))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, doc, offset, size = [], [], [], 0
        for b in batches:
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text")):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass") + pad
                for s in range(0, max(0, len(raw) - length + 1), BLOCK):  # stretches of a very long text share all but a byte of a window
                    texts.append(raw[s : s + BLOCK + length - 1])
                    doc.append((i, k))
                    offset.append(s)
                    size += len(texts[-1])
                    if size > BLOCK:
                        yield from _packed(texts, doc, offset, length, least, gram, buckets, common)
                        texts, doc, offset, size = [], [], [], 0
        if texts:
            yield from _packed(texts, doc, offset, length, least, gram, buckets, common)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, "bucket"):
            found = _repeats(list(zip(group.column("data").to_pylist(), group.column("text").to_pylist())), lengths, keep_first)
            if found is not None:
                yield found

    return docs.mapInArrow(cut, "bucket long, data binary, text binary").repartition(partitions(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, SPAN_SQL)


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, out = 0, []
    for s, e in zip(starts.tolist(), ends.tolist()):
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, *passages: np.ndarray) -> tuple:
    more = [int((passages[1] - passages[0]).sum())] if passages else []
    return len(raw), int((ends - starts).sum()), len(starts), hashlib.sha256(_kept(raw, starts, ends)).hexdigest(), *more


def _whole_characters(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans cut back to whole UTF-8 characters."""
    s, e = starts.copy(), ends.copy()
    follow = lambda x: np.array([p < len(raw) and raw[p] & 0xC0 == 0x80 for p in x.tolist()], bool)
    while (m := follow(s)).any():
        s[m] += 1
    while (m := follow(e)).any():
        e[m] -= 1
    ok = s < e
    return s[ok], e[ok]


def _text(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str]:
    return (_kept(raw, *_whole_characters(raw, starts, ends)).decode("utf-8", "replace"),)


def digests(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs, after repeated strings of length bytes go.

    Null and empty texts have no bytes; texts shorter than length lose none; very long ones are cut into stretches that
    share all but a byte of a window. A null doc_id counts as later than every other. Repeated rows are copies of each
    other. Other columns, whatever their names, are not read. An empty table gives an empty result. With a passage,
    n_passage_bytes follows: bytes covered by repeated strings of that length, which stay, unless longer ones take them.
    """
    rows = keyed(docs)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if passage is None:
        return apply_spans(rows, repeated_spans(rows, length, keep_first), _digest, pa.schema(fields), sql)
    found = repeated_spans(rows, length, keep_first, PASSAGE_GRAM, passage)
    return apply_spans(rows, found, _digest, pa.schema([*fields, ("n_passage_bytes", pa.int64())]), f"{sql}, n_passage_bytes long", 2)


def kept_texts(docs: DataFrame, length: int = PASSAGE, keep_first: bool = True, gram: int = PASSAGE_GRAM) -> DataFrame:
    """Every row of docs with its text less later copies of strings of length bytes; all other columns as they are.

    Spans are cut back to whole characters. A null text becomes ''. Null ids come last; repeated rows keep the same text.
    """
    others = [c for c in docs.columns if c != "text"]
    carry = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))  # numbered, so that no names clash
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    done = apply_spans(keyed(docs, carry), repeated_spans(keyed(docs), length, keep_first, gram), _text, out, "doc_id long, text string")
    return done.select(*(F.col("text") if c == "text" else F.col(f"carry.c{others.index(c)}").alias(c) for c in docs.columns))
