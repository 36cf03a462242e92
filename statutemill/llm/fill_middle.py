"""Fill-in-middle transformation: a finite automaton scanned in parallel finds where whole texts are cut.

The automaton reads UTF-8 bytes. Its states say what stands before: nothing, white space, a word, a word that ends in `<`,
or one that ends in `<P`, `<S` or `<M`. A step may begin a token or end a marker. A stretch of bytes (a lane) emits, for
each state it may be entered in, the state it is left in and how many tokens and markers it holds; such functions compose
associatively, so lanes and pieces are scanned side by side and a prefix composition gives each one's true entry state.

Ordinary texts lie one after another in a block, where the first byte of each text acts as from the start. Texts of over
PIECE_BYTES are cut into pieces that go to all tasks; the functions of a text's pieces are composed, the piece and then
the lane that hold a cut are selected by their counts, and only that lane of the text is read again. Both ways give the
same cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, partitions, stored, unpack

#: Bytes of a piece; a longer text is scanned piece by piece, wherever there is room.
PIECE_BYTES = 1 << 16
#: Bytes of a lane within a piece, of which selection reads one again for each cut.
LANE_BYTES = 1 << 10
#: Bytes of ordinary texts that are scanned side by side, in LANES lanes.
BLOCK_BYTES, LANES = 4 << 20, 1 << 14
#: Share of texts, in percent, that are transformed, and of those with the suffix first.
RATE, SPM_RATE, SEED = 50, 80, "42"

#: Fixed: the marks before the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_START, _SPACE, _WORD, _LESS, _NAMED = range(5)
_STATES = 5
_OTHER, _WHITE, _OPEN, _NAME, _CLOSE, _IDLE = range(6)
_FIRST = 8  # added to the class of a text's first byte
_TOKEN, _MARK = 8, 16  # bits beside the next state


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte; and, for class * 8 + state, the next state with the bits of what the step emits."""
    of = np.full(256, _OTHER, np.uint8)
    of[[32, *range(9, 14)]] = _WHITE
    of[ord("<")], of[ord(">")] = _OPEN, _CLOSE
    of[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _NAME
    table = np.zeros((16, 8), np.uint8)
    for state in range(_STATES):
        table[_IDLE, state] = state
        for kind in (_OTHER, _WHITE, _OPEN, _NAME, _CLOSE):
            to = {_WHITE: _SPACE, _OPEN: _LESS}.get(kind, _WORD)
            if kind == _NAME and state == _LESS:
                to = _NAMED
            begins = state == _START or kind == _WHITE and state != _SPACE
            table[kind, state] = to | _TOKEN * begins | _MARK * (kind == _CLOSE and state == _NAMED)
    table[_FIRST : _FIRST + 6] = table[:6, [_START]]  # whatever came before
    return of, table.reshape(-1)


_CLASS, _TABLE = _automaton()


def _grid(classes: np.ndarray, width: int) -> np.ndarray:
    """Lanes of equal width as columns, so that a step of all lanes is one row; steps after the end do nothing."""
    lanes = max(1, -(-len(classes) // width))
    whole = np.full(lanes * width, _IDLE, np.uint8)
    whole[: len(classes)] = classes
    return np.ascontiguousarray(whole.reshape(lanes, width).T) * np.uint8(8)


def functions(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, tokens, marks), each states x lanes: what a lane does when it is entered in each state."""
    state = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], grid.shape[1], 1)
    tokens, marks = np.zeros(state.shape, np.int32), np.zeros(state.shape, np.int32)
    for row in grid:
        code = _TABLE[row + state]
        state = code & np.uint8(7)
        tokens += (code & _TOKEN) != 0
        marks += (code & _MARK) != 0
    return state, tokens, marks


def compose(first: tuple, then: tuple) -> tuple:
    """The function of two neighbours: counts add along the states that the first one leads to. Associative."""
    ends = first[0].astype(np.intp)
    return (np.take_along_axis(then[0], ends, 0), *(a + np.take_along_axis(b, ends, 0) for a, b in zip(first[1:], then[1:])))


def prefixes(each: tuple) -> tuple:
    """For each lane the composition of all up to it, in as many rounds as the number of lanes has binary digits."""
    done, n, reach = each, each[0].shape[1], 1
    while reach < n:
        joined = compose(tuple(a[:, :-reach] for a in done), tuple(a[:, reach:] for a in done))
        done = tuple(np.concatenate([a[:, :reach], b], 1) for a, b in zip(done, joined))
        reach *= 2
    return done


def entered(each: tuple, start: int) -> tuple[np.ndarray, ...]:
    """(entry state, and each count before it) of every lane, when the first is entered in start."""
    upto = [a[start] for a in prefixes(each)]
    return tuple(np.concatenate([[s], a[:-1]]) for s, a in zip((start, 0, 0), upto))


def emitted(grid: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """What each byte emits, in order, once the lanes' entry states are known."""
    out, state = np.empty(grid.shape, np.uint8), entry.astype(np.uint8)
    for i, row in enumerate(grid):
        code = _TABLE[row + state]
        state = code & np.uint8(7)
        out[i] = code
    return out.T.reshape(-1)


def _points(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80


def block_cuts(data: np.ndarray, ends: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, code points before the two cuts, has a marker) of texts that lie one after another and end at ends."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    classes = _CLASS[data]
    classes[starts[starts < ends]] += _FIRST
    grid = _grid(classes, max(64, -(-len(data) // LANES)))
    out = emitted(grid, entered(functions(grid), _START)[0])
    begins = np.flatnonzero(out[: len(data)] & _TOKEN)
    marks = np.flatnonzero(out[: len(data)] & _MARK)
    first, last = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    n = last - first
    units = np.sort(draws % (n + 1)[:, None], 1)
    at = np.append(begins, 0)[np.minimum(first[:, None] + units, len(begins))]
    at = np.where(units == n[:, None], ends[:, None], at)
    upto = np.concatenate([[0], np.cumsum(_points(data), dtype=np.int32)])
    return n, upto[at] - upto[starts][:, None], np.searchsorted(marks, ends) > np.searchsorted(marks, starts)


_CUTS = T.StructType().add("n", "long").add("cut1", "long").add("cut2", "long").add("marked", "boolean")
_CUT_TYPE = pa.struct([("n", pa.int64()), ("cut1", pa.int64()), ("cut2", pa.int64()), ("marked", pa.bool_())])


@F.arrow_udf(_CUTS)
def _ordinary(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    draws = np.stack([h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)], 1)
    found, at = [], 0
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        found.append(block_cuts(data[offsets[at] : offsets[upto]], offsets[at + 1 : upto + 1] - offsets[at], draws[at:upto]))
        at = upto
    if not found:
        return pa.array([], _CUT_TYPE)
    n, cuts, marked = (np.concatenate(x) for x in zip(*found))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cuts[:, 0], pa.int64()), pa.array(cuts[:, 1], pa.int64()), pa.array(marked)], fields=list(_CUT_TYPE))


_PIECE_SQL = "key string, piece int, h1 long, h2 long, ends binary, tokens array<long>, marks array<long>, points long, lanes binary"
_PIECE = pa.schema([("key", pa.string()), ("piece", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("ends", pa.binary()), ("tokens", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("points", pa.int64()), ("lanes", pa.binary())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's function, and those of its lanes packed."""
    for b in batches:
        for i in range(len(b)):
            data = np.frombuffer(b.column("data")[i].as_buffer(), np.uint8)
            each = functions(_grid(_CLASS[data], LANE_BYTES))
            ends, tokens, marks = (a[:, -1] for a in prefixes(each))
            points = np.add.reduceat(_points(data), np.arange(0, len(data), LANE_BYTES), dtype=np.int64)
            lanes = pack(each[0].reshape(-1), each[1].reshape(-1), points)
            row = [*(b.column(c)[i].as_py() for c in ("key", "piece", "h1", "h2")), ends.tobytes(), tokens.tolist(), marks.tolist(), int(points.sum()), lanes]
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, row))], schema=_PIECE)


_PLACE_SQL = "key string, cut int, n long, marked boolean, piece int, state int, want long, points long"


def _compose_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
    """One text's cuts: the piece that holds each, its entry state, which of its tokens begins there, code points before it.

    A row holds at most 2 GB, so a text has 32,768 pieces at most, of which only the functions come here.
    """
    p = pieces.sort_values("piece")
    each = (np.stack([np.frombuffer(x, np.uint8) for x in p["ends"]], 1), np.stack(p["tokens"].to_list(), 1).astype(np.int64), np.stack(p["marks"].to_list(), 1).astype(np.int64))
    state, before, _ = entered(each, _START)
    total = [a[_START, -1] for a in prefixes(each)]
    n, points = int(total[1]), np.concatenate([[0], np.cumsum(p["points"].to_numpy())])
    rows = []
    for cut, unit in enumerate(sorted((int(p["h1"].iloc[0]) % (n + 1), int(p["h2"].iloc[0]) % (n + 1)))):
        if unit == n:
            rows.append((p["key"].iloc[0], cut, n, bool(total[2]), -1, 0, 0, int(points[-1])))
        else:
            k = int(np.searchsorted(before, unit, "right")) - 1  # the last piece with as few tokens before it
            rows.append((p["key"].iloc[0], cut, n, bool(total[2]), k, int(state[k]), unit - int(before[k]), int(points[k])))
    return pd.DataFrame(rows, columns=["key", "cut", "n", "marked", "piece", "state", "want", "points"])


@F.arrow_udf(T.StructType().add("lane", "integer").add("state", "integer").add("want", "long").add("points", "long"))
def _select_lane(lanes: pa.Array, state: pa.Array, want: pa.Array) -> pa.Array:
    out = []
    for blob, s, w in zip(lanes.to_pylist(), state.to_pylist(), want.to_pylist()):
        ends, tokens, points = unpack(blob)
        each = (ends.reshape(_STATES, -1), tokens.reshape(_STATES, -1))
        entry, before = entered(each, s)
        k = int(np.searchsorted(before, w, "right")) - 1
        out.append({"lane": k, "state": int(entry[k]), "want": w - int(before[k]), "points": int(points[:k].sum())})
    return pa.array(out, pa.struct([("lane", pa.int32()), ("state", pa.int32()), ("want", pa.int64()), ("points", pa.int64())]))


@F.arrow_udf(T.LongType())
def _in_lane(lane: pa.Array, state: pa.Array, want: pa.Array) -> pa.Array:
    """Code points of a lane before the token it begins as number want, counted from 0."""
    out = []
    for raw, s, w in zip(lane.to_pylist(), state.to_pylist(), want.to_pylist()):
        data = np.frombuffer(raw, np.uint8)
        begins = np.flatnonzero(emitted(_grid(_CLASS[data], max(1, len(data))), np.array([s])) & _TOKEN)
        out.append(int(_points(data[: begins[w]]).sum()))
    return pa.array(out, pa.int64())


def _giant_cuts(giants: DataFrame, piece_bytes: int) -> DataFrame:
    """giants with cuts: pieces are dealt to all tasks, scanned, composed, and the lanes of the cuts are read again."""
    data = F.col("text").cast("binary")
    slices = F.transform(F.sequence(F.lit(0), ((F.octet_length("text") - 1) / piece_bytes).cast("int")), lambda i: F.substring(data, i * piece_bytes + 1, F.lit(piece_bytes)))
    pieces = giants.select("key", "h1", "h2", F.posexplode(slices).alias("piece", "data")).repartition(4 * partitions(giants))
    scanned = stored(pieces.select("key", "piece", "h1", "h2", "data").mapInArrow(_scan, _PIECE_SQL), "fim-pieces").dropDuplicates(["key", "piece"])
    places = scanned.drop("lanes").groupBy("key").applyInPandas(_compose_pieces, _PLACE_SQL)
    lanes = scanned.select("key", "piece", "lanes")
    inside = places.where("piece >= 0").join(lanes, ["key", "piece"]).withColumn("at", _select_lane("lanes", "state", "want"))
    inside = inside.select("key", "cut", "n", "marked", (F.col("piece").cast("long") * piece_bytes + F.col("at.lane") * LANE_BYTES).alias("byte"), F.col("at.state").alias("state"), F.col("at.want").alias("want"), (F.col("points") + F.col("at.points")).alias("points"))
    at_end = places.where("piece < 0").select("key", "cut", "n", "marked", F.lit(None).cast("long").alias("byte"), "state", "want", "points")
    place = lambda c: F.max(F.when(F.col("cut") == c, F.struct("byte", "state", "want", "points"))).alias(f"p{c}")
    cuts = inside.unionByName(at_end).groupBy("key").agg(F.first("n").alias("n"), F.first("marked").alias("marked"), place(0), place(1))
    found = giants.join(cuts, "key")

    def position(p: str) -> Column:
        piece_end = (F.floor(F.col(f"{p}.byte") / piece_bytes) + 1) * piece_bytes
        lane = F.substring(data, (F.col(f"{p}.byte") + 1).cast("int"), F.least(F.lit(LANE_BYTES), piece_end - F.col(f"{p}.byte")).cast("int"))
        return F.col(f"{p}.points") + F.when(F.col(f"{p}.byte").isNull(), 0).otherwise(_in_lane(F.coalesce(lane, F.lit(b" ")), F.when(F.col(f"{p}.byte").isNull(), _START).otherwise(F.col(f"{p}.state")), F.coalesce(f"{p}.want", F.lit(0))))

    return found.select("doc_id", "text", "h3", "h4", F.struct("n", position("p0").alias("cut1"), position("p1").alias("cut2"), "marked").alias("at"))


def transform(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs.

    Null texts are empty; empty texts and those that hold a marker stay plain. A null doc_id draws as an empty one. Equal
    rows each get a row, with equal results, and so do other texts under the same id. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(draw(i) for i in range(4)))
    small = rows.where(F.octet_length("text") <= piece_bytes).select("doc_id", "text", "h3", "h4", _ordinary("text", "h1", "h2").alias("at"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256))
    found = small.unionByName(_giant_cuts(rows.where(F.octet_length("text") > piece_bytes).withColumn("key", key), piece_bytes))
    a, b = F.col("at.cut1").cast("int"), F.col("at.cut2").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    plain = (F.col("text") == "") | F.col("at.marked") | (F.col("h3") % 100 >= RATE)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_RATE, "spm").otherwise("psm")
    output = F.when(form == "plain", F.col("text")).when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return found.select("doc_id", F.col("at.n").alias("n"), form.alias("form"), F.when(~plain, a.cast("long")).alias("prefix_chars"), F.when(~plain, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restore(output: str, form: str) -> str:
    """The text before transform(), from its output and form alone; the first place of each marker is its own."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    part, rest = {}, output[len(marks[0]) :]
    for mark, following in zip(marks, marks[1:]):
        part[mark], _, rest = rest.partition(following)
    return part[PREFIX] + rest + part[SUFFIX]


@F.arrow_udf(T.StringType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """restore() as a column."""
    return pa.array([restore(o.as_py(), f.as_py()) for o, f in zip(output, form)], pa.string())


@F.arrow_udf(T.StructType().add("output", "string").add("restored", "string"))
def _digests(output: pa.Array, form: pa.Array) -> pa.Array:
    hexed = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    found = [(hexed(o := x.as_py()), hexed(restore(o, f.as_py()))) for x, f in zip(output, form)]
    return pa.array([{"output": a, "restored": b} for a, b in found], pa.struct([("output", pa.string()), ("restored", pa.string())]))


def digests(docs: DataFrame) -> DataFrame:
    """transform() with its outputs, and the texts rebuilt from them, as sha256."""
    found = transform(docs).withColumn("sha256", _digests("output", "form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("sha256.output").alias("output_sha256"), F.col("sha256.restored").alias("restored_sha256"))
