"""Fill-in-the-middle: texts cut into prefix, middle and suffix at places that a parallel automaton scan finds (operator 11)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import chunks, save, starts

#: What stands before the prefix, suffix and middle of an output.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk, whose transitions one task finds; a text of more is shared out among tasks.
CHUNK = 1 << 16
#: Bytes whose transitions are composed before those of a text's chunks are.
LEAF = 64
#: A byte that no text in UTF-8 holds: it changes nothing, and fills leaves up.
FILL = 0xFF
_STATE, _UNIT, _HIT = (1 << 8) - 1, 1 << 8, 1 << 36
_UNITS = (1 << 28) - 1


class Automaton:
    """A finite automaton over bytes that counts the units of a text, here code points or words, and the markers in it.

    A function of a stretch of text is an array with one number per entry state: the state after the stretch in the low 8
    bits, then 28 bits of units that begin in it and 28 bits of markers that end in it. Functions compose
    associatively, so stretches can be read in any order and by anybody.
    """

    def __init__(self, units: str = "chars", markers: Iterable[str] = MARKERS):
        step, hits = _matcher([m.encode() for m in markers])
        if len(step) > _STATE // 2:
            raise ValueError("the markers are too long")
        word = np.zeros(256, dtype=bool)
        word[[b for b in range(256) if not (b == 32 or 9 <= b <= 13)]] = True
        if units == "words":  # twice the states: behind white space, and within a word
            n = len(step)
            begins = np.concatenate([np.broadcast_to(word, (n, 256)), np.zeros((n, 256), dtype=bool)])
            step, hits = np.concatenate([step, step]) + n * word, np.concatenate([hits, hits])
        elif units == "chars":
            begins = np.broadcast_to((np.arange(256) & 0xC0) != 0x80, step.shape)
        else:
            raise ValueError("units are chars or words")
        each = (step + _UNIT * begins + _HIT * hits).T.copy()
        each[FILL] = np.arange(len(step))
        self.states, self.byte = len(step), each
        self.pair = compose(np.tile(each, (256, 1)), np.repeat(each, 256, axis=0))  # by the first byte, then 256 times the second

    def leaves(self, data: np.ndarray) -> np.ndarray:
        """The functions of each LEAF bytes: pairs by a table, then neighbours among each other."""
        out = self.pair[data.view("<u2")]
        while len(out) * LEAF > len(data):
            out = compose(out[::2], out[1::2])
        return out


def _matcher(markers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(next state, markers that end) by state and byte: a state is the longest suffix of what was read that begins a marker and isn't one whole."""
    names = [b"", *dict.fromkeys(m[:k] for m in markers for k in range(1, len(m)))]
    number = {s: i for i, s in enumerate(names)}
    step, hits = np.zeros((len(names), 256), dtype=np.int64), np.zeros((len(names), 256), dtype=np.int64)
    for s, i in number.items():
        for b in range(256):
            read = s + bytes([b])
            hits[i, b] = sum(read.endswith(m) for m in markers)
            step[i, b] = next(number[read[k:]] for k in range(len(read) + 1) if read[k:] in number)
    return step, hits


@lru_cache(maxsize=4)
def automaton(units: str, markers: tuple[str, ...]) -> Automaton:
    return Automaton(units, markers)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The functions of stretches made of two: what `first` ends in is what `then` begins with."""
    return (first & ~_STATE) + np.take_along_axis(then, first & _STATE, axis=1)


def prefixes(functions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The function of everything up to and with each stretch, within runs of `counts` stretches, by doubling."""
    out, place, step = functions.copy(), np.arange(len(functions)) - np.repeat(starts(counts)[:-1], counts), 1
    while (at := np.flatnonzero(place >= step)).size:
        out[at] = compose(out[at - step], out[at])
        step *= 2
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each filled up to whole leaves, and the leaves of each."""
    n = np.fromiter((-(-len(t) // LEAF) for t in texts), dtype=np.int64, count=len(texts))
    fill = bytes([FILL]) * LEAF
    return np.frombuffer(b"".join(t + fill[: -len(t) % LEAF] for t in texts), dtype=np.uint8), n


def select(machine: Automaton, data: np.ndarray, before: np.ndarray, leaf: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place in `data` of each unit that is the nth, from 0, to begin in its leaf, read from the state `before` on."""
    state, left, out = before.copy(), nth.copy(), np.full(len(leaf), -1)
    for k in range(LEAF):
        at = leaf * LEAF + k
        f = machine.byte[data[at], state] if len(leaf) else state
        begins = (f // _UNIT & _UNITS) > 0
        out[begins & (left == 0) & (out < 0)] = at[begins & (left == 0) & (out < 0)]
        left = left - begins
        state = f & _STATE
    return out


def cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Two columns: the units before the middle and before the suffix."""
    return np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1)


def scan(machine: Automaton, texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, markers, cuts in units, cuts in bytes) of whole texts."""
    data, counts = padded(texts)
    upto = prefixes(machine.leaves(data), counts)[:, 0]  # every text begins in state 0
    base = starts(counts)
    whole = np.where(counts > 0, upto[base[1:] - 1] if len(upto) else 0, 0)
    n, hits = whole // _UNIT & _UNITS, whole // _HIT
    cut = cuts(n, h1, h2)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    place = np.where(cut == 0, 0, size[:, None])
    text, side = np.nonzero((cut > 0) & (cut < n[:, None]))
    # units up to each leaf, made increasing over all texts, so that one binary search finds all leaves
    over = np.repeat(starts(n)[:-1], counts) + (upto // _UNIT & _UNITS)
    leaf = np.searchsorted(over, starts(n)[text] + cut[text, side], side="right")
    first = leaf == base[text]
    entry = np.where(first, 0, upto[leaf - 1]) if len(leaf) else leaf
    place[text, side] = select(machine, data, entry & _STATE, leaf, cut[text, side] - (entry // _UNIT & _UNITS)) - base[text] * LEAF
    return n, hits, cut, place


_FOUND = "n long, markers long, cut1 long, cut2 long, byte1 long, byte2 long"
_NAMES = ("n", "markers", "cut1", "cut2", "byte1", "byte2")


def _scanned(rows: DataFrame, units: str, markers: tuple[str, ...]) -> DataFrame:
    """Adds _FOUND to rows whose texts are one chunk each."""

    def run(batches):
        machine = automaton(units, markers)
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                n, hits, cut, place = scan(machine, [t.encode() for t in texts], part.column("_h1").to_numpy(), part.column("_h2").to_numpy())
                found = (n, hits, cut[:, 0], cut[:, 1], place[:, 0], place[:, 1])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in found)], [*part.schema.names, *_NAMES])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in _NAMES)]))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """(_key, chunk, bytes) of each text; chunks are dealt to all tasks."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text").cast(pa.binary()), strict=True):
                raw = memoryview(text.as_buffer())
                for begin in range(0, len(raw), 64 * size):
                    some = [bytes(raw[k : k + size]) for k in range(begin, min(begin + 64 * size, len(raw)), size)]
                    numbers = pa.array(np.arange(begin // size, begin // size + len(some)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.binary()), numbers, pa.array(some, pa.binary())], ["_key", "chunk", "bytes"])

    return rows.select("_key", "_text").mapInArrow(run, "_key binary, chunk int, bytes binary").repartition("_key", "chunk")


def _giant(rows: DataFrame, units: str, markers: tuple[str, ...], chunk: int) -> DataFrame:
    """Adds _FOUND to rows with texts of many chunks.

    Tasks give each chunk's function, one number per entry state. Those of a text, a few bytes per chunk, are composed in one
    place, which tells what state each chunk begins in and which chunk holds a cut; the tasks with these chunks find its place.
    """
    distinct = rows.groupBy("_key").agg(F.any_value("_text").alias("_text"), F.any_value("_h1").alias("_h1"), F.any_value("_h2").alias("_h2"))
    distinct = save(distinct.select("*", F.octet_length("_text").alias("_size")), "fim-giant")
    parts = _chunks(distinct, chunk)

    def functions(batches):
        m = automaton(units, markers)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                data, counts = padded(part.column("bytes").to_pylist())
                whole = prefixes(m.leaves(data), counts)[starts(counts)[1:] - 1]
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * m.states, pa.int32()), pa.array(whole.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("chunk"), each], ["_key", "chunk", "f"])

    found = parts.mapInArrow(functions, "_key binary, chunk int, f array<long>").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("chunk", "f"))).alias("c"))
    found = found.join(distinct.select("_key", "_h1", "_h2", "_size"), "_key")

    def resolved(h1: pd.Series, h2: pd.Series, size: pd.Series, functions: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, bytes_, f in zip(h1, h2, size, functions, strict=True):
            f = np.stack(list(f))
            state, units_, hits = np.zeros(len(f) + 1, dtype=np.int64), np.zeros(len(f) + 1, dtype=np.int64), 0
            ends = prefixes(f & _STATE, np.array([len(f)]))[:, 0]
            state[1:] = ends & _STATE
            own = np.take_along_axis(f, state[:-1, None], axis=1)[:, 0]
            units_[1:], hits = np.cumsum(own // _UNIT & _UNITS), int((own // _HIT).sum())
            cut = cuts(units_[-1:], np.array([a]), np.array([b]))[0]
            at = np.searchsorted(units_[1:], cut, side="right")
            row = [int(units_[-1]), hits, *map(int, cut)]
            for c, k in zip(cut, at, strict=True):  # the chunk, its entry state and the units of it before the cut; no chunk at an end
                row += [None if c == 0 or c == units_[-1] else int(k), int(state[min(k, len(f) - 1)]), int(c - units_[min(k, len(f) - 1)]), 0 if c == 0 else int(bytes_)]
            out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in _RESOLVED])

    resolve = F.pandas_udf(resolved, _RESOLVED)
    found = save(found.select("_key", resolve("_h1", "_h2", "_size", F.transform("c", lambda x: x["f"])).alias("r")).select("_key", "r.*"), "fim-cuts", batch_rows=64)
    wanted = found.select("_key", F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"chunk{i}").alias("chunk"), F.col(f"state{i}").alias("state"), F.col(f"nth{i}").alias("nth")) for i in (1, 2)))).alias("w"))
    wanted = wanted.select("_key", "w.*").where("chunk is not null")

    def places(batches):
        m = automaton(units, markers)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                data, counts = padded(part.column("bytes").to_pylist())
                entry, nth = part.column("state").to_numpy().astype(np.int64), part.column("nth").to_numpy()
                upto = prefixes(m.leaves(data), counts)[np.arange(int(counts.sum())), np.repeat(entry, counts)]
                units_ = upto // _UNIT & _UNITS
                base = starts(counts)
                leaf = np.array([a + np.searchsorted(units_[a:b], x, side="right") for a, b, x in zip(base[:-1], base[1:], nth, strict=True)], dtype=np.int64)
                first = leaf == base[:-1]
                state, done = np.where(first, entry, upto[leaf - 1] & _STATE), np.where(first, 0, units_[leaf - 1])
                place = select(m, data, state, leaf, nth - done) - base[:-1] * LEAF + part.column("chunk").to_numpy().astype(np.int64) * chunk
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("side"), pa.array(place, pa.int64())], ["_key", "side", "place"])

    placed = parts.join(wanted, ["_key", "chunk"]).select("_key", "chunk", "bytes", "side", "state", "nth").mapInArrow(places, "_key binary, side int, place long")
    placed = placed.groupBy("_key").agg(*(F.max(F.when(F.col("side") == i, F.col("place"))).alias(f"p{i}") for i in (1, 2)))
    found = found.join(placed, "_key", "left").select("_key", "n", "markers", "cut1", "cut2", *(F.coalesce(f"p{i}", f"end{i}").alias(f"byte{i}") for i in (1, 2)))
    return rows.join(found, "_key").select(*rows.columns, *_NAMES)


_RESOLVED = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "markers", "cut1", "cut2")] + [T.StructField(f"{c}{i}", T.IntegerType() if c in ("chunk", "state") else T.LongType()) for i in (1, 2) for c in ("chunk", "state", "nth", "end")])


def _apart(markers: tuple[str, ...]) -> None:
    """Raises unless no marker can overlap another one or the text beside it: none begins another, and first characters occur nowhere else in them."""
    firsts = {m[:1] for m in markers}
    if "" in firsts or any(c in firsts for m in markers for c in m[1:]) or any(a != b and b.startswith(a) for a in markers for b in markers) or len(set(markers)) < len(markers):
        raise ValueError(f"markers could overlap: {markers}")


def draws(seed: Column) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1: the first 8-digit groups of the hexadecimal sha256 of a text."""
    digest = F.sha2(seed, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: Column | None = None, rate: int = 90, spm: int = 20, units: str = "chars", markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """(id, `keep`, n, form, prefix_chars, middle_chars, output) of every whole text.

    A text of n units is cut after the smaller and the larger of two drawn numbers of units into prefix, middle and suffix. form is `psm`
    (marker, prefix, marker, suffix, marker, middle), in `spm` of 100 cases `spm` (suffix first, then prefix), and `plain`
    (the text itself) in all but `rate` of 100 cases, and if the text is empty (or null) or holds a marker; the
    sizes, in units, are null then. Draws depend on the seed alone, by default `1:` and the id (null: empty). With words as units
    a cut lies before a word's first byte, and what stands before the first word belongs to it.

    Texts of one chunk are scanned where they are, without a shuffle; longer ones are shared out by chunks. Repeated
    rows give repeated rows, an empty table none.
    """
    _apart(markers)
    seed = F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))) if seed is None else seed
    h1, h2, h3, h4 = draws(seed)
    rows = docs.select(F.struct(id_col, *keep).alias("_row"), F.coalesce(text_col, F.lit("")).alias("_text"), h1.alias("_h1"), h2.alias("_h2"), (h3 % 100).alias("_h3"), (h4 % 100).alias("_h4"))
    size = F.octet_length("_text")
    short = _scanned(rows.where(size <= chunk), units, tuple(markers))
    long = rows.where(size > chunk).withColumn("_key", F.unhex(F.sha2(F.concat_ws(":", "_h1", "_h2", "_text"), 256)))
    found = short.unionByName(_giant(long, units, tuple(markers), chunk).drop("_key"))
    form = F.when((size == 0) | (F.col("markers") > 0) | (F.col("_h3") >= rate), "plain").when(F.col("_h4") < spm, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    raw = F.col("_text").cast("binary")
    part = lambda a, b: F.substring(raw, a.cast("int") + 1, (b - a).cast("int"))
    p, s, m = part(F.lit(0), F.col("byte1")), part(F.col("byte2"), size), part(F.col("byte1"), F.col("byte2"))
    mark = [F.lit(x).cast("binary") for x in markers]
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(mark[0], p, mark[1], s, mark[2], m).cast("string")).otherwise(F.concat(mark[1], s, mark[0], p, mark[2], m).cast("string"))
    cut = F.col("form") != "plain"
    return found.select("_row.*", "n", "form", F.when(cut, F.col("cut1")).alias("prefix_chars"), F.when(cut, F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. Only the markers that were put there are in it; see _apart()."""
    _apart(markers)
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers))
    joined = F.transform(F.array(parts), lambda x: F.when(form == "psm", F.concat(F.get(x, 1), F.get(x, 3), F.get(x, 2))).otherwise(F.concat(F.get(x, 2), F.get(x, 3), F.get(x, 1))))[0]
    return F.when(form == "plain", output).otherwise(joined)
