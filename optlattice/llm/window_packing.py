"""Packing into windows by non-negative least squares over shallow combinations of lengths (operator 12)."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import chunks, save, starts
from .packing import load

#: Tokens of a window, and of a class of lengths that the least squares take for alike.
WINDOW, WIDTH = 4096, 16
#: Pieces of which combinations of any lengths consist at most. Beyond it one length is repeated, with one other piece.
DEEPEST = 3
#: Rows whose token ids are cut together.
CUT_ROWS = 500


def combinations(units: int, present: set[int], deepest: int = DEEPEST) -> list[dict[int, int]]:
    """Multisets {class: pieces} that fill a window of so many units from the classes at hand: of up to `deepest` pieces, or of one class repeated with one other piece."""
    found: dict[tuple, dict[int, int]] = {}

    def grow(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            add(chosen)
        elif len(chosen) == deepest - 1:
            if left in present and left >= (chosen[-1] if chosen else 1):
                add((*chosen, left))
        else:
            for c in range(chosen[-1] if chosen else 1, left + 1):
                if c in present and (c == left or 2 * c <= left):
                    grow((*chosen, c), left - c)

    def add(chosen: tuple[int, ...]) -> None:
        made: defaultdict[int, int] = defaultdict(int)
        for c in chosen:
            made[c] += 1
        found[tuple(sorted(made.items()))] = dict(made)

    grow((), units)
    for c in present:
        for k in range(2, units // c + 1):
            rest = units - k * c
            if rest == 0 or rest in present:
                add((c,) * k + ((rest,) if rest else ()))
    return [found[k] for k in sorted(found)]


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|: the active-set method of Lawson and Hanson, on the normal equations of the chosen columns."""
    n = a.shape[1]
    x = np.zeros(n)
    if not n:
        return x
    chosen: list[int] = []
    gram, target = np.zeros((0, 0)), a.T @ b
    small = 1e-10 * max(1e-300, np.abs(target).max())
    for _ in range(most or 3 * a.shape[0]):
        slope = target - a.T @ (a[:, chosen] @ x[chosen])
        slope[chosen] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= small:
            break
        across = a[:, chosen].T @ a[:, j]
        gram = np.block([[gram, across[:, None]], [across[None, :], np.array([[a[:, j] @ a[:, j]]])]])
        chosen.append(j)
        while chosen:
            z = np.linalg.solve(gram + 1e-12 * np.eye(len(chosen)) * gram.max(), target[chosen])
            if z.min() > 0:
                break
            now = x[chosen]
            falls = z <= 0
            step = (now[falls] / np.maximum(now[falls] - z[falls], 1e-300)).min()
            x[chosen] = now + step * (z - now)
            drop = falls & (x[chosen] <= 1e-12 * max(1.0, np.abs(z).max()))
            if not drop.any():
                drop[np.flatnonzero(falls)[x[np.array(chosen)[falls]].argmin()]] = True
            x[np.array(chosen)[drop]] = 0
            stay = np.flatnonzero(~drop)
            chosen, gram = [chosen[i] for i in stay], gram[np.ix_(stay, stay)]
        if chosen:
            x[chosen] = z
    return x


class Plan(NamedTuple):
    """Where items go, from the number of items of each length alone. An item of a length has a rank among those of that length.

    slots: rows (length, first rank, last rank + 1, sequence of the first, offset): one item a sequence.
    fillers: rows (length, first rank, last rank + 1, place of the first in the stream): items one after the other.
    gaps: rows (place in the stream, tokens, first sequence, offset): from that place on so many tokens of the stream go to each next sequence.
    """

    slots: list[tuple[int, int, int, int, int]]
    fillers: list[tuple[int, int, int, int]]
    gaps: list[tuple[int, int, int, int]]
    sequences: int


def repeats(counts: dict[int, int], window: int = WINDOW, width: int = WIDTH) -> list[tuple[dict[int, int], int]]:
    """How often each combination of classes is to be used, solved against the histogram in tokens and rounded; most used first, never more than there is."""
    have: defaultdict[int, int] = defaultdict(int)
    for length, n in counts.items():
        have[-(-length // width)] += n
    columns = combinations(window // width, set(have))
    classes = sorted(have)
    row = {c: i for i, c in enumerate(classes)}
    a, weight = np.zeros((len(classes), len(columns))), np.array(classes, dtype=float)
    for j, made in enumerate(columns):
        for c, k in made.items():
            a[row[c], j] = k * c
    b = weight * np.array([have[c] for c in classes], dtype=float)
    x = nnls(a, b / max(1.0, b.max(initial=0))) * max(1.0, b.max(initial=0))
    out = []
    for j in np.lexsort((np.arange(len(x)), -x)):
        n = min([int(x[j] + 0.5), *(have[c] // k for c, k in columns[j].items())])
        if n > 0:
            out.append((columns[j], n))
            for c, k in columns[j].items():
                have[c] -= n * k
    return out


def _alike(wanted: list[tuple[dict[int, int], int]], counts: dict[int, int], width: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], dict[int, int]]:
    """Groups (((length, items), ...), sequences) that are filled alike, and what is left of each length: classes are made of their longest items first."""
    left = {k: v for k, v in counts.items() if v}
    lengths: defaultdict[int, list[int]] = defaultdict(list)
    for length in sorted(left):
        lengths[-(-length // width)].append(length)
    groups = []
    for made, n in wanted:
        while n:
            most, used = n, []
            for c, k in made.items():
                at = len(lengths[c]) - 1
                while k:
                    take = min(k, left[lengths[c][at]])
                    used.append((lengths[c][at], take))
                    k, at = k - take, at - 1
            for length, k in used:
                most = min(most, left[length] // k)
            for length, k in used:
                left[length] -= k * most
                c = -(-length // width)
                while lengths[c] and not left[lengths[c][-1]]:
                    lengths[c].pop()
            groups.append((tuple(used), most))
            n -= most
    return groups, left


def plan(counts: dict[int, int], window: int = WINDOW, width: int = WIDTH) -> Plan:
    """Fills windows by the rounded combinations; what is left fills the gaps in them and then windows of its own, cut where these end.

    The longest of what is left come first, so few items are cut small. If too little is left for the gaps, sequences with the
    largest ones are given up for it. What remains at the end is cut into sequences whose lengths are powers of two,
    so nothing is padded. The work depends on the window, not on the number of items.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if any(k > window or k < 1 for k in counts):
        raise ValueError("lengths must be from 1 to the window")
    groups, left = _alike(repeats(counts, window, width), counts, width)
    gap_of = lambda used: window - sum(length * k for length, k in used)
    groups.sort(key=lambda g: (gap_of(g[0]), g[0]))
    rest = sum(length * n for length, n in left.items())
    need = sum(gap_of(used) * n for used, n in groups)
    while rest < need:
        used, n = groups.pop()
        give = min(n, -(-(need - rest) // window))
        for length, k in used:
            left[length] += k * give
        rest, need = rest + (window - gap_of(used)) * give, need - gap_of(used) * give
        if n > give:
            groups.append((used, n - give))
    rank: defaultdict[int, int] = defaultdict(int)
    slots, gaps, sequence, place = [], [], 0, 0
    for used, n in reversed(groups):
        offset = 0
        for length, k in used:
            for _ in range(k):
                slots.append((length, rank[length], rank[length] + n, sequence, offset))
                rank[length] += n
                offset += length
        if offset < window:
            gaps.append((place, window - offset, sequence, offset))
            place += (window - offset) * n
        sequence += n
    fillers, at = [], 0
    for length in sorted((k for k in left if left[k]), reverse=True):
        fillers.append((length, rank[length], rank[length] + left[length], at))
        at += length * left[length]
    whole, last = divmod(at - place, window)
    if whole:
        gaps.append((place, window, sequence, 0))
        sequence += whole
    place += whole * window
    for bit in range(last.bit_length() - 1, -1, -1):
        if last >> bit & 1:
            gaps.append((place, 1 << bit, sequence, 0))
            sequence, place = sequence + 1, place + (1 << bit)
    return Plan(slots, fillers, gaps, sequence)


class Placer:
    """Looks up where ranked items go."""

    def __init__(self, p: Plan):
        every = sorted([(*s, 0) for s in p.slots] + [(*f, 0, 1) for f in p.fillers])
        self.length, self.first, self.last, self.to, self.offset, self.stream = np.array(every, dtype=np.int64).reshape(-1, 6).T
        self.key = self.length << 44 | self.first
        self.gap_at, self.gap, self.gap_to, self.gap_offset = np.array(p.gaps, dtype=np.int64).reshape(-1, 4).T

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, begin in it, tokens, sequence, offset) of each piece."""
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        nth = rank - self.first[at]
        direct = self.stream[at] == 0
        i = np.flatnonzero(direct)
        out = [(i, np.zeros(len(i), dtype=np.int64), length[i], self.to[at[i]] + nth[i], self.offset[at[i]])]
        i = np.flatnonzero(~direct)
        begin = self.to[at[i]] + nth[i] * length[i]
        end, now = begin + length[i], begin.copy()
        while len(i):
            g = np.searchsorted(self.gap_at, now, side="right") - 1
            k, inside = np.divmod(now - self.gap_at[g], self.gap[g])
            take = np.minimum(self.gap[g] - inside, end - now)
            out.append((i, now - begin, take, self.gap_to[g] + k, self.gap_offset[g] + inside))
            now = now + take
            on = now < end
            i, begin, end, now = i[on], begin[on], end[on], now[on]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def items(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, pos, id, start, length, nth, doc_tokens, ids): the ids of each text and end_id, in items of a window's length at most.

    part and pos number the items by task and place, nth those of a length within the task. ids are little-endian numbers of
    two bytes, or four if one doesn't fit. A null or empty text is the single id end_id. Repeated rows give repeated items.
    """

    def run(batches):
        model, part, done = load(path), TaskContext.get().partitionId(), 0
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            for rows, texts in chunks(batch, text_col):
                ids, counts = model.encode(texts)
                ids = np.insert(ids, starts(counts)[1:], end_id)
                counts = counts + 1
                n = -(-counts // window)
                doc = np.repeat(np.arange(len(texts)), n)
                start = (np.arange(len(doc)) - np.repeat(starts(n)[:-1], n)) * window
                length = np.minimum(counts[doc] - start, window)
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(doc), dtype=np.int64)
                size = np.bincount(length, minlength=window + 1)
                nth[order] = np.arange(len(doc)) - starts(size)[length[order]] + seen[length[order]]
                seen += size
                wide = "<u2" if ids.max(initial=0) < 1 << 16 else "<u4"
                raw, at = memoryview(ids.astype(wide).tobytes()), starts(length) * int(wide[2])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), part), pa.int32()),
                        pa.array(np.arange(done, done + len(doc)), pa.int64()),
                        rows.column(id_col).take(pa.array(doc)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int32()),
                        pa.array(nth, pa.int64()),
                        pa.array(counts[doc], pa.int64()),
                        pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    ["_part", "_pos", id_col, "start", "length", "nth", "doc_tokens", "ids"],
                )
                done += len(doc)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"_part int, _pos long, `{id_col}` {kind}, start long, length int, nth long, doc_tokens long, ids binary")


def placed(cut: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(part, pos, begin, tokens, sequence_id, offset) of the pieces of items.

    Only the number of items of each length goes to the driver, `window` numbers at most. Ranks come from the numbers that tasks gave:
    one row for each task and length is summed up, and joined with the items, so a length that most items have is spread by task.
    """
    keys = cut.select("_part", "_pos", "length", "nth")
    here = keys.groupBy("_part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, window, width)
    ranked = keys.join(here.select("_part", "length", before.alias("before")), ["_part", "length"]).select("_part", "_pos", "length", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        placer = Placer(made)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            item, *rest = placer.pieces(length, rank)
            take = pa.array(item)
            yield pa.RecordBatch.from_arrays([batch.column("_part").take(take), batch.column("_pos").take(take), *(pa.array(x, pa.int64()) for x in rest)], ["_part", "_pos", "begin", "tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "_part int, _pos long, begin long, tokens long, sequence_id long, offset long")


def windows(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): every token of every document in exactly one piece of a sequence.

    ids are little-endian numbers of four bytes. Sequences are filled without a gap; each is a window long, but for
    some at the end whose lengths are powers of two. See items() and plan(). No documents: no rows.
    """
    cut = save(items(docs, path, window, end_id, id_col, text_col), "window-items", batch_rows=1000)
    rows = cut.select("_part", "_pos", id_col, F.col("start").alias("_start"), F.col("length").alias("_length"), "doc_tokens", F.col("ids").alias("_ids")).join(placed(cut, window, width), ["_part", "_pos"])
    columns = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, CUT_ROWS):
                part = batch.slice(k, CUT_ROWS)
                ids = []
                for raw, size, a, n in zip(part.column("_ids").to_pylist(), *(part.column(c).to_pylist() for c in ("_length", "begin", "tokens")), strict=True):
                    ids.append(np.frombuffer(raw, dtype=f"<u{len(raw) // size}")[a : a + n].astype("<u4").tobytes())
                start = pa.compute.add(part.column("_start"), part.column("begin"))
                yield pa.RecordBatch.from_arrays([part.column(id_col), start, part.column("tokens"), pa.array(ids, pa.binary()), *(part.column(c) for c in columns[4:])], columns)

    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    schema = T.StructType([cut.schema[id_col], *long("start", "length"), T.StructField("ids", T.BinaryType()), *long("doc_tokens", "sequence_id", "offset")])
    return rows.mapInArrow(run, schema)
