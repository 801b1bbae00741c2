"""Periodic runs of words: maximal repetitions found by harmonic grid probing (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import chunks, coded, ragged_take, run_sums, starts

#: Words of the shortest run; a run also repeats its period at least twice.
SHORTEST = 12
#: Grid points that are tested together, and words that one comparison of survivors reads.
PROBES, COMPARED = 1_000_000, 4_000_000
#: Words of the first chunk that survivors are compared by; each further chunk is twice as long.
FIRST_CHUNK = 8
#: Characters of text that a task works on at a time.
PART_CHARS = 1_000_000
#: Fixed value: the white space between words, of which a text's words are the rest.
SPACES = r"[\x20\x09-\x0D]+"


def extend(codes: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many places in a row, up to `room`, have the word that lies `period` later, from each `at` on in the direction of step.

    Survivors are compared chunk by chunk; those that match a whole chunk go on with one of twice the length.
    """
    found = np.zeros(len(at), dtype=np.int64)
    active, size = np.flatnonzero(room > 0), FIRST_CHUNK
    while len(active):
        on = []
        for some in np.array_split(active, -(-len(active) * size // COMPARED)):
            k = found[some][:, None] + np.arange(size)
            inside = k < room[some][:, None]
            here = at[some][:, None] + step * np.minimum(k, room[some][:, None] - 1)
            differ = ~inside | (codes[here] != codes[here + period[some][:, None]])
            n = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
            found[some] += n
            on.append(some[(n == size) & (found[some] < room[some])])
        active, size = np.concatenate(on), min(2 * size, COMPARED)
    return found


def _grid(doc: np.ndarray, n: np.ndarray, lowest: int, highest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, grid points) of all pairs of a document and a period from lowest to below highest that it can hold twice, a bounded number of grid points at a time."""
    periods = np.minimum(highest, n[doc] // 2 + 1) - lowest
    after, done = starts(periods), 0
    while done < after[-1]:
        end = min(int(after[-1]), done + PROBES)
        d = np.searchsorted(after, np.arange(done, end), side="right") - 1
        p = lowest + np.arange(done, end) - after[d]
        points = (n[doc[d]] - 1) // p  # j from 0 with (j + 1) p inside
        some = max(1, int(np.searchsorted(np.cumsum(points), PROBES, side="right")))
        yield doc[d[:some]], p[:some], points[:some]
        done += some


def _blocks(base: np.ndarray, p: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, place) of every grid point, a bounded number at a time, also of a single pair with very many."""
    after = starts(points)
    for begin in range(0, int(after[-1]), PROBES):
        flat = np.arange(begin, min(begin + PROBES, int(after[-1])))
        pair = np.searchsorted(after, flat, side="right") - 1
        yield pair, base[pair] + (flat - after[pair]) * p[pair]


def find_runs(codes: np.ndarray, counts: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run in documents of coded words, by document, start and period.

    A run is a stretch with smallest period q of at least max(shortest, 2 q) words that no neighbour extends keeping q.
    The words of a run of period p that equal the word p later are p in a row or more, so one of them is a grid point jp of its
    document, tested against (j + 1) p. Grid points within a run found before whose period divides p can belong to no other
    run and are skipped. Consecutive grid points that a run joins are one candidate, which is extended at both ends
    by less than a period. Work: n ln n tests for n words, and as many comparisons as the survivors need.
    """
    counts = np.asarray(counts, dtype=np.int64)
    base = starts(counts)
    end_of = np.repeat(base[1:], counts)
    found: list[np.ndarray] = []  # rows of (document, start in the flat array, matches, period)
    reach, reach_period = np.zeros(len(codes), dtype=np.int64), np.ones(len(codes), dtype=np.int64)
    lowest = 1
    while (doc := np.flatnonzero(counts >= max(shortest, 2 * lowest))).size:
        new = []
        for d, p, points in _grid(doc, counts, lowest, 2 * lowest):
            kept = []
            for pair, at in _blocks(base[d], p, points):
                hit = codes[at] == codes[at + p[pair]]
                pair, at = pair[hit], at[hit]
                skip = (reach[at] > at + p[pair]) & (p[pair] % reach_period[at] == 0)
                kept.append((pair[~skip], at[~skip]))
            pair, at = (np.concatenate(x) for x in zip(*kept, strict=True))
            if len(at):
                new.append(_candidates(codes, base, end_of, d[pair], p[pair], at, shortest))
        new = [x for x in new if len(x)]
        if new:
            found += new
            reach, reach_period = _covered(np.concatenate(found), len(codes))
        lowest *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1]))]
    return rows[:, 0], rows[:, 1] - base[rows[:, 0]], rows[:, 2] + rows[:, 3], rows[:, 3]


def _candidates(codes, base, end_of, doc, p, at, shortest) -> np.ndarray:
    """The runs among survivors, which are ordered by document, period and place."""
    need = np.maximum(p, shortest - p)
    right = extend(codes, at, p, np.minimum(p, end_of[at] - p - at), 1)
    left = extend(codes, at - 1, p, np.minimum(p, at - base[doc]), -1)
    joined = np.r_[False, (at[1:] == at[:-1] + p[:-1]) & (p[1:] == p[:-1]) & (doc[1:] == doc[:-1]) & (right[:-1] == p[:-1])]
    first = np.flatnonzero(~joined)
    last = np.r_[first[1:], len(at)] - 1
    start, matches = at[first] - left[first], at[last] + right[last] - at[first] + left[first]
    keep = matches >= need[first]
    rows = np.stack([doc[first], start, matches, p[first]], axis=1)[keep]
    return rows[_primitive(codes, rows[:, 1], rows[:, 3])]


def _primitive(codes: np.ndarray, start: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether no shorter period holds: it would divide p, so it would be p over a prime or a divisor of that."""
    out, rest, prime = np.ones(len(p), dtype=bool), p.copy(), 2
    while (rest > 1).any():
        if prime * prime > rest.max():
            factor = rest > 1  # what is left is prime
            shorter = p[factor] // rest[factor]
        else:
            factor = rest % prime == 0
            shorter = p[factor] // prime
        if factor.any():
            out[factor] &= extend(codes, start[factor], shorter, p[factor], 1) < p[factor]
            if prime * prime > rest.max():
                break
            while (more := rest % prime == 0).any():
                rest[more] //= prime
        prime += 1 if prime == 2 else 2
    return out


def _covered(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place the end of the run that reaches furthest among those that begin at it or before, and its period."""
    end = rows[:, 1] + rows[:, 2] + rows[:, 3]
    order = np.lexsort((end, rows[:, 1]))
    best = np.maximum.accumulate(end[order])
    own = np.maximum.accumulate(np.where(end[order] == best, np.arange(len(order)), 0))
    at = np.searchsorted(rows[order, 1], np.arange(n), side="right") - 1
    return np.where(at >= 0, best[at], 0), np.where(at >= 0, rows[order[own[at]], 3], 1)


def repeated(doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marks the words that a run contains after its first period."""
    base = starts(counts)
    edge = np.zeros(int(base[-1]) + 1, dtype=np.int64)
    np.add.at(edge, base[doc] + start + period, 1)
    np.add.at(edge, base[doc] + start + length, -1)
    return np.cumsum(edge)[:-1] > 0


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), shortest: int = SHORTEST) -> DataFrame:
    """(id, `keep`, runs, collapsed): every run of every whole text, and its words without repetitions, joined by single spaces.

    Words are what white space of ASCII separates, as they are, numbered from 0; runs are structs of start, length and period, by
    start, then period. `collapsed` leaves out the words that a run contains after its first period. A null text counts as
    empty and has neither. Repeated rows give repeated rows, an empty table none. One pass without a shuffle; a task
    holds PART_CHARS characters at a time, or one longer text.
    """

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, text_col, PART_CHARS):
                codes, distinct, counts = coded([t.encode("utf-8", "surrogatepass").split() for t in texts])
                doc, start, length, period = find_runs(codes, counts, shortest)
                keep_word = ~repeated(doc, start, length, period, counts)
                words, at = distinct[codes[keep_word]], starts(run_sums(keep_word.astype(np.int64), counts))
                collapsed = [b" ".join(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                offsets = pa.array(starts(np.bincount(doc, minlength=len(texts))), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], RUN.names))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_col, *keep)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], [id_col, *keep, "runs", "collapsed"])

    rows = docs.select(id_col, *keep, text_col)
    schema = T.StructType([*(rows.schema[c] for c in (id_col, *keep)), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length, ties by smallest start, then period; null without runs."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))


def listed(runs: Column) -> Column:
    """All runs as text: start, length and period with commas, a line each."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def with_repeats(text: Column, h: Column) -> Column:
    """The text, or for a tenth of all h (unsigned) its words with a repetition from some word to the end, so that there is something to find.

    With g = floor(h / 10) and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    places = lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), F.pmod(g, F.size(w)).cast("long").alias("a"))
    period = lambda x: F.floor((x["n"] - x["a"]) / (F.pmod(g, F.lit(8)) + 3)) + 1
    again = lambda x, p: F.concat(F.slice(x["w"], 1, x["a"].cast("int")), F.transform(F.sequence(x["a"], x["n"] - 1), lambda i: F.get(x["w"], (x["a"] + F.pmod(i - x["a"], p)).cast("int"))))
    let = lambda value, use: F.transform(F.array(value), use)[0]
    planted = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(let(places(w), lambda x: let(period(x), lambda p: again(x, p))), " ")).otherwise(text))
    return F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(text)
