"""Building the input store: decoding, routing of recycled ids, appending."""

from __future__ import annotations

import datetime as dt
import heapq
import itertools
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import from_epoch_nanos

#: Prices are integers in units of 1e-9; contracts without a unit of measure have 50 of it.
SCALE, DEFAULT_MULTIPLIER = 1e9, 50
DEFINITION_KEYS = ("instrument_id", "activation", "expiration")


def decode_definitions(raw: DataFrame) -> DataFrame:
    """Futures, calls and puts with dates, strike and multiplier; one row per instrument, activation and expiration, the first by its other values."""
    rows = raw.where(F.col("instrument_class").isin("F", "C", "P"))
    unit = F.round(F.col("unit_of_measure_qty") / SCALE).cast("long")
    strike = F.when(F.col("instrument_class") != "F", F.col("strike_price") / SCALE)
    out = rows.select(
        "instrument_id",
        "instrument_class",
        "symbol",
        "underlying_id",
        strike.alias("strike_price"),
        F.when(F.col("instrument_class") != "F", F.col("instrument_class")).alias("right"),
        F.when(unit > 0, unit).otherwise(DEFAULT_MULTIPLIER).alias("multiplier"),
        from_epoch_nanos(F.col("activation")).alias("activation"),
        from_epoch_nanos(F.col("expiration")).alias("expiration"),
    )
    return dedupe(out, [c for c in out.columns if c not in DEFINITION_KEYS], DEFINITION_KEYS)


def decode_bars(raw: DataFrame) -> DataFrame:
    """Prices as doubles and times as UTC instants of integer-coded bars."""
    micros = F.floor(F.col("ts_event") / 1000)
    stamp = F.timestamp_micros(micros).cast("timestamp_ntz")
    return raw.withColumns({c: F.col(c) / SCALE for c in ("open", "high", "low", "close")}).withColumn("ts_event", stamp)


def distinct_instruments(bars: DataFrame) -> DataFrame:
    return bars.select("instrument_id").distinct()


def missing_definitions(bars: DataFrame, definitions: DataFrame) -> DataFrame:
    """Instruments with bars but no definition."""
    return distinct_instruments(bars).join(definitions.select("instrument_id"), "instrument_id", "left_anti")


def dedupe(bars: DataFrame, order: Sequence[str], keys: Sequence[str] = ("ts_event", "instrument_id")) -> DataFrame:
    """The first bar of each key in the stated order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return bars.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


#: Stand for an open end of a segment, in days since 1970.
_EVER = 10_000_000
_FIRST = dt.date(1970, 1, 1)


def _winners(segments: list[tuple[int, int, tuple]]) -> list[tuple[int, int]]:
    """(first day, segment): from which day on which of the segments (activation, expiration, rank) of an id is chosen.

    One sweep over the days at which segments begin and end: of those that are open the one of the smallest rank, between two of them the
    nearer one, on the day in the middle the one of smaller rank.
    """
    order = sorted(range(len(segments)), key=lambda i: segments[i][0])
    rank = lambda i: segments[i][2]
    points = sorted({x for a, e, _ in segments for x in (a, e + 1)})
    out: list[tuple[int, int]] = [(-_EVER, min(range(len(segments)), key=lambda i: (segments[i][0], rank(i))))]
    heap: list[tuple[tuple, int]] = []
    at, before = 0, None
    for p in points:
        while at < len(order) and segments[order[at]][0] <= p:
            i = order[at]
            heapq.heappush(heap, (rank(i), i))
            if before is None or (-segments[i][1], rank(i)) < (-segments[before][1], rank(before)):
                before = i
            at += 1
        while heap and segments[heap[0][1]][1] < p:
            heapq.heappop(heap)
        if heap:
            out.append((p, heap[0][1]))
            continue
        out.append((p, before))
        if at < len(order):
            begin = segments[order[at]][0]
            following = min(itertools.takewhile(lambda i: segments[i][0] == begin, itertools.islice(order, at, None)), key=rank)  # noqa: B023
            end = segments[before][1]
            middle = (begin + end) // 2
            if (begin + end) % 2 == 0:
                out.append((middle, min(before, following, key=rank)))
            out.append((middle + 1, following))
    return [x for k, x in enumerate(out) if k + 1 == len(out) or out[k + 1][0] > x[0]]


def stretches(segments: DataFrame) -> DataFrame:
    """(instrument_id, first, segment columns): each id's days cut into disjoint stretches, with the segment that is chosen from `first` on.

    A grouped function sees the segments of one id, a few for each time that the id was given away; never bars.
    """
    others = [c for c in segments.columns if c != "instrument_id"]

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        day = lambda d, none: none if pd.isna(d) else (d - _FIRST).days
        ends = [(day(a, -_EVER), day(e, _EVER)) for a, e in zip(rows["seg_activation"], rows["seg_expiration"], strict=True)]
        known = [(min(a, e), max(a, e), (-1 if _EVER in (-a, e) else e - a, a, e)) for a, e in ends]
        found = _winners(known)
        found = [(d, i) for d, i in found if d <= (dt.date.max - _FIRST).days]
        first = [_FIRST + dt.timedelta(days=max(d, (dt.date.min - _FIRST).days)) for d, _ in found]
        out = rows.iloc[[i for _, i in found]].reset_index(drop=True)
        return out.assign(first=first)[["instrument_id", "first", *others]]

    schema = T.StructType([segments.schema["instrument_id"], T.StructField("first", T.DateType()), *(segments.schema[c] for c in others)])
    return segments.groupBy("instrument_id").applyInPandas(cut, schema)


def route(bars: DataFrame, segments: DataFrame, date: str = "date") -> DataFrame:
    """Joins each bar with one segment of its recycled instrument id.

    Of the segments of the id, that with the date within [activation, expiration] or else the fewest days away
    wins; ties go to the narrower and then the earlier one. A missing end is open; ends in the wrong order count as if they were in the right one.
    Every bar whose id is known stays exactly once; one without a date gets the segment that comes first. The distinct dates of an id look their stretch up in one
    window over both: as many rows as there are dates and segments.
    """
    others = [c for c in segments.columns if c != "instrument_id"]
    chosen = F.struct(*others)
    own = F.coalesce(F.col(date), F.lit("0001-01-01").cast("date"))
    days = bars.select("instrument_id", own.alias("_d")).distinct()
    cuts = stretches(segments).select("instrument_id", F.col("first").alias("_d"), F.lit(0).alias("_own"), chosen.alias("_s"))
    both = cuts.unionByName(days.select("instrument_id", "_d", F.lit(1).alias("_own"), F.lit(None).cast(cuts.schema["_s"].dataType).alias("_s")))
    past = Window.partitionBy("instrument_id").orderBy("_d", "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_s", F.last("_s", True).over(past)).where("_own = 1 and _s is not null").select(F.col("instrument_id").alias("_i"), "_d", "_s")
    out = bars.join(found, (bars["instrument_id"] == found["_i"]) & (F.coalesce(bars[date], F.lit("0001-01-01").cast("date")) == found["_d"])).select(*bars.columns, "_s.*")
    away = F.greatest(F.lit(0), F.datediff("seg_activation", date), F.datediff(date, "seg_expiration"))
    return out.withColumn("seg_distance", away)


def overlaps(bars: DataFrame, segments: DataFrame, date: str = "date") -> DataFrame:
    """(instrument_id, bars): bars that lie in more than one segment.

    A segment is +1 at its activation and -1 after its expiration; running sums over these and the distinct dates tell how many are
    open. Segments without one of the ends, or with the ends in the wrong order, hold no bar.
    """
    whole = segments.where(F.col("seg_activation") <= F.col("seg_expiration"))
    steps = F.array(F.struct(F.col("seg_activation").alias("_d"), F.lit(1).alias("_n")), F.struct(F.date_add("seg_expiration", 1).alias("_d"), F.lit(-1).alias("_n")))
    events = whole.select("instrument_id", F.explode(steps).alias("e")).groupBy("instrument_id", "e._d").agg(F.sum("e._n").alias("_n")).withColumn("_own", F.lit(0))
    days = bars.select("instrument_id", F.col(date).alias("_d")).distinct().withColumns({"_n": F.lit(0).cast("long"), "_own": F.lit(1)})
    past = Window.partitionBy("instrument_id").orderBy("_d", "_own").rowsBetween(Window.unboundedPreceding, 0)
    twice = events.unionByName(days).withColumn("_open", F.sum("_n").over(past)).where("_own = 1 and _open > 1").select("instrument_id", F.col("_d").alias(date))
    rows = bars.select("instrument_id", "ts_event", date).distinct().join(twice, ["instrument_id", date], "left_semi")
    return rows.groupBy("instrument_id").agg(F.count("*").alias("bars"))


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("ts_event", "instrument_id")) -> DataFrame:
    """The incoming rows whose key isn't stored yet; running an append twice adds nothing.

    Rows after the newest stored instant can't be there, so only the others are compared.
    """
    newest = stored.agg(F.max(keys[0]).alias("_newest"))
    tagged = incoming.join(F.broadcast(newest))
    fresh = tagged.where(F.col("_newest").isNull() | (F.col(keys[0]) > F.col("_newest")))
    old = tagged.where(F.col(keys[0]) <= F.col("_newest")).join(stored.select(*keys), list(keys), "left_anti")
    return fresh.unionByName(old).select(*incoming.columns)


def heal(table: DataFrame, columns: Mapping[str, str], renamed: Mapping[str, str] | None = None) -> DataFrame:
    """Renames old columns and adds missing ones, null, of the types stated."""
    for old, new in (renamed or {}).items():
        if old in table.columns and new not in table.columns:
            table = table.withColumnRenamed(old, new)
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def sorted_for_scans(table: DataFrame, keys: Sequence[str] = ("underlying_id", "dte", "ts_event")) -> DataFrame:
    """Range-partitioned and sorted, so that files and row groups can be skipped by their smallest and largest keys."""
    return table.repartitionByRange(*keys).sortWithinPartitions(*keys)
