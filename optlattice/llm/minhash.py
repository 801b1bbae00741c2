"""Near-duplicates by MinHash with sequential Bayesian verification (operator 2)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, coded, forget, hashed, mix64, save, starts, words_of
from .components import components

#: Words per shingle.
WORDS = 5
#: Hashes of a signature, compared in batches of this size.
HASHES, BATCH = 180, 30
#: A candidate is given up when the posterior probability that it is a link falls below this.
MISS = 1e-6
#: Members of a band bucket that are compared in one task at most, squared.
BLOCK = 1024
_ROWS_AT_A_TIME = 200_000


def band_rows(num: int, den: int) -> int:
    """Hashes per band: as many as keep the chance that a link shares no band below about one in a million."""
    t = num / den
    return max(r for r in range(1, HASHES + 1) if HASHES % r == 0 and (r == 1 or (1 - t**r) ** (HASHES // r) <= 2e-6))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, one text after the other, and their numbers."""
    codes, distinct, counts = coded([words_of(t) for t in texts])
    each = mix64(hashed(distinct))[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    at = starts(counts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(each) - words + 1), dtype=np.uint64)
        for k in range(words if len(rolled) else 0):
            rolled = mix64(rolled + each[k : k + len(rolled)] + np.uint64(0x9E3779B97F4A7C15))
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in each[a:b]:
                    whole = mix64(whole + x + np.uint64(0x9E3779B97F4A7C15))
                out.append(np.array([whole], dtype=np.uint64))
            else:
                out.append(rolled[:0])
    return (np.concatenate(out) if out else rolled[:0]), np.fromiter(map(len, out), dtype=np.int64, count=len(out))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    return draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty, as 32 bits."""
    with np.errstate(over="ignore"):
        out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(hashes), 4096):
            out = np.minimum(out, (a[:, None] * hashes[None, i : i + 4096] + b[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype("<u4")


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of each set's hashes, which tell sets apart."""
    with np.errstate(over="ignore"):
        k1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
        k2 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
    return k1, k2


#: What identifies a shingle set: its two sums and its size.
KEY = ["k1", "k2", "n"]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, h, n, k1, k2, sig) of every whole text: a hash of it, its set's size, sums and signature (null if empty)."""

    def run(batches):
        a, b = _multipliers()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                flat, counts = shingle_sets(texts, words)
                at = starts(counts)
                sets = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                sig = [signature(s, a, b).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(counts), *map(pa.array, _set_keys(sets)), pa.array(sig, pa.binary())], ["id", "h", "n", "k1", "k2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _numbered(docs, id_col, text_col).mapInArrow(run, f"id {kind}, h long, n long, k1 long, k2 long, sig binary")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): a row with its text's hash, which tells rows of one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def bands(reps: DataFrame, rows: int) -> DataFrame:
    """(id, bucket): a 64-bit key for each band of each signature."""

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"))
            key = _band_keys(sig, rows)
            n = key.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(len(sig)), n))), pa.array(key.reshape(-1).view(np.int64))], ["id", "bucket"])

    return reps.select("id", "sig").mapInArrow(run, "id long, bucket long")


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n = HASHES // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(sig), n)).copy()
        for k in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows].astype(np.uint64) + np.uint64(1))
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), HASHES)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes, a pair with fewer than m equal ones is a link with a posterior below `miss`.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), so P(similarity >= t) is
    the chance of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def likely(sig: np.ndarray, i: np.ndarray, other: np.ndarray, j: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (sig[i], other[j]) survive all batches of hashes; each batch is compared for survivors only."""
    alive, same, before = np.arange(len(i)), np.zeros(len(i), dtype=np.int64), 0
    for n, m in bounds:
        same[alive] += (sig[i[alive], before:n] == other[j[alive], before:n]).sum(axis=1)
        alive, before = alive[same[alive] >= m], n
    return alive


def _prune(pairs: DataFrame, reps: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The candidate pairs (a, b) that survive the sequential comparison of their signatures."""

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column("sa")), _matrix(batch.column("sb"))
            at = np.arange(len(x))
            keep = pa.array(likely(x, at, y, at, bounds))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    joined = pairs.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, same: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, s): the full shingle sets with these numbers. Only the texts of their representatives are read again.

    The numbers grow with the input, so both sides are shuffled, whatever their sizes.
    """

    def run(batches):
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                flat, counts = shingle_sets(texts, words)
                at = starts(counts)
                sets = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, _set_keys(sets)), pa.array(counts), pa.array([x.tobytes() for x in sets], pa.binary())], [*KEY, "s"])

    chosen = same.join(wanted.select("id").distinct(), "id", "left_semi")
    places = chosen.select("first.id", "first.h").hint("shuffle_hash")
    texts = _numbered(docs, id_col, text_col).join(places, ["id", "h"], "left_semi")
    found = texts.mapInArrow(run, "k1 long, k2 long, n long, s binary").join(chosen.select("id", *KEY), KEY)
    return save(found.groupBy("id").agg(F.min("s").alias("s")), "minhash-sets")


def is_link(x, y, num: int, den: int) -> bool:
    """Whether two sets, given as buffers of sorted hashes, have den * intersection >= num * union."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(both) - common)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are linked."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("sa"), batch.column("sb"), strict=True)
            keep = pa.array([k for k, (x, y) in enumerate(pairs) if is_link(x.as_buffer(), y.as_buffer(), num, den)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _leaders(rows: DataFrame) -> DataFrame:
    """(bucket, size, leader) of every bucket with two members or more.

    The leader is the member with the most company in all its buckets: the text that most copies come from, if it
    is there. Ties: the smallest id.
    """
    size = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    company = rows.join(size, "bucket").groupBy("id").agg(F.sum("size").alias("company"))
    ranked = rows.join(company, "id")
    return ranked.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("m"))).alias("top"), F.count("*").alias("size")).where("size > 1").select("bucket", "size", (-F.col("top.m")).alias("leader"))


def _mixed_members(rows: DataFrame, leads: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, size, part): members, the leader aside, of buckets that the first links leave in several components."""
    members = rows.join(leads.where("size > 2"), "bucket").where("id <> leader").select("bucket", "id", "size")
    members = members.join(labels, "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("part"))
    mixed = members.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
    return members.join(mixed, "bucket")


def _mixed_links(members: DataFrame, reps: DataFrame, sets: DataFrame, rows_per_band: int, bounds: list[tuple[int, int]], num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what links between members of a bucket connect.

    Members are dealt to blocks of bounded size, and each pair of blocks is a task's group: signatures are
    compared in batches, survivors on their full sets, and pairs that are connected already are passed over. A
    pair is looked at only in the first band that it shares. No pairs leave the task but the links that join
    two of its components.
    """
    members = members.withColumn("n_blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("bucket", "id", "part", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    dealt = dealt.join(reps.select("id", "sig").join(sets, "id"), "id")

    def compare(key, group):
        sig = np.frombuffer(b"".join(group["sig"]), dtype="<u4").reshape(len(group), HASHES)
        part, own, ids, full = group["part"].to_numpy(), group["own"].to_numpy(), group["id"].to_numpy(), group["s"].tolist()
        bands = _band_keys(sig, rows_per_band)
        here = int(np.flatnonzero((bands == np.int64(key[0]).view(np.uint64)).all(axis=0))[0])
        _, part = np.unique(part, return_inverse=True)
        found = []
        step = max(1, _ROWS_AT_A_TIME // max(1, len(ids)))
        for begin in range(0, len(ids), step):
            i, j = np.meshgrid(np.arange(begin, min(begin + step, len(ids))), np.arange(len(ids)), indexing="ij")
            fits = (ids[i] < ids[j]) & (part[i] != part[j]) & ((own[i] != own[j]) | (key[1] == key[2]))
            i, j = i[fits], j[fits]
            keep = likely(sig, i, sig, j, bounds)
            i, j = i[keep], j[keep]
            first = ~(bands[i, :here] == bands[j, :here]).any(axis=1)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                if part[a] != part[b] and is_link(full[a], full[b], num, den):
                    found.append((ids[a], ids[b]))
                    part[part == part[b]] = part[a]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame, num: int = 85, den: int = 100, words: int = WORDS, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n, group, first) of every row: its text's hash, its set's size, the number of its group of linked sets, and
    the smallest id in that group. Rows without a set or an id have no group.

    Distinct sets, not ids, are compared: equal sets are one numbered representative, and rows that share an id are
    told apart by their texts. Band buckets propose (leader, member) pairs, never all pairs; pairs between members are
    compared only in buckets that the first links leave in several components.
    """
    sketch = save(sketches(docs, id_col, text_col, words), "minhash-sketches")
    same = sketch.where("n > 0 and id is not null").groupBy(*KEY).agg(F.min(F.struct("id", "h")).alias("first"), F.min("sig").alias("sig"))
    same = save(same.withColumn("id", F.monotonically_increasing_id()), "minhash-representatives")  # numbers hold once they are written
    reps = same.select("id", "sig")
    bounds, per_band = least_matches(num / den, miss), band_rows(num, den)
    rows = save(bands(reps, per_band), "minhash-bands")
    leads = save(_leaders(rows), "minhash-leaders")
    pairs = rows.join(leads, "bucket").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    survivors = save(_prune(pairs, reps, bounds), "minhash-survivors")
    ends = survivors.select(F.col("a").alias("id")).unionByName(survivors.select(F.col("b").alias("id")))
    sets = _sets(docs, ends, same, id_col, text_col, words)
    links = save(_verify(survivors, sets, num, den), "minhash-links", batch_rows=500)
    forget(survivors, sets)
    labels = save(components(links), "minhash-labels")
    members = save(_mixed_members(rows, leads, labels), "minhash-mixed")
    forget(rows, leads, labels)
    sets = _sets(docs, members, same, id_col, text_col, words)
    more = save(_mixed_links(members, reps, sets, per_band, bounds, num, den), "minhash-more")
    forget(members, sets)
    labels = save(components(links.unionByName(more)), "minhash-labels")
    per_set = same.select(*KEY, "id", F.col("first.id").alias("first")).join(labels, "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = per_set.groupBy("group").agg(F.min("first").alias("least"))
    per_set = per_set.join(least, "group").select(*KEY, "group", F.col("least").alias("first"))
    out = sketch.select("id", "h", *KEY).join(per_set, KEY, "left")
    named = F.col("id").isNotNull()
    return out.select("id", "h", "n", F.when(named, F.col("group")).alias("group"), F.when(named, F.coalesce("first", "id")).alias("first"))


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, words: int = WORDS, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked where den * intersection >= num * union of their shingle sets.

    component_id is the smallest id reachable by links, kept tells if it is the document's own. Whole texts are
    used. Texts without words (or null) are linked with nothing; rows with a null id, too, and they get a null
    component and kept = false. Ids are integers. Every row is a document of its own: rows that share an id are linked
    only where their sets are, so each has the component of its own text. An empty table gives no rows.
    """
    found = groups(docs, num, den, words, miss, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), F.coalesce(F.col("id") == F.col("first"), F.lit(False)).alias("kept"))
