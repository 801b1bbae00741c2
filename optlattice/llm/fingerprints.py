"""Document fingerprints: every shingle hash below a fixed fraction (operator 8). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import save

#: Share of all hash values that a sketch keeps, and words per shingle: short ones, so that texts of a few words have hashes, too.
FRACTION = 1 / 2
WORDS = 2
#: Bits of an id within a bucket of neighbours, and of a bucket's number within each level above.
LEVELS = (8, 12, 16, 16)
_LOWEST = -(1 << 31)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """32-bit hashes of the runs of `words` words of a text; a shorter text is one shingle, one without words has none."""
    found = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    runs = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.shiftright(F.xxhash64(F.slice(w, i, words)), 32).cast("int"))).otherwise(F.array().cast("array<int>"))
    return _let(found, runs)


def _limit(fraction: float) -> int:
    return _LOWEST + int(fraction * (1 << 32))


def sketch(text: Column, fraction: float = FRACTION, words: int = WORDS) -> Column:
    """The sorted distinct shingle hashes of a text below the fraction, whatever its length.

    A text of few words may have none: one of n shingles is without a hash in (1 - fraction)^n of all cases.
    """
    return F.sort_array(F.array_distinct(F.filter(shingle_hashes(text, words), lambda h: h < F.lit(_limit(fraction)))))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two shingle sets, from their sketches alone."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too. For an a without hashes 1 if b has none as well, else 0."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))


def shown(a: Column) -> Column:
    """A sketch as text: hashes in hexadecimal, joined by commas."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(F.pmod(h.cast("long"), F.lit(1 << 32))), 8, "0"))), ",")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """(id, fingerprint, shingles kept) of every whole text; null counts as empty. No shuffle. Equal texts have equal fingerprints."""
    rows = docs.select(id_col, sketch(F.coalesce(text_col, F.lit("")), fraction, words).alias("_s"))
    return rows.select(id_col, shown(F.col("_s")).alias("fingerprint"), F.size("_s").alias("n_kept"))


def _before(keys: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(b, before): the largest smaller b of the distinct numbers b; null for the smallest.

    Numbers are compared within groups of a bounded range, then the groups among each other, level by level: no
    task sees more numbers than a group's range has.
    """
    if not levels:
        return keys.select("b", F.lag("b").over(Window.orderBy("b")).alias("before"))
    groups = keys.withColumn("g", F.shiftright("b", levels[0]))
    inner = groups.select("b", "g", F.lag("b").over(Window.partitionBy("g").orderBy("b")).alias("before"))
    tops = groups.groupBy("g").agg(F.max("b").alias("top"))
    above = _before(tops.select(F.col("g").alias("b")), levels[1:])
    last = above.join(tops.select(F.col("g").alias("before"), "top"), "before").select(F.col("b").alias("g"), "top")
    return inner.join(last, "g", "left").select("b", F.coalesce("before", "top").alias("before"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """(id, _text, _sketch, _next_text, _next_sketch): each document with the next one by descending id; after the last comes the first.

    Ids are integers; rows that share an id follow each other by text. Rows with a null id come last, by the hash of
    their texts, which also spreads them over buckets. Texts are shuffled once, to buckets of 256 ids; only a bucket's
    largest document travels to the bucket above it.
    """
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64("_text"))
    below = F.when(F.col(id_col).isNull(), F.shiftright(F.xxhash64("_text"), LEVELS[0] + 1) - F.lit(1 << 56))  # under all ids
    rows = rows.withColumns({"_k": key, "_b": F.coalesce(below, F.shiftright(key, LEVELS[0]))})
    spread = rows.repartition("_b").withColumn("_sketch", sketch(F.col("_text"), fraction, words))
    here = Window.partitionBy("_b").orderBy("_k", "_text")
    inner = spread.withColumns({"_next_text": F.lag("_text").over(here), "_next_sketch": F.lag("_sketch").over(here)})
    tops = save(rows.groupBy("_b").agg(F.max_by("_text", F.struct("_k", "_text")).alias("_top")), "fingerprint-tops")  # the search for neighbours doesn't read the texts again
    keys = tops.select(F.col("_b").alias("b"))
    order = _before(keys, LEVELS[1:])
    wrap = keys.agg(F.max("b").alias("largest"))
    order = order.join(F.broadcast(wrap)).select("b", F.coalesce("before", "largest").alias("before"))
    above = order.join(tops, order["before"] == tops["_b"]).select(F.col("b").alias("_b"), "_top")
    above = above.withColumn("_top_sketch", sketch(F.col("_top"), fraction, words))
    joined = inner.join(above, "_b")
    return joined.select(id_col, "_text", "_sketch", F.coalesce("_next_text", "_top").alias("_next_text"), F.coalesce("_next_sketch", "_top_sketch").alias("_next_sketch"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the next document's beginning.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); near_* is the
    estimated share of the text's shingles that the other text has too. A null text counts as empty; a single
    document is its own next one; an empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col, fraction, words)
    n = F.length("_text")
    k = F.floor(n / 3).cast("int")
    text = F.concat(F.substring("_text", F.lit(1), n - k), F.substring("_next_text", F.lit(1), k))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), text.alias("_edited"), "_sketch", "_next_sketch")
    rows = rows.withColumn("_edited_sketch", sketch(F.col("_edited"), fraction, words))
    return rows.select(
        id_col,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        shown(F.col("_sketch")).alias("fingerprint"),
        shown(F.col("_edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        containment(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )
