"""Best-fit packing of tokenized documents into sequences of a fixed capacity (operator 5)."""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from ._shared import WHITE_SPACE, Remembered, chunks, coded, finder, ragged_take, run_sums, save, starts

KNOWN_WORDS = 250_000
#: The pattern of a word's parts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Rows that are ranked together at most, about.
ROWS_PER_BUCKET = 200_000


class WordTokens:
    """Token ids of whole texts under a vocabulary with word ends, where white space only separates words.

    Each distinct word is encoded once: put into its normal form, split by the pattern, and merged by the tiktoken library, to
    which a line end stands for the end of a word. Words with a special token are left to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.path, self.model = path, None
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(to_byte[c] for c in s.removesuffix(suffix)) + b"\n" * s.endswith(suffix)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = [c + end for end in ("", suffix) for c in byte_alphabet()] + [x + y for x, y in merges]
        ranks: dict[bytes, int] = {}
        for token in made:
            ranks.setdefault(raw(token), len(ranks))
        self.ids = np.array([vocab[t] for t in dict.fromkeys(made)], dtype=np.uint32)
        self.ends = np.array([t.endswith(suffix) for t in dict.fromkeys(made)])
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.words = finder(f"[^{WHITE_SPACE}]+")
        self.known = Remembered(self._encode_words, KNOWN_WORDS)

    def _parts(self, word: str) -> list[str]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = word.lower() if "Σ" not in word else "".join(map(str.lower, word))  # no letter depends on its neighbours
        if word.isalpha():
            return [word]
        return [word[:-1], word[-1]] if word[-1] in ".,;:!?" and word[:-1].isalpha() else self.split(word)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._parts(w) for w in words]
        flat = list(chain.from_iterable(parts))
        rank = np.array(self.fast.encode_ordinary("\n".join(flat) + "\n"), dtype=np.int64) if flat else np.zeros(0, dtype=np.int64)
        ids = self.ids[rank]
        at = np.r_[0, np.flatnonzero(self.ends[rank]) + 1][starts(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))]
        size = np.diff(at)
        special = [i for i, w in enumerate(words) if "<" in w and any(x in w for x in self.special)]
        if special:
            self.model = self.model or Tokenizer.from_file(self.path)
            each = np.split(ids, at[1:-1])
            for i in special:
                each[i] = np.array(self.model.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32)
                size[i] = len(each[i])
            ids = np.concatenate(each)
        return ids, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's ids."""
        codes, distinct, counts = coded([self.words(t) for t in texts])
        flat, begin, size = self.known.get(distinct)
        return ragged_take(flat, begin[codes], size[codes]), run_sums(size[codes], counts)


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and end_id, cut only where they exceed the capacity.

    A null or empty text is the single id end_id. Repeated rows give repeated pieces.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            for part, texts in chunks(batch, text_col):
                ids, counts = model.encode(texts)
                ids = np.insert(ids, starts(counts)[1:], end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(doc)) - np.repeat(starts(n)[:-1], n)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                raw, at = memoryview(ids.tobytes()), starts(length) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """How pieces of each length fill sequences, from the number of pieces of each length alone.

    Pieces longer than a third of the capacity come at most two to a sequence: the longest takes the longest
    partner that fits, and so on (greedy matching). Shorter ones, longest first, go to the sequences whose gap is
    smallest but large enough. Sequences that are filled alike are one group, so the work depends on the
    distinct lengths and not on the pieces.

    Returns slots (length, first rank, last rank + 1, first sequence, offset, per_sequence): the pieces of that
    length with these ranks lie in sequences from the first on, per_sequence side by side in each from offset on.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    n_sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    order: list[int] = []  # the gaps, ascending

    def add_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(length: int, first: int, n: int, offset: int, per: int = 1) -> None:
        slots.append((length, used[length], used[length] + n * per, first, offset, per))
        used[length] += n * per
        left[length] -= n * per

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1  # the longest partner that fits
        b = large[at] if at >= 0 else None
        if b is None:
            n, gap = left[a], capacity - a
        elif b == a and left[a] == 1:
            rest = at - 1
            b = large[rest] if rest >= 0 else None
            n, gap = 1, capacity - a - (b or 0)
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
            gap = capacity - a - b
        put(a, n_sequences, n, 0)
        if b is not None:
            put(b, n_sequences, n, a)
        add_gap(gap, n_sequences, n)
        n_sequences += n
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if left[k]), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                per = capacity // s
                full, over = divmod(left[s], per)
                for n, k in ((full, per), (1 if over else 0, over)):
                    if n:
                        put(s, n_sequences, n, 0, k)
                        add_gap(capacity - k * s, n_sequences, n)
                        n_sequences += n
                break
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            # best fit goes on in the same sequence while the piece still fits: its gap is now the smallest
            per = min(gap // s, left[s])
            take = min(n, left[s] // per)
            put(s, first, take, capacity - gap, per)
            add_gap(gap - per * s, first, take)
            add_gap(gap, first + take, n - take)
    return slots


def pack(lengths: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to the capacity.

    Only the number of rows of each length goes to the driver: `capacity` numbers at most. Rows of a length
    are ranked in buckets by their keys, so a length that most rows have is spread over the cluster.
    """
    spark = lengths.sparkSession
    buckets = max(64, lengths.count() // ROWS_PER_BUCKET)
    rows = lengths.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    per_bucket = rows.groupBy("length", "_b").count()
    total = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = plan(total, capacity)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_l", "_from", "_to", "_first", "_offset", "_per")])
    planned = spark.createDataFrame(slots, schema)
    before = per_bucket.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy(*keys)
    ranked = rows.withColumn("_n", F.row_number().over(within) - 1).join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_n"))
    placed = _ranges(ranked, planned)
    side = F.col("_rank") - F.col("_from")
    return placed.select(
        *lengths.columns,
        (F.col("_first") + F.floor(side / F.col("_per"))).alias("sequence_id"),
        (F.col("_offset") + side % F.col("_per") * F.col("length")).alias("offset"),
    )


def _ranges(ranked: DataFrame, planned: DataFrame) -> DataFrame:
    """Joins each row with the slot that holds its rank. The slots of a length are an array that is searched; there are a few thousand slots in all."""
    per_length = planned.groupBy("_l").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_first", "_offset", "_per"))).alias("_slots"))
    found = F.filter("_slots", lambda s: (s["_from"] <= F.col("_rank")) & (F.col("_rank") < s["_to"]))[0]
    joined = ranked.join(F.broadcast(per_length), ranked["length"] == per_length["_l"])
    return joined.withColumn("_slot", found).select(*ranked.columns, "_slot.*")


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and offset. No documents: no rows. See pieces() and plan()."""
    cut = save(pieces(docs, path, capacity, end_id, id_col, text_col), "packing-pieces")
    return pack(cut, capacity, (id_col, "piece", "ids_crc32"))
