"""Helpers that the text operators share."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The code points with Unicode's White_Space property.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of text that a task handles at a time.
CHUNK_CHARS = 1_500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may leave it unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "optlattice-checkpoints")
    return found.rstrip("/")


#: Settings of a session while a table is written: Spark deletes the query's shuffle files when it has ended, and Python workers get few rows at a time.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCK, _WRITERS, _BEFORE = threading.Lock(), [], {}


def _begin(spark: SparkSession, batch_rows: int) -> None:
    """The first of several writers at a time remembers the settings; the least number of rows holds for all."""
    with _LOCK:
        if not _WRITERS:
            _BEFORE.update({_CLEANUP: spark.conf.get(_CLEANUP, "false"), _BATCH: spark.conf.get(_BATCH)})
        _WRITERS.append(batch_rows)
        spark.conf.set(_CLEANUP, "true")
        spark.conf.set(_BATCH, str(min(_WRITERS)))


def _end(spark: SparkSession, batch_rows: int) -> None:
    """The last writer sets them back."""
    with _LOCK:
        _WRITERS.remove(batch_rows)
        for key, value in ({_BATCH: str(min(_WRITERS))} if _WRITERS else _BEFORE).items():
            spark.conf.set(key, value)


def save(df: DataFrame, name: str, batch_rows: int = 2000, file_rows: int = 0) -> DataFrame:
    """Writes df to the shared folder and reads it again: what was computed survives lost executors.

    The table is deleted when the application ends, or by forget(). batch_rows bounds what Python workers get at a time,
    file_rows the rows of a file, for rows of some megabytes (0: no bound).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _begin(spark, batch_rows)
    try:
        (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    finally:
        _end(spark, batch_rows)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*saved: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in saved:
        place, files = _place(df.sparkSession, df.saved_at)
        files.delete(place, True)


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with numbered column names, which clash with nothing, and the numbered name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with about `limit` characters each, and their texts (null: empty). A longer text is a slice of its own."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
    begin = 0
    while begin < len(sizes):
        total, end = 0, begin
        while end < len(sizes) and (end == begin or total + sizes[end] <= limit):
            total += sizes[end]
            end += 1
        part = batch.slice(begin, end - begin)
        yield part, [t or "" for t in part.column(text).to_pylist()]
        begin = end


def coded(lists: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all items in order, the distinct items, and the items in each list."""
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    number: defaultdict = defaultdict(count().__next__)
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(counts.sum()))
    distinct = np.empty(len(number), dtype=object)
    distinct[:] = list(number)
    return codes, distinct, counts


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each run of a ragged array begins, and its end: one value more than counts has."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged_take(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[begin[i] : begin[i] + length[i]], one after the other."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(begin - starts(length)[:-1], length)
    return flat[shift + np.arange(total)]


def run_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of a ragged array; 0 for an empty run."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    at = starts(counts)
    return total[at[1:]] - total[at[:-1]]


class Remembered:
    """Ragged results of distinct words, computed once; all are forgotten when there are more than `limit` of them, or 20 values for each.

    compute(words) returns the results one after the other, and the length of each.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.compute, self.limit = compute, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.size = self.compute([])

    def get(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, begin, length): word i's result is flat[begin[i] : begin[i] + length[i]]."""
        if len(self.place) > self.limit or len(self.flat) > 20 * self.limit:
            self._clear()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, size = self.compute(words[new].tolist())
            at[new] = len(self.size) + np.arange(len(new))
            self.place.update(zip(words[new], at[new].tolist(), strict=True))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return self.flat, starts(self.size)[at], self.size[at]


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z only and takes the runs without the white space of ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well mixed bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(distinct: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings or texts, alike in every process."""
    if not len(distinct):
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)


def finder(pattern: str) -> Callable[[str], list[str]]:
    return re.compile(pattern).findall
