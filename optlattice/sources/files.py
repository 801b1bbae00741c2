"""Archives, uploads and reports."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the columns of an upload may have, and its date formats.
DATE_NAMES = ("date", "datetime", "time", "timestamp")
PNL_NAMES = ("pnl", "net_pnl", "profit", "realized_pnl")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")


def archive_members(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, member) of the members of all zip archives in a folder whose names match."""

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(p, n) for p, c in zip(part["path"], part["content"], strict=True) for n in zipfile.ZipFile(io.BytesIO(c)).namelist() if fnmatch.fnmatch(n, pattern)]
            yield pd.DataFrame(found, columns=["path", "member"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return files.select("path", "content").mapInPandas(members, "path string, member string")


def archive_rows(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """The CSV rows of all matching members, read by the tasks that hold the archives; `file_seq` orders them."""
    names = [f.split()[0] for f in schema.split(",")]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                for member in sorted(n for n in archive.namelist() if fnmatch.fnmatch(n, pattern)):
                    with archive.open(member) as f:
                        for chunk in pd.read_csv(f, chunksize=100_000):
                            yield chunk[names].assign(file_seq=f"{path}!{member}")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return files.select("path", "content").mapInPandas(rows, f"{schema}, file_seq string")


def uploaded_trades(raw: DataFrame) -> DataFrame:
    """(ts, pnl) of an uploaded table of texts, whatever the accepted names of its columns; bad rows are left out."""
    names = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    date = next((names[n] for n in DATE_NAMES if n in names), None)
    pnl = next((names[n] for n in PNL_NAMES if n in names), None)
    if date is None or pnl is None:
        raise ValueError("an upload needs a date and a profit column")
    ts = F.coalesce(*(F.try_to_timestamp(F.trim(F.col(f"`{date}`")), F.lit(f)) for f in DATE_FORMATS))
    value = F.regexp_replace(F.col(f"`{pnl}`"), r"[$,]", "").try_cast("double")
    return raw.select(ts.cast("timestamp_ntz").alias("ts"), value.alias("pnl")).where("ts is not null and pnl is not null")


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """The trades of an uploaded CSV file: UTF-8, or Latin-1 where the file isn't valid UTF-8."""
    text = spark.read.text(path)
    broken = text.where(F.col("value").contains("\ufffd")).limit(1).count() > 0
    return uploaded_trades(spark.read.options(header=True, encoding="ISO-8859-1" if broken else "UTF-8").csv(path))


def compare_dumps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two dumps has, with `side`; repeated rows count as often as they are there.

    A column that only one dump has is null in the other: rows where it holds a value differ.
    """
    kinds = {f.name: f.dataType for d in (old, new) for f in d.schema.fields}
    a, b = (d.select(*(F.col(c) if c in d.columns else F.lit(None).cast(kinds[c]).alias(c) for c in sorted(kinds))) for d in (old, new))
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def report(counts: DataFrame, form: str = "text", columns: Sequence[str] = ("flag_code", "flag_severity", "n", "n_instruments")) -> str:
    """A small table of counts (one row per flag code) as text, json or csv."""
    rows = counts.select(*columns).orderBy(*columns).toPandas()
    if form == "json":
        return rows.to_json(orient="records")
    return rows.to_csv(index=False) if form == "csv" else rows.to_string(index=False)
