"""Results that are kept until the tables that they come from change."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def files_of(table: DataFrame) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change) of all files that a table is read from: their list tells of every change, and nothing in them is read."""
    out = []
    for name in table.inputFiles():
        place, files = _place(table.sparkSession, name)
        status = files.getFileStatus(place)
        out.append((name, status.getLen(), status.getModificationTime()))
    return sorted(out)


class ResultCache:
    """Results in a folder that all executors see, by name and by the files of the tables behind them.

    Rows are stored in files that never change: adding, removing or changing one gives other files, so any change counts, unlike in
    a fingerprint of counts and sums. A result that is found is read from the folder, and its tables aren't. A new one
    takes the place of the older ones of its name and parameters.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, name: str, tables: Sequence[DataFrame], compute: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The result of compute() over the tables; parameters are what else it depends on. Tables without files can't be told apart and are an error."""
        listed = [files_of(t) for t in tables]
        if not all(listed):
            raise ValueError("only results of stored tables are kept")
        said = json.dumps(parameters, sort_keys=True, default=str)
        home = f"{self.folder}/{name}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"
        path = f"{home}/{hashlib.sha256(json.dumps(listed).encode()).hexdigest()}"
        done, files = _place(self.spark, f"{path}/_SUCCESS")
        if not files.exists(done):
            compute().write.mode("overwrite").parquet(path)
            for other in files.listStatus(_place(self.spark, home)[0]):
                if other.getPath().getName() != path.rsplit("/", 1)[1]:
                    files.delete(other.getPath(), True)
        return self.spark.read.parquet(path)

    def forget(self, name: str) -> None:
        """Drops all results of a name, whatever their parameters."""
        home, files = _place(self.spark, self.folder)
        if files.exists(home):
            for found in files.listStatus(home):
                if found.getPath().getName().rsplit("-", 1)[0] == name:
                    files.delete(found.getPath(), True)
