"""Tables that grow by small batches: sorted into buckets, merged by key, folded from time to time.

Every batch adds one run. Runs of a level are folded into one run of the next level once
there are `fan` of them, so a row is rewritten as often as there are levels and a reader sees
few runs. What rows of a key become is the table's `merge`: the newest version, or a sum.
A batch that looks up keys reads their buckets only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..session import stored_small

Merge = Callable[[DataFrame], DataFrame]
BUCKETS, FAN = 16, 8
_NAME = re.compile(r"run=(\d+)-(\d+)-(\d+)")


def newest(*keys: str) -> Merge:
    """Rows of a key's last batch; a key may have many rows, which are not shuffled while the keys are few."""
    def merge(rows: DataFrame) -> DataFrame:
        last = stored_small(rows.groupBy(*keys).agg(F.max("batch").alias("batch")), "newest")
        return rows.join(last, [*keys, "batch"], "left_semi").select(*rows.columns)

    return merge


def folded(keys: list[str], **how: str) -> Merge:
    """One row per key; every other column by its aggregate (sum, min, max)."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.call_function(f, F.col(c)).alias(c) for c, f in how.items()])

    return merge


def every_row(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True, order=True)
class Run:
    """Batches `first` to `last`; a run that is inside another one has been folded into it."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run={self.level}-{self.first}-{self.last}"

    def inside(self, other: Run) -> bool:
        return other.level > self.level and other.first <= self.first and self.last <= other.last


class RunTable:
    """A table of runs in a folder that all executors share.

    A batch may be written again (a replay); it is folded only after a later batch has begun.
    A run counts once its writer has committed it. Folded runs stay until the next fold, so a
    reader that has listed them can finish. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, merge: Merge, bucket_by: str, buckets: int = BUCKETS, fan: int = FAN) -> None:
        self.spark, self.path, self.merge, self.bucket_by, self.buckets, self.fan = spark, path.rstrip("/"), merge, bucket_by, buckets, fan
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), path, folder

    def _finished(self) -> list[Run]:
        files, path, folder = self._files()
        if not files.exists(folder):
            return []
        found = [_NAME.fullmatch(s.getPath().getName()) for s in files.listStatus(folder)]
        return sorted(Run(*map(int, m.groups())) for m in found if m and files.exists(path(f"{self.path}/{m[0]}/_SUCCESS")))

    def runs(self) -> list[Run]:
        """Committed runs that are not inside another one."""
        every = self._finished()
        return [r for r in every if not any(r.inside(o) for o in every)]

    def bucket(self, key: str | None = None):
        return F.pmod(F.xxhash64(key or self.bucket_by), F.lit(self.buckets)).cast("int")

    def _union(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        schema = StructType([*self.schema.fields, StructField("run", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{r.name}" for r in runs]).drop("run")

    def read(self, touched: DataFrame | None = None, key: str | None = None, before: int | None = None) -> DataFrame:
        """Merged rows; with `touched` only those in the buckets of its keys, with `before` only of earlier batches."""
        rows = self._union([r for r in self.runs() if before is None or r.last < before])
        if touched is not None:
            wanted = [r["b"] for r in touched.select(self.bucket(key).alias("b")).distinct().collect()]  # at most `buckets` numbers
            rows = rows.filter(F.col("bucket").isin(wanted))
        return self.merge(rows.drop("bucket"))

    def batch(self, number: int) -> DataFrame:
        """What one batch has added, as long as it is not folded."""
        return self._union([Run(0, number, number)]).drop("bucket")

    def _write(self, rows: DataFrame, run: Run) -> None:
        """A batch's rows get its number where the table keeps one; folded rows have theirs."""
        if "batch" in self.schema.names and "batch" not in rows.columns:
            rows = rows.withColumn("batch", F.lit(run.last).cast("bigint"))
        rows = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        rows.repartition("bucket").sortWithinPartitions("bucket", self.bucket_by).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{run.name}", compression="zstd")

    def add(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch, then a fold where enough earlier runs have gathered."""
        self._write(rows, Run(0, batch, batch))
        self.fold(batch)

    def fold(self, before: int) -> None:
        """Fold the runs of every level that has `fan` of them, of batches before `before`; drop what earlier folds replaced."""
        files, path, _ = self._files()
        every = self._finished()
        spent = [r for r in every if any(r.inside(o) for o in every)]
        level = 0
        while True:
            runs = self.runs()
            here = [r for r in runs if r.level == level and r.last < before]
            if len(here) >= self.fan:
                if spent:
                    for r in spent:
                        files.delete(path(f"{self.path}/{r.name}"), True)
                    spent = []
                self._write(self.merge(self._union(here).drop("bucket")), Run(level + 1, here[0].first, here[-1].last))
            elif not any(r.level > level for r in runs):
                return
            level += 1
