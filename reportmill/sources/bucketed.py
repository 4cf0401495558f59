"""Tables in buckets by key, upserted bucket by bucket.

An upsert reads and writes the buckets that its new rows fall into; all other buckets keep
their files. The new rows are sent to where the old ones are while they are few, so the stored
table is never shuffled; more of them are joined by shuffle with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import within

BUCKETS = 64
#: New rows that may be sent to all tasks.
MAX_SENT = 100_000


class BucketTable:
    """Rows by the hash of `keys` in a folder that all executors share. One writer at a time.

    An upsert replaces whole buckets when its job commits; until then readers see the old ones.
    Null keys are equal to each other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Write the whole table, one file or few per bucket."""
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def touched(self, new: DataFrame) -> DataFrame:
        """Stored rows of the buckets that the new rows fall into."""
        numbers = [r["b"] for r in new.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        return self._stored().filter(F.col("bucket").isin(numbers))

    def _sent(self, new: DataFrame) -> DataFrame:
        return F.broadcast(new) if within(new, MAX_SENT) else new

    def _same(self, old: DataFrame, new: DataFrame) -> Column:
        test = F.lit(True)
        for k in self.keys:
            test = test & old[k].eqNullSafe(new[f"new_{k}"])
        return test

    def _added(self, new: DataFrame) -> DataFrame:
        return new.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket")

    def replaced(self, new: DataFrame) -> DataFrame:
        """Touched buckets with all rows of a new key replaced; a key may have many rows."""
        old = self.touched(new)
        keys = self._sent(new.select(*[F.col(k).alias(f"new_{k}") for k in self.keys]).distinct())
        return old.join(keys, self._same(old, keys), "left_anti").select(*self.schema.names, "bucket").unionByName(self._added(new))

    def merged(self, new: DataFrame, updates: list[str], take: Callable[[Column, Column], Column], by: str) -> DataFrame:
        """Touched buckets where `updates` of a known key come from its new row if take(old by, new by); unknown keys are added.

        `new` has one row per key.
        """
        old = self.touched(new)
        sent = self._sent(new.select(*[F.col(c).alias(f"new_{c}") for c in dict.fromkeys([*self.keys, *updates, by])], F.lit(True).alias("new_here")))
        both = old.join(sent, self._same(old, sent), "left")
        better = F.coalesce(F.col("new_here") & take(F.col(by), F.col(f"new_{by}")), F.lit(False))
        kept = both.select(*[F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in self.schema.names], "bucket")
        known = old.join(sent, self._same(old, sent), "left_semi").select(*[F.col(k).alias(f"new_{k}") for k in self.keys])
        absent = new.join(F.broadcast(known) if within(new, MAX_SENT) else known, self._same(new, known), "left_anti")
        return kept.unionByName(self._added(absent))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def replace(self, new: DataFrame) -> None:
        self._write(self.replaced(new))

    def merge(self, new: DataFrame, updates: list[str], take: Callable[[Column, Column], Column], by: str) -> None:
        self._write(self.merged(new, updates, take, by))
