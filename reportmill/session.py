"""Session helpers: shared scratch location and size-checked small sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "reportmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Only a local session may fall back to a folder of its own; on a cluster an unset
    folder is an error, since executors cannot read each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="reportmill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a result used several times to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, path: str, **counts: Column) -> dict[str, int]:
    """Write rows and return aggregates of what was written, from the same pass over them.

    They are observed on the writing stage itself, whose tasks count once however often they run.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite").parquet(path)
    return {n: seen.get[n] for n in counts}


def within(df: DataFrame, max_rows: int) -> bool:
    """Size check for a side one means to broadcast: reads at most max_rows + 1 rows."""
    return df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= max_rows


def sized(df: DataFrame, few: bool) -> DataFrame:
    """One side of a join whose rows were counted: Spark may send few to all tasks, many are joined by shuffle.

    Spark itself goes by the bytes of the files behind it, packed, and by no rows that later steps add.
    """
    return df if few else df.hint("merge")


def stored_small(df: DataFrame, name: str, max_rows: int = 100_000) -> DataFrame:
    """A few computed rows for a join with a large table: stored, and sent to all tasks as long as they are few."""
    stored = materialise(df, name)
    return F.broadcast(stored) if within(stored, max_rows) else stored


def beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row results side by side, each as one scalar subquery instead of a join."""
    one = [o.select(F.struct(*o.columns)).scalar().alias(f"_row{i}") for i, o in enumerate(others)]
    parts = [F.col(f"_row{i}.{c}").alias(c) for i, o in enumerate(others) for c in o.columns]
    return row.select("*", *one).select(*row.columns, *parts)
