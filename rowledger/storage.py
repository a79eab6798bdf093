"""Written intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_folder: str | None = None


def work_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local sessions without any."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="rowledger-")
    return _local_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/rowledger/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives executors, runs shared work once, and gives
    the optimizer the true size, so it alone decides whether a join side may be broadcast.
    """
    return write_once_observed(df, name)[0]


def write_once_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates taken on the way as in ``write_observed``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    facts = write_observed(df, path, **metrics) if metrics else df.write.parquet(path) or {}
    return spark.read.schema(df.schema).parquet(path), facts


def write_observed(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write ``df`` to ``path`` and return aggregates over it, taken while its rows pass on their way to the files.

    The aggregates sit right under the write, in tasks whose results count once however often they run.
    """
    seen = Observation()
    df.observe(seen, *(m.alias(name) for name, m in metrics.items())).write.mode("overwrite").parquet(path)
    found = seen.get
    return {name: found.get(name) for name in metrics}
