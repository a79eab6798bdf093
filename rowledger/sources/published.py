"""Sets of table files that change in one step.

A set is a folder with ``_runs/<version>`` (hidden from plain listings), the files that a run wrote, and ``manifests/version=<version>``, a list of all
tables of the set with the folder that holds each. A run writes its files first and its list last, in one file that
says how many tables it names. Readers take the newest list that is whole, so a run that dies on its way leaves the
set as it was. Tables that a run doesn't change are named with the folder they are in; they are neither read nor written.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.model import TableSet
from rowledger.storage import write_once

MANIFESTS, RUNS = "manifests", "_runs"
SCHEMA = "table_name string, suffix string, root string, n_tables long, version string"


def _absolute(folder: str) -> str:
    return folder.rstrip("/") if "://" in folder else os.path.abspath(folder)


def publish(write: Callable[[TableSet, str], None], changed: TableSet, kept: DataFrame, folder: str) -> int:
    """Add a version to the set in ``folder`` and return its number of tables.

    ``write`` writes a table set to a folder. ``kept`` has (table_name, suffix, root) of the tables that stay as they
    are; changed ones of the same name replace them. Versions are ordered by the clock.
    """
    spark = changed.spark
    version = f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    run = f"{RUNS}/{version}"
    named = write_once(changed.meta.select("table_name", "suffix", F.lit(run).alias("root")), "changed-tables")
    if not named.isEmpty():
        write(changed, f"{folder}/{run}")
    # a row per table
    tables = write_once(named.unionByName(kept.select("table_name", "suffix", "root").join(named.select("table_name"), ["table_name"], "left_anti")), "manifest")
    n_tables = tables.count()
    publish_manifest(tables, folder, version, n_tables)
    return n_tables


def publish_manifest(tables: DataFrame, folder: str, version: str, n_tables: int) -> None:
    """The last step of a run."""
    listed = tables.select("*", F.lit(n_tables).cast("long").alias("n_tables"), F.lit(version).alias("version"))
    listed.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{folder}/{MANIFESTS}")


def newest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(table_name, suffix, root) of the newest whole version, or None if the folder is no such set."""
    try:
        listed = spark.read.schema(SCHEMA).parquet(f"{folder}/{MANIFESTS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    whole = listed.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.max("n_tables").alias("n_tables")).where("n = n_tables")
    version = whole.agg(F.max("version")).first()[0]
    if version is None:
        return None
    inside = F.concat(F.lit(f"{_absolute(folder)}/"), F.col("root"))
    root = F.when(F.col("root").startswith(f"{RUNS}/"), inside).otherwise(F.col("root"))
    return listed.where(F.col("version") == version).select("table_name", "suffix", root.alias("root"))


def kept_tables(files: DataFrame) -> DataFrame:
    """(table_name, suffix, root) of the listed files."""
    return files.select("table_name", "suffix", "root").distinct()


def roots_of(spark: SparkSession, folder: str) -> tuple[list[str], DataFrame | None]:
    """The folders that hold the set's files, one per run that still has a table in it, and the list of tables."""
    tables = newest(spark, folder)
    if tables is None:
        return [_absolute(folder)], None
    tables = write_once(tables, "published")
    return sorted(r["root"] for r in tables.select("root").distinct().collect()), tables
