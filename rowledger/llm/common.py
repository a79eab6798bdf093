"""Reading, written intermediate tables and sizes, shared by the operators of this folder."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowledger.storage import new_path, write_once

__all__ = ["documents", "held_out", "new_path", "partitions_for", "ranked", "table", "write_once"]

RANKED_ROWS = 2_000_000  # rows that one task sorts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for the fold that no model may learn from; rows without an id are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def partitions_for(spark: SparkSession, units: int, unit_size: int) -> int:
    """Tasks for ``units`` of work, at most ``unit_size`` each, and never fewer than the session deals out."""
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-units // unit_size))


def either(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """All rows with their place in the order, counted from 0 over the whole table; ``rows`` is a written table.

    Ranges of the order are sorted each in a task and written, so that places don't change when a task is repeated; then
    each range begins where the ones before it end. Rows must be told apart by the order, else many equal ones
    stay in one range.
    """
    spark = rows.sparkSession
    parts = partitions_for(spark, rows.count(), RANKED_ROWS)
    # the number of a row within its task stands in the low 33 bits of the increasing id
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = write_once(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("range_part"), place.alias("range_place")),
        "ranges",
    )
    # a row per range
    sizes = dealt.groupBy("range_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("range_part", before.alias("range_begin"))
    return (
        dealt.join(F.broadcast(begins), "range_part").withColumn(rank, F.col("range_begin") + F.col("range_place"))
        .drop("range_part", "range_place", "range_begin")
    )
