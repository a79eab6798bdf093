"""Per-request summary of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.operators.pairs import BEFORE_ONLY

SUMMARY_COLUMNS = [
    "change_request_id", "description", "tables_touched", "n_value_changes", "n_row_adds", "n_row_deletes",
    "n_column_changes", "n_key_count_changes", "has_conflict", "status",
]
# Which change types each count covers.
COUNTED = {
    "n_value_changes": ("value_update",),
    "n_row_adds": ("row_add",),
    "n_row_deletes": ("row_delete",),
    "n_column_changes": ("column_add", "column_delete", "column_rename"),
    "n_key_count_changes": ("key_count_change",),
}


def _count(types: tuple[str, ...]) -> Column:
    return F.sum(F.when(F.col("change_type").isin(*types), F.col("copies")).otherwise(0))


def summarize(log: DataFrame, pairs: DataFrame, steps: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Counts, touched tables and status of every taking-part request."""
    counts = log.groupBy("change_request_id").agg(*(_count(t).alias(name) for name, t in COUNTED.items()))
    touched = F.when(F.col("kind") != BEFORE_ONLY, F.col("table_name"))
    tables = pairs.groupBy("change_request_id").agg(F.array_sort(F.collect_set(touched)).alias("touched"))
    conflicted = conflicts.select(F.explode("change_request_ids").alias("change_request_id")).distinct()
    status = (
        F.when(F.col("touched").isNull(), "EMPTY")
        .when(F.size("touched") == 0, "NO_CHANGES")
        .when(F.col("conflicted"), "CONFLICT")
        .otherwise("OK")
    )
    return (
        steps.join(counts, ["change_request_id"], "left")
        .join(tables, ["change_request_id"], "left")
        .join(conflicted.withColumn("conflicted", F.lit(True)), ["change_request_id"], "left")
        .select(
            "change_request_id", "description",
            F.coalesce(F.array_join("touched", ", "), F.lit("")).alias("tables_touched"),
            *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in COUNTED),
            F.when(F.col("conflicted"), "Y").otherwise("N").alias("has_conflict"),
            status.alias("status"),
        )
    )
