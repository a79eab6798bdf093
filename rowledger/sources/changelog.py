"""Change logs, conflicts, reports and audit records as files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.functions.cells import literal, strip, text
from rowledger.model import LOG_COLUMNS, POSITION, small_frame
from rowledger.operators.conflicts import CONFLICT_COLUMNS, flat_conflicts
from rowledger.operators.diff import CROWDED_NOTE
from rowledger.storage import write_observed

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}
# rows of a CSV file of the log; cells may hold line ends, so one task reads a whole file
FILE_ROWS = 100_000
SEQUENCE = f"struct<old:{POSITION.simpleString()},new:{POSITION.simpleString()}>"


def write_log(log: DataFrame, folder: str) -> dict:
    """The log as parquet, which later stages read, and as CSV for people. Returns what is on record of it."""
    facts = write_observed(log, f"{folder}/log", **log_facts())
    export_log(log.sparkSession.read.parquet(f"{folder}/log"), f"{folder}/detail_csv")
    return facts


def export_log(log: DataFrame, path: str) -> None:
    """The ten columns as CSV, then ``copies`` and the order ``seq``; unknown key counts are empty."""
    counts = {"n_keys_before", "n_keys_after"}
    columns = [F.expr(f"coalesce(cast({c} as string), '')").alias(c) if c in counts else F.col(c) for c in LOG_COLUMNS]
    extra = ["coalesce(cast(copies as string), '') as copies", "coalesce(to_json(seq), '') as seq"]
    log.select(*columns, *map(F.expr, extra)).write.options(**CSV_OPTIONS, emptyValue="", maxRecordsPerFile=FILE_ROWS).mode("overwrite").csv(path)


def normalize_log(df: DataFrame) -> DataFrame:
    """Any frame with the ten columns as a change log; its order is the frame's ``seq`` if it has one."""
    have = set(df.columns)
    trimmed = {"change_request_id", "table_name", "change_type"}
    counts = {"n_keys_before", "n_keys_after"}

    def column(c: str) -> str:
        if c not in have:
            return f"cast(null as int) as {c}" if c in counts else f"'' as {c}"
        if c in counts:
            return f"try_cast({c} as int) as {c}"
        if c in trimmed:
            return f"{strip(text(c))} as {c}"
        if c in ("old_value", "new_value") and "copies" in have:
            return c
        return f"{text(f'cast({c} as string)')} as {c}"

    seq = "seq" if "seq" in have else f"cast(null as {SEQUENCE}) as seq"
    copies = "copies" if "copies" in have else "1L as copies"
    return df.selectExpr(*(column(c) for c in LOG_COLUMNS), seq, copies).where("change_request_id <> ''")


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """A change log kept as quoted CSV with a header.

    Without the columns ``copies`` and ``seq`` every row counts once, and the file position gives
    the order. Of a repeated key, rows that count nothing hold an old value only, others a new one.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*LOG_COLUMNS, "copies", "seq"]])
    raw = spark.read.options(**CSV_OPTIONS, multiLine=True).schema(schema).csv(path)
    position = f"cast(struct(_metadata.file_name, _metadata.file_block_start, monotonically_increasing_id()) as {POSITION.simpleString()})"
    apart = f"notes = {literal(CROWDED_NOTE)}"
    values = {
        "old_value": f"if({apart} and try_cast(copies as bigint) > 0, null, coalesce(old_value, ''))",
        "new_value": f"if({apart} and try_cast(copies as bigint) = 0, null, coalesce(new_value, ''))",
        "copies": "coalesce(try_cast(copies as bigint), 1)",
        "seq": f"coalesce(from_json(seq, '{SEQUENCE}'), cast(struct(null as old, {position} as new) as {SEQUENCE}))",
    }
    return normalize_log(raw.withColumns({c: F.expr(e) for c, e in values.items()}))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """A change log written by ``write_log``, or a CSV one."""
    if folder.endswith(".csv"):
        return read_log_csv(spark, folder)
    return normalize_log(spark.read.parquet(f"{folder}/log"))


def write_conflicts(conflicts: DataFrame, folder: str) -> dict:
    """Conflicts as parquet, and as a CSV in which people mark them resolved. Returns their number."""
    facts = write_observed(conflicts, f"{folder}/conflicts", n_conflicts=F.count("*"))
    written = conflicts.sparkSession.read.parquet(f"{folder}/conflicts")
    flat_conflicts(written).write.options(**CSV_OPTIONS, emptyValue="").mode("overwrite").csv(f"{folder}/conflicts_csv")
    return facts


def parse_conflicts(df: DataFrame) -> DataFrame:
    """Conflict records with their request ids as a list; blank records are dropped."""
    ids = f"filter(transform(split({text('change_request_ids')}, ','), x -> {strip('x')}), x -> x <> '')"
    fields = ("conflict_type", "table_name", "key_tuple", "column_name", "notes")
    return df.dropna("all").selectExpr(
        *(f"{text(c)} as {c}" for c in fields), f"{ids} as change_request_ids", "coalesce(resolved, 'N') as resolved"
    )


def read_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts as people left them; a log without a conflict table has none."""
    try:
        df = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(f"{folder}/conflicts_csv")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = [T.StructField(c, T.StringType()) for c in CONFLICT_COLUMNS]
        df = small_frame(spark, [], T.StructType(fields))
    return parse_conflicts(df)


def hash_of_rows(columns: list[str]) -> Column:
    """Aggregate: hash of a table's rows with their numbers, whatever their order.

    Every row becomes one text, each cell led by its length, so that no two rows share it. The four parts of its
    MD5 sum are added up over all rows, each apart.
    """
    cells = [F.coalesce(F.concat(F.length(text_of).cast("string"), F.lit(":"), text_of), F.lit("-")) for text_of in (F.col(c).cast("string") for c in columns)]
    digest = F.md5(F.concat(*cells))
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").cast("decimal(20,0)") for i in range(4)]
    return F.concat_ws("-", *(F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts))


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive hash of all rows."""
    return df.agg(F.count("*").alias("n_rows"), hash_of_rows(df.columns).alias("content_hash"))


def log_facts() -> dict[str, Column]:
    """What is on record of a change log: rows, rows with their copies, tables named in it, and its hash.

    The set of table names is as large as the list of tables.
    """
    return {
        "n_rows": F.count("*"), "n_change_rows": F.coalesce(F.sum("copies"), F.lit(0)),
        "tables_affected": F.size(F.collect_set("table_name")), "content_hash": hash_of_rows(LOG_COLUMNS),
    }


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def latest_change_log(runs: DataFrame) -> DataFrame:
    """Path of the newest change log in a listing with ``path`` and ``modified``."""
    return runs.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
