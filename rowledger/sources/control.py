"""Control tables: settings, change requests, declared renames, key-count approvals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.functions.cells import strip, text, yes
from rowledger.model import TABLE_KEY, small_frame

# Column names, in the order used when a header is not recognised.
REQUEST_COLUMNS = ["change_request_id", "order", "include", "approved", "description", "notes"]
RENAME_COLUMNS = ["change_request_id", "table_name", "old_column_name", "new_column_name"]
APPROVAL_COLUMNS = ["change_request_id", "table_name", "approved"]
DEFAULTS = {
    "mode": "generate_changelog",
    "production_tables_path": "Production_Tables",
    "output_path": "Output",
    "run_id": "",
}
SETTINGS = ("working_root", *DEFAULTS)


@dataclass(frozen=True)
class Control:
    """Three frames and the run settings."""

    requests: DataFrame
    renames: DataFrame
    approvals: DataFrame
    config: dict[str, str] = field(default_factory=dict)

    def setting(self, name: str) -> str:
        return self.config.get(name) or DEFAULTS[name]


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by header, ignoring case and blanks, else by place; null where neither exists."""
    found = {c.strip().lower(): c for c in df.columns}
    columns = []
    for place, name in enumerate(names):
        source = found.get(name) or (df.columns[place] if place < len(df.columns) else None)
        value = F.col(f"`{source}`") if source else F.lit(None)
        columns.append(value.cast("string").alias(name))
    if "sheet_pos" in df.columns:
        return df.select(*columns, F.col("sheet_pos").cast("long"))
    return df.select(*columns, F.monotonically_increasing_id().alias("sheet_pos"))


def _word(name: str) -> Column:
    return F.expr(strip(text(name))).alias(name)


def _flag(name: str) -> Column:
    return F.expr(yes(name)).alias(name)


def change_requests(df: DataFrame) -> DataFrame:
    """Change requests; an order that is no whole number counts as 0."""
    return _named(df, REQUEST_COLUMNS).select(
        _word("change_request_id"),
        F.coalesce(F.col("order").try_cast("int"), F.lit(0)).alias("order"),
        _flag("include"),
        _flag("approved"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        "sheet_pos",
    ).where("change_request_id <> ''")


def column_renames(df: DataFrame) -> DataFrame:
    """Declared renames with all four fields filled."""
    renames = _named(df, RENAME_COLUMNS).select(*(_word(c) for c in RENAME_COLUMNS), "sheet_pos")
    filled = F.lit(True)
    for c in RENAME_COLUMNS:
        filled &= F.col(c) != ""
    return renames.where(filled)


def key_count_approvals(df: DataFrame) -> DataFrame:
    return _named(df, APPROVAL_COLUMNS).select(
        *(_word(c) for c in TABLE_KEY), _flag("approved"), "sheet_pos"
    ).where("change_request_id <> '' and table_name <> ''")


def make_control(
    spark: SparkSession,
    requests: DataFrame,
    renames: DataFrame | None = None,
    approvals: DataFrame | None = None,
    config: dict[str, str] | None = None,
) -> Control:
    """A control from frames in hand; renames and approvals are optional."""

    def blank(names: list[str]) -> DataFrame:
        fields = [T.StructField(n, T.StringType()) for n in names]
        return small_frame(spark, [], T.StructType([*fields, T.StructField("sheet_pos", T.LongType())]))

    return Control(
        change_requests(requests),
        column_renames(blank(RENAME_COLUMNS) if renames is None else renames),
        key_count_approvals(blank(APPROVAL_COLUMNS) if approvals is None else approvals),
        dict(config or {}),
    )


def read_control(spark: SparkSession, folder: str) -> Control:
    """Control tables as CSV files with a header, in one folder.

    ``config.csv`` and ``change_requests.csv`` are required.
    """

    def read(name: str, required: bool = False, header: bool = True) -> DataFrame | None:
        try:
            return spark.read.csv(f"{folder}/{name}.csv", header=header, quote='"', escape='"', multiLine=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            if required:
                raise ValueError(f"Control is missing the required table {name}") from None
            return None

    settings = read("config", required=True, header=False)
    # the settings that exist, read by the driver because they steer the run; of repeated ones the last counts
    names = [F.lit(name) for name in SETTINGS]
    key, value = (F.expr(strip(text(f"`{c}`"))) for c in settings.columns[:2])
    known = settings.select(key.alias("name"), value.alias("value"), F.col(settings.columns[1]).isNotNull().alias("given"), F.monotonically_increasing_id().alias("nth"))
    last = known.where("given").where(F.col("name").isin(*names)).groupBy("name").agg(F.max_by("value", "nth").alias("value"))
    config = {r["name"]: r["value"] for r in last.collect()}
    return make_control(
        spark, read("change_requests", required=True), read("column_renames"), read("key_count_approvals"), config
    )


def included_requests(requests: DataFrame, require_approved: bool = False) -> DataFrame:
    """Requests that take part; their order is (``order``, ``sheet_pos``)."""
    chosen = requests.where("include")
    return chosen.where("approved") if require_approved else chosen


def request_steps(requests: DataFrame, require_approved: bool = False) -> DataFrame:
    """Taking-part requests numbered 1, 2, ... in their order. Meant for the short request list."""
    ranked = F.array_sort(F.collect_list(F.struct("order", "sheet_pos", "change_request_id", "description")))
    return (
        included_requests(requests, require_approved).agg(ranked.alias("ranked"))
        .select(F.posexplode("ranked").alias("nth", "r"))
        .select("r.change_request_id", "r.description", (F.col("nth") + 1).alias("step"))
    )


def key_count_approved(groups: DataFrame, control: Control) -> DataFrame:
    """Approval of key-count changes: first table entry, else the request's own flag, else no."""
    listed = control.approvals.groupBy(*TABLE_KEY).agg(F.min_by("approved", "sheet_pos").alias("listed"))
    own = control.requests.groupBy("change_request_id").agg(F.min_by("approved", "sheet_pos").alias("own"))
    approved = F.coalesce("listed", "own", F.lit(False)).alias("approved")
    return (
        groups.join(listed, TABLE_KEY, "left").join(own, ["change_request_id"], "left")
        .select(*[groups[c] for c in groups.columns if c not in TABLE_KEY], *TABLE_KEY, approved)
    )
