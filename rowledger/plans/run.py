"""The two runs: generate a change log, and validate or apply it.

A run writes its results once and derives everything else from the written log.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.model import TABLE_KEY, TableSet
from rowledger.operators.apply import changed_tables, with_untouched
from rowledger.operators.conflicts import Conflicts, detect_conflicts
from rowledger.operators.diff import Diff, diff_tables
from rowledger.operators.review import Review, build_review
from rowledger.operators.summary import summarize
from rowledger.operators.validate import approved_log, conflict_messages, message, unresolved_conflicts, validate
from rowledger.sources.changelog import (
    file_hashes, log_facts, read_conflicts, read_log, write_conflicts, write_log,
)
from rowledger.sources.control import Control, read_control, request_steps
from rowledger.sources.marker import scan_tables, write_tables
from rowledger.sources.published import kept_tables, publish
from rowledger.storage import write_observed, write_once, write_once_observed

MODES = ("validate_only", "apply")
SUCCESS, FAILED, DRY_RUN = "SUCCESS", "FAILED", "DRY_RUN_SUCCESS"


@dataclass(frozen=True)
class ChangeLog:
    """Everything one comparison yields. ``log`` is written already."""

    diff: Diff
    log: DataFrame
    conflicts: Conflicts
    summary: DataFrame
    review: Review
    warnings: DataFrame


@dataclass(frozen=True)
class Integration:
    """``tables`` is the whole set and ``changed`` what of it the log names; ``approved`` is what is on record of the log."""

    status: str
    messages: DataFrame
    tables: TableSet | None
    approved: dict
    changed: TableSet | None = None


def compare(before: TableSet, after: TableSet, control: Control) -> ChangeLog:
    """Stage 1 on table sets: change log, conflicts, summary, review, warnings."""
    spark = before.spark
    steps = write_once(request_steps(control.requests), "steps")
    before = _of_requests(before, steps)
    after = _of_requests(after, steps)
    diff = diff_tables(before, after, control.renames)
    failed = diff.errors.take(1)
    if failed:
        raise ValueError(f"{failed[0]['table_name']}: {failed[0]['message']}")
    log = write_once(diff.log, "log")
    found = detect_conflicts(log, steps)
    conflicts = Conflicts(write_once(found.conflicts, "conflicts"), found.values)
    summary = summarize(log, diff.pairs, steps, conflicts.conflicts)
    empty = summary.where("status = 'EMPTY'").selectExpr(
        "change_request_id", "'' as table_name",
        "format_string('[%s] Empty change request folder (no CSVs in before/ or after/).', change_request_id) as message",
    )
    review = build_review(before, after, diff.pairs, log, steps)
    return ChangeLog(diff, log, conflicts, summary, review, diff.warnings.unionByName(empty))


def _of_requests(tables: TableSet, steps: DataFrame) -> TableSet:
    ids = steps.select("change_request_id")
    return TableSet(
        *(d.join(ids, ["change_request_id"], "left_semi") for d in (tables.meta, tables.rows, tables.dummies))
    )


def integrate(
    log: DataFrame, conflicts: DataFrame, production: TableSet, control: Control, mode: str
) -> Integration:
    """Stage 2 on frames: validate the approved log and, in mode ``apply``, apply it.

    Two counts decide: open conflicts stop ``apply``, failures stop every mode.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be 'validate_only' or 'apply', got {mode!r}")
    steps = write_once(request_steps(control.requests, require_approved=True), "approved-steps")
    approved, facts = write_once_observed(approved_log(log, steps), "approved-log", **log_facts())
    open_conflicts = write_once(conflict_messages(unresolved_conflicts(conflicts, steps)), "open-conflicts")
    if mode == "apply" and not open_conflicts.isEmpty():
        return Integration(FAILED, open_conflicts, None, facts)
    checks = write_once(validate(approved, production, control), "checks")
    messages = open_conflicts.unionByName(checks)
    if not checks.where("severity = 'FAIL'").isEmpty():
        return Integration(FAILED, messages, None, facts)
    if mode == "validate_only":
        note = F.lit("Validation passed (dry-run); no tables written.")
        return Integration(DRY_RUN, messages.unionByName(_note(log.sparkSession, "summary", note)), None, facts)
    applied = approved.groupBy(*TABLE_KEY).agg(F.sum("copies").alias("n"))
    notes = message(
        applied, "apply", F.format_string("Applied %d change row(s).", "n"), "INFO", **{c: c for c in TABLE_KEY}
    )
    changed = changed_tables(production, approved)
    return Integration(SUCCESS, messages.unionByName(notes), with_untouched(production, changed), facts, changed)


def _note(spark: SparkSession, section: str, text) -> DataFrame:
    return message(spark.range(1), section, text, "INFO")


def report(messages: DataFrame, status: str, mode: str) -> DataFrame:
    """Report rows carry the run's status and mode."""
    return messages.withColumn("status", F.lit(status)).withColumn("mode", F.lit(mode))


def report_totals(report_rows: DataFrame, status: str, mode: str) -> DataFrame:
    return report_rows.agg(
        F.lit(status).alias("status"), F.lit(mode).alias("mode"),
        F.count("*").alias("n_messages"), F.count_if(F.col("severity") == "FAIL").alias("n_failures"),
    )


def facts_frame(spark: SparkSession, facts: dict) -> DataFrame:
    """One row of facts that a write observed."""
    return spark.range(1).select(*(F.lit(value).alias(name) for name, value in facts.items()))


def audit_record(run_id: str, mode: str, status: str, facts: DataFrame) -> DataFrame:
    """One audit row; ``facts`` holds one row of run-specific values."""
    return facts.select(
        F.current_timestamp().alias("timestamp"), F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"),
        F.to_json(F.struct(*facts.columns)).alias("facts"), F.lit(status).alias("final_status"),
    )


def _write_audit(facts: DataFrame, output: str, run_id: str, mode: str, status: str) -> None:
    audit_record(run_id, mode, status, facts).write.mode("append").parquet(f"{output}/Audit")


def _one_row(spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """One row with, per name, the rows of a small frame as a list of structs."""
    lists = [
        df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("v")).select(F.lit(name).alias("k"), F.to_json("v").alias("v"))
        for name, df in frames.items()
    ]
    stacked = lists[0]
    for part in lists[1:]:
        stacked = stacked.unionByName(part)
    return stacked.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("facts"))


def _path(root: str, given: str) -> str:
    return given if "://" in given or given.startswith("/") else f"{root}/{given}"


def _roots(control: Control, folder: str) -> tuple[str, str]:
    root = _path(folder, control.config.get("working_root") or folder)
    return root, _path(root, control.setting("output_path"))


def _run_id(spark: SparkSession, control: Control) -> str:
    now = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    return control.setting("run_id") or spark.range(1).select(now).first()[0]


def _hashes(spark: SparkSession, control_folder: str) -> DataFrame:
    return file_hashes(spark, control_folder + "/*.csv")


def generate_change_log(spark: SparkSession, control_folder: str) -> str:
    """Stage 1. Compares ``ChangeRequests/<id>/before`` and ``after`` of every included request.

    Returns the folder ``ChangeLog_<run id>`` with ``log``, ``detail_csv``, ``summary``,
    ``conflicts``, ``conflicts_csv``, ``conflict_values``, ``review_*`` and ``warnings``.
    """
    control = read_control(spark, control_folder)
    root, output = _roots(control, control_folder)
    run_id = _run_id(spark, control)
    try:
        return _change_log(spark, control, control_folder, root, output, run_id)
    except Exception as error:
        facts = _one_row(
            spark, control_hashes=_hashes(spark, control_folder),
            change_requests=request_steps(control.requests).select("step", "change_request_id"),
            error=spark.range(1).select(F.lit(str(error)).alias("message")),
        )
        _write_audit(facts, output, run_id, "generate_changelog", FAILED)
        raise


def _change_log(
    spark: SparkSession, control: Control, control_folder: str, root: str, output: str, run_id: str
) -> str:
    included = request_steps(control.requests)
    # a row per change request
    ids = [r["change_request_id"] for r in included.select("change_request_id").collect()]
    scan = scan_tables(spark, f"{root}/ChangeRequests", path_fields=True, requests=ids)
    # vanished tables are not compared, so only tables of the new side can fail
    broken = scan.errors.join(included, ["change_request_id"], "left_semi")
    after_files = scan.files.where("side = 'after'").select(*TABLE_KEY)
    broken = broken.join(after_files, TABLE_KEY, "left_semi").take(1)
    if broken:
        raise ValueError(broken[0]["message"])
    out = f"{output}/ChangeLog_{run_id}"
    found = compare(_with_lost_tables(scan, "before"), scan.after, control)
    log = write_log(found.log, out)
    conflicts = write_conflicts(found.conflicts.conflicts, out)
    found.conflicts.values.write.mode("overwrite").parquet(f"{out}/conflict_values")
    found.summary.write.mode("overwrite").parquet(f"{out}/summary")
    warnings = write_observed(found.warnings, f"{out}/warnings", n_warnings=F.count("*"))
    found.review.columns.write.mode("overwrite").parquet(f"{out}/review_columns")
    found.review.notes.write.mode("overwrite").parquet(f"{out}/review_notes")
    found.review.grid.write.mode("overwrite").parquet(f"{out}/review_grid")
    facts = _one_row(
        spark, control_hashes=_hashes(spark, control_folder), change_requests=included.select("step", "change_request_id"),
        change_log=facts_frame(spark, log), conflicts=facts_frame(spark, conflicts), warnings=facts_frame(spark, warnings),
    )
    _write_audit(facts, output, run_id, "generate_changelog", SUCCESS)
    return out


def _with_lost_tables(scan, side: str) -> TableSet:
    """Old tables that cannot be read but have no new side still count as vanished."""
    tables = scan.before
    listed = scan.files.where(F.col("side") == side).select(*TABLE_KEY, "suffix").distinct()
    lost = listed.join(tables.meta.select(*TABLE_KEY), TABLE_KEY, "left_anti").selectExpr(
        *TABLE_KEY, "1 as n_keys", "cast(array() as array<string>) as columns", "suffix",
        "cast(null as string) as encoding", "cast(null as string) as source_path",
    )
    return tables.with_tables(meta=tables.meta.unionByName(lost))


def export_tables(spark: SparkSession, published: str, folder: str) -> None:
    """Write every table of a set as plain text files, whichever run wrote it."""
    write_tables(scan_tables(spark, published).tables, folder)


def integrate_changes(spark: SparkSession, control_folder: str, change_log: str, mode: str) -> str:
    """Stage 2. Returns the folder ``IntegrationReport_<run id>`` with ``report`` and ``totals``.

    In mode ``apply``, and only if nothing failed, ``New_Production_Tables`` gets a new version (see ``published``), which
    ``export_tables`` copies to plain files.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be 'validate_only' or 'apply', got {mode!r}")
    control = read_control(spark, control_folder)
    root, output = _roots(control, control_folder)
    run_id = _run_id(spark, control)
    out = f"{output}/IntegrationReport_{run_id}"
    status, messages, n_tables = FAILED, message(spark.range(0), "error", F.lit(""), "FAIL"), 0
    approved = None
    try:
        log = read_log(spark, change_log)
        conflicts = read_conflicts(spark, change_log if not change_log.endswith(".csv") else os.path.dirname(change_log))
        scan = scan_tables(spark, _path(root, control.setting("production_tables_path")))
        broken = scan.errors.take(1)
        if broken:
            raise ValueError(broken[0]["message"])
        result = integrate(log, conflicts, scan.tables, control, mode)
        messages, approved = result.messages, result.approved
        if result.changed is not None:
            target = f"{output}/New_Production_Tables"
            n_tables = publish(write_tables, result.changed, kept_tables(scan.files), target)
            note = F.lit(f"Wrote {n_tables} table(s) to {target}")
            messages = messages.unionByName(_note(spark, "summary", note))
        status = result.status
    except Exception as error:
        messages = messages.unionByName(message(spark.range(1), "error", F.lit(str(error)), "FAIL"))
        raise
    finally:
        rows = write_once(report(messages, status, mode), "report")
        rows.write.mode("overwrite").parquet(f"{out}/report")
        report_totals(rows, status, mode).write.mode("overwrite").parquet(f"{out}/totals")
        facts = _one_row(
            spark, control_hashes=_hashes(spark, control_folder),
            # a log that cannot be read has no facts
            **({} if approved is None else {"change_log": facts_frame(spark, approved)}),
            change_requests=request_steps(control.requests, True).select("step", "change_request_id"),
            counts=report_totals(rows, status, mode).withColumn("tables_affected", F.lit(n_tables)),
        )
        _write_audit(facts, output, run_id, mode, status)
    return out
