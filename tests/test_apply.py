"""Applying change logs: tables worked out by hand, and laws over random logs."""

import random

import pytest

from rowledger.model import LOG, small_frame
from rowledger.operators.apply import apply_changes
from tests.test_stage1 import steps_frame, table_set

COLUMNS = ["k1", "k2", "v1", "v2"]


def log_frame(spark, rows, order):
    from pyspark.sql import types as T

    schema = T.StructType([*LOG.fields, T.StructField("seq", T.LongType()), T.StructField("copies", T.LongType())])
    log = small_frame(spark, [(*r, i, 1) for i, r in enumerate(rows)], schema)
    return log.join(steps_frame(spark, order), ["change_request_id"])


def as_tables(applied):
    columns = {r["table_name"]: (r["n_keys"], r["columns"]) for r in applied.meta.collect()}
    rows = {t: [] for t in columns}
    for r in applied.rows.orderBy("pos").collect():
        rows[r["table_name"]].append(r["cells"])
    return {t: (n, c, rows[t]) for t, (n, c) in columns.items()}


def random_log(rng, order, structural):
    rows, renamed = [], set()
    for cr in order:
        for t in ("T1", "T2"):
            if rng.random() < 0.2:
                continue
            keys = lambda: f"{rng.choice('123')}|{rng.choice('ab')}"
            value = lambda: rng.choice(["p", "q", "r", "7"]) + str(rng.randint(0, 99))
            columns = ["v1", "v2"]
            if structural:
                columns += ["n1", "k1", "u1"]
                if t not in renamed and rng.random() < 0.3:
                    renamed.add(t)
                    rows.append((cr, t, "column_rename", 3, 3, "", "v1->w1", "v1", "w1", ""))
                if t in renamed:
                    columns.append("w1")
                for c in ("n1", "n2", "v2"):
                    if rng.random() < 0.25:
                        rows.append((cr, t, "column_add", 3, 3, "", c, "", "", ""))
                if rng.random() < 0.25:
                    rows.append((cr, t, "column_delete", 3, 3, "", rng.choice(["v2", "n1"]), "", "", ""))
                if rng.random() < 0.25:
                    rows.append((cr, t, "key_count_change", 3, rng.choice([2, 3, 4]), "", "", "3", "4", ""))
                if rng.random() < 0.15:
                    rows.append((cr, t, "table_add", None, 3, "", "", "", "", ""))
                    for _ in range(3):
                        k = keys()
                        for c, v in zip(("k1", "k2", "v1"), (*k.split("|"), value())):
                            rows.append((cr, t, "row_add", None, 3, k, c, "", v, ""))
                    continue
            for _ in range(rng.randint(0, 4)):
                rows.append((cr, t, "value_update", 3, 3, keys(), rng.choice(columns), "", value(), ""))
            for _ in range(rng.randint(0, 2)):
                rows.append((cr, t, "row_delete", 3, 3, keys(), "v1", "", "", ""))
            for _ in range(rng.randint(0, 2)):
                k = keys()
                for c in (["k1", "k2", "v1"] if rng.random() < 0.5 else ["v2"]):
                    v = {"k1": k[0], "k2": k[2]}.get(c) or value()
                    rows.append((cr, t, "row_add", 3, 3, k, c, "", v, ""))
    rng.shuffle(rows)
    return rows


def start(rng):
    return {
        t: (3, COLUMNS, [[rng.choice(["1", "2", "3", "01"]), rng.choice("ab"), f"x{i}", f"y{i}"] for i in range(6)])
        for t in ("T1", "T2", "T3")
    }


def applied(spark, tables, log, order):
    return as_tables(apply_changes(table_set(spark, {("", t): v for t, v in tables.items()}), log_frame(spark, log, order)))


@pytest.mark.parametrize("seed", range(6))
def test_one_pass_equals_request_by_request(spark, seed):
    rng = random.Random(seed)
    order = ["CR_B", "CR_A", "CR_C"]
    tables = start(rng)
    log = random_log(rng, order, structural=seed % 2 == 1)
    at_once = applied(spark, tables, log, order)
    for cr in order:
        tables = applied(spark, tables, [r for r in log if r[0] == cr], [cr])
    assert at_once == tables


def test_requests_on_different_tables_commute(spark):
    rng = random.Random(3)
    tables = start(rng)
    log = [r for r in random_log(rng, ["CR_A", "CR_B"], structural=True) if r[:2] in (("CR_A", "T1"), ("CR_B", "T2"))]
    assert applied(spark, tables, log, ["CR_A", "CR_B"]) == applied(spark, tables, log, ["CR_B", "CR_A"])


def test_every_kind_of_change_by_hand(spark):
    tables = {
        "T": (3, COLUMNS, [["1", "a", "x0", "y0"], ["01", "b", "x1", "y1"], ["2", "a", "x2", "y2"]]),
        "U": (2, ["k", "v"], [["1", "a"]]), "W": (2, ["k", "v", "gone"], [["1", "a", "b"]]), "KEPT": (2, ["k"], [["5"]]),
    }
    log = [
        ("CR_A", "T", "column_rename", 3, 3, "", "v1->w1", "v1", "w1", ""), ("CR_A", "T", "column_add", 3, 3, "", "n1", "", "", ""),
        ("CR_A", "T", "value_update", 3, 3, "1|b", "w1", "x1", "new", ""), ("CR_A", "T", "row_delete", 3, 3, "2|a", "w1", "x2", "", ""),
        ("CR_A", "T", "row_add", 3, 3, "3|c", "v2", "", "z", ""),
        ("CR_A", "U", "key_count_change", 2, 3, "", "", "2", "3", ""), ("CR_A", "U", "column_add", 2, 3, "", "s", "", "", ""),
        ("CR_A", "U", "value_update", 2, 3, "1", "s", "", "m", ""), ("CR_A", "W", "column_delete", 2, 2, "", "gone", "", "", ""),
        ("CR_A", "N", "table_add", None, 2, "", "", "", "", ""), ("CR_A", "N", "row_add", None, 2, "9", "k", "", "9", ""),
        ("CR_A", "N", "row_add", None, 2, "9", "v", "", "q", ""),
        # the later request wins
        ("CR_B", "T", "value_update", 3, 3, "1|a", "v2", "y0", "last", ""), ("CR_A", "T", "value_update", 3, 3, "1|a", "v2", "y0", "first", ""),
    ]
    assert applied(spark, tables, log, ["CR_A", "CR_B"]) == {
        "T": (3, ["k1", "k2", "w1", "v2", "n1"], [["1", "a", "x0", "last", ""], ["01", "b", "new", "y1", ""], ["3", "c", "", "z", ""]]),
        "U": (3, ["k", "s", "v"], [["1", "m", "a"]]), "W": (2, ["k", "v"], [["1", "a"]]),
        "N": (2, ["k", "v"], [["9", "q"]]), "KEPT": (2, ["k"], [["5"]]),
    }


def test_empty_log_changes_nothing(spark):
    tables = {"T1": (3, COLUMNS, [["1", "a", "x", "y"]])}
    production = table_set(spark, {("", t): v for t, v in tables.items()})
    log = log_frame(spark, [], ["CR_A"])
    assert as_tables(apply_changes(production, log)) == tables
