"""Comparison, conflicts and summary: tables worked out by hand, and laws over random ones."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rowledger.model import DUMMIES, LOG, META, POSITION, ROWS, TableSet, small_frame
from rowledger.operators.apply import apply_changes
from rowledger.operators.conflicts import detect_conflicts, flat_conflicts
from rowledger.operators.diff import CROWDED_NOTE, diff_tables
from rowledger.operators.review import build_review
from rowledger.operators.summary import summarize
from rowledger.operators.validate import log_groups, missing_keys
from rowledger.sources.changelog import export_log, read_log_csv
from rowledger.sources.control import column_renames
from rowledger.storage import write_once

NO_RENAMES = "change_request_id string, table_name string, old_column_name string, new_column_name string"


def table_set(spark, tables):
    """tables: {(cr, name): (n_keys, columns, rows)}"""
    meta, rows = [], []
    for (cr, name), (n_keys, columns, records) in tables.items():
        meta.append((cr, name, n_keys, columns, ".csv", None, None))
        rows += [(cr, name, {"part": "", "block": 0, "line": i}, r) for i, r in enumerate(records)]
    return TableSet(small_frame(spark, meta, META), small_frame(spark, rows, ROWS), small_frame(spark, [], DUMMIES))


def renames_frame(spark, renames):
    df = spark.createDataFrame([(*r,) for r in renames], NO_RENAMES) if renames else spark.sql(
        "select '' change_request_id, '' table_name, '' old_column_name, '' new_column_name")
    return column_renames(df.coalesce(1))


def expanded(log):
    out = Counter()
    for r in log.collect():
        out[tuple(r[c] for c in LOG.fieldNames())] += r["copies"]
    return out


def run(spark, before, after, renames=()):
    diff = diff_tables(table_set(spark, before), table_set(spark, after), renames_frame(spark, renames))
    return replace(diff, log=write_once(diff.log, "test-log"))


def steps_frame(spark, ids):
    return spark.createDataFrame([(c, "", i + 1) for i, c in enumerate(ids)],
                                 "change_request_id string, description string, step int")


MORT = ["Age", "Duration", "Product", "Rate", "Loading"]


def test_numeric_aware_values_and_keys(spark):
    before = {("CR1", "A"): (4, MORT, [["20", "1", "PROD_A", "1.10", "1.05"]]),
              ("CR1", "B"): (4, MORT, [["20", "1", "PROD_A", "1.10", "1.05"]]),
              ("CR1", "T"): (2, ["Age", "Rate"], [["1.10", "0.5"]])}
    after = {("CR1", "A"): (4, MORT, [["20", "1", "PROD_A", "1.1", "1.05"]]),
             ("CR1", "B"): (4, MORT, [["20", "1", "PROD_A", "1.2", "1.05"]]),
             ("CR1", "T"): (2, ["Age", "Rate"], [["1.1", "0.6"]])}
    got = expanded(run(spark, before, after).log)
    assert got == Counter({
        ("CR1", "B", "value_update", 4, 4, "20|1|PROD_A", "Rate", "1.10", "1.2", ""): 1,
        ("CR1", "T", "value_update", 2, 2, "1.1", "Rate", "0.5", "0.6", ""): 1,
    })


def random_tables(rng, with_structure):
    """Two snapshots of several tables for two requests, with repeated keys and odd numbers."""
    before, after, renames = {}, {}, []
    for cr in ("CR_A", "CR_B"):
        for name in ("T1", "T2", "T3", "T4"):
            columns = ["k1", "k2", "v1", "v2", "v3"]
            n_keys = rng.choice([1, 2, 3])

            def record(columns):
                return [rng.choice(["1", "1.0", "2", "x", "01"]) if c.startswith("k") else
                        rng.choice(["", "5", "5.0", "6", "y"]) for c in columns]

            b = [record(columns) for _ in range(rng.randint(0, 5))]
            a_columns, a_keys = list(columns), n_keys
            if with_structure:
                if rng.random() < 0.4:
                    renames.append((cr, name, "v1", "w1"))
                    if rng.random() < 0.8:
                        a_columns[a_columns.index("v1")] = "w1"
                if rng.random() < 0.4:
                    a_columns.remove("v2")
                if rng.random() < 0.4:
                    a_columns.append("n1")
                if rng.random() < 0.3:
                    a_columns.insert(n_keys - 1, "k9")
                    a_keys += 1
            a = [record(a_columns) for _ in range(rng.randint(0, 5))]
            if rng.random() < 0.85:
                before[cr, name] = (n_keys, columns, b)
            if rng.random() < 0.85:
                after[cr, name] = (a_keys, a_columns, a)
    return before, after, renames


def test_structural_changes_by_hand(spark):
    before = {("CR1", "T"): (2, ["k", "v", "old"], [["1", "a", "x"], ["2", "b", "y"]]), ("CR1", "U"): (2, ["k", "v"], [["1", "a"]])}
    after = {("CR1", "T"): (2, ["k", "w", "new"], [["1", "A", "n"], ["3", "c", "m"]]),
             ("CR1", "U"): (3, ["k", "s", "v"], [["1", "m", "a"]]), ("CR1", "N"): (2, ["k", "v"], [["9", "q"]])}
    got = expanded(run(spark, before, after, [("CR1", "T", "v", "w")]).log)
    t, u, n = (("CR1", "T"), (2, 2)), (("CR1", "U"), (2, 3)), (("CR1", "N"), (None, 2))
    assert got == Counter((*name, kind, *keys, *rest) for (name, keys), kind, *rest in [
        (t, "column_rename", "", "v->w", "v", "w", "Declared in ColumnRenames"),
        (t, "column_add", "", "new", "", "", ""),
        (t, "column_delete", "", "old", "", "", ""),
        (t, "value_update", "1", "w", "a", "A", ""),
        (t, "value_update", "1", "new", "", "n", "Value on newly added column"),
        (t, "row_delete", "2", "k", "2", "", ""), (t, "row_delete", "2", "w", "b", "", ""),
        (t, "row_add", "3", "k", "", "3", ""), (t, "row_add", "3", "w", "", "c", ""), (t, "row_add", "3", "new", "", "m", ""),
        (u, "key_count_change", "", "", "2", "3", "Structural key-count change"),
        (u, "column_add", "", "s", "", "", ""),
        (u, "value_update", "1", "s", "", "m", "Value on newly added column"),
        (n, "table_add", "", "", "", "", "Table only present in after/"),
        (n, "row_add", "9", "k", "", "9", "Part of table_add"), (n, "row_add", "9", "v", "", "q", "Part of table_add"),
    ])


def test_repeated_keys_by_hand(spark):
    """Every old row of a key meets every new one: the pairs are counted with the new values."""
    before = {("CR1", "T"): (2, ["k", "v"], [["a", "1"], ["a", "2"], ["b", "5"]])}
    after = {("CR1", "T"): (2, ["k", "v"], [["a", "1"], ["a", "3"], ["b", "5.0"]])}
    log = run(spark, before, after).log
    assert {tuple(r) for r in log.select("key_tuple", "column_name", "old_value", "new_value", "copies", "notes").collect()} == {
        ("a", "v", old, new, copies, CROWDED_NOTE)
        for old, new, copies in [("1", None, 0), ("2", None, 0), (None, "1", 1), (None, "3", 2)]}


def old_rows(spark, n):
    """A set of one table, in which one key has ``n`` rows of different values."""
    rows = spark.range(n).selectExpr(
        "'CR_A' as change_request_id", "'T' as table_name",
        f"cast(struct('' as part, 0 as block, id as line) as {POSITION.simpleString()}) as pos",
        "array('a', cast(id as string)) as cells")
    other = table_set(spark, {("CR_A", "T"): (2, ["k", "v"], []), ("CR_B", "T"): (2, ["k", "v"], [["a", "old"]])})
    return TableSet(other.meta, other.rows.unionByName(rows.select(*other.rows.columns)), other.dummies)


@pytest.mark.parametrize("n", [1, 2, 100, 101, 20_001])
def test_one_rule_for_any_number_of_rows(spark, tmp_path, n):
    """Log, conflicts, review, validation, apply and CSV of a key with n old rows and one new."""
    before = old_rows(spark, n)
    after = table_set(spark, {("CR_A", "T"): (2, ["k", "v"], [["a", "z"]]), ("CR_B", "T"): (2, ["k", "v"], [["a", "new"]])})
    diff = diff_tables(before, after, renames_frame(spark, []))
    log, steps = write_once(diff.log, "test-log"), steps_frame(spark, ["CR_A", "CR_B"])
    mine = log.where("change_request_id = 'CR_A'")
    counted = mine.where("new_value is not null").select("old_value", "new_value", "copies").collect()
    assert [tuple(r) for r in counted] == [("0" if n == 1 else None, "z", n)]
    assert mine.where("new_value is null and copies = 0").count() == (0 if n == 1 else n)

    found = detect_conflicts(log, steps)
    (conflict,) = found.conflicts.collect()
    texts = (["0", "old"], ["new", "z"]) if n == 1 else (
        [f"{n + 1} distinct values, see conflict_values"], ["2 distinct values, see conflict_values"])
    assert (conflict["old_values"], conflict["new_values"]) == texts
    assert found.values.where("kind = 'old'").count() == n + 1

    grid = build_review(before, after, diff.pairs, log, steps).grid.collect()
    shown = "0 -> z [CR_A] | old -> new [CR_B]" if n == 1 else f"{n + 1} updates, see change log"
    assert [r["cells"] for r in grid] == [["a", shown]]

    nothing = table_set(spark, {("", "T"): (2, ["k", "v"], [["b", "1"]])})
    stepped = mine.join(steps, ["change_request_id"])
    assert missing_keys(stepped, log_groups(stepped, nothing), nothing).count() == 1

    export_log(log, str(tmp_path / "log"))
    back = read_log_csv(spark, str(tmp_path / "log"))
    assert back.exceptAll(log).count() == log.exceptAll(back).count() == 0
    production = table_set(spark, {("", "T"): (2, ["k", "v"], [["a", "1"], ["a", "2"]])})
    for form in (mine, back.where("change_request_id = 'CR_A'")):
        applied = apply_changes(production, form.join(steps, ["change_request_id"]))
        assert [r["cells"] for r in applied.rows.collect()] == [["a", "z"]] * 2


def test_csv_of_ten_columns(spark, tmp_path):
    """A log from elsewhere has no copies and no order: every row counts once, empty stays empty."""
    path = tmp_path / "log.csv"
    path.write_text("change_request_id,table_name,change_type,n_keys_before,n_keys_after,key_tuple,column_name,old_value,new_value,notes\n"
                    "CR_A,T,value_update,2,2,a,v,1,,\nCR_A,T,value_update,2,2,a,v,1,\"x, y\",\n")
    rows = read_log_csv(spark, str(path)).orderBy("seq").collect()
    assert [(r["old_value"], r["new_value"], r["copies"]) for r in rows] == [("1", "", 1), ("1", "x, y", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_log_of_two_versions_turns_one_into_the_other(spark, seed):
    rng = random.Random(seed)
    before, after, renames = {}, {}, []
    for name in ("T1", "T2", "T3"):
        value = lambda: rng.choice("pqrs") + rng.choice(["", "1", " 2"])
        keys = rng.sample([(a, b) for a in "123x" for b in "ab"], 6)
        old = {k: {"v1": value(), "v2": value(), "v3": value()} for k in keys[:4]}
        # two rows stay, one may change, one goes, up to two come
        new = {k: dict(old[k]) for k in keys[:3]}
        new[keys[0]]["v1"] = value()
        new |= {k: {"v1": value(), "v2": value(), "v3": value()} for k in keys[4 : 4 + rng.randint(0, 2)]}
        columns = {"v1": "v1", "v2": "v2", "v3": "v3"}
        if seed % 2:
            columns["v1"] = "w1"
            renames.append(("CR_A", name, "v1", "w1"))
            if rng.random() < 0.5:
                del columns["v2"]
        wanted = [[*k, *(r[c] for c in columns), *([value()] if seed % 2 else [])] for k, r in new.items()]
        before["CR_A", name] = (3, ["k1", "k2", "v1", "v2", "v3"], [[*k, *r.values()] for k, r in old.items()])
        after["CR_A", name] = (3, ["k1", "k2", *columns.values(), *(["n1"] if seed % 2 else [])], wanted)
    after["CR_A", "T4"] = (2, ["k", "v"], [["1", "x"], ["2", "y"]])
    log = run(spark, before, after, renames).log.join(steps_frame(spark, ["CR_A"]), ["change_request_id"])
    applied = apply_changes(table_set(spark, {("", t): v for (_, t), v in before.items()}), log)
    layout = {r["table_name"]: (r["n_keys"], r["columns"]) for r in applied.meta.collect()}
    got = {t: (n_keys, []) for t, (n_keys, _) in layout.items()}
    for r in applied.rows.collect():
        got[r["table_name"]][1].append(sorted(zip(layout[r["table_name"]][1], r["cells"])))
    want = {t: (n_keys, sorted(sorted(zip(names, r)) for r in records)) for (_, t), (n_keys, names, records) in after.items()}
    assert {t: (n_keys, sorted(records)) for t, (n_keys, records) in got.items()} == want


@pytest.mark.parametrize("seed", range(3))
def test_counted_pairs_are_all_pairs(spark, seed):
    """New values with their counts are what joining every old with every new row gives."""
    before, after, renames = random_tables(random.Random(100 + seed), with_structure=False)
    log = run(spark, before, after, renames).log.where("change_type = 'value_update' and copies > 0")
    got = {tuple(r) for r in log.groupBy("change_request_id", "table_name", "column_name", "new_value").agg(F.sum("copies")).collect()}

    def number(x):
        return float(x) if x.replace(".", "").isdigit() else x

    want = Counter()
    for (cr, name), (n_keys, columns, rows) in after.items():
        n_old, _, olds = before.get((cr, name), (0, [], []))
        if n_old != n_keys:
            continue
        for new in rows:
            for old in olds:
                if all(number(x) == number(y) for x, y in zip(old[: n_keys - 1], new[: n_keys - 1])):
                    for c, x, y in list(zip(columns, old, new))[n_keys - 1 :]:
                        want[cr, name, c, y] += number(x) != number(y)
    assert got == {(*k, n) for k, n in want.items() if n}


def log_frame(spark, rows):
    base = spark.createDataFrame(
        [(cr, "MORT_TABLE", kind, 2, 2, key, column, "", new, "") for cr, kind, key, column, new in rows], LOG)
    return base.withColumn("seq", F.lit(0)).withColumn("copies", F.lit(1).cast("long"))


def test_conflicts_by_hand(spark):
    log = log_frame(spark, [
        ("CR_A", "value_update", "20", "Rate", "1"), ("CR_B", "value_update", "20", "Rate", "2"),
        ("CR_A", "value_update", "21", "Rate", "3"), ("CR_A", "column_add", "", "X", ""),
        ("CR_B", "column_delete", "", "Y", ""), ("CR_B", "row_add", "30", "Rate", "9"),
    ])
    found = flat_conflicts(detect_conflicts(log, steps_frame(spark, ["CR_A", "CR_B"])).conflicts)
    both = "CR_A, CR_B"
    assert {tuple(map(str, r)) for r in found.collect()} == {
        ("cell_overlap", "MORT_TABLE", "20", "Rate", both, "value_update", "", "1, 2", "Multiple change requests modify the same cell", "N"),
        ("structural_collision", "MORT_TABLE", "", "", both, "column_add, column_delete", "", "",
         "Multiple change requests apply structural changes to the same table", "N"),
        ("missing_row_column_fill", "MORT_TABLE", "30", "X", both, "column_add, row_add", "", "",
         "Row add + column add leave this cell without a value; add a Detail value_update "
         "(or row_add cell) or set resolved=Y if blank is intentional", "N"),
    }


def fills(spark, rows):
    found = detect_conflicts(log_frame(spark, rows), steps_frame(spark, ["CR_A", "CR_B"])).conflicts
    return found.where("conflict_type = 'missing_row_column_fill'").collect()


def test_missing_fill(spark):
    base = [("CR_A", "row_add", "99", "Age", "99"), ("CR_A", "row_add", "99", "Rate", "0.5"),
            ("CR_B", "column_add", "", "NewCol", ""), ("CR_B", "value_update", "20", "NewCol", "x")]
    missing = fills(spark, base)
    assert [(r["key_tuple"], r["column_name"], r["change_request_ids"]) for r in missing] == [
        ("99", "NewCol", ["CR_A", "CR_B"])]
    assert "without a value" in missing[0]["notes"]
    assert fills(spark, base + [("CR_B", "value_update", "99", "NewCol", "")]) == []
    assert fills(spark, [("CR_A", "column_add", "", "NewCol", ""), ("CR_A", "row_add", "99", "Age", "99"),
                         ("CR_A", "row_add", "99", "NewCol", "y")]) == []


def test_summary_and_warnings(spark):
    before = {("CR_A", "T"): (2, ["k", "v"], [["1", "a"], ["2", "b"]]), ("CR_A", "GONE"): (2, ["k", "v"], []),
              ("CR_B", "T"): (2, ["k", "v"], [["1", "a"], ["2", "b"]]), ("CR_C", "GONE"): (2, ["k", "v"], [])}
    after = {("CR_A", "T"): (2, ["k", "v"], [["1", "x"], ["3", "c"]]), ("CR_B", "T"): (2, ["k", "v"], [["1", "y"], ["2", "b"]])}
    diff = run(spark, before, after)
    steps = steps_frame(spark, ["CR_A", "CR_B", "CR_C", "CR_D"])
    conflicts = detect_conflicts(diff.log, steps).conflicts
    got = {r[0]: tuple(r)[2:] for r in summarize(diff.log, diff.pairs, steps, conflicts).collect()}
    assert got == {
        "CR_A": ("T", 1, 2, 2, 0, 0, "Y", "CONFLICT"), "CR_B": ("T", 1, 0, 0, 0, 0, "Y", "CONFLICT"),
        "CR_C": ("", 0, 0, 0, 0, 0, "N", "NO_CHANGES"), "CR_D": ("", 0, 0, 0, 0, 0, "N", "EMPTY"),
    }
    assert {(r[0], r[1]) for r in diff.warnings.collect()} == {("CR_A", "GONE"), ("CR_C", "GONE")}
