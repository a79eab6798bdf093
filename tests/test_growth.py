"""Plans that must grow with the input alone: no whole shuffles, same results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.functions.cells import WHITE, cell_text, filled, literal, strip
from rowledger.model import LOG_COLUMNS, META, TableSet, empty_set, from_dataframe, small_frame
from rowledger.operators import diff as D
from rowledger.operators.diff import diff_tables, key_bitmap, maybe_listed
from rowledger.operators import review as R
from rowledger.operators.review import build_review
from rowledger.plans import bindings as B
from rowledger.plans import queries as Q
from rowledger.sources import changelog as C
from rowledger.sources.marker import decoded
from rowledger.storage import write_once


def test_bitmap_keeps_listed_keys_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id", "xxhash64(id) as key_hash")
    listed = rows.where("id < 2000 or id = 19999")
    found = {r["id"] for r in maybe_listed(rows, key_bitmap(listed.select("key_hash"), 1 << 15), 1 << 15).collect()}
    assert found >= {*range(2000), 19999}
    assert len(found) < 2001 + 2000
    assert maybe_listed(rows, key_bitmap(listed.where("false").select("key_hash"), 64), 64).count() == 0


def test_long_list_of_changed_keys_gives_the_same_log(spark, monkeypatch):
    old = spark.range(3000).selectExpr("id div if(id < 40, 4, 1) as k", "id % 7 as v", "'x' as w")
    new = old.selectExpr("k + if(k = 900, 5000, 0) as k", "if(k % 50 = 3, v + 1, v) as v", "w", "k % 2 as extra")
    sides = [from_dataframe(df, "t", ["k"], change_request_id="CR") for df in (old, new)]
    none = B.control(spark).renames

    def logged():
        log = diff_tables(*sides, none).log.select(*LOG_COLUMNS, "copies")
        return sorted(map(str, log.collect()))

    listed = logged()
    monkeypatch.setattr(D, "LISTED_KEYS", 0)
    assert logged() == listed
    assert len(listed) > 3000


def test_table_of_many_blocks_is_not_dealt_out(spark, tmp_path):
    for name, n in (("part", 1), ("orders", 64)):
        spark.range(0, 6400, 1, n).selectExpr("id", "repeat(uuid(), 8) as t").write.parquet(str(tmp_path / f"{name}.parquet"))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        # one file that Spark itself cuts into many pieces
        cut = B.read(spark, str(tmp_path), "part")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert "Repartition" not in cut


def _review(spark):
    old = spark.range(400).selectExpr("id as k", "id % 7 as v", "'x' as w")
    new = old.selectExpr("k", "if(k % 3 = 0, v + 1, v) as v", "w").where("k % 10 <> 9")
    sides = [from_dataframe(df, "t", ["k"], change_request_id="CR_A", order_by="k") for df in (old, new)]
    found = diff_tables(*sides, B.control(spark).renames)
    return build_review(*sides, found.pairs, write_once(found.log, "log"), B.steps(spark))


def test_order_of_review_needs_no_snapshot(spark):
    plan = _review(spark).grid.select("table_name", "status_rank", "key_tuple")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan


def test_review_of_a_long_list_of_keys(spark, monkeypatch):
    listed = sorted(map(str, _review(spark).grid.collect()))
    assert len(listed) == 40 + 134 - 14
    monkeypatch.setattr(R, "LISTED_KEYS", 0)
    assert sorted(map(str, _review(spark).grid.collect())) == listed


def test_folders_of_many_tables_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    supplier = spark.range(60).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 25 as int) as s_nationkey", "0.0D as s_acctbal")
    supplier.write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(Q, "new_path", lambda spark, name: str(tmp_path / name))
    found = Q.REGISTRY["discover_prefer_fac"](spark, str(tmp_path))
    assert found.count() == 60
    assert found.where("suffix = '.FAC'").count() == supplier.where("s_nationkey < 15").count()
    tasks = {f.name.split("-")[1] for f in (tmp_path / "listing").rglob("part-*.txt")}
    assert len(tasks) > 1


def test_keys_of_both_sides_meet_in_one_aggregation(spark):
    old, new = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["1", "1.0", None, "a"], ["1", "b", "b"]))
    found = Q.key_sets(*(from_dataframe(df, "t", ["k"], change_request_id="CR") for df in (old, new)))
    assert sorted((r.key_tuple, r.part) for r in found.collect()) == [("", "deleted"), ("1", "common"), ("a", "deleted"), ("b", "added")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "LeftAnti" not in plan and "LeftSemi" not in plan


def test_no_task_reads_the_log_of_one_task_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FILE_ROWS", 10)
    entry = {c: F.lit("x") for c in LOG_COLUMNS} | {"n_keys_before": F.lit(2), "n_keys_after": F.lit(2), "copies": F.lit(1)}
    log = spark.range(0, 95, 1, 1).withColumns(entry | {"key_tuple": F.expr("concat(id, '\\n', id)"), "seq": F.expr(f"cast(null as {C.SEQUENCE})")})
    C.export_log(log, str(tmp_path / "log.csv"))
    assert len(list((tmp_path / "log.csv").glob("part-*"))) == 10
    found = C.read_log_csv(spark, str(tmp_path / "log.csv")).collect()
    assert sorted(r.key_tuple for r in found) == sorted(f"{i}\n{i}" for i in range(95))


def test_keys_of_few_and_of_many_rows_give_the_same_log(spark, monkeypatch):
    values = "case id % 5 when 0 then '1' when 1 then '1.0' when 2 then 'a' when 3 then null else string(id % 3) end"
    old = spark.range(300).selectExpr("if(id < 200, id div 4, id) as k", f"{values} as v", "id % 2 as w", "id as line")
    new = spark.range(320).where("id % 11 <> 0").selectExpr("if(id < 220, id div 5, id) as k", f"{values} as v", "id % 3 as w", "id as line")
    sides = [from_dataframe(df, "t", ["k"], change_request_id="CR", order_by="line") for df in (old, new)]
    none = B.control(spark).renames

    def logged(rows):
        monkeypatch.setattr(D, "GATHERED_ROWS", rows)
        log = diff_tables(*sides, none).log
        return sorted(map(str, log.collect())), log._jdf.queryExecution().optimizedPlan().toString()

    gathered, plan = logged(1000)
    assert "Window" in plan
    for rows in (0, 7):
        assert logged(rows)[0] == gathered
    assert sum(D.CROWDED_NOTE in line for line in gathered) > 100


def test_list_of_changed_keys_too_long_for_a_small_broadcast_limit_has_a_bitmap(spark, monkeypatch):
    made = []
    monkeypatch.setattr(D, "key_bitmap", lambda keys, bits: made.append(bits) or key_bitmap(keys, bits))
    old = spark.range(30_000).selectExpr("id as k", "1 as v")
    new = old.selectExpr("k", "if(k < 25000, 2, 1) as v")
    sides = [from_dataframe(df, "t", ["k"], change_request_id="CR") for df in (old, new)]
    log = diff_tables(*sides, B.control(spark).renames).log
    assert log.count() == 25_000
    assert made


def _odd_sides(spark):
    """Repeated keys in short rows, null cells, a name used twice, a table of keys alone, keys of one side, and lines far apart."""
    half = 1 << 62
    pos = "cast(struct('p' as part, id % 3 as block, {line} as line) as " + D.POSITION.simpleString() + ") as pos"
    cells = "array(string(id % 6 + {lone}), case id % 4 when 0 then '1' when 1 then '1.0' when 2 then null else string(id) end, string(id % 3), 'x')"
    sides = []
    for n, lone, line in ((60, 0, f"(id - 30) * {half // 30}L"), (66, 1, "id")):
        rows = spark.range(n).selectExpr(
            "'CR' as change_request_id", "'t' as table_name", pos.format(line=line), f"slice({cells.format(lone=lone)}, 1, if(id % 5 = 0, 2, 4)) as cells",
        )
        keys = rows.selectExpr("change_request_id", "'k' as table_name", "pos", "slice(cells, 1, 1) as cells")
        meta = [("CR", "t", 2, ["k", "v", "w", "w"], ".csv", None, None), ("CR", "k", 2, ["k"], ".csv", None, None)]
        sides.append(TableSet(small_frame(spark, meta, META), rows.unionAll(keys), empty_set(spark).dummies))
    return sides


def test_rows_of_vast_keys_are_counted_without_being_written(spark, monkeypatch):
    sides, none, written = _odd_sides(spark), B.control(spark).renames, []
    monkeypatch.setattr(D, "write_once", lambda df, name: written.append(name) or write_once(df, name))

    def logged(rows):
        monkeypatch.setattr(D, "GATHERED_ROWS", rows)
        return sorted(map(str, diff_tables(*sides, none).log.collect()))

    gathered = logged(1000)
    assert "crowded-rows" in written
    written.clear()
    assert logged(0) == gathered
    assert "crowded-rows" not in written
    kinds = [sum(kind in line for line in gathered) for kind in ("row_add", "row_delete", "value_update")]
    assert all(kinds), kinds


def test_text_of_numbers_of_few_decimals(spark):
    values = [0.001, 0.00099, 0.1, 1.25, 104948.05, 9999999.999999, 10000000.5, 1e7, -0.0, -3.5, 0.1 + 0.2, 1 / 3, 2.0e-3, 1e-5, float("nan"), float("inf")]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").selectExpr(cell_text("d", T.DoubleType())).collect()]
    assert found == [str(int(v)) if v == v and abs(v) < 1e15 and v == int(v) else str(v) for v in values]


def test_ends_of_long_texts_are_found_without_a_search(spark):
    plan = spark.range(1).selectExpr("concat(id, ' x ') as c").selectExpr(strip("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "trim" in plan
    ends = ["", " ", "　\x85a b\xa0 \n", "\r\n x\x1c \x1f", "​ z ", "é ", "a\n\n"]
    raw = [t.encode() for t in ends] + [b"\xe9  ", b"\xa0a", b" a\x85", b"*\xe9 ", b"\xc2", b" \xff "]
    frame = spark.createDataFrame([(r,) for r in raw], "b binary").selectExpr("cast(b as string) as c")
    old = f"regexp_replace(c, r'^{WHITE}+|{WHITE}+$', '')"
    same = frame.selectExpr(f"hex({strip('c')}) = hex({old}) as stripped", f"{filled('c')} = ({old} <> '') as full").collect()
    assert all(r.stripped and r.full for r in same), same
    texts = spark.createDataFrame([(bytes(range(32, 256)),), (b"plain \xe9",)], "b binary").selectExpr("cast(b as string) as c")
    got = [r[0] for r in texts.selectExpr(f"{decoded('c', literal('cp1252'))} as t").collect()]
    assert got[1] == "plain é" and "€" in got[0] and "Ÿ" in got[0] and len(got[0]) == 224


def _typed_sides(spark):
    """Nulls that change places, numbers and times of one text, types that differ between the sides, repeated keys, null keys."""
    old = spark.range(400).selectExpr(
        "if(id % 50 = 7, null, if(id < 40, id div 4, id)) as k", "concat('0', id % 3) as k2", "if(id % 9 = 0, null, 'a') as v", "if(id % 9 = 0, 'a', null) as w",
        "case id % 5 when 0 then -0.0D when 1 then double('nan') when 2 then null else id / 3 end as d",
        "timestamp_millis(id * 1000) as t", "int(id % 7) as n", "id as line",
    )
    new = old.where("line % 31 <> 0").selectExpr(
        "k", "k2", "if(line % 27 = 0, 'a', v) as v", "if(line % 27 = 0, null, w) as w", "if(line % 10 = 0, 0.0D, if(line % 10 = 3, d + 1, d)) as d",
        "t + make_interval(0, 0, 0, 0, 0, 0, if(line % 2 = 0, 0.5, 2 * int(line % 11 = 0))) as t", "concat(n, '.0') as n", "line", "k2 as extra",
    ).unionByName(old.where("line < 20").selectExpr("k + 5000 as k", "k2", "v", "w", "d", "t", "string(n) as n", "line", "'x' as extra"))
    return [from_dataframe(df, "t", ["k", "k2"], change_request_id="CR_A", order_by="line") for df in (old, new)]


def test_typed_frames_give_the_log_and_review_of_their_rows(spark, monkeypatch):
    sides, none = _typed_sides(spark), B.control(spark).renames
    assert all(s.frames for s in sides)

    def found(sides):
        result = diff_tables(*sides, none)
        log = write_once(result.log, "log")
        review = build_review(*sides, result.pairs, log, B.steps(spark))
        return [sorted(map(str, df.collect())) for df in (log, review.grid, sides[0].keyed_rows())]

    plain = found([s.with_tables() for s in sides])
    assert len(plain[0]) > 400 and any("'a'" in line for line in plain[0])
    assert found(sides) == plain
    # long lists of keys, and more requests than get a column each
    for module in (D, R):
        monkeypatch.setattr(module, "LISTED_KEYS", 0)
    monkeypatch.setattr(R, "SPREAD_STEPS", 0)
    assert found(sides) == plain


def test_each_kind_of_changed_keys_has_a_bitmap_of_its_own(spark, monkeypatch):
    made = []
    monkeypatch.setattr(D, "LISTED_KEYS", 0)
    monkeypatch.setattr(D, "key_bitmap", lambda keys, bits: made.append((keys.count(), bits)) or key_bitmap(keys, bits))
    old = spark.range(60).selectExpr("if(id < 30, id div 3, id) as k", "id as v")
    new = old.selectExpr("k", "v + int(k = 50 or k < 5) as v")
    diff_tables(*(from_dataframe(df, "t", ["k"], change_request_id="CR") for df in (old, new)), B.control(spark).renames)
    assert [n for n, _ in made] == [1, 10, 0]


def test_no_text_is_made_of_columns_that_are_only_compared(spark, monkeypatch):
    plans = []
    changed_keys = D.changed_keys
    monkeypatch.setattr(D, "changed_keys", lambda b, a: plans.extend(s._jdf.queryExecution().optimizedPlan().toString() for s in (b, a)) or changed_keys(b, a))
    old = spark.range(60).selectExpr("id as k", "timestamp_millis(id) as t", "id / 7 as d")
    diff_tables(*(from_dataframe(old.where(c), "t", ["k"], change_request_id="CR") for c in ("k < 50", "k > 9")), B.control(spark).renames)
    assert len(plans) == 2 and not any("date_format" in p for p in plans)


def test_changes_and_rows_of_a_key_are_brought_together_in_one_step_each(spark):
    plan = _review(spark).grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_review_over_two_requests_takes_the_latest_new_row_and_the_first_old_one(spark):
    def tables(cr, rows):
        frame = spark.createDataFrame(rows, "k string, v string, w string, line long")
        return from_dataframe(frame, "t", ["k"], change_request_id=cr, order_by="line")

    before = [tables("CR_A", [("1", "a", "b", 1), ("2", "c", "d", 2), ("1", "z", None, 3)]), tables("CR_B", [("1", "q", "r", 1), ("2", "s", "t", 2)])]
    after = [tables("CR_A", [("1", "a2", "b", 1), ("3", "n", "m", 4)]), tables("CR_B", [("1", "q", "r9", 1)])]
    before, after = B.union_sets(spark, before), B.union_sets(spark, after)
    found = diff_tables(before, after, B.control(spark).renames)
    grid = build_review(before, after, found.pairs, write_once(found.log, "log"), B.steps(spark)).grid
    rows = {r.key_tuple: (r.status, r.cells) for r in grid.collect()}
    # key 1 repeats on a side of CR_A, the only update of its w in CR_B is shown with its request
    assert rows["3"] == ("ADD", ["3", "n", "m", "4"])
    assert rows["2"][0] == "DELETE" and rows["2"][1][1] in ("s", "c")
    assert rows["1"][0] == "" and rows["1"][1][2].endswith("updates, see change log")
    assert len(rows) == 3
