"""A scan gives the same lines however Spark cuts the files, also when that changes between planning and action."""

import pytest

from rowledger.functions.cells import key_number, strip
from rowledger.sources.marker import scan_tables

SETTINGS = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def folder(tmp_path):
    for name, n in (("A", 9000), ("B", 6000), ("C", 2500)):
        lines = ["about", "!2,Id,Value", *(f"*,{i},{name}{i}" for i in range(n)), "end of block", f"*,late,{name}"]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


@pytest.mark.parametrize(("first", "later", "size"), [(4, 16, "16m"), (16, 4, "16m"), (8, 3, "16m"), (4, 4, "9k")])
def test_a_changed_cut_loses_no_line(spark, folder, first, later, size):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.minPartitionNum", first)
        tables = scan_tables(spark, folder).tables
        spark.conf.set("spark.sql.files.minPartitionNum", later)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = {r["table_name"]: r["count"] for r in tables.rows.groupBy("table_name").count().collect()}
        around = sorted((r.table_name, r.value) for r in tables.dummies.collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows == {"A": 9000, "B": 6000, "C": 2500}
    assert around == sorted((t, v) for t in "ABC" for v in ("about", "end of block", f"*,late,{t}"))


def test_white_space_of_every_kind(spark):
    signs = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    rows = spark.createDataFrame([(f"{s}20{s}{s}",) for s in signs], "c string")
    assert {tuple(r) for r in rows.selectExpr(strip("c"), key_number("c")).collect()} == {("20", 20.0)}
