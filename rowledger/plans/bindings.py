"""Change requests on ordinary parquet tables, used by the registered queries and the benchmark.

Snapshots are plain SELECTs over the source tables, so that any SQL engine can build them.
Two requests change ``orders`` at once; others change ``lineitem``, ``customer`` and ``part``,
and one adds ``supplier``. ``books`` is a set with one small table per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.model import DUMMIES, META, TableSet, from_dataframe, small_frame, union_sets
from rowledger.operators.diff import Diff, diff_tables
from rowledger.sources.control import Control, make_control
from rowledger.storage import write_once

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Snapshots: (select, key columns). Names in braces are source tables.
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}"
ORDERS_A = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN o_totalprice + 1 ELSE o_totalprice END
       AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 5000)
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_totalprice BETWEEN 250000 AND 255000"""
ORDERS_B = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 470000 THEN o_totalprice + 2 ELSE o_totalprice END
       AS o_totalprice, o_orderdate,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN '0-REVIEW' ELSE o_orderpriority END
       AS o_orderpriority,
       CASE WHEN o_totalprice >= 250000 THEN 'high' ELSE 'low' END AS o_band
FROM {orders} WHERE o_totalprice >= 2000"""
ORDERS_KEYED = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_price, o_orderdate
FROM {orders} WHERE o_totalprice > 1500"""
LINEITEM = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
       l_linestatus, l_shipdate FROM {lineitem}"""
LINEITEM_A = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_discount + 0.01 ELSE l_discount END AS l_discount, l_tax,
       CASE WHEN l_linestatus = 'O' AND l_quantity < 3 THEN 'X' ELSE l_returnflag END AS l_returnflag,
       l_linestatus, l_shipdate FROM {lineitem} WHERE NOT (l_quantity = 50 AND l_returnflag = 'A')"""
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {customer}"
CUSTOMER_A = """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_balance
FROM {customer}"""
PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {part}"
PART_B = """
SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 45 THEN CAST(p_size AS VARCHAR(9)) || '.5'
       ELSE CAST(p_size AS VARCHAR(9)) || '.0' END AS p_size, p_retailprice FROM {part}"""
SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {supplier}"
LINEITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

BEFORE = [
    ("CR_A", "orders", ORDERS, ["o_orderkey"]),
    ("CR_B", "orders", ORDERS, ["o_orderkey"]),
    ("CR_A", "lineitem", LINEITEM, LINEITEM_KEYS),
    ("CR_A", "customer", CUSTOMER, ["c_custkey"]),
    ("CR_B", "part", PART, ["p_partkey"]),
]
AFTER = [
    ("CR_A", "orders", ORDERS_A, ["o_orderkey"]),
    ("CR_B", "orders", ORDERS_B, ["o_orderkey"]),
    ("CR_A", "lineitem", LINEITEM_A, LINEITEM_KEYS),
    ("CR_A", "customer", CUSTOMER_A, ["c_custkey"]),
    ("CR_B", "part", PART_B, ["p_partkey"]),
    ("CR_A", "supplier", SUPPLIER, ["s_suppkey"]),
]
REQUESTS = [("CR_A", "1", "Y", "Y", "prices and deletions", ""), ("CR_B", "2", "Y", "Y", "bands and reviews", "")]
RENAMES = [("CR_A", "customer", "c_acctbal", "c_balance")]

_written: dict[tuple, DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A source table as it is stored; a small one, cut into fewer pieces than cores by Spark itself, is dealt out.

    A larger one is never dealt out: that would shuffle it whole, and into as many parts as cores however large it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def source(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """A SELECT over the parquet tables it names in braces."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in select}
    return spark.sql(select, **used)


def snapshots(spark: SparkSession, sf_dir: str, listed: list[tuple], only: str | None = None) -> TableSet:
    return union_sets(spark, (
        from_dataframe(source(spark, sf_dir, select), table, keys, change_request_id=cr, order_by=keys[0])
        for cr, table, select, keys in listed
        if only in (None, table)
    ))


def control(spark: SparkSession, requests=REQUESTS, renames=RENAMES, approvals=()) -> Control:
    def frame(rows, columns):
        fields = [T.StructField(c, T.StringType()) for c in columns]
        schema = T.StructType([*fields, T.StructField("sheet_pos", T.LongType())])
        return small_frame(spark, [(*r, i) for i, r in enumerate(rows)], schema)

    return make_control(
        spark,
        frame(requests, ["change_request_id", "order", "include", "approved", "description", "notes"]),
        frame(renames, ["change_request_id", "table_name", "old_column_name", "new_column_name"]),
        frame(approvals, ["change_request_id", "table_name", "approved"]),
    )


def steps(spark: SparkSession) -> DataFrame:
    """The two requests in order."""
    rows = ", ".join(f"('{r[0]}', '{r[4]}', {i})" for i, r in enumerate(REQUESTS, 1))
    return spark.sql(f"select * from values {rows} as t(change_request_id, description, step)")


def diff(spark: SparkSession, sf_dir: str, only: str | None = None) -> Diff:
    renames = control(spark).renames
    return diff_tables(
        snapshots(spark, sf_dir, BEFORE, only), snapshots(spark, sf_dir, AFTER, only), renames
    )


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A frame that several queries of a session share, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = write_once(make(), name)
    return _written[key]


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of both requests over all bound tables."""
    return once(spark, sf_dir, "bound-log", lambda: diff(spark, sf_dir).log)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(spark, sf_dir).where("table_name = 'orders'")


def production(spark: SparkSession, sf_dir: str, whole: bool = True) -> TableSet:
    """All base tables, or with orders above a price limit missing."""
    orders = ORDERS if whole else ORDERS + " WHERE o_totalprice < 480000"
    listed = [("", "orders", orders, ["o_orderkey"])] + [("", *b[1:]) for b in BEFORE if b[1] != "orders"]
    return snapshots(spark, sf_dir, listed)


# One small table per customer: segment and nation decide what its request changes.


def books(spark: SparkSession, sf_dir: str, request: str = "CR_1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(before meta, after meta, renames) of the customer books.

    Before: ``id, balance, <segment>``. After: no book below zero balance; BUILDING renames
    ``balance``; nations under 5 get a second key; nations from 20 on get a column; MACHINERY
    loses its segment column; every supplier opens a new book.
    """
    customer = read(spark, sf_dir, "customer")
    supplier = read(spark, sf_dir, "supplier")
    rest = "'.csv' as suffix", "cast(null as string) as encoding", "cast(null as string) as source_path"
    head = f"'{request}' as change_request_id"
    before = customer.selectExpr(
        head, "c_name as table_name", "2 as n_keys", "array('id', 'balance', lower(c_mktsegment)) as columns", *rest
    )
    after = customer.where("c_acctbal >= 0").selectExpr(
        head, "c_name as table_name", "if(c_nationkey < 5, 3, 2) as n_keys",
        "concat(array('id', if(c_mktsegment = 'BUILDING', 'amount', 'balance')),"
        " if(c_mktsegment = 'MACHINERY', array(), array(lower(c_mktsegment))),"
        " if(c_nationkey >= 20, array(concat('n', c_nationkey)), array())) as columns", *rest,
    ).unionByName(supplier.selectExpr(
        head, "s_name as table_name", "2 as n_keys", "array('id', 'balance') as columns", *rest))
    renames = customer.where("c_mktsegment = 'BUILDING'").selectExpr(
        head, "c_name as table_name", "'balance' as old_column_name", "'amount' as new_column_name",
        "cast(c_custkey as bigint) as sheet_pos",
    )
    return before, after, renames


def books_set(spark: SparkSession, sf_dir: str) -> TableSet:
    """The books as production: every order is a row of its customer's book."""
    before, _, _ = books(spark, sf_dir)
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "'' as change_request_id", "c_name as table_name",
        "named_struct('part', '', 'block', 0L, 'line', o_orderkey) as pos",
        "array(cast(o_orderkey as string), cast(cast(floor(o_totalprice) as bigint) as string), o_orderstatus) as cells",
    )
    meta = before.withColumn("change_request_id", F.lit("")).select(*META.fieldNames())
    return TableSet(meta, rows, small_frame(spark, [], DUMMIES))
