"""A set of keyed tables, held in three DataFrames so that one plan serves all tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowledger.functions.cells import cell_text, key_part, key_text

POSITION = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("line", T.LongType()),
    ]
)
META = T.StructType(
    [
        T.StructField("change_request_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("n_keys", T.IntegerType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("suffix", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("source_path", T.StringType()),
    ]
)
ROWS = T.StructType(
    [
        T.StructField("change_request_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("pos", POSITION),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)
DUMMIES = T.StructType(
    [
        T.StructField("change_request_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("section", T.IntegerType()),
        T.StructField("pos", POSITION),
        T.StructField("value", T.StringType()),
    ]
)
LOG = T.StructType(
    [
        T.StructField("change_request_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("n_keys_before", T.IntegerType()),
        T.StructField("n_keys_after", T.IntegerType()),
        T.StructField("key_tuple", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
LOG_COLUMNS = LOG.fieldNames()
TABLE_KEY = ["change_request_id", "table_name"]

# Sections of a table file, in file order.
LEADING, HEADER, BODY, TRAILING = 0, 1, 2, 3


def position(part: Column, block: Column, line: Column) -> Column:
    return F.struct(
        part.cast("string").alias("part"), block.cast("long").alias("block"), line.cast("long").alias("line")
    )


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A handful of driver-side records as a local relation, whose size the optimizer knows."""
    if not rows:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return spark.range(1).select(*nulls).where(F.lit(False))
    records = [dict(zip(schema.fieldNames(), row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


@dataclass(frozen=True)
class Frame:
    """The ordinary frame behind a table: columns ``c0``, ``c1`` and so on, still typed, key columns first.

    Keys and hashes are taken from it before any cell is made into text, so that only rows in demand ever are.
    """

    change_request_id: str
    table_name: str
    n_keys: int
    df: DataFrame
    line: str

    @property
    def types(self) -> list[T.DataType]:
        return [f.dataType for f in self.df.schema]

    @property
    def cells(self) -> list[str]:
        return [cell_text(f"c{i}", t) for i, t in enumerate(self.types)]

    @property
    def key_places(self) -> list[int]:
        return list(range(len(self.types)))[: max(self.n_keys - 1, 0)]

    def keyed(self, places: list[int], hashed: list[str]) -> DataFrame:
        """Typed rows with the key made of the columns at ``places``, and a hash of the columns ``hashed``."""
        parts = [key_part(f"c{i}", self.types[i]) if i >= 0 else "''" for i in places]
        key = f"array_join(array({', '.join(parts)}), '|')" if parts else "''"
        named = {"change_request_id": F.lit(self.change_request_id), "table_name": F.lit(self.table_name), "key_tuple": F.expr(key)}
        return self.df.withColumns(named).withColumn("key_hash", F.xxhash64(*hashed))

    def as_rows(self, keyed: DataFrame) -> DataFrame:
        """Rows of ``keyed`` as rows of a table set, with their key."""
        pos = position(F.lit(""), F.lit(0), F.expr(self.line)).alias("pos")
        return keyed.select(*TABLE_KEY, "key_tuple", "key_hash", pos, F.array(*map(F.expr, self.cells)).alias("cells"))


@dataclass(frozen=True)
class TableSet:
    """``meta``: one row per table. ``rows``: one row per record. ``dummies``: lines outside the block.

    ``frames`` are the ordinary frames that ``rows`` are made of, if they are made of nothing else.
    """

    meta: DataFrame
    rows: DataFrame
    dummies: DataFrame
    frames: tuple[Frame, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.meta.sparkSession

    def for_request(self, change_request_id: str) -> TableSet:
        """The same tables, filed under a change request."""
        label = F.lit(change_request_id)
        return TableSet(*(d.withColumn("change_request_id", label) for d in (self.meta, self.rows, self.dummies)))

    def with_tables(self, **frames: DataFrame) -> TableSet:
        return replace(self, **{"frames": (), **frames})

    def keyed_rows(self) -> DataFrame:
        """Rows with ``key_tuple``, the canonical text of their key cells."""
        if self.frames:
            keyed = [f.as_rows(f.keyed(f.key_places, ["key_tuple"])) for f in self.frames]
            return reduce(DataFrame.unionAll, keyed).select(*self.rows.columns, "key_tuple")
        keys = self.meta.select(*TABLE_KEY, "n_keys")
        places = "transform(slice(cells, 1, greatest(n_keys - 1, 0)), (_c, i) -> i)"
        key = F.expr(key_text("cells", places)).alias("key_tuple")
        return self.rows.join(keys, TABLE_KEY).select(*self.rows.columns, key)

    def to_dataframe(self, table_name: str, columns: list[str]) -> DataFrame:
        """One table as an ordinary wide frame of text columns, with its row position."""
        cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]
        return self.rows.where(F.col("table_name") == table_name).select(*cells, F.col("pos"))


def empty_set(spark: SparkSession) -> TableSet:
    return TableSet(*(small_frame(spark, [], s) for s in (META, ROWS, DUMMIES)))


def union_sets(spark: SparkSession, sets: Iterable[TableSet]) -> TableSet:
    """All tables of several sets."""
    sets = list(sets) or [empty_set(spark)]
    frames = [f for s in sets for f in s.frames]
    apart = len({(f.change_request_id, f.table_name) for f in frames}) == len(frames)
    return TableSet(
        reduce(DataFrame.unionByName, [s.meta for s in sets]),
        reduce(DataFrame.unionByName, [s.rows for s in sets]),
        reduce(DataFrame.unionByName, [s.dummies for s in sets]),
        tuple(frames) if apart and all(s.frames for s in sets) else (),
    )


def from_dataframe(
    df: DataFrame,
    table_name: str,
    keys: list[str],
    *,
    change_request_id: str = "",
    order_by: str | None = None,
) -> TableSet:
    """An ordinary frame as a keyed table: key columns first, every cell as text.

    ``order_by`` names a whole-number column that gives the row order where it matters.
    """
    spark = df.sparkSession
    columns = keys + [c for c in df.columns if c not in keys]
    meta = small_frame(
        spark, [(change_request_id, table_name, len(keys) + 1, columns, ".csv", None, None)], META
    )
    line = F.col(order_by) if order_by else F.lit(0)
    cells = [F.expr(cell_text(f"`{c}`", df.schema[c].dataType)) for c in columns]
    rows = df.select(
        F.lit(change_request_id).alias("change_request_id"),
        F.lit(table_name).alias("table_name"),
        position(F.lit(""), F.lit(0), line).alias("pos"),
        F.array(*cells).alias("cells"),
    )
    typed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    frame = Frame(change_request_id, table_name, len(keys) + 1, typed, f"c{columns.index(order_by)}" if order_by else "0")
    return TableSet(meta, rows, small_frame(spark, [], DUMMIES), (frame,))
