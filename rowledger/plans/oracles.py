"""The registered queries as plain SQL over the same tables, for an independent engine.

Tables are unpivoted to one row per cell, and everything is stated on that long form.
"""

from __future__ import annotations

from rowledger.operators.conflicts import FILL_NOTE, OVERLAP_NOTE, STRUCTURAL_NOTE
from rowledger.operators.diff import CROWDED_NOTE, FRESH_NOTE, TABLE_ADD_NOTE
from rowledger.operators.validate import REPEATED_ROW, SHARED_FILL
from rowledger.plans import bindings as B

# Kind of every bound column: s text, i whole number, d double, t timestamp.
KINDS = {
    "orders": "o_orderkey i o_custkey i o_orderstatus s o_totalprice d o_orderdate t o_orderpriority s",
    "orders_b": "o_orderkey i o_custkey i o_orderstatus s o_totalprice d o_orderdate t o_orderpriority s o_band s",
    "orders_k": "o_orderkey i o_custkey i o_orderstatus s o_price d o_orderdate t",
    "lineitem": "l_orderkey i l_linenumber i l_partkey i l_suppkey i l_quantity d l_extendedprice d l_discount d"
                " l_tax d l_returnflag s l_linestatus s l_shipdate t",
    "customer": "c_custkey i c_name s c_nationkey i c_acctbal d c_mktsegment s",
    "customer_a": "c_custkey i c_name s c_nationkey i c_balance d",
    "part": "p_partkey i p_name s p_brand s p_type s p_size i p_retailprice d",
    "part_b": "p_partkey i p_name s p_brand s p_type s p_size s p_retailprice d",
    "supplier": "s_suppkey i s_name s s_nationkey i s_acctbal d",
}
LOG = (
    "change_request_id, table_name, change_type, n_keys_before, n_keys_after, key_tuple, column_name,"
    " old_value, new_value, notes"
)


def columns(shape: str) -> list[tuple[str, str]]:
    words = KINDS[shape].split()
    return list(zip(words[::2], words[1::2]))


def cell(name: str, kind: str) -> str:
    if kind == "d":
        whole = f"{name} = floor({name}) AND abs({name}) < 1e15"
        return f"coalesce(CASE WHEN {whole} THEN CAST(CAST({name} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({name} AS DOUBLE) AS VARCHAR) END, '')"
    if kind == "t":
        return f"coalesce(strftime({name}, '%Y-%m-%d %H:%M:%S'), '')"
    return f"coalesce(CAST({name} AS VARCHAR), '')"


def row_text(shape: str, keys: list[str], separator: str = ",", replace: dict | None = None) -> str:
    """All cells of a row as one text, key columns first."""
    kinds = dict(columns(shape))
    order = keys + [c for c in kinds if c not in keys]
    return "concat_ws('%s', %s)" % (separator, ", ".join((replace or {}).get(c) or cell(c, kinds[c]) for c in order))


def sql(select: str) -> str:
    return select.format(**{t: t for t in B.TABLES})


def long_form(cr: str, table: str, select: str, keys: list[str], shape: str) -> str:
    """One row per cell: cr, tbl, nk, k, col, val, ord."""
    kinds = dict(columns(shape))
    order = keys + [c for c in kinds if c not in keys]
    key = "concat_ws('|', %s)" % ", ".join(cell(k, kinds[k]) for k in keys)
    names = ", ".join(f"'{c}'" for c in order)
    values = ", ".join(cell(c, kinds[c]) for c in order)
    return (
        f"SELECT '{cr}' AS cr, '{table}' AS tbl, {len(keys) + 1} AS nk, {key} AS k,"
        f" unnest([{names}]) AS col, unnest([{values}]) AS val, unnest(range({len(order)})) AS ord"
        f" FROM ({sql(select)})"
    )


SHAPES_BEFORE = {("CR_A", "customer"): "customer"}
SHAPES_AFTER = {("CR_B", "orders"): "orders_b", ("CR_A", "customer"): "customer_a", ("CR_B", "part"): "part_b"}


def long_forms(only: str | None = None) -> str:
    """CTEs ``b`` and ``a`` of all bound snapshots, with renamed columns already aligned in ``b``."""
    def side(listed, shapes):
        parts = [
            long_form(cr, table, select, keys, shapes.get((cr, table), table))
            for cr, table, select, keys in listed if only in (None, table)
        ]
        return " UNION ALL ".join(parts) or "SELECT '' cr, '' tbl, 0 nk, '' k, '' col, '' val, 0::BIGINT ord WHERE false"

    return (
        f"b0 AS ({side(B.BEFORE, SHAPES_BEFORE)}),"
        " b AS (SELECT cr, tbl, nk, k, CASE WHEN tbl = 'customer' AND col = 'c_acctbal' THEN 'c_balance' ELSE col END AS col,"
        f" val, ord FROM b0), a AS ({side(B.AFTER, SHAPES_AFTER)})"
    )


DIFFERENT = "b.val <> a.val AND NOT coalesce(TRY_CAST(b.val AS DOUBLE) = TRY_CAST(a.val AS DOUBLE), false)"


def log_cte(only: str | None = None) -> str:
    """CTE ``log`` with the ten columns and ``copies``, from ``b`` and ``a``.

    ``met`` holds all pairs of differing cells; those of repeated keys are listed apart.
    """
    def row(kind, nb, na, key, col, old, new, note="''", copies="1"):
        return f"'{kind}', {nb}, {na}, {key}, {col}, {old}, {new}, {note}, {copies}"

    return f"""
{long_forms(only)},
bt AS (SELECT DISTINCT cr, tbl, nk FROM b), atb AS (SELECT DISTINCT cr, tbl, nk FROM a),
bk AS (SELECT DISTINCT cr, tbl, k FROM b), ak AS (SELECT DISTINCT cr, tbl, k FROM a),
bc AS (SELECT DISTINCT cr, tbl, col FROM b), ac AS (SELECT DISTINCT cr, tbl, col FROM a),
rep AS (SELECT cr, tbl, k FROM b WHERE ord = 0 GROUP BY ALL HAVING count(*) > 1
 UNION SELECT cr, tbl, k FROM a WHERE ord = 0 GROUP BY ALL HAVING count(*) > 1),
met AS (SELECT b.cr, b.tbl, b.k, b.col, b.nk AS nb, a.nk AS na, b.val AS old, a.val AS new, rep.k IS NOT NULL AS apart
 FROM b JOIN a USING (cr, tbl, k, col) LEFT JOIN rep USING (cr, tbl, k) WHERE {DIFFERENT}),
log0(cr, tbl, ct, nb, na, k, col, old, new, note, copies) AS (
SELECT cr, tbl, {row('table_add', 'NULL', 'nk', "''", "''", "''", "''", "'Table only present in after/'")}
FROM atb WHERE (cr, tbl) NOT IN (SELECT (cr, tbl) FROM bt)
UNION ALL SELECT cr, tbl, {row('row_add', 'NULL', 'nk', 'k', 'col', "''", 'val', f"'{TABLE_ADD_NOTE}'")}
FROM a WHERE (cr, tbl) NOT IN (SELECT (cr, tbl) FROM bt)
UNION ALL SELECT cr, tbl, {row('column_rename', '2', '2', "''", "'c_acctbal->c_balance'", "'c_acctbal'", "'c_balance'", "'Declared in ColumnRenames'")}
FROM bt WHERE tbl = 'customer'
UNION ALL SELECT ac.cr, ac.tbl, {row('column_add', 'bt.nk', 'atb.nk', "''", 'ac.col', "''", "''")}
FROM ac JOIN bt USING (cr, tbl) JOIN atb USING (cr, tbl)
WHERE NOT EXISTS (SELECT 1 FROM bc WHERE (bc.cr, bc.tbl, bc.col) = (ac.cr, ac.tbl, ac.col))
UNION ALL SELECT bc.cr, bc.tbl, {row('column_delete', 'bt.nk', 'atb.nk', "''", 'bc.col', "''", "''")}
FROM bc JOIN bt USING (cr, tbl) JOIN atb USING (cr, tbl)
WHERE NOT EXISTS (SELECT 1 FROM ac WHERE (ac.cr, ac.tbl, ac.col) = (bc.cr, bc.tbl, bc.col))
UNION ALL SELECT a.cr, a.tbl, {row('row_add', 'bt.nk', 'a.nk', 'a.k', 'a.col', "''", 'a.val')}
FROM a JOIN bt USING (cr, tbl) WHERE NOT EXISTS (SELECT 1 FROM bk WHERE (bk.cr, bk.tbl, bk.k) = (a.cr, a.tbl, a.k))
UNION ALL SELECT b.cr, b.tbl, {row('row_delete', 'b.nk', 'atb.nk', 'b.k', 'b.col', 'b.val', "''")}
FROM b JOIN atb USING (cr, tbl) JOIN ac USING (cr, tbl, col)
WHERE NOT EXISTS (SELECT 1 FROM ak WHERE (ak.cr, ak.tbl, ak.k) = (b.cr, b.tbl, b.k))
UNION ALL SELECT cr, tbl, {row('value_update', 'nb', 'na', 'k', 'col', 'old', 'new')} FROM met WHERE NOT apart
UNION ALL SELECT DISTINCT cr, tbl, {row('value_update', 'nb', 'na', 'k', 'col', 'old', 'NULL', f"'{CROWDED_NOTE}'", '0')}
FROM met WHERE apart
UNION ALL SELECT cr, tbl, {row('value_update', 'nb', 'na', 'k', 'col', 'NULL', 'new', f"'{CROWDED_NOTE}'", 'count(*)')}
FROM met WHERE apart GROUP BY cr, tbl, nb, na, k, col, new
UNION ALL SELECT a.cr, a.tbl, {row('value_update', 'bt.nk', 'a.nk', 'a.k', 'a.col', "''", 'a.val', f"'{FRESH_NOTE}'")}
FROM a JOIN bt USING (cr, tbl) JOIN bk USING (cr, tbl, k)
WHERE NOT EXISTS (SELECT 1 FROM bc WHERE (bc.cr, bc.tbl, bc.col) = (a.cr, a.tbl, a.col))),
log AS (SELECT cr AS change_request_id, tbl AS table_name, ct AS change_type, CAST(nb AS INTEGER) AS n_keys_before,
 CAST(na AS INTEGER) AS n_keys_after, k AS key_tuple, col AS column_name, old AS old_value, new AS new_value,
 note AS notes, copies FROM log0)"""


def with_log(select: str, only: str | None = None) -> str:
    return f"WITH {log_cte(only)} {select}"


def hash_of_log() -> str:
    """Four sums over all rows: parts of the MD5 sum of a row's cells, each led by its length."""
    cells = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in LOG.split(", "))
    parts = (f"coalesce(sum(CAST('0x' || substr(md5({cells}), {8 * i + 1}, 8) AS BIGINT)), 0)" for i in range(4))
    return f"concat_ws('-', {', '.join(parts)})"


def of_type(kind: str, extra: str = "") -> str:
    return with_log(f"SELECT {LOG} FROM log WHERE change_type = '{kind}' {extra}", "orders")


# --- books ----------------------------------------------------------------------------------

BOOK_ROWS = """
bb AS (SELECT 'CR_1' AS cr, c_name AS tbl, 2 AS nk, ['id', 'balance', lower(c_mktsegment)] AS cols, c_mktsegment AS seg,
       c_nationkey AS nation, c_acctbal AS bal FROM customer),
ba AS (SELECT 'CR_1' AS cr, c_name AS tbl, CASE WHEN c_nationkey < 5 THEN 3 ELSE 2 END AS nk,
       list_concat(list_concat(['id', CASE WHEN c_mktsegment = 'BUILDING' THEN 'amount' ELSE 'balance' END],
         CASE WHEN c_mktsegment = 'MACHINERY' THEN [] ELSE [lower(c_mktsegment)] END),
         CASE WHEN c_nationkey >= 20 THEN ['n' || c_nationkey] ELSE [] END) AS cols, c_mktsegment AS seg,
       c_nationkey AS nation FROM customer WHERE c_acctbal >= 0
       UNION ALL SELECT 'CR_1', s_name, 2, ['id', 'balance'], NULL, NULL FROM supplier)"""
BOOK_LOG = BOOK_ROWS + """,
pairs AS (SELECT bb.tbl, bb.nk AS nb, ba.nk AS na, bb.seg, bb.nation FROM bb JOIN ba USING (tbl)),
blog AS (
SELECT 'CR_1' AS change_request_id, tbl AS table_name, 'table_add' AS change_type, NULL::INTEGER AS n_keys_before,
 nk::INTEGER AS n_keys_after, '' AS key_tuple, '' AS column_name, '' AS old_value, '' AS new_value,
 'Table only present in after/' AS notes FROM ba WHERE seg IS NULL
UNION ALL SELECT 'CR_1', tbl, 'key_count_change', nb, na, '', '', nb::VARCHAR, na::VARCHAR, 'Structural key-count change'
 FROM pairs WHERE nb <> na
UNION ALL SELECT 'CR_1', tbl, 'column_rename', nb, na, '', 'balance->amount', 'balance', 'amount',
 'Declared in ColumnRenames' FROM pairs WHERE seg = 'BUILDING'
UNION ALL SELECT 'CR_1', tbl, 'column_add', nb, na, '', 'n' || nation, '', '', '' FROM pairs WHERE nation >= 20
UNION ALL SELECT 'CR_1', tbl, 'column_delete', nb, na, '', 'machinery', '', '', '' FROM pairs WHERE seg = 'MACHINERY')"""


def book_log(select: str) -> str:
    return f"WITH {BOOK_LOG} {select}"


BOOK_CELLS = """
SELECT c_name AS table_name, CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS balance,
 o_orderstatus AS status, c_mktsegment AS seg, c_nationkey AS nation, c_acctbal AS bal
FROM orders JOIN customer ON o_custkey = c_custkey"""

# --- conflicts ------------------------------------------------------------------------------


def set_text(c: str) -> str:
    return f"list_aggregate(list_sort(list_distinct(list({c}))), 'string_agg', ', ')"


OVERLAPS = f"""
SELECT 'cell_overlap' AS conflict_type, table_name, key_tuple, column_name, {set_text('change_request_id')} AS change_request_ids,
 {set_text('change_type')} AS change_types, {set_text('old_value')} AS old_values, {set_text('new_value')} AS new_values,
 '{OVERLAP_NOTE}' AS notes, 'N' AS resolved
FROM log WHERE change_type IN ('value_update', 'row_add', 'row_delete') AND column_name <> ''
GROUP BY table_name, key_tuple, column_name HAVING count(DISTINCT change_request_id) >= 2"""


def collisions(log: str) -> str:
    return f"""
SELECT 'structural_collision' AS conflict_type, table_name, '' AS key_tuple, '' AS column_name,
 {set_text('change_request_id')} AS change_request_ids, {set_text('change_type')} AS change_types, '' AS old_values,
 '' AS new_values, '{STRUCTURAL_NOTE}' AS notes, 'N' AS resolved
FROM {log} WHERE change_type IN ('key_count_change', 'column_add', 'column_delete', 'column_rename', 'table_add')
GROUP BY table_name HAVING count(DISTINCT change_request_id) >= 2"""


FILLS = f"""
SELECT 'missing_row_column_fill' AS conflict_type, k.table_name, k.key_tuple, c.column_name,
 list_aggregate(list_sort(list_distinct(list_append(k.crs, c.cr))), 'string_agg', ', ') AS change_request_ids,
 'column_add, row_add' AS change_types, '' AS old_values, '' AS new_values, '{FILL_NOTE}' AS notes, 'N' AS resolved
FROM (SELECT table_name, key_tuple, list(DISTINCT change_request_id) AS crs FROM log
      WHERE change_type = 'row_add' AND key_tuple <> '' GROUP BY ALL) k
JOIN (SELECT table_name, column_name, max(change_request_id) AS cr FROM log WHERE change_type = 'column_add' GROUP BY ALL) c
  ON k.table_name = c.table_name
WHERE NOT EXISTS (SELECT 1 FROM log v WHERE v.change_type IN ('row_add', 'value_update') AND v.table_name = k.table_name
  AND v.key_tuple = k.key_tuple AND v.column_name = c.column_name)"""
CONFLICTS = f"conflicts AS ({OVERLAPS} UNION ALL {collisions('log')} UNION ALL {FILLS})"

STEP = "CASE change_request_id WHEN 'CR_A' THEN 1 ELSE 2 END"
SUMMARY = f"""
SELECT r.change_request_id, r.description, coalesce(t.touched, '') AS tables_touched,
 coalesce(n_value_changes, 0) AS n_value_changes, coalesce(n_row_adds, 0) AS n_row_adds,
 coalesce(n_row_deletes, 0) AS n_row_deletes, coalesce(n_column_changes, 0) AS n_column_changes,
 coalesce(n_key_count_changes, 0) AS n_key_count_changes
FROM (VALUES ('CR_A', 'prices and deletions'), ('CR_B', 'bands and reviews')) r(change_request_id, description)
LEFT JOIN (SELECT change_request_id, CAST(sum(copies) FILTER (change_type = 'value_update') AS BIGINT) AS n_value_changes,
  count(*) FILTER (change_type = 'row_add') AS n_row_adds, count(*) FILTER (change_type = 'row_delete') AS n_row_deletes,
  count(*) FILTER (change_type IN ('column_add', 'column_delete', 'column_rename')) AS n_column_changes,
  count(*) FILTER (change_type = 'key_count_change') AS n_key_count_changes FROM log GROUP BY 1) n USING (change_request_id)
LEFT JOIN (SELECT cr, string_agg(tbl, ', ' ORDER BY tbl) AS touched FROM atb GROUP BY 1) t ON t.cr = r.change_request_id"""

# --- apply ----------------------------------------------------------------------------------


def orders_row(replace: dict, extra: str) -> str:
    return f"concat({row_text('orders', ['o_orderkey'], replace=replace)}, ',', {extra})"


ADDED_A = "o_totalprice BETWEEN 250000 AND 255000"
DELETED = "(o_totalprice < 2000 OR (o_orderstatus = 'F' AND o_totalprice < 5000))"
NEW_PRICE = (
    "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 470000 THEN o_totalprice + 2"
    " WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN o_totalprice + 1 ELSE o_totalprice END"
)
NEW_PRIORITY = "CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN '0-REVIEW' ELSE o_orderpriority END"
BAND = "CASE WHEN o_totalprice < 2000 THEN '' WHEN o_totalprice >= 250000 THEN 'high' ELSE 'low' END"
UPDATED = {"o_totalprice": cell(f"({NEW_PRICE})", "d"), "o_orderpriority": f"({NEW_PRIORITY})"}
ADDED_KEY = {"o_orderkey": "CAST(o_orderkey + 10000000 AS VARCHAR)"}


def applied_orders(band_of_added: str = "''") -> str:
    """Orders rows after both requests."""
    return (
        f"SELECT 'orders' AS table_name, {orders_row(UPDATED, BAND)} AS cells FROM orders WHERE NOT {DELETED}"
        f" UNION ALL SELECT 'orders', {orders_row(ADDED_KEY, band_of_added)} FROM orders WHERE {ADDED_A}"
    )


def rendered(table: str, body: str, header: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 1 AS section, '{header}' AS value"
        f" UNION ALL SELECT '{table}', 2, '*,' || cells FROM ({body})"
    )


def _row_select(table: str, select: str, keys: list[str], shape: str) -> str:
    return f"SELECT '{table}' AS table_name, {row_text(shape, keys)} AS cells FROM ({sql(select)})"


def names(shape: str, keys: list[str]) -> list[str]:
    return keys + [c for c, _ in columns(shape) if c not in keys]


PART_APPLIED = (
    "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 45 THEN CAST(p_size AS VARCHAR) || '.5' ELSE"
    " CAST(p_size AS VARCHAR) END AS p_size, p_retailprice FROM part"
)
LINEITEM_UPDATED = B.LINEITEM_A
CUSTOMER_APPLIED = B.CUSTOMER_A
ALL_TABLES = " UNION ALL ".join([
    rendered("orders", applied_orders(), "!2," + ",".join(names("orders_b", ["o_orderkey"]))),
    rendered("lineitem", _row_select("lineitem", LINEITEM_UPDATED, B.LINEITEM_KEYS, "lineitem"),
             "!5," + ",".join(names("lineitem", B.LINEITEM_KEYS))),
    rendered("customer", _row_select("customer", CUSTOMER_APPLIED, ["c_custkey"], "customer_a"),
             "!2," + ",".join(names("customer_a", ["c_custkey"]))),
    rendered("part", _row_select("part", PART_APPLIED, ["p_partkey"], "part_b"),
             "!2," + ",".join(names("part_b", ["p_partkey"]))),
    rendered("supplier",
             "SELECT concat_ws(',', %s) AS cells FROM supplier" % ", ".join(
                 cell(c, k) for c, k in sorted(columns("supplier"))),
             "!2," + ",".join(sorted(names("supplier", ["s_suppkey"])))),
])

# --- review ---------------------------------------------------------------------------------

REVIEW_COLUMNS = {
    "orders": names("orders_b", ["o_orderkey"]), "lineitem": names("lineitem", B.LINEITEM_KEYS),
    "customer": names("customer_a", ["c_custkey"]), "part": names("part_b", ["p_partkey"]),
    "supplier": names("supplier", ["s_suppkey"]),
}
REVIEW = f"""
rcol AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{c}', {i})" for t, cs in REVIEW_COLUMNS.items() for i, c in enumerate(cs))})
 v(table_name, column_name, ord)),
wanted AS (SELECT DISTINCT table_name, key_tuple FROM log WHERE change_type IN ('row_add', 'row_delete', 'value_update')
 AND key_tuple <> ''),
stat AS (SELECT table_name, key_tuple, CASE WHEN bool_or(change_type = 'row_delete') THEN 'DELETE'
 WHEN bool_or(change_type = 'row_add') THEN 'ADD' ELSE '' END AS status FROM log WHERE key_tuple <> '' GROUP BY ALL),
seed_a AS (SELECT tbl AS table_name, k AS key_tuple, col AS column_name, arg_max(val, cr) AS val FROM a GROUP BY ALL),
seed_b AS (SELECT tbl AS table_name, k AS key_tuple, col AS column_name, arg_min(val, cr) AS val FROM b0
 WHERE NOT EXISTS (SELECT 1 FROM ak WHERE ak.tbl = b0.tbl AND ak.k = b0.k) GROUP BY ALL),
seed AS (SELECT * FROM seed_a UNION ALL SELECT * FROM seed_b),
ext AS (SELECT table_name, key_tuple, column_name,
 arg_max(CASE WHEN change_type = 'row_delete' THEN old_value ELSE new_value END,
   {STEP} * 10 + CASE WHEN change_type = 'row_delete' THEN 1 ELSE 0 END) AS val
 FROM log WHERE change_type IN ('row_add', 'row_delete') GROUP BY ALL),
multi AS (SELECT tbl AS table_name, count(DISTINCT cr) > 1 AS many FROM atb GROUP BY 1),
upd AS (SELECT table_name, key_tuple, column_name, CASE WHEN count(*) > count(DISTINCT change_request_id)
 THEN CAST(sum(copies) AS BIGINT) || ' updates, see change log' ELSE string_agg(old_value || ' -> ' || new_value ||
 CASE WHEN many THEN ' [' || change_request_id || ']' ELSE '' END, ' | ' ORDER BY change_request_id) END AS shown
 FROM log JOIN multi USING (table_name) WHERE change_type = 'value_update' GROUP BY ALL),
grid AS (SELECT w.table_name, w.key_tuple, s.status, r.column_name, r.ord,
 coalesce(upd.shown, ext.val, seed.val, '') AS cell
 FROM wanted w JOIN stat s USING (table_name, key_tuple) JOIN rcol r USING (table_name)
 LEFT JOIN upd USING (table_name, key_tuple, column_name) LEFT JOIN ext USING (table_name, key_tuple, column_name)
 LEFT JOIN seed USING (table_name, key_tuple, column_name))"""

SPELLINGS = [
    "'00' || o_orderkey", "o_orderkey || '.0'", "o_orderkey || 'e3'", "'-' || o_orderkey", "o_orderkey || '.250'",
    "'0.0000' || (o_orderkey + 1)", "(o_orderkey + 1) || 'e18'", "o_orderkey || '_000'", "o_orderpriority", "''",
    "o_custkey || 'd'",
]


def norm(raw: str) -> str:
    number = f"TRY_CAST({raw} AS DOUBLE)"
    return (
        f"CASE WHEN {number} IS NULL THEN {raw} WHEN {number} = floor({number}) AND abs({number}) < 1e15"
        f" THEN CAST(CAST({number} AS BIGINT) AS VARCHAR) ELSE CAST({number} AS VARCHAR) END"
    )


PAIRS = [
    ("CAST(o_custkey AS VARCHAR)", "o_custkey || '.0'"), ("CAST(o_custkey AS VARCHAR)", "CAST(o_custkey + 1 AS VARCHAR)"),
    ("o_orderpriority", "o_orderstatus"), ("''", "CAST(o_custkey AS VARCHAR)"), ("o_custkey || '.10'", "o_custkey || '.1'"),
    ("o_custkey || 'e1'", "o_custkey || '0'"), ("''", "''"),
]
REQUEST_SHEET = """
SELECT c_name AS change_request_id, CAST(CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE 0 END AS INTEGER) AS "order",
 c_acctbal > 1000 AS include, c_mktsegment = 'BUILDING' AS approved, c_mktsegment AS description, '' AS notes,
 CAST(c_custkey AS BIGINT) AS sheet_pos FROM customer"""
RAW_CELLS = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['*', o_orderkey::VARCHAR, o_orderstatus]
 WHEN 'O' THEN ['*', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority]
 ELSE ['*', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, 'x', 'y'] END AS cells FROM orders"""
TWO_KEYS = ["l_orderkey", "l_linenumber"]


def two_key_log(keys: list[str]) -> str:
    """Lineitem log under a key that repeats: pairs of unique keys, counted old and new cells of the others."""
    before = long_form("CR_A", "lineitem", B.LINEITEM, keys, "lineitem")
    after = long_form("CR_A", "lineitem", B.LINEITEM_A, keys, "lineitem")
    cls = "coalesce('n' || TRY_CAST(val AS DOUBLE), 't' || val) AS cls"
    free = f"col NOT IN ({', '.join(repr(k) for k in keys)})"
    return f"""
b AS ({before}), a AS ({after}), bk AS (SELECT DISTINCT k FROM b), ak AS (SELECT DISTINCT k FROM a),
bv AS (SELECT k, col, val, {cls}, count(*) AS n FROM b GROUP BY ALL),
av AS (SELECT k, col, val, {cls}, count(*) AS n FROM a GROUP BY ALL),
bc AS (SELECT k, col, cls, sum(n) AS n FROM bv GROUP BY ALL), ac AS (SELECT k, col, cls, sum(n) AS n FROM av GROUP BY ALL),
bt AS (SELECT k, col, sum(n) AS n FROM bv GROUP BY ALL), tot AS (SELECT k, col, sum(n) AS n FROM av GROUP BY ALL),
l AS (SELECT 'row_add' AS change_type, k AS key_tuple, col AS column_name, '' AS old_value, val AS new_value, n AS copies
 FROM av WHERE k NOT IN (SELECT k FROM bk)
UNION ALL SELECT 'row_delete', k, col, val, '', n FROM bv WHERE k NOT IN (SELECT k FROM ak)
UNION ALL SELECT 'value_update', k, col, b.val, a.val, 1 FROM bv b JOIN av a USING (k, col)
 JOIN bt USING (k, col) JOIN tot USING (k, col) WHERE bt.n = 1 AND tot.n = 1 AND {DIFFERENT} AND {free}
UNION ALL SELECT 'value_update', k, col, val, NULL, 0 FROM bv JOIN bt USING (k, col) JOIN tot USING (k, col)
 LEFT JOIN ac USING (k, col, cls) WHERE (bt.n > 1 OR tot.n > 1) AND tot.n > coalesce(ac.n, 0) AND {free}
UNION ALL SELECT 'value_update', k, col, NULL, val, av.n * (bt.n - coalesce(bc.n, 0)) FROM av JOIN bt USING (k, col)
 JOIN tot USING (k, col) LEFT JOIN bc USING (k, col, cls) WHERE (bt.n > 1 OR tot.n > 1) AND bt.n > coalesce(bc.n, 0) AND {free})"""


def crowded_log(key: str) -> str:
    """Totals of the pairs under one crowded key, from counts per value class."""
    before = long_form("CR_A", "lineitem", B.LINEITEM, [key], "lineitem")
    after = long_form("CR_A", "lineitem", B.LINEITEM_A, [key], "lineitem")
    cls = "coalesce('n' || TRY_CAST(val AS DOUBLE), 't' || val) AS cls"
    return f"""
WITH b AS ({before}), a AS ({after}), bk AS (SELECT DISTINCT k FROM b), ak AS (SELECT DISTINCT k FROM a),
bv AS (SELECT k, col, val, {cls}, count(*) AS n FROM b GROUP BY ALL),
av AS (SELECT k, col, val, {cls}, count(*) AS n FROM a GROUP BY ALL),
bc AS (SELECT k, col, cls, sum(n) AS n FROM bv GROUP BY ALL), ac AS (SELECT k, col, cls, sum(n) AS n FROM av GROUP BY ALL),
bt AS (SELECT k, col, sum(n) AS n FROM bv GROUP BY ALL), tot AS (SELECT k, col, sum(n) AS n FROM av GROUP BY ALL),
olds AS (SELECT k, col, val FROM bv JOIN tot USING (k, col) LEFT JOIN ac USING (k, col, cls)
 WHERE tot.n > coalesce(ac.n, 0)),
news AS (SELECT k, col, val, av.n * (bt.n - coalesce(bc.n, 0)) AS copies FROM av JOIN bt USING (k, col)
 LEFT JOIN bc USING (k, col, cls) WHERE bt.n > coalesce(bc.n, 0)),
upd AS (SELECT k, col, sum(copies) AS copies, count(*) AS n_new FROM news WHERE col <> '{key}' GROUP BY ALL),
old_n AS (SELECT k, col, count(*) AS n_old FROM olds GROUP BY ALL)
SELECT 'value_update' AS change_type, k AS key_tuple, col AS column_name, CAST(copies AS BIGINT) AS copies, n_old, n_new
FROM upd JOIN old_n USING (k, col)
UNION ALL SELECT 'row_add', k, col, sum(n)::BIGINT, 1, count(*) FROM av WHERE k NOT IN (SELECT k FROM bk) GROUP BY k, col
UNION ALL SELECT 'row_delete', k, col, sum(n)::BIGINT, count(*), 1 FROM bv WHERE k NOT IN (SELECT k FROM ak) GROUP BY k, col"""


def keyed_orders_log() -> str:
    before = long_form("CR_K", "orders", B.ORDERS, ["o_orderkey", "o_custkey"], "orders")
    after = long_form("CR_K", "orders", B.ORDERS_KEYED, ["o_orderkey", "o_custkey"], "orders_k")
    head = "'CR_K' AS change_request_id, 'orders' AS table_name"
    return f"""
WITH b AS ({before}), a AS ({after}), ak AS (SELECT DISTINCT k FROM a)
SELECT {head}, 'key_count_change' AS change_type, 2::INTEGER AS n_keys_before, 3::INTEGER AS n_keys_after, '' AS key_tuple,
 '' AS column_name, '2' AS old_value, '3' AS new_value, 'Structural key-count change' AS notes
UNION ALL SELECT 'CR_K', 'orders', 'column_add', 2, 3, '', 'o_price', '', '', ''
UNION ALL SELECT 'CR_K', 'orders', 'column_delete', 2, 3, '', unnest(['o_totalprice', 'o_orderpriority']), '', '', ''
UNION ALL SELECT 'CR_K', 'orders', 'row_delete', 2, 3, k, col, val, '', '' FROM b
 WHERE k NOT IN (SELECT k FROM ak) AND col NOT IN ('o_totalprice', 'o_orderpriority')
UNION ALL SELECT 'CR_K', 'orders', 'value_update', 2, 3, k, col, '', val, '{FRESH_NOTE}' FROM a WHERE col = 'o_price'"""


CLEAN_BODY = (
    r"regexp_replace(translate(regexp_replace(text, '[^\x01-\x7f\xa0-\xff]', '?', 'g'),"
    r" ',' || chr(10) || chr(13) || chr(9) || chr(11) || chr(12), '      '), '^\s+|\s+$', '', 'g')"
)

ORACLES: dict[str, str] = {
    "diff_value_update": of_type("value_update", "AND notes = ''"),
    "diff_row_add": of_type("row_add"),
    "diff_row_delete": of_type("row_delete"),
    "diff_new_column_fill": of_type("value_update", "AND notes <> ''"),
    "diff_lineitem": with_log(f"SELECT {LOG} FROM log", "lineitem"),
    "diff_repeated_keys": f"WITH {two_key_log(TWO_KEYS)} SELECT change_type, key_tuple, column_name, old_value, new_value,"
                          " CAST(sum(copies) AS BIGINT) AS copies FROM l GROUP BY ALL",
    "diff_crowded_keys": crowded_log("l_returnflag"),
    "diff_table_add": with_log(f"SELECT {LOG} FROM log", "supplier"),
    "diff_key_count": keyed_orders_log(),
    "full_changelog": with_log(f"SELECT {LOG} FROM log"),
    "key_set_ops": f"""
WITH {long_forms()}, bk AS (SELECT DISTINCT cr AS change_request_id, tbl AS table_name, k AS key_tuple FROM b),
ak AS (SELECT DISTINCT cr AS change_request_id, tbl AS table_name, k AS key_tuple FROM a)
SELECT *, 'added' AS part FROM (SELECT * FROM ak EXCEPT SELECT * FROM bk)
UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM bk EXCEPT SELECT * FROM ak)
UNION ALL SELECT *, 'common' FROM (SELECT * FROM ak INTERSECT SELECT * FROM bk)""",
    "table_pairing": f"""
WITH {BOOK_ROWS} SELECT 'CR_1' AS change_request_id, tbl AS table_name,
CASE WHEN ba.nk IS NULL THEN 'before_only' WHEN bb.nk IS NULL THEN 'after_only' ELSE 'both' END AS kind,
bb.nk AS n_before, ba.nk AS n_after FROM bb FULL JOIN ba USING (tbl)""",
    "align_renames": "SELECT c_name AS table_name, concat_ws(',', 'id', CASE WHEN c_mktsegment = 'BUILDING' THEN 'amount'"
                     " ELSE 'balance' END, lower(c_mktsegment)) AS columns FROM customer",
    "diff_before_only": "SELECT 'CR_1' AS change_request_id, c_name AS table_name, '[CR_1] Table ''' || c_name ||"
                        " ''' exists only in before/ — skipped (no automatic deletes).' AS message"
                        " FROM customer WHERE c_acctbal < 0",
    "diff_column_rename": book_log(f"SELECT {LOG} FROM blog WHERE change_type = 'column_rename'"),
    "diff_column_add": book_log(f"SELECT {LOG} FROM blog WHERE change_type = 'column_add'"),
    "diff_column_delete": book_log(f"SELECT {LOG} FROM blog WHERE change_type = 'column_delete'"),
    "normalize_key": "SELECT o_orderkey, CAST(nth AS INTEGER) AS nth, raw, " + norm("raw") + " AS part FROM (SELECT o_orderkey,"
                     f" unnest(range({len(SPELLINGS)})) AS nth, unnest([{', '.join(SPELLINGS)}]) AS raw FROM orders)",
    "composite_key": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('|', l_orderkey, l_linenumber,"
                     " l_partkey, l_returnflag) AS key_tuple FROM lineitem",
    "cells_differ": "SELECT o_orderkey, CAST(nth AS INTEGER) AS nth, d AS differs, d AS class_differs FROM (SELECT o_orderkey,"
                    f" unnest(range({len(PAIRS)})) AS nth, unnest([" + ", ".join(
                        f"{o} <> {n} AND NOT coalesce(TRY_CAST({o} AS DOUBLE) = TRY_CAST({n} AS DOUBLE), false)" for o, n in PAIRS
                    ) + "]) AS d FROM orders)",
    "yn_flag": """
WITH w AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice > 250000 THEN ' Y ' ELSE ' y ' END
 WHEN 'O' THEN CASE WHEN o_totalprice > 250000 THEN 'True' ELSE 'no' END
 ELSE CASE WHEN o_totalprice > 250000 THEN '1' ELSE o_orderpriority END END AS word FROM orders)
SELECT o_orderkey, word, upper(trim(word)) IN ('Y', 'YES', 'TRUE', '1') AS flag FROM w""",
    "control_tables": REQUEST_SHEET,
    "included_requests": f'SELECT change_request_id, "order", sheet_pos FROM ({REQUEST_SHEET}) WHERE include AND approved',
    "declared_renames": """
SELECT 'CR_' || c_nationkey AS change_request_id, c_name AS table_name,
 CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS INTEGER) AS n_renames, 'balance' AS first_old,
 CASE WHEN c_acctbal > 5000 THEN 'latest' ELSE 'b' || c_nationkey END AS first_new FROM customer""",
    "key_count_approved": """
SELECT 'CR_' || c_nationkey AS change_request_id, c_name AS table_name,
 CASE WHEN c_acctbal > 0 THEN c_acctbal > 5000 WHEN n_nationkey <> 7 THEN n_regionkey < 2 ELSE false END AS approved
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "conflict_cell_overlap": with_log(OVERLAPS),
    "conflict_missing_fill": with_log(FILLS),
    "conflict_structural": f"""
WITH {BOOK_LOG}, both_logs AS (SELECT * FROM blog UNION ALL
 SELECT 'CR_2' AS change_request_id, * EXCLUDE (change_request_id) FROM blog)
{collisions('both_logs')}""",
    "conflicts_flat": with_log(f", {CONFLICTS} SELECT * FROM conflicts"),
    "conflict_roundtrip": with_log(
        f", {CONFLICTS} SELECT conflict_type, table_name, key_tuple, column_name, notes,"
        " replace(change_request_ids, ', ', '+') AS change_request_ids, resolved FROM conflicts"),
    "summary_by_cr": with_log(SUMMARY),
    "summary_conflict_flag": with_log(
        f", {CONFLICTS} SELECT cr AS change_request_id, CASE WHEN n > 0 THEN 'Y' ELSE 'N' END AS has_conflict,"
        " CASE WHEN n > 0 THEN 'CONFLICT' ELSE 'OK' END AS status FROM (SELECT unnest(['CR_A', 'CR_B']) AS cr) r"
        " CROSS JOIN LATERAL (SELECT count(*) AS n FROM conflicts c WHERE contains(c.change_request_ids, r.cr)) x"),
    "ordered_log": with_log(
        f"SELECT {STEP}::INTEGER AS step, table_name, change_type, key_tuple, column_name, concat_ws('/', lpad(({STEP})::VARCHAR, 4, '0'),"
        " table_name, change_type, key_tuple, column_name) AS place FROM log"),
    "changed_keys": with_log(
        "SELECT DISTINCT table_name, key_tuple FROM log WHERE change_type IN ('row_add', 'row_delete', 'value_update')"
        " AND key_tuple <> ''"),
    "unresolved_conflicts": with_log(
        f", {CONFLICTS} SELECT 'conflict' AS section, '' AS change_request_id, table_name, '' AS change_type, '' AS key_tuple,"
        " '' AS column_name, 'Unresolved conflict (' || conflict_type || ') on table ' || table_name || ' key=''' || key_tuple"
        " || ''' col=''' || column_name || ''' CRs=[''' || replace(change_request_ids, ', ', ''', ''') || ''']' AS message,"
        " 'FAIL' AS severity FROM conflicts"),
    "validate_keys": with_log(
        f"SELECT {LOG} FROM log WHERE change_type IN ('value_update', 'row_delete') AND table_name = 'orders'"
        " AND key_tuple IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice >= 480000)"),
    "validate_tables": book_log(
        "SELECT DISTINCT change_request_id, table_name FROM blog WHERE change_type <> 'table_add' AND table_name IN"
        " (SELECT c_name FROM customer WHERE c_nationkey = 0)"),
    "validate_key_count": book_log(
        "SELECT change_request_id, table_name, n_keys_after FROM blog JOIN customer ON c_name = table_name"
        " WHERE change_type = 'key_count_change' AND c_nationkey > 0 AND c_nationkey >= 3"),
    "validate_renames": book_log(
        "SELECT change_request_id, table_name, old_value, new_value FROM blog JOIN customer ON c_name = table_name"
        " WHERE change_type = 'column_rename' AND c_nationkey = 0"),
    "validate_messages": book_log(f"""
, dear AS (SELECT c_name, c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000),
vlog AS (SELECT change_request_id, table_name, change_type FROM blog
 UNION ALL SELECT 'CR_1', c_name, unnest(['row_add', 'value_update']) FROM dear),
widened AS (SELECT table_name FROM blog WHERE change_type = 'key_count_change' AND n_keys_after > n_keys_before),
fails AS (
SELECT DISTINCT 'validation' AS section, change_request_id, table_name, '' AS change_type, '' AS key_tuple, '' AS column_name,
 'Table ''' || table_name || ''' not found in production (and not a table_add).' AS message, 'FAIL' AS severity
FROM vlog WHERE change_type <> 'table_add' AND table_name IN (SELECT c_name FROM customer WHERE c_nationkey = 0)
UNION ALL SELECT 'validation', change_request_id, table_name, change_type, '', '',
 'Key-count change blocked: not approved in Control.', 'FAIL' FROM blog JOIN customer ON c_name = table_name
WHERE change_type = 'key_count_change' AND c_nationkey >= 3)
SELECT * FROM fails UNION ALL
SELECT DISTINCT 'validation', change_request_id, table_name, '', '', '', 'Validation passed.', 'INFO' FROM vlog
WHERE change_type <> 'table_add' AND table_name NOT IN (SELECT table_name FROM fails)
UNION ALL SELECT 'validation', 'CR_1', c_name, 'row_add', CAST(o_orderkey AS VARCHAR), '',
 '{REPEATED_ROW}', 'WARN' FROM dear WHERE c_nationkey > 0
UNION ALL SELECT 'validation', 'CR_1', c_name, 'value_update', CAST(o_orderkey AS VARCHAR), 'extra',
 '{SHARED_FILL}', 'WARN' FROM dear WHERE c_nationkey > 0 AND c_name IN (SELECT table_name FROM widened)"""),
    "integration_report": with_log(f"""
, {CONFLICTS}, missing AS (SELECT * FROM log WHERE change_type IN ('value_update', 'row_delete') AND table_name = 'orders'
 AND key_tuple IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice >= 480000)),
passed AS (SELECT DISTINCT change_request_id, table_name FROM log WHERE table_name <> 'supplier' AND
 (change_request_id, table_name) NOT IN (SELECT (change_request_id, table_name) FROM missing))
SELECT 'FAILED' AS status, 'validate_only' AS mode, (SELECT count(*) FROM conflicts) + (SELECT count(*) FROM missing)
 + (SELECT count(*) FROM passed) AS n_messages, (SELECT count(*) FROM conflicts) + (SELECT count(*) FROM missing) AS n_failures"""),
    "apply_update": f"SELECT 'orders' AS table_name, {orders_row(UPDATED, BAND)} AS cells FROM orders",
    "apply_delete": f"SELECT 'orders' AS table_name, {row_text('orders', ['o_orderkey'])} AS cells FROM orders WHERE NOT {DELETED}",
    "apply_row_add": f"SELECT 'orders' AS table_name, {row_text('orders', ['o_orderkey'])} AS cells FROM orders UNION ALL"
                     f" SELECT 'orders', {row_text('orders', ['o_orderkey'], replace=ADDED_KEY)} FROM orders WHERE {ADDED_A}",
    "apply_table_add": "SELECT 'supplier' AS table_name, concat_ws(',', %s) AS cells FROM supplier" % ", ".join(
        cell(c, k) for c, k in sorted(columns("supplier"))) + "".join(
        " UNION ALL " + _row_select(table, select, keys, table)
        for table, select, keys in (b[1:] for b in B.BEFORE if b[0] == "CR_A" or b[1] == "part")),
    "apply_key_count": "SELECT c_name AS table_name, CAST(CASE WHEN c_nationkey < 5 AND c_acctbal >= 0 THEN 3 ELSE 2 END AS INTEGER)"
                       " AS n_keys, 'id,balance,' || lower(c_mktsegment) AS columns FROM customer",
    "apply_rename": "SELECT c_name AS table_name, 2::INTEGER AS n_keys, 'id,' || CASE WHEN c_mktsegment = 'BUILDING' AND"
                    " c_acctbal >= 0 THEN 'amount' ELSE 'balance' END || ',' || lower(c_mktsegment) AS columns FROM customer",
    "apply_column_add": f"SELECT table_name, id || ',' || balance || ',' || status || CASE WHEN nation >= 20 AND bal >= 0 THEN ','"
                        f" ELSE '' END AS cells FROM ({BOOK_CELLS})",
    "apply_column_delete": f"SELECT table_name, id || ',' || balance || CASE WHEN seg = 'MACHINERY' AND bal >= 0 THEN '' ELSE"
                           f" ',' || status END AS cells FROM ({BOOK_CELLS})",
    "apply_sequence": applied_orders(),
    "apply_all_tables": f"SELECT table_name, section, count(*) AS n_lines, CAST(sum(length(value)) AS BIGINT) AS n_chars,"
                        f" max(value) AS greatest_line FROM ({ALL_TABLES}) GROUP BY table_name, section",
    "review_grid": with_log(
        f", {REVIEW} SELECT table_name, key_tuple, status, string_agg(cell, ';' ORDER BY ord) AS cells FROM grid"
        " GROUP BY table_name, key_tuple, status"),
    "review_display": with_log(
        f", {REVIEW} SELECT table_name, key_tuple, column_name, cell AS shown FROM grid WHERE cell LIKE '% -> %'"),
    "review_order": with_log(
        f", {REVIEW} SELECT table_name, CAST(CASE status WHEN 'ADD' THEN 0 WHEN 'DELETE' THEN 2 ELSE 1 END AS INTEGER) AS status_rank,"
        " key_tuple FROM stat JOIN wanted USING (table_name, key_tuple)"),
    "review_columns": f"""
WITH {BOOK_ROWS} SELECT ba.tbl AS table_name, concat_ws(',', array_to_string(ba.cols, ','),
 CASE WHEN ba.seg = 'MACHINERY' THEN NULL END) AS columns, false AS multi_cr FROM ba""",
    "review_notes": book_log("""
SELECT DISTINCT table_name, '[CR_1] ' || change_type || ' - ' || CASE change_type WHEN 'table_add' THEN notes
 WHEN 'key_count_change' THEN old_value || ' -> ' || new_value || ' (' || notes || ')'
 WHEN 'column_rename' THEN old_value || ' -> ' || new_value ELSE column_name END AS note FROM blog"""),
    "render_lines": " UNION ALL ".join([
        rendered("sub/orders", _row_select("orders", B.ORDERS, ["o_orderkey"], "orders"),
                 "!2," + ",".join(names("orders", ["o_orderkey"]))),
        rendered("customer", _row_select("customer", B.CUSTOMER, ["c_custkey"], "customer"),
                 "!2," + ",".join(names("customer", ["c_custkey"]))),
    ]),
    "scan_marker_block": _row_select("sub/orders", B.ORDERS, ["o_orderkey"], "orders") + " UNION ALL "
                         + _row_select("customer", B.CUSTOMER, ["c_custkey"], "customer"),
    "split_cells": f"SELECT o_orderkey, CAST(unnest(range(len(cells))) AS INTEGER) AS nth, unnest(cells) AS cell FROM ({RAW_CELLS})",
    "pad_trim_cells": f"SELECT o_orderkey, concat_ws('|', cells[2], cells[3], coalesce(cells[4], '')) AS cells FROM ({RAW_CELLS})",
    "parse_key_count": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '!x' ELSE '!' || CASE WHEN c_nationkey < 9 THEN '0' ELSE ''"
                       " END || c_nationkey END AS marker, CAST(CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS INTEGER) AS n_keys"
                       " FROM customer",
    "dummy_lines": """
SELECT 'customer' AS table_name, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 3 ELSE 2 END AS section,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'about ' || c_name || ',,'
 WHEN 'FURNITURE' THEN CASE WHEN c_nationkey > 12 THEN '*,' ELSE '' END || c_name || ' ,'
 ELSE c_custkey || ',x' END AS value FROM customer
UNION ALL SELECT 'customer', 3, 'end of block'""",
    "encoding_fallback": f"""
SELECT unnest(['utf', 'latin']) AS table_name, unnest(['utf-8-sig', 'cp1252']) AS encoding, CAST(doc_id AS VARCHAR) AS doc_id,
 {CLEAN_BODY} AS body FROM documents""",
    "discover_prefer_fac": "SELECT 'r' || s_nationkey || '/' || s_name AS table_name, CASE WHEN s_nationkey < 15 THEN '.FAC'"
                           " ELSE '.csv' END AS suffix FROM supplier",
    "changelog_roundtrip": with_log(f"SELECT {LOG} FROM log"),
    "content_hash": with_log(f"SELECT count(*) AS n_rows, {hash_of_log()} AS content_hash FROM log"),
    "audit_record": with_log(
        "SELECT 'RUN' AS run_id, 'generate_changelog' AS mode, 'SUCCESS' AS final_status, count(*) AS n_rows,"
        f" CAST(sum(copies) AS BIGINT) AS n_change_rows, count(DISTINCT table_name) AS tables_affected, {hash_of_log()} AS content_hash FROM log"),
    "latest_changelog": "SELECT 'Output/ChangeLog_' || event_id AS path FROM events ORDER BY ts DESC, path DESC LIMIT 1",
}
