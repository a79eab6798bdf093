"""Marker-block text tables: a ``!N`` header line, ``*`` data lines, other lines around them.

A line's position is (file, byte offset of its split, running number in the split), so files
stay splittable and no file is read by one task. The running number comes from one and the
same scan definition everywhere, over one file listing.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.functions.cells import filled, literal, strip
from rowledger.model import BODY, HEADER, LEADING, META, POSITION, TRAILING, TableSet, empty_set, small_frame
from rowledger.sources.published import roots_of
from rowledger.storage import write_once

# File suffixes of tables, and of the parts of a written table.
TABLE_SUFFIXES = (".csv", ".fac")
PART_SUFFIX = ".txt"
NAME_GLOB = "*.[cCfFtT][sSaAxX][vVcCtT]"
HEADER_MARK = r"^!\d+$"
UTF8, CP1252, LATIN1 = "utf-8-sig", "cp1252", "latin-1"

# The bytes 0x80-0x9F as Latin-1 characters, with and without a meaning in cp1252.
C1 = [bytes([b]) for b in range(0x80, 0xA0)]
DEFINED = [b for b in C1 if b.decode(CP1252, "ignore")]
UNDEFINED = [b for b in C1 if b not in DEFINED]
LATIN1_CHARS = b"".join(DEFINED).decode(LATIN1)
CP1252_CHARS = b"".join(DEFINED).decode(CP1252)
UNDEFINED_CHARS = b"".join(UNDEFINED).decode(LATIN1)

FILE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_path", "change_request_id", "side", "table_name", "suffix", "part")]
    + [T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType()), T.StructField("root", T.StringType())]
)


# Signs with a meaning in path patterns.
GLOB_SIGNS = re.compile(r"[\\*?\[\]{},]")
NAME_SCHEMA = T.StructType([T.StructField("file_path", T.StringType())])


def split_cells(line: str) -> str:
    """Comma-separated cells without quoting, each stripped."""
    return f"transform(split({line}, ',', -1), c -> {strip('c')})"


def first_cell(line: str) -> str:
    return strip(f"substring_index({line}, ',', 1)")


def fit_cells(cells: str, n: str) -> str:
    """Pad short rows with empty cells, cut long ones."""
    return f"slice(concat({cells}, array_repeat('', {n})), 1, {n})"


def header_keys(marker: str) -> str:
    """Key count behind a ``!N`` marker."""
    return f"try_cast(substr({marker}, 2) as int)"


def decoded(line: str, encoding: str) -> str:
    """Text of a raw line in its file's encoding."""
    raw = f"decode(cast({line} as binary), 'ISO-8859-1')"
    return (
        f"case {encoding} when '{UTF8}' then {line}"
        f" when '{CP1252}' then if({raw} rlike {literal('[' + LATIN1_CHARS + ']')},"
        f" translate({raw}, {literal(LATIN1_CHARS)}, {literal(CP1252_CHARS)}), {raw}) else {raw} end"
    )


def _no_scheme(path: str) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path)


def _root(folder: str) -> str:
    """Folder as Spark will print it, without scheme."""
    return _no_scheme(folder if "://" in folder else os.path.abspath(_no_scheme(folder))).rstrip("/")


def _reader(spark: SparkSession, kind: str):
    return spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", NAME_GLOB)


def _below(folder: str, requests: list[str] | None) -> str:
    """The folder, or the folders of some change requests in it, as a pattern."""
    if requests is None:
        return folder
    return f"{folder}/{{{','.join(GLOB_SIGNS.sub(lambda m: chr(92) + m.group(), r) for r in requests)}}}"


def list_tables(spark: SparkSession, folder: str, path_fields: bool = False, requests: list[str] | None = None) -> DataFrame:
    """Table files under a folder; identity is the relative path without suffix.

    With ``path_fields`` the first two path components are the change request and the side; ``requests`` are those
    to look at. A table written in parts is the folder ``table_file=<name>``. ``.fac`` beats ``.csv``, otherwise the first
    path in order wins. A missing folder has no tables. Of a published set, the tables of its newest version are listed.
    """
    if path_fields:
        return _list_folder(spark, folder, True, requests)
    roots, published = roots_of(spark, folder)
    found = reduce(DataFrame.unionByName, (_list_folder(spark, root) for root in roots))
    return found if published is None else found.join(published, ["table_name", "suffix", "root"], "left_semi").select(*found.columns)


def _list_folder(spark: SparkSession, folder: str, path_fields: bool = False, requests: list[str] | None = None) -> DataFrame:
    try:
        files = _reader(spark, "binaryFile").load(_below(folder, requests))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return small_frame(spark, [], FILE_SCHEMA)
    path = "url_decode(replace(file_path, '+', '%2B'))"
    plain = rf"regexp_replace({path}, r'^[a-zA-Z][a-zA-Z0-9+.\-]*:(//[^/]*)?', '')"
    fields = "split(rel, '/')"
    inner = f"array_join(slice({fields}, 3, size({fields})), '/')" if path_fields else "rel"
    written = r"regexp_extract(inner, r'(^|/)table_file=([^/]+)/[^/]+$', 2)"
    # Spark skips empty files when reading, but they must not go unnoticed: take all names from the index
    names = small_frame(spark, [(f,) for f in files.inputFiles()], NAME_SCHEMA).selectExpr(
        "file_path as name_path", f"{plain} as plain"
    )
    sized = files.selectExpr(
        "_metadata.file_path as file_path", "length", "modificationTime as modified"
    ).selectExpr("*", f"{plain} as plain")
    listed = (
        names.join(sized, ["plain"], "left")
        .selectExpr("coalesce(file_path, name_path) as file_path", "plain", "coalesce(length, 0L) as length", "modified")
        .selectExpr("*", f"substr(plain, {len(_root(folder)) + 2}) as rel")
        .selectExpr(
            "file_path", "length", "modified", "rel as part", f"{inner} as inner",
            f"get({fields}, 0) as change_request_id" if path_fields else "'' as change_request_id",
            f"get({fields}, 1) as side" if path_fields else "'' as side",
        )
        .selectExpr("*", f"if({written} <> '', url_decode(replace({written}, '+', '%2B')), inner) as name")
        .selectExpr("*", r"lower(regexp_extract(name, r'(\.[^./]+)$', 1)) as kind")
        .where(F.col("kind").isin(*TABLE_SUFFIXES))
        .selectExpr("*", "substr(name, 1, length(name) - length(kind)) as table_name")
    )
    owner = ["change_request_id", "side", "table_name"]
    best = listed.groupBy(*owner).agg(
        F.expr("min_by(name, struct(kind <> '.fac', name)) as name")
    )
    return listed.join(best, [*owner, "name"]).selectExpr(
        "file_path", *owner, r"regexp_extract(name, r'(\.[^./]+)$', 1) as suffix", "part", "length", "modified",
        f"{literal(folder)} as root",
    )


@dataclass(frozen=True)
class Scan:
    """Tables found in a folder, per side, and the files that could not be read as tables."""

    files: DataFrame
    before: TableSet
    after: TableSet
    errors: DataFrame

    @property
    def tables(self) -> TableSet:
        return self.before


def _lines(spark: SparkSession, folders: list[str], files: DataFrame) -> DataFrame:
    """Raw lines of the chosen files with their positions, read and numbered once.

    Positions depend on how a scan is cut into splits, which changes with the cluster. They are only
    comparable within one scan, so all that follows works on the written lines.
    """
    raw = _reader(spark, "text").load(folders).selectExpr(
        "value", "_metadata.file_path as file_path", "_metadata.file_block_start as block",
        "monotonically_increasing_id() as line",
    )
    place = f"cast(struct(part, block, line) as {POSITION.simpleString()}) as pos"
    placed = raw.join(files.select("file_path", "change_request_id", "side", "table_name", "part"), ["file_path"]).selectExpr(
        "change_request_id", "side", "table_name", place, "value", f"{first_cell('value')} as mark"
    )
    return write_once(placed, "text-lines")


OWNER = ["change_request_id", "side", "table_name"]


def _layout(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Per table: header, end of the block, encoding.

    One pass over the written lines keeps the few that matter: all that are neither data nor blank, and those
    whose bytes tell the encoding.
    """
    plain = "(is_valid_utf8(value) and length(value) = octet_length(value))"
    raw = "decode(cast(value as binary), 'ISO-8859-1')"
    marks = write_once(
        lines.selectExpr(
            *OWNER, "pos", "mark", f"{filled('value')} and mark <> '*' as other",
            "not is_valid_utf8(value) as invalid",
            f"not {plain} and {raw} rlike {literal('[' + UNDEFINED_CHARS + ']')} as undefined",
            "value",
        ).where("other or invalid or undefined"),
        "marks",
    )
    per_table = marks.groupBy(*OWNER).agg(
        F.expr(f"min(struct(pos, value)) filter (where other and mark rlike r'{HEADER_MARK}') as header"),
        F.expr(
            f"case when not max(invalid) then '{UTF8}' when not max(undefined) then '{CP1252}'"
            f" else '{LATIN1}' end as encoding"
        ),
    )
    ends = (
        marks.where("other").join(per_table.selectExpr(*OWNER, "header.pos as start"), OWNER)
        .where("pos > start").groupBy(*OWNER).agg(F.expr("min(pos) as stop"))
    )
    found = files.groupBy(*OWNER).agg(
        F.expr("min(suffix) as suffix"), F.expr("sum(length) as length"), F.expr("min(file_path) as source_path")
    )
    cells = split_cells(decoded("header.value", "encoding"))
    return write_once(
        found.join(per_table, OWNER, "left").join(ends, OWNER, "left")
        .selectExpr(*OWNER, "suffix", "length", "source_path", "encoding", "header.pos as start", "stop", f"{cells} as cells")
        .selectExpr(
            *OWNER, "suffix", "length", "source_path", f"coalesce(encoding, '{UTF8}') as encoding", "start", "stop",
            f"{header_keys('get(cells, 0)')} as n_keys", "slice(cells, 2, size(cells)) as columns",
        ),
        "layout",
    )


def _problems(layout: DataFrame) -> DataFrame:
    problem = (
        "case when length = 0 then 'Empty CSV'"
        " when start is null then 'no !N header row found'"
        " when n_keys is null then 'Invalid key-count marker'"
        " when n_keys < 1 then concat('n_keys must be >= 1, got ', n_keys)"
        " when n_keys - 1 > size(columns) then"
        " concat('n_keys=', n_keys, ' exceeds available columns (', size(columns), ')') end"
    )
    return layout.selectExpr(*OWNER, "source_path", f"{problem} as problem").where("problem is not null").selectExpr(
        *OWNER, "concat(problem, ' in ', source_path) as message"
    )


def scan_tables(spark: SparkSession, folder: str, path_fields: bool = False, requests: list[str] | None = None) -> Scan:
    """Read all table files under a folder, or of the change requests ``requests`` in it, in one plan."""
    files = write_once(list_tables(spark, folder, path_fields, requests), "files")
    if files.isEmpty():
        blank = empty_set(spark)
        errors = small_frame(
            spark, [], T.StructType([T.StructField(n, T.StringType()) for n in (*OWNER, "message")])
        )
        return Scan(files, blank, blank, errors)
    # one folder, or one per run that still has a table of a published set
    roots = [_below(folder, requests)] if path_fields else [r["root"] for r in files.select("root").distinct().collect()]
    lines = _lines(spark, roots, files)
    layout = _layout(files, lines)
    errors = _problems(layout)
    good = layout.join(errors.select(*OWNER), OWNER, "left_anti")
    meta = good.selectExpr(*OWNER, *[c for c in META.fieldNames() if c not in OWNER])
    placed = lines.join(good.select(*OWNER, "start", "stop", "encoding", F.size("columns").alias("width")), OWNER)
    text = decoded("value", "encoding")
    in_block = "pos > start and (stop is null or pos < stop)"
    cells = f"{split_cells(text)}"
    rows = placed.where(f"{in_block} and mark = '*'").selectExpr(
        *OWNER, "pos", f"{cells} as cells", "width"
    ).selectExpr(*OWNER, "pos", f"{fit_cells('slice(cells, 2, size(cells))', 'width')} as cells")
    last_row = placed.where(f"{in_block} and mark = '*'").groupBy(*OWNER).agg(F.expr("max(pos) as last_row"))
    outside = (
        placed.where("pos <> start and not (pos > start and (stop is null or pos < stop) and mark = '*')")
        .join(last_row, OWNER, "left")
        .where("pos < start or pos >= stop or pos > coalesce(last_row, start)")
    )
    dummies = outside.selectExpr(*OWNER, f"if(pos < start, {LEADING}, {TRAILING}) as section", "pos", f"{text} as value")

    def side(name: str) -> TableSet:
        return TableSet(*(d.where(F.col("side") == name).drop("side") for d in (meta, rows, dummies)))

    if path_fields:
        return Scan(files, side("before"), side("after"), errors)
    return Scan(files, side(""), side(""), errors)


def render_lines(tables: TableSet) -> DataFrame:
    """Every table as text lines, with the section and position that order them."""
    head = tables.meta.selectExpr(
        "table_name", f"{HEADER} as section", f"cast(null as {POSITION.simpleString()}) as pos",
        "concat_ws(',', concat('!', n_keys), array_join(columns, ',')) as value", "size(columns) as width",
    ).selectExpr("table_name", "section", "pos", "if(width = 0, substring_index(value, ',', 1), value) as value")
    # array_join would drop null cells
    body = tables.rows.selectExpr(
        "table_name", f"{BODY} as section", "pos",
        "concat_ws(',', concat(array('*'), transform(cells, c -> coalesce(c, '')))) as value",
    )
    around = tables.dummies.select("table_name", "section", "pos", "value")
    return around.unionByName(head).unionByName(body)


def write_tables(tables: TableSet, folder: str) -> None:
    """Write every table as UTF-8 text, one folder ``table_file=<name><suffix>`` per table.

    Range partitioning by (table, section, position) spreads a large table over many ordered
    part files and keeps small tables together. The ranges are sampled from a written copy,
    so that the plan behind the tables runs once.
    """
    names = tables.meta.selectExpr("table_name", "concat(table_name, suffix) as table_file")
    lines = write_once(render_lines(tables).join(names, ["table_name"]).drop("table_name"), "lines")
    order = ["table_file", "section", "pos"]
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("table_file", "value").write.partitionBy("table_file").mode("overwrite").text(folder)
    )
