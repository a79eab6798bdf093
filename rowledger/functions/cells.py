"""Expressions on single cells: numbers, key parts, comparison, flags.

All cells are text. Each function takes and returns SQL expression text, to be used in
``F.expr`` and inside lambda functions. Nothing here leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The spellings that read as a number.
DIGITS = r"\d+(_\d+)*"
KEY_NUMBER = rf"^[+-]?({DIGITS}(\.({DIGITS})?)?|\.{DIGITS})([eE][+-]?{DIGITS})?$"
CELL_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"
NOT_A_NUMBER = r"(?i)^[+-]?nan$"
# White space of every kind, as a character class.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WHITE_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(WHITE, c))
MAYBE_NUMBER = rf"(?i)^{WHITE}*[+-]?(\d|\.\d|inf|nan)"
# Fixed value: whole numbers that are their own key. Asked before any cast, because a failing cast is an exception inside.
PLAIN_WHOLE = r"^(0|-?[1-9]\d*)$"
YES_WORDS = ("Y", "YES", "TRUE", "1")


def literal(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def text(c: str) -> str:
    """A null cell is an empty cell."""
    return f"coalesce({c}, '')"


def strip(c: str) -> str:
    """Drop white space of every kind at both ends.

    A pattern that asks for the end is tried at every blank of a long text, so it is left to texts that are no UTF-8.
    """
    trimmed = f"trim(BOTH {literal(WHITE_CHARS)} FROM {c})"
    return f"if(is_valid_utf8({c}), {trimmed}, regexp_replace({c}, r'^{WHITE}+|{WHITE}+$', ''))"


def filled(c: str) -> str:
    """Whether anything is left after ``strip``."""
    return f"({c} rlike r'{WHITE.replace('[', '[^', 1)}')"


def _number(c: str, grammar: str, digits: str) -> str:
    return (
        f"case when {c} rlike r'{grammar}' then try_cast({digits} as double)"
        f" when {c} rlike r'{INFINITE}' then if({c} like '-%', double('-inf'), double('inf'))"
        f" when {c} rlike r'{NOT_A_NUMBER}' then double('nan') end"
    )


def key_number(c: str) -> str:
    """Number behind a key part, or null: ``1_000`` and surrounding blanks count."""
    return bind(strip(c), "_txt", _number("_txt", KEY_NUMBER, "replace(_txt, '_', '')"))


def cell_number(c: str) -> str:
    """Number behind a compared cell, or null: no underscores, no blanks."""
    return _number(c, CELL_NUMBER, c)


def _whole_exponent(d: str) -> str:
    """A large whole number in exponent form, rounded from its exact digits."""
    whole = f"try_cast(abs({d}) as bigint)"
    tries = ", ".join(
        f"if(cast(round({whole}, -{k}) as double) = abs({d}), round({whole}, -{k}), null)" for k in (4, 3, 2, 1)
    )
    joined = "concat(substr(_digits, 1, 1), '.', substr(_digits, 2), 'E', length(_digits) - 1)"
    return f"concat(if({d} < 0, '-', ''), {bind(f'cast(coalesce({tries}, {whole}) as string)', '_digits', joined)})"


def _shortest(d: str) -> str:
    """Spark's text of a double, without the surplus digits that older JVMs may print."""
    n_digits = r"length(regexp_replace(regexp_replace(_plain, r'E.*$', ''), r'[-.]|^-?0\.0*', ''))"
    tries = ", ".join(
        f"if(try_cast(format_string('%.{n}e', {d}) as double) = {d}, format_string('%.{n}e', {d}), null)"
        for n in (14, 15, 16)
    )
    checked = f"if({n_digits} >= 16, coalesce({tries}, _plain), _plain)"
    return (
        f"if(abs({d}) >= 1e16D and abs({d}) < 9e18D, {_whole_exponent(d)},"
        f" {bind(f'cast({d} as string)', '_plain', checked)})"
    )


def _fixed_point(s: str) -> str:
    plain = f"cast(try_cast({s} as decimal(38,20)) as string)"
    digits = rf"regexp_replace(regexp_replace({plain}, r'0+$', ''), r'\.$', '.0')"
    return f"if(contains({s}, 'E') or contains({s}, 'e'), {digits}, {s})"


def _exponent(s: str) -> str:
    mantissa = rf"regexp_replace(regexp_extract({s}, r'^(-?[\d.]+)[eE]', 1), r'\.?0*$', '')"
    power = rf"try_cast(regexp_extract({s}, r'[eE]([+-]?\d+)$', 1) as int)"
    size = f"cast(abs({power}) as string)"
    return f"concat({mantissa}, if({power} < 0, 'e-', 'e+'), if(length({size}) < 2, '0', ''), {size})"


def number_text(d: str) -> str:
    """Canonical text: whole numbers under 1e15 without a fraction, others as shortest text.

    Spark's own text is right for all but very short, very long and very large numbers, and
    is taken without further work when it is short and has no exponent. Numbers of six decimals at most are told by
    arithmetic, because their text need then be made only once.
    """
    few_digits = f"abs({d}) >= 1e-3D and abs({d}) < 1e7D and rint({d} * 1e6D) / 1e6D = {d}"
    plain = f"cast({d} as string)"
    wide = f"abs({d}) >= 1e16D or abs({d}) < 1e-4D"
    fraction = bind(_shortest(d), "_short", f"if({wide}, {_exponent('_short')}, {_fixed_point('_short')})")
    return (
        f"case when {d} is null then null when {d} = floor({d}) and abs({d}) < 1e15D then"
        f" cast(cast({d} as bigint) as string)"
        f" when {few_digits} then {plain}"
        f" when isnan({d}) then 'nan' when {d} = double('inf') then 'inf' when {d} = double('-inf') then '-inf'"
        f" when length({plain}) < 17 and not contains({plain}, 'E') then {plain} else {fraction} end"
    )


def normalize_key_part(c: str) -> str:
    """Canonical text of one key cell, so that ``1.10`` and ``1.1`` are one key."""
    number = bind(key_number(c), "_num", number_text("_num"))
    return (
        f"case when {c} is null then ''"
        f" when length({c}) <= 15 and {c} rlike r'{PLAIN_WHOLE}' then {c}"
        f" when not {c} rlike r'{MAYBE_NUMBER}' then {c} else coalesce({number}, {c}) end"
    )


def key_part(c: str, dtype: T.DataType) -> str:
    """Canonical text of a typed key column: short whole numbers are their own text, without a look at it."""
    cell = cell_text(c, dtype)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return cell
    part = bind(cell, "_cell", normalize_key_part("_cell"))
    if isinstance(dtype, T.LongType):
        return f"if({c} between -99999999999999 and 999999999999999, {cell}, {part})"
    return normalize_key_part(cell) if isinstance(dtype, T.StringType) else part


def key_text(cells: str, positions: str) -> str:
    """Pipe-joined canonical key from the cells at the given positions."""
    return f"array_join(transform(cells_at, _key -> {normalize_key_part('_key')}), '|')".replace(
        "cells_at", cells_at(cells, positions)
    )


def cells_at(cells: str, positions: str) -> str:
    """Cells at the given positions; a position beyond the row is an empty cell."""
    return f"transform({positions}, _at -> coalesce(get({cells}, _at), ''))"


def cells_differ(old: str, new: str) -> str:
    """Different text that is not the same number on both sides."""
    o, n = text(old), text(new)
    return f"({o} <> {n} and not coalesce({cell_number(o)} = {cell_number(n)}, false))"


def value_class(c: str) -> str:
    """Text that is equal for two cells exactly when ``cells_differ`` is false."""
    return f"coalesce(concat('n:', cast({cell_number(text(c))} + 0.0D as string)), concat('t:', {text(c)}))"


def yes(c: str) -> str:
    """Flag words to boolean; anything else, and null, is false."""
    words = ", ".join(literal(w) for w in YES_WORDS)
    return f"coalesce(upper({strip(f'cast({c} as string)')}) in ({words}), false)"


def cell_text(c: str, dtype: T.DataType) -> str:
    """Text of a typed column as a table cell."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return text(number_text(f"cast({c} as double)"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return text(f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')")
    return text(f"cast({c} as string)")
