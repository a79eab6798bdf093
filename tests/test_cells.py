"""Cell functions against stated results and laws that any result must keep."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowledger.functions import cells


# texts that are numbers, and the form that they get as part of a key
NUMBERS = {
    "20": "20", "1.10": "1.1", "100.0": "100", "007": "7", "7": "7", "+5": "5", "5.": "5", ".5": "0.5", "-0": "0", "-0.0": "0",
    "1_000": "1000", "1e3": "1000", "1e+05": "100000", "1E5": "100000", "0.1e1": "1", "2e-3": "0.002",
    "999999999999999": "999999999999999", "1e15": "1000000000000000.0", "9007199254740993": "9007199254740992.0",
    "1e16": "1e+16", "1e22": "1e+22", "2e23": "2e+23", "1e100": "1e+100", "123456789012345678": "1.2345678901234568e+17",
    "1.7976931348623157e308": "1.7976931348623157e+308", "1e400": "inf", "-1e400": "-inf", "inf": "inf",
    "-Infinity": "-inf", "nan": "nan", "NaN": "nan", "+nan": "nan",
    "12345678.5": "12345678.5", "1234567.125": "1234567.125", "99999999.99": "99999999.99", "123456789.125": "123456789.125",
    "0.0001": "0.0001", "0.00001": "1e-05", "1e-5": "1e-05", "1.5e-7": "1.5e-07", "2.98023223876953125E-8": "2.9802322387695312e-08",
    "0.00012345678901234567": "0.00012345678901234567", "1e-300": "1e-300", "2.2250738585072014e-308": "2.2250738585072014e-308",
}
WORDS = "PROD_A||1__0|_1|1_|1e|1d|1f|0x10|abc|12a|--1|1.2.3|1,2|e5|.|+|-".split("|")


def column_values(spark, values, fn):
    from pyspark.sql import types as T

    from rowledger.model import small_frame

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.StringType())])
    df = small_frame(spark, list(enumerate(values)), schema)
    return [r[1] for r in sorted(df.select("i", F.expr(fn("s"))).collect())]


def test_key_parts(spark):
    expected = {**NUMBERS, **{w: w for w in WORDS}, None: ""}
    got = column_values(spark, list(expected), cells.normalize_key_part)
    assert dict(zip(expected, got)) == expected


def test_fractions_and_large_numbers_get_their_shortest_form(spark):
    rng = random.Random(7)
    fractions = [rng.randint(-(10**6), 10**6) + rng.randint(1, 99) / 100 for _ in range(15000)]
    fractions += [rng.uniform(0.1, 1) * 10.0 ** -rng.randint(1, 12) for _ in range(10000)]
    large = [rng.uniform(1, 9) * 10.0 ** rng.randint(15, 18) for _ in range(5000)]
    expected = [(repr(x), repr(x)) for x in fractions + large]
    expected += [(text, str(n)) for n in (rng.randint(1, 10**14) for _ in range(2000))
                 for text in (f"{n}", f"{n}.0", f"+{n}", f"000{n}", f"{n}e0", f"{n}0e-1")]
    got = column_values(spark, [text for text, _ in expected], cells.normalize_key_part)
    wrong = [(e, g) for e, g in zip(expected, got) if g != e[1]]
    assert not wrong, wrong[:5]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789eE+-._infaNn ", max_size=8), min_size=1, max_size=200))
def test_any_number_like_text(spark, values):
    """Other texts stay; equal numbers, and no others, get one form, which is its own."""
    got = column_values(spark, values, cells.normalize_key_part)
    assert column_values(spark, got, cells.normalize_key_part) == got
    forms = {}
    for text, key in zip(values, got):
        try:
            number = float(text)
        except ValueError:
            assert key == text
            continue
        assert float(key) == number or number != number and key == "nan"
        assert forms.setdefault(number, key) == key


def test_cells_differ(spark):
    pairs = [
        ("1.10", "1.1", False), ("1.10", "1.2", True), ("abc", "abc", False), ("abc", "abd", True),
        ("", "", False), ("", "0", True), ("1e3", "1000", False), ("1_000", "1000", True),
        (None, "", False), ("nan", "NaN", False), ("0", "-0.0", False), ("7", "007", False), ("1d", "1", True),
    ]
    df = spark.createDataFrame([(o, n) for o, n, _ in pairs], "o string, n string")
    out = df.select(
        F.expr(cells.cells_differ("o", "n")),
        F.expr(f'{cells.value_class("o")} <> {cells.value_class("n")}'),
    ).collect()
    assert [r[0] for r in out] == [e for *_, e in pairs]
    assert [r[1] for r in out] == [e for *_, e in pairs]


def test_yes_words(spark):
    values = ["Y", " yes ", "true", "1", "N", "", None, "2", "TRUE\t"]
    got = column_values(spark, values, cells.yes)
    assert got == [True, True, True, True, False, False, False, False, True]
