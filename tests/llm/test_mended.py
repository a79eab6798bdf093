"""Labels of licenses, near-duplicates under shared ids, personal data in long lists, registered text queries."""

import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rowledger.llm import licenses, neardup, pii, queries
from rowledger.llm import tokens as T

# what SQL can't express: models, parsers, signatures, iterations
WITHOUT_SQL = {
    "op1_personal_data", "op2_decontaminate", "op3_quality_rules", "op5_main_text", "op6_lm_score", "op7_license_scan", "op8_toxicity",
    "op9_near_duplicates", "op10_language", "op11_whitening",
}


def test_every_text_query_has_sql_or_a_reason():
    assert set(queries.REGISTRY) - set(queries.ORACLES) == WITHOUT_SQL
    assert set(entry.queries()) >= {*queries.REGISTRY, "pipeline"}


def test_license_labels_are_told_apart(spark):
    texts = [(text, label) for label, parts in licenses.TEMPLATES.items() for text in parts] + [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"), ("Licensed under CC BY 4.0", "cc-by"),
        ("the license under which it was released", ""), ("released under the bridge, the license is with the driver", ""),
        ("Released under the MIT License and licensed under the Apache License, Version 2.0", "apache-2,mit"),
        ("you may use this work under the terms and conditions of the public license as published", ""),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(rows).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(texts)] == texts


def test_license_columns_on_odd_rows(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [None, "", " .\n", "one", "x" * 30_000, "cc by nc " * 400, "Ünder the MIT license, under the mit  license", "under the MIT\nlicense", "apache license version 20", "apache license version 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[7], None])], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("labels", "score", "n_base", "blocks")})
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(rows).collect()}
    want = set()
    for i, t in enumerate([*texts, texts[7], None]):
        w = word.findall((t or "").translate(low))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want.add((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == want


def test_rows_with_a_shared_id_keep_their_links(spark):
    def words(name, n=120):
        return [f"{name}{i}" for i in range(n)]

    a, b = words("a"), words("b")
    rows = [
        (1, " ".join(a)), (5, " ".join(["new", *a[1:]])), (5, " ".join(b)), (7, " ".join([*b[:-1], "new"])), (8, None), (8, ""), (9, "x"), (9, "x"),
        (5, " ".join([*b[:-2], "other", "end"])), (None, "q r s t u v"), (None, "q r s t u v"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "class", "key_1", "row", "bucket", "same")})
    got = neardup.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id) == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 5), (8, 8), (8, 8), (9, 9), (9, 9)]
    kept = neardup.one_of_each(frame)
    assert kept.columns == frame.columns
    left = sorted(((r.doc_id or 0), (r.text or "")[:2]) for r in kept.collect())
    assert left == [(0, "q "), (1, "a0"), (5, "b0"), (8, ""), (9, "x")]


class Even(pii.Trees):
    """Judges by length alone."""

    def __init__(self):
        self.threshold = 0.4

    def probability(self, values):
        return F.lit(0.5) + values[pii.FEATURES.index("length")] / 1000


def python_spans(found):
    """The choice among candidates, one by one: (kind, start, end)."""
    base = [c for c in found if c.base]
    free = [c for c in found if not c.strict and not c.base and not any(b.start < c.end and c.start < b.end for b in base)]
    chosen = []
    for c in sorted(free, key=lambda c: (c.start, -c.end, c.kind)):
        if chosen and c.start < chosen[-1].end:
            if len(c.value) > len(chosen[-1].value):
                chosen[-1] = c
        else:
            chosen.append(c)
    return sorted((c.kind, c.start, c.end) for c in base + chosen)


def test_spans_are_chosen_as_one_by_one(spark):
    texts = [
        "mail a@b.co or c (at) d.org, c (at) d [dot] org; tel 030 123 45 67 89 +49 30 1234567 4111 1111 1111 1111", "", None, "no data here",
        "ä 😀 " * 900 + "x (at) y.org and 4111-1111-1111-1111 " * 40, " ".join(f"u{i}@m{i}.org, v{i} (at) m.org é" for i in range(600)),
        "1.2.3.4 2001:db8:0:0:0:0:0:1 1.2.3.4.5.6 (030) 1234-5678 (030) 1234-5678 1234.5678.9012.3456",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = pii.candidates(F.col("text"))
    for r in rows.withColumn("c", c).select("text", "c", pii.all_spans(F.col("text"), F.col("c"), Even()).alias("found")).collect():
        assert all(r.text[x.start : x.end] == x.value for x in r.c)
        assert [(x.kind, x.start, x.end) for x in r.found] == python_spans(r.c)


def test_redaction_puts_every_gap_back(spark, monkeypatch):
    monkeypatch.setattr(pii, "fit_trees", lambda docs: Even())
    long = " ".join(f"é😀 u{i}@m{i}.org, v{i} (at) m.org" for i in range(500)) + " end"
    rows = spark.createDataFrame([(1, long, 5), (2, None, 3), (3, "x", 9), (4, "a@b.co", 6)], "doc_id long, text string, n_chars int").withColumns({c: F.lit("clash") for c in ("new", "c", "row")})
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(rows).collect()}
    want = re.sub(r"[uv]\d+(@m\d+\.org| \(at\) m\.org)", "[EMAIL]", long)
    assert got == {1: (want, len(want)), 2: (None, 3), 3: ("x", 9), 4: ("[EMAIL]", 7)}


@pytest.mark.parametrize("n", [4000])
def test_many_candidates_take_time_in_proportion(spark, n):
    def seconds(k):
        text = " ".join(f"write to a{i}@mail{i}.example.org or b{i} (at) mail [dot] org, é" for i in range(k // 2))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string").select(pii.candidates(F.col("text")).alias("c"), "text")
        started = time.perf_counter()
        assert rows.select(F.size(pii.all_spans(F.col("text"), F.col("c"), Even())).alias("n")).first().n == k
        return time.perf_counter() - started

    seconds(n)
    assert seconds(4 * n) < 8 * max(seconds(n), 1)


def test_words_of_templates_hash_apart():
    every = {w for parts in licenses.TEMPLATES.values() for t in parts for w in t.split()}
    assert len({int(T.word_hash(w)) for w in every}) == len(every)


def test_an_article_keeps_its_own_head():
    from rowledger.llm import html

    body = "<p>" + "a long paragraph of the text " * 20 + "</p>"
    for head in ("<div class='post-header'><h1>The title</h1></div>", "<div class='entry-header'><h1>The title</h1></div>", "<h1 class='page-header'>The title</h1>", "<header><h1>The title</h1></header>"):
        page = f"<body><div class='site-header'>Home</div><nav>Menu</nav><article>{head}{body}<div class='comment-list'>first!</div></article><footer>2024</footer></body>"
        text = html.main_text(page)[0]
        assert text.split("\n")[0] == "The title" and text.count("\n") == 1
    # without an article the clusters alone decide
    page = f"<body><div class='top-header'>Home</div><ul><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul><div>{body}{body}</div></body>"
    assert html.main_text(page)[0].count("a long paragraph") == 40 and "Home" not in html.main_text(page)[0]


def test_pages_odd_rows(spark):
    from rowledger.llm import html

    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "no markup"), (4, long), (5, "<article><p>same</p></article>"), (5, "<article><p>same</p></article>"), (None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "'clash' as text", "1 as n_chars", "2 as n_lines")
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in html.extract_main_text(pages).collect())
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "no markup", 9), (4, "word\nword", 30_000 * 5 - 1), (5, "same", 4), (5, "same", 4)]
    assert html.extract_main_text(pages.where("false")).count() == 0
