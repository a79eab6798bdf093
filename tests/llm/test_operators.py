"""Operators for training data against brute force, and on nulls, empty and repeated rows, and empty tables."""

import hashlib
import html as entities
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowledger.llm import decontaminate, html, language, licenses, lm, mixing, neardup, pii, quality, queries, toxicity
from rowledger.llm import tokens as T
from rowledger.llm.common import documents, held_out

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "   \n ", "one", "Zwölf Boxkämpfer jagen Viktor\x1f\xa0quer", "same line\nsame line\n\nsame line", "a b c d e f g h " * 40, "x" * 50_000]


def fold():
    return held_out(F.col("doc_id"), 7, 2)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table with odd texts, a repeated row and columns whose names clash with results."""
    odd = spark.createDataFrame([(10**6 + i, t, None, "odd", 0) for i, t in enumerate([*ODD, ODD[4], ODD[4]])], "doc_id long, text string, lang string, source string, n_chars long")
    both = documents(spark, DATA).unionByName(odd).unionByName(odd.where("doc_id = 1000003"))
    return both.withColumns({c: F.lit("clash") for c in ("score", "spans", "held_out", "id", "class", "copy", "hash", "base")}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.where("false")


def test_quality_counts(docs, texts):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, marked = Counter(runs), set()
        for i, r in enumerate(runs):
            if n[r] > 1:
                marked.update(range(i, i + 8))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(docs).collect())
    assert got == Counter((i, *brute(t)) for i, t in texts)
    assert quality.quality_rules(empty(docs)).count() == 0


def test_quality_bands(spark):
    prose = " ".join(f"{a}{b}" for a in ("river", "stone", "cloud", "ember", "maple") for b in "abcdefghijklmnopqrstuvwxyz")
    noise = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(300))
    noise = " ".join("".join(chr(33 + (int(noise[j : j + 4], 16) % 90)) for j in range(i, i + 40, 4)) for i in range(0, len(noise) - 40, 40))
    rows = spark.createDataFrame([(1, prose), (2, " ".join(f"w{i % 7}" for i in range(3000))), (3, noise)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_rules(rows).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[3].base_failed


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies and many more words than you would like to read here</div><aside>More news for you</aside>"
        "<article><header><h1>A &amp; B</h1></header><p>First long paragraph of the\n article &eacute;.<p>Short.</p><div class='ad'>Buy now</div>"
        "<p><b>Last one<br>goes on</b></p></article><section id='comments'><p>I like this article a lot, thank you very much</p></section>"
        "<form><label>Name</label></form><footer>&copy; me</footer>"
    )
    assert html.main_text(page)[0] == "A & B\nFirst long paragraph of the article é.\nShort.\nLast one\ngoes on"
    assert html.main_text(None) == ("", 0) and html.main_text("")[0] == "" and html.main_text("<nav>x</nav>")[0] == ""


def test_main_text_loses_no_section():
    """Neither a teaser in an article element nor a long section makes the others go."""
    long = "A long paragraph of the text that the page is about, without any tags. " * 6
    teaser = f"<body><nav>Home</nav><article><p>A teaser that is long enough to be taken for content.</p></article><div><p>{long}</p><p>{long}</p><p>Short.</p></div></body>"
    assert html.main_text(teaser)[0] == "\n".join(["A teaser that is long enough to be taken for content.", long.strip(), long.strip(), "Short."])
    sections = f"<body><nav>Home</nav><div><section><p>{long}</p><p>{long}</p></section><section><p>A short section of the same text, which also counts.</p></section></div></body>"
    assert html.main_text(sections)[0] == "\n".join([long.strip(), long.strip(), "A short section of the same text, which also counts."])


def test_main_text_of_pages(spark):
    for r in queries.op5_main_text(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").drop("url"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", re.sub("<[^>]*>", "", b)).strip() for b in re.split("</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(entities.unescape(b) for b in blocks if b) and r.n_chars == len(r.text)


def test_language_model(docs, texts):
    def tokens(t):
        return [*WORD.findall((t or "").translate(LOW)), None]

    def kept_out(i):
        return zlib.crc32(str(i).encode()) % 7 == 2

    words, pairs = Counter(), Counter()
    for i, t in texts:
        if not kept_out(i):
            w = tokens(t)
            words.update(w)
            pairs.update(zip(["<s> ", *w[:-1]], w))
    follows, total, mass = Counter(b for _, b in pairs), Counter(), defaultdict(float)
    d, e = (lm.discounts([sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]) for counts in (pairs, follows))
    for (a, _), n in pairs.items():
        total[a] += n
        mass[a] += d[min(n, 3)]
    left = sum(e[min(n, 3)] for n in follows.values()) / len(pairs)
    n_all, n_types = sum(words.values()), len(words)

    def lower(b):
        return max(follows[b] - e[min(follows[b], 3)], 0) / len(pairs) + left / (n_types + 1)

    def score(t):
        w, s, base = tokens(t), 0.0, 0.0
        for a, b in zip(["<s> ", *w[:-1]], w):
            n = pairs[a, b]
            s += math.log10((max(n - d[min(n, 3)], 0) + mass[a] * lower(b)) / total[a] if total[a] else lower(b))
            base += math.log10((words[b] + 1) / (n_all + n_types + 1))
        return s, base

    got = lm.score_texts(docs, fold()).collect()
    assert len(got) == len(texts)
    by_id = dict(texts)
    for r in got:
        s, base = score(by_id[r.doc_id])
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(tokens(by_id[r.doc_id])), n_all, kept_out(r.doc_id))
        assert r.n_known == sum(words[b] > 0 for b in tokens(by_id[r.doc_id]))
        assert r.score == pytest.approx(s, abs=1e-6) and r.base_score == pytest.approx(base, abs=1e-6)
    # every context's probabilities, the unknown word's with them, add up to one
    for a in list(total)[:20]:
        seen = sum((max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) + mass[a] * lower(b)) / total[a] for b in words)
        assert seen + mass[a] * left / (n_types + 1) / total[a] == pytest.approx(1, abs=1e-9)
    assert lm.score_texts(empty(docs), fold()).count() == 0


def test_licenses(docs, spark):
    rows = [
        (1, "Released under the MIT License. And again: under the\nMIT license!"), (2, "LICENSED UNDER CC BY-NC 4.0"),
        (3, "this work, is licensed under GNU general public license version 3"), (4, "the license of the work is under the bridge"), (5, None),
        (6, "word " * 5000 + "Licensed under the Apache License, Version 2.0."),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 1, 7, "mit")
    assert got[2].base_labels == "cc-by-nc" and got[3].base_labels == "" and got[3].labels == "gpl-3" and 0.8 <= got[3].score < 1
    assert (got[4].labels, got[4].score, got[5].n_words) == ("", 0.0, 0) and got[6].first_word == 5003 and "apache-2" in got[6].labels
    # the filters lose no block: all windows, without filters
    order = licenses.word_order(docs, licenses.TEMPLATES)
    join = licenses.Join(order, licenses.TEMPLATES)
    for text in (r[1] or "" for r in rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
        known = [(i, order[int(T.word_hash(x))]) for i, x in enumerate(w) if int(T.word_hash(x)) in order]
        at, rank = (np.array([k[j] for k in known], np.int64) for j in (0, 1))
        want = set()
        for label, parts in licenses.TEMPLATES.items():
            for part in parts:
                words = part.split()
                for first in range(0, max(1, len(w)), len(words)):
                    share = len(set(words) & set(w[first : first + 2 * len(words)])) / len(set(words))
                    if share >= licenses.THETA - 1e-9:
                        want.add((label, first, round(share, 9)))
        assert {(a, b, round(c, 9)) for a, b, c in join.blocks(at, rank, len(w))} == want
    assert licenses.scan_licenses(empty(docs)).count() == 0


def test_toxicity(docs, spark):
    base = [f"the {a} and {b} went to {c} today" for a in ("river", "stone", "cloud", "ember") for b in ("maple", "birch", "cedar", "aspen") for c in ("town", "sea", "hill", "farm", "lake")]
    rows = [(i, t) for i, t in enumerate(base * 2)] + [(1000 + i, f"{t} you utter gromblax") for i, t in enumerate(base)] + [(5000, None), (5001, ""), (5002, "...")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id").between(1000, 1999)).cast("int").alias("toxic"))
    got = toxicity.score_toxicity(table, labels, held_out(F.col("doc_id"), 5, 0)).collect()
    wrong = [r for r in got if r.held_out and r.predicted != int(1000 <= r.doc_id < 2000)]
    assert len(got) == len(rows) and not wrong and all(0 <= r.score <= 1 for r in got)
    model = toxicity.fit_on_labels(table, labels, held_out(F.col("doc_id"), 5, 0))
    hidden = spark.createDataFrame([(1, "you gromblaxx here"), (2, "you grom-blax here"), (3, "the river went here")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.with_score(hidden, model, "doc_id").collect()}
    assert min(scores[1], scores[2]) > 0.5 > scores[3]
    assert toxicity.score_toxicity(empty(docs), labels, fold()).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(table, labels.where("false"), fold()).collect()} == {0}



def toxic_scores(model, texts):
    data, at = T.utf8(pa.array(texts, pa.string()))
    return model.scores(model.values(toxicity.strings(data, at), len(texts)))


def test_toxicity_sample_is_as_stated():
    assert toxicity.FIT_TEXTS == 3000


def test_repeated_moderate_strings_add_up():
    """A stem that clean texts have now and then marks the toxic texts without an insult, where it is repeated."""
    rng = np.random.default_rng(5)
    parts = ["la", "mor", "tin", "ou", "ré", "ent", "vi", "sel", "pa", "chu"]

    def text(*more):
        return " ".join(rng.permutation(["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(60)] + list(more)))

    def stems(n):
        return ["réeux" + "".join(rng.choice(parts, 2)) for _ in range(n)]

    insult = [text("gromblax") for _ in range(200)]
    many, once, clean = [text(*stems(rng.integers(3, 7))) for _ in range(200)], [text(*stems(1)) for _ in range(120)], [text() for _ in range(1000)]
    parted = [(x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :]) for x in (insult, many, once, clean)]
    learned = [t for a, _ in parted for t in a]
    n_toxic = len(parted[0][0]) + len(parted[1][0])
    model = toxicity.fit(learned, np.arange(len(learned)) < n_toxic)
    found = [float((toxic_scores(model, b) >= 0.5).mean()) for _, b in parted]
    assert found[0] >= 0.9 and found[1] >= 0.8 and found[2] <= 0.2 and found[3] == 0



def test_letter_runs_are_scored_to_their_end():
    base = [f"the {a} and {b} went to {c} today" for a in ("river", "stone", "cloud", "ember") for b in ("maple", "birch", "cedar", "aspen") for c in ("town", "sea", "hill", "farm", "lake")]
    learned = base + [f"{t} gromblax" for t in base]
    model = toxicity.fit(learned, np.arange(len(learned)) >= len(base))
    plain, insult = " ".join("thestonewenttothetowntodayandtheriverwenttothelake"), " ".join("gromblax")
    glued = "thestonewenttothetowntodayandtheriver"
    # texts end and begin with single letters
    scores = toxic_scores(model, [plain, f"{plain} {insult}", f"{insult} {plain}", f"{plain} {insult} {plain}"])
    assert scores[0] < 0.5 and min(scores[1:]) > 0.5
    for n in range(30):
        data, at = T.utf8(pa.array([f"{glued[:n]}g-r-o-m-b-l-a-x{glued}"]))
        assert any(b"g-r-o-m-b-l-a-x" in x.tobytes() for x in toxicity.strings(data, at).codes)
    data, at = T.utf8(pa.array(["y o u a r e s u c h a b i g o l d s t u p i d i d i o t"]))
    s = toxicity.strings(data, at)
    last = s.string[-1]
    assert any(b"stupididiot" in x.tobytes() for x in s.codes[s.owner == last])


def test_language(docs):
    got = language.identify_language(docs, held_out(F.col("doc_id"), 4, 2)).join(docs.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    out = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in got)
    assert language.identify_language(empty(docs), fold()).count() == 0


def test_language_with_many_copies(spark):
    """A language of few texts with many copies each is learned, from its different texts."""
    few = spark.range(8000).crossJoin(spark.createDataFrame([("aa", f"{w} zorblat kvex {w}um pliff") for w in ("mon", "tir", "pel")], "lang string, text string"))
    other = spark.createDataFrame([("bb", f"the {a} and the {b} went home") for a in ("river", "stone", "cloud") for b in ("maple", "birch", "cedar")], "lang string, text string")
    hot = other.where("text like '%stone%maple%'").crossJoin(spark.range(700)).select("lang", "text")
    train = few.select("lang", "text").unionByName(other).unionByName(hot)
    langs, centers, _ = language.fit_centroids(train, language.inverse_frequencies(train))
    plain = few.select("lang", "text").distinct().unionByName(other)
    once = language.fit_centroids(plain, language.inverse_frequencies(train))
    assert langs == ["aa"] * 3 + ["bb"] * 4 == once[0] and np.array_equal(centers, once[1])


def shingled(text):
    w = (text or "").translate(LOW).encode().split()
    return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates(docs, texts, spark):
    sets = {i: shingled(t) for i, t in texts}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for j, a in enumerate(ids):
        for b in ids[:j]:
            shared = sum((sets[a] & sets[b]).values())
            if shared and shared >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(texts) and {(r.doc_id, r.class_id) for r in got} == {(i, top(i)) for i in ids}
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({top(i) for i in ids})
    assert neardup.near_duplicates(empty(docs)).count() == 0
    loose = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f")], "doc_id long, text string")
    assert len({r.class_id for r in neardup.near_duplicates(loose).collect()}) == 1


def test_chain_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for step in range(12):  # each differs from the one before it in a few words, the ends share little
        for k in range(3):
            words[(step * 25 + k * 7) % 300] = f"new{step}x{k}"
        rows.append((step, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_mixing(docs, texts):
    plain = docs.drop("copy")
    got = mixing.mix_sources(docs, {"odd": 1.0})
    assert {r.source for r in got.select("source").distinct().collect()} <= {"odd"} and got.columns.count("copy") == 1
    both = [sorted(map(str, mixing.mix_sources(plain, seed=s).collect())) for s in (3, 3, 4)]
    assert both[0] == both[1] != both[2] and mixing.mix_sources(empty(docs)).count() == 0


def test_poisson_draws(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(None).cast("string").alias("source"))
    n = [r["n"] for r in mixing.mix_sources(many, epochs=3.0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    mean = sum(n) / 20000
    spread = (sum(x * x for x in n) / 20000) - mean * mean
    assert abs(mean - 3) < 0.05 and abs(spread - 3) < 0.15 and abs((20000 - len(n)) / 20000 - math.exp(-3)) < 0.01


def test_decontamination(docs, texts, spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in bench.collect()}
    want = set()
    for i, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        have = {tuple(w[j : j + 8]) for j in range(len(w) - 7)}
        for k, q in items.items():
            runs = {tuple(q[j : j + 8]) for j in range(len(q) - 7)}
            if len(runs & have) >= 0.5 * len(runs):
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and want
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(texts) - sum(i in {d for d, _ in want} for i, _ in texts)
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 == decontaminate.contaminated(empty(docs), bench).count()


def test_changed_numbers_and_names_are_found(spark):
    bench = spark.createDataFrame([(7, "If Tom has 3 apples and gives 2 apples to Mary, how many apples does Tom have after walking 8 km to school today?"), (8, None), (9, "one two")], "item_id long, text string")
    rows = [
        (1, "Intro. If Anna has 12 apples and gives 5 apples to Peter, how many apples does Anna have after walking 3 km to school today? End."),
        (2, "If Bob has 12 apples and gives 5 apples to Peter, how many apples does Carl have after walking 3 km to school today?"),
        (3, "If nobody has apples there is nothing to give."), (4, None), (5, ""), (6, "and one two and"),
    ]
    got = {(r.doc_id, r.item_id): r.consistency for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 9)} and got[1, 7] == 1 > got[2, 7]


def test_exact_copies_of_short_items_are_found(spark):
    items = [(1, "What is 12 * 7?"), (2, "What is the capital city of France?"), (3, "12 7"), (4, "Then Alice Brown met Bob Green near Paris Texas before Carol White left Rome")]
    rows = [
        (1, "today: What is 12 * 7? nobody knows", {1}), (2, "today: What is 13 * 7? nobody knows", set()), (3, "12 7", set()),
        (4, "quiz: What is the capital city of France? nobody knows", {2}), (5, "they ask what is the capital city of france or so", {2}),
        (6, "What is the capital city of Spain?", {2}), (7, "once then alice brown met bob green near paris texas before carol white left rome", {4}),
        (8, "they like the capital city of many lands", set()),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, _, found in rows for i in found}
    assert all(0.5 <= r.coverage <= 1 and 0.7 <= r.consistency <= 1 for r in got)


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_personal_data(docs, texts, spark):
    odd = ["a@b.c_d@e.f x@y z@.w q@r.s.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4 1..2.3.4", "1" * 5000 + " 4111 1111 1111 1111-2", "+1+12 345 678 90 (1) ++44.20.7946.0958)", "é@ü.ß 😀 a@b.co 😀 4111-1111-1111-1111"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], "doc_id long, text string"))
    got = pii.personal_data_report(rows).collect()
    by_id = dict(texts) | {-i: t for i, t in enumerate(odd, 1)}
    assert len(got) == len(texts) + len(odd)
    for r in got:
        base = base_spans(by_id[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.select("doc_id", "text", "n_chars").collect():
        assert not base_spans(r.text) and (r.text is None) == (by_id[r.doc_id] is None)
        assert r.text == by_id[r.doc_id] or r.n_chars == len(r.text)
    assert pii.personal_data_report(empty(docs)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = step.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, str(tmp_path))
        assert after.columns == names, name
        path = str(tmp_path / name.replace(" ", "-"))
        after.write.parquet(path)
        step = spark.read.parquet(path)
    want = mixing.mix_sources(step)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < step.count() < docs.count()
