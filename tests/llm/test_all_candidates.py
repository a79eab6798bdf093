"""The trees of op1 learn from every candidate."""

from __future__ import annotations

from rowledger.llm import pii


def test_trees_learn_from_more_candidates_than_a_sample_holds(spark, monkeypatch):
    good = "concat('write to a', id, '@example.org or call +1 415 555 ', lpad(id % 10000, 4, '0'), ' today')"
    docs = spark.range(9000).selectExpr("id as doc_id", f"concat({good}, if(id % 2 = 0, ' host 10.0.0.999 ', ' host 10.0.0.9 ')) as text")
    seen = {}
    keep = pii.write_once

    def spy(df, name):
        out = keep(df, name)
        seen["rows"], seen["weight"] = out.selectExpr("count(*)", "sum(weight)").first()
        return out

    monkeypatch.setattr(pii, "write_once", spy)
    trees = pii.fit_trees(docs.select("text"))
    assert trees is not None
    # 3 variants of an email and of a telephone number, 2 of a good address, 1 of a bad one; and numbers that are no
    # cards: of the names from 10 on, of the telephone numbers, two or one in an address
    assert seen["weight"] == 9000 * 3 + 9000 * 3 + 4500 * 2 + 4500 + 8990 + 9000 + 9000 + 4500
    assert seen["rows"] < 500
