from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekiln.llm import survivor
from lorekiln.llm.survivor import best_representatives, duplicate_groups, question_key, retained_values, source_quality

SHAPE = "record_id long, src string, oid long, question string, question_type string, hint_1 string, model string, at timestamp, vals array<string>, group string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SHAPE)


def groups_of(df):
    key = F.concat_ws("|", "src", F.col("oid").cast("string"))
    key = F.when(F.col("src").isNotNull() & F.col("oid").isNotNull(), key)
    return duplicate_groups(df, "record_id", [key, question_key(F.col("question"))])


def test_groups_and_field_by_field_survivors(spark):
    t = [datetime(2025, 1, d) for d in range(1, 6)]
    df = rows(spark, [
        (1, "a", 7, "Who is X?", "FR", "tbd", "low", t[0], ["u", "v"]),
        (2, "a", 7, "Something else", "?", "hint two", "low", t[1], ["u"]),
        (3, "b", None, "something  ELSE!", None, "hint three", "low", t[1], None),
        (4, "b", None, "who is ｘ？", "EX", "N/A", "high", t[0], ["u", None, ""]),
        (5, "b", None, "alone", "EX", "hint", "high", t[0], ["z"]),
        (6, None, 7, None, "EX", "hint", "high", None, []),
        (7, "a", 9, "", "FR", "-", "none", t[3], None),
        (8, "a", 9, None, "FR", None, None, None, None),
    ])
    g = groups_of(df)
    assert {r.record_id for r in g.collect()} >= {1, 2, 3, 4, 7, 8}
    trust = spark.createDataFrame([("high", 1), ("low", 2)], "m string, r int")
    picks = best_representatives(df, g, "record_id", ["question_type", "hint_1"], "model", "at", trust, ["vals"])
    retained, quality = retained_values(df, g, "record_id", "model", ["vals"])
    got = {tuple(r) for r in picks.collect()}
    # ties of rank and date go to the smaller id; the group of 7 and 8 has no hint at all
    assert got == {(1, "question_type", 4), (1, "hint_1", 2), (7, "question_type", 7)}
    assert {r.value for r in retained.collect() if r.group_id == 1} >= {"u"}
    assert {r.source for r in quality.collect()} >= {"low", "high"}


def test_no_rows(spark):
    df = rows(spark, [])
    trust = spark.createDataFrame([], "m string, r int")
    picks = best_representatives(df, groups_of(df), "record_id", ["hint_1"], "model", "at", trust, ["vals"])
    retained, quality = retained_values(df, groups_of(df), "record_id", "model", ["vals"])
    assert picks.count() == retained.count() == quality.count() == 0


def test_spellings_are_those_of_records(spark):
    t = datetime(2025, 1, 1)
    vals = (["Old Tower"], [" old tower"], ["Old Tower", "OLD TOWER"])
    df = rows(spark, [(i, "a", 7, f"q{i}", "FR", "h", m, t, v) for i, (m, v) in enumerate(zip(("x", "y", "z"), vals))])
    retained, _ = retained_values(df, groups_of(df), "record_id", "model", ["vals"])
    assert [(r.group_id, r.value) for r in retained.collect()] == [(0, "Old Tower")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_quality_tells_honest_from_careless_sources_and_keeps_several_values(spark, monkeypatch, most):
    monkeypatch.setattr(survivor, "PATTERN_ROWS", most)
    claims = []
    for g in range(300):
        true = [f"t{g}a", f"t{g}b"]
        claims += [(str(g), "f", v, s) for s in ("good", "fair") for v in true]
        claims += [(str(g), "f", true[0], "lazy")]
        claims += [(str(g), "f", v, "wild") for v in (f"w{g}", f"w{g}x", true[1])]
    facts, quality = source_quality(spark.createDataFrame(claims, "group string, field string, value string, source string"))
    q = {r.source: r for r in quality.collect()}
    assert q["good"].sensitivity > q["lazy"].sensitivity + 0.2
    assert q["good"].specificity > q["wild"].specificity + 0.05
    p = {r.value: r.p_true for r in facts.collect()}
    assert p["t1a"] > 0.5 and p["t1b"] > 0.5 and p["w1"] < 0.5
