import random

import numpy as np
import pytest

from lorekiln.llm import shared_spans as S
from lorekiln.llm.shared_spans import Joined, anchor_sketch, anchored_runs, shared_spans


def brute(rows, n):
    texts = {(q, t) for q, t in rows if q is not None and t is not None}
    seen = {}
    for q, t in texts:
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], set()).add(q)
    out = {}
    for q, t in texts:
        mark = [False] * len(t)
        for i in range(len(t) - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                mark[i : i + n] = [True] * n
        if sum(mark):
            out[q] = out.get(q, 0) + sum(mark)
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdé ß中") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(20)))
        for _ in range(rnd.randrange(3)):
            b = rnd.choice(base)
            k = rnd.randrange(len(b))
            t += b[k : k + rnd.randrange(60)] + rnd.choice(["", "!", "-"])
        rows.append((f"q{i}", t))
    rows += rows[:5] + [(None, base[0]), ("q1", None), ("q2", ""), ("solo", "k" * 90), ("q3", base[0] * 40)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "temp_qid string, source_quote string, h1 string, r int")
    got = {r.temp_qid: r.shared_chars for r in shared_spans(df, length=12).collect()}
    assert got == brute(rows, 12)


def test_one_passage_in_a_third_of_all_records(spark):
    rows = [(f"q{i}", ("common passage of text " * 3 if i % 3 == 0 else "") + f"own {i} " * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "temp_qid string, source_quote string").repartition(7)
    got = {r.temp_qid: r.shared_chars for r in shared_spans(df, length=40).collect()}
    assert got == brute(rows, 40)


def test_empty_table(spark):
    assert shared_spans(spark.createDataFrame([], "temp_qid string, source_quote string")).collect() == []


@pytest.mark.parametrize("change", ["cells", "salted", "small slices"])
def test_bounds_change_nothing(spark, monkeypatch, change):
    """A sketch too small for the anchors, frequent anchors in salted parts, and slices of single texts."""
    if change == "cells":
        monkeypatch.setattr(S, "MAX_CELLS", 2**6)
    elif change == "salted":
        monkeypatch.setattr(S, "HEAVY", 3)
        monkeypatch.setattr(S, "SALT_RECORDS", 4)
    else:
        monkeypatch.setattr(S, "_CHARS", 10)
    rnd = random.Random(8)
    parts = ["".join(rnd.choice("abcd") for _ in range(30)) for _ in range(4)]
    rows = [(f"q{i % 90}", "".join(rnd.choice(parts)[rnd.randrange(9) :] for _ in range(3)) + f"#{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "temp_qid string, source_quote string").repartition(5)
    got = {r.temp_qid: r.shared_chars for r in shared_spans(df, length=14).collect()}
    assert got == brute(rows, 14)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab中") for _ in range(rnd.randrange(80))) for _ in range(50)]
    j, full, seen, n = Joined(texts), "".join(texts), {}, 0
    for first, end, anchor in zip(*anchored_runs(j, 12)):
        for i in range(first, end):
            seen.setdefault(full[i : i + 12], set()).add(anchor)
            n += 1
    assert n == sum(max(0, len(t) - 11) for t in texts) and all(len(a) == 1 for a in seen.values())


def test_sketch_never_underestimates(spark):
    texts = [("abcdefghij" * 3,), ("abcdefghijk",), ("zzzzzzzzzzzz",), (None,)]
    df = spark.createDataFrame(texts, "t string").repartition(3)
    sketch = anchor_sketch(df.where("t is not null"), "t", 10, 12)
    anchor = anchored_runs(Joined(["abcdefghij"]), 10)[2]
    assert sketch.repeated(anchor).all() and not sketch.heavy(anchor).any()
    assert len(np.unique(anchored_runs(Joined(["zzzzzzzzzzzz"]), 10)[2])) == 1
