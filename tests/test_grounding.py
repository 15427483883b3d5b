import hashlib
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lorekiln.operators import grounding
from lorekiln.plans import registry


def bag(text):
    def at(w):
        h = hashlib.md5(w.encode()).hexdigest()
        return int(h[0], 16) * 4 + int(h[1], 16) % 4

    return Counter(map(at, re.findall("[a-z0-9]+", text.lower())))


def cosine(x, y):
    dot = lambda a, b: sum(n * b[k] for k, n in a.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def tables(path, quotes, docs):
    """quotes: (temp_qid, quote, reference); docs: (text, source)."""
    s = pa.string()
    pq.write_table(pa.table({k: pa.array([q[i] for q in quotes], s) for i, k in enumerate(("temp_qid", "source_quote", "source_reference"))}), path / "judge_batch.parquet")
    columns = {"doc_id": pa.array(range(len(docs)), pa.int64())} | {k: pa.array([x[i] for x in docs], s) for i, k in enumerate(("text", "source"))}
    pq.write_table(pa.table(columns), path / "documents.parquet")


@pytest.mark.parametrize("sentences, quotes", [(1024, 256), (2, 1)])
def test_odd_texts(spark, tmp_path, monkeypatch, sentences, quotes):
    monkeypatch.setattr(grounding, "SENTENCES", sentences)
    monkeypatch.setattr(grounding, "QUOTES", quotes)
    docs = [
        ("The bell rang. A key was lost! Who   found it? Nobody did.. The end", "a_b_chapter_01.txt"),
        ("One sentence only", "a_b_chapter_1.txt"), ("", "a_b_chapter_01.txt"), ("...", "a_b_chapter_01.txt"), ("é. ü. ö", "a_b_chapter_01.txt"),
        (None, "a_b_chapter_01.txt"), ("Lost keys", None), ("Lost keys", "notes.txt"), ("– . —", "c_chapter_02.txt"),
    ]
    rows = [
        ("Q_50", "A KEY was lost who found it", "a_b Chapter 1"), ("Q_100", "one sentence only", "a_b Chapter 1"),
        ("Q_150", "!!", "a_b Chapter 1"), ("Q_200", "lost", "c Chapter 2"), ("Q_250", "lost", "d Chapter 2"), ("Q_300", "lost", "nothing"),
        ("Q_350", "nobody", "d Chapter 2"), ("Q_350", "nobody did the end", "a_b Chapter 1"), ("Q_351", "lost", "a_b Chapter 1"), ("Q_400", None, "a_b Chapter 1"),
    ]
    tables(tmp_path, rows, docs)
    got = {r.temp_qid: r.grounding for r in registry.QUERIES["grounding_score"](spark, str(tmp_path)).collect()}
    assert got == {"Q_50": 1.0, "Q_100": 1.0, "Q_150": 0.0, "Q_200": 0.0, "Q_250": 0.0, "Q_300": 0.0, "Q_350": 1.0}


def test_a_long_chapter_and_many_quotes(spark, tmp_path):
    """300 quotes against 3,000 windows of one chapter, one text of it longer than a block."""
    rng = random.Random(1)
    words = [hashlib.md5(str(k).encode()).hexdigest()[:6] for k in range(400)]
    told = [[" ".join(rng.choices(words, k=12)) for _ in range(n)] for n in (2500, 500, 2)]
    rows = [(f"Q_{50 * i}", " ".join(rng.choices(words, k=15)), "x Chapter 3") for i in range(300)]
    tables(tmp_path, rows, [(". ".join(s), "x_chapter_3.txt") for s in told])
    began = time.time()
    got = {r.temp_qid: r.grounding for r in registry.QUERIES["grounding_score"](spark, str(tmp_path)).collect()}
    assert len(got) == 300 and time.time() - began < 60
    windows = [bag(f"{a} {b}") for s in told for a, b in zip(s, s[1:])]
    for q, text, _ in rows[:20]:
        assert got[q] == pytest.approx(max(cosine(bag(text), w) for w in windows), abs=1e-6)
