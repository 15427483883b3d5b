import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekiln.operators import similar
from lorekiln.plans.stage import Stages

SHAPE = "id long, term string, idf double, w double"


def vectors(rows):
    """(id, term, idf, w) of {id: {term: count}}, length one each."""
    out = []
    for i, v in rows.items():
        norm = sum(x * x for x in v.values()) ** 0.5
        out += [(i, k, float(len(k)), x / norm) for k, x in v.items()]
    return out


def pairs(rows, least):
    v = {i: {k: w for j, k, _, w in vectors({i: x})} for i, x in rows.items()}
    dot = lambda a, b: round(sum(w * v[b].get(k, 0.0) for k, w in v[a].items()), 6)
    return {(a, b): dot(a, b) for a in v for b in v if a < b and dot(a, b) >= least}


def first(all_pairs, count):
    most = max(all_pairs.values(), default=0)
    return sorted((*k, x) for k, x in all_pairs.items() if x >= most - 1e-6)[:count]


@pytest.mark.parametrize("top", [True, False])
def test_most_similar_and_all_pairs(spark, top):
    rng = np.random.default_rng(4)
    rows = {int(i): {f"t{k}": int(rng.integers(1, 4)) for k in rng.choice(25, 6, replace=False)} for i in rng.permutation(60)}
    if top:  # groups of equal documents, ids mixed
        rows |= {100 + i: rows[i % 3] for i in range(10)}
    w = spark.createDataFrame(vectors(rows), SHAPE)
    for least in (0.6, 0.9):
        got = {(r.id_a, r.id_b): r.sim for r in similar.similar_pairs(w, "id", least).collect()}
        assert got == pytest.approx(pairs(rows, least), abs=1.5e-6)
    want = first(pairs(rows, 0.6), 7)
    got = [tuple(r) for r in similar.most_similar(w, "id", 0.6, 7, Stages(spark, "test")).collect()]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1.5e-6)


def test_many_equal_documents_make_no_pairs(spark):
    """20,000 equal documents are 200 million pairs, of which three are asked for."""
    w = spark.range(20_000).select("id", F.lit("a").alias("term"), F.lit(1.0).alias("idf"), F.lit(1.0).alias("w"))
    work = Stages(spark, "test")
    assert [tuple(r) for r in similar.most_similar(w, "id", 0.6, 3, work).collect()] == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)]
    assert similar.most_similar(w.where("id < 1"), "id", 0.6, 3, work).collect() == []
