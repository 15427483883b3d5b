import random

from lorekiln.llm.components import grid_components
from lorekiln.llm.consolidate import consolidate_matches


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            r, s = sorted((find(a), find(b)))
            parent[s] = r
    return {x: find(x) for x in parent}


def labels(df):
    rows = df.collect()
    assert len(rows) == len({r.vertex for r in rows})
    return {r.vertex: r.label for r in rows}


def test_random_graphs_chain_and_star_over_many_cells(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(5000, 6000 + i) for i in range(90)]  # a hub that is smaller than its leaves
    edges += [(9000, 7000 + i) for i in range(90)]  # and one that is larger
    edges += edges[:40] + [(b, a) for a, b in edges[40:80]] + [(5, 5), (None, 7), (8, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    for cell in (20, 10_000):
        assert labels(grid_components(df, "a", "b", cell_edges=cell)) == brute(edges)


def test_strings_and_no_edges(spark):
    df = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "x")], "a string, b string")
    assert labels(grid_components(df, "a", "b")) == {"a": "a", "b": "a", "c": "a"}
    assert grid_components(df.limit(0), "a", "b").collect() == []


def test_matches_with_spellings_nulls_strangers_and_clashing_columns(spark):
    m = [
        ("SYN_1", "syn-2", True), (" SYN_2", "SYN 3\t", True), ("SYN_3", "SYN_1", True), ("SYN_4", "SYN_5", False),
        ("SYN_5", "SYN_6", None), ("SYN_7", None, True), ("SYN_7", "SYN_99", True), ("SYN_7", "syn_7", True),
        ("SYN_8", "SYN_9", True), ("SYN_9", "SYN_8", True), ("", "SYN_4", True),
    ]
    matches = spark.createDataFrame([(*r, "x") for r in m], "temp_qid_a string, temp_qid_b string, is_match boolean, temp_qid string")
    records = spark.createDataFrame([(f"SYN_{i}", "q") for i in range(1, 10)] + [("SYN_1", "q"), (None, "q")], "temp_qid string, _key string")
    got = {tuple(r) for r in consolidate_matches(matches, records).collect()}
    assert got == {("SYN_1", "SYN_1"), ("SYN_2", "SYN_1"), ("SYN_3", "SYN_1"), ("SYN_8", "SYN_8"), ("SYN_9", "SYN_8")}
    assert consolidate_matches(matches.limit(0), records).count() == 0
    assert consolidate_matches(matches, records.limit(0)).count() == 0
