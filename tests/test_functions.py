import random

from pyspark.sql import functions as F

from lorekiln.functions import questions as fq
from lorekiln.functions.text import identity_form, is_missing, missing_py
from lorekiln.operators.clusters import connected
from lorekiln.sources import files


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_ratio(spark):
    rnd = random.Random(2)
    pairs = [("".join(rnd.choice("abcé") for _ in range(rnd.randrange(80))), "".join(rnd.choice("abcé") for _ in range(rnd.randrange(80)))) for _ in range(200)]
    pairs += [("", ""), (None, ""), (None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("a", "b", fq.indel_ratio("a", "b").alias("r")).collect():
        a, b = r.a or "", r.b or ""
        assert abs(r.r - (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12


def test_answer_types(spark):
    want = {
        "date": ["July 31, 1980", "2025-08-29", "23 March", "1 Jan 25", "1-13-90", "July 30"],
        "year": ["1994", "1108 AD", "65 BC", "21st century", "the year 1050"],
        "numeric": ["42", "3.14", "700.", "13"],
        "text": ["Comet 2000", "700 coins", "12 Weir Place", "115 years old", "14 coins.", "words only"],
    }
    rows = [(k, a) for k, xs in want.items() for a in xs]
    got = spark.createDataFrame(rows, "k string, a string").select("k", "a", fq.answer_type(F.col("a")).alias("t")).collect()
    assert [(r.a, r.t) for r in got] == [(a, k) for k, a in rows]


def test_missing_values_agree(spark):
    values = [None, "", " ​\xa0", "-", "N/A", "#n/a", "[empty]", "To be added", "TBD.", "None given", "no value", "nothing", "0", "é", "(blank)", "unknown!"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", is_missing(F.col("v")).alias("m")).collect()
    assert [r.m for r in got] == [missing_py(v) for v in values]
    assert [v for v, r in zip(values, got) if not r.m] == ["nothing", "0", "é"]


def test_identity_form():
    assert identity_form("  Ｗho’s  THERE？ﬁ_") == identity_form("whos there fi") != identity_form("who there")


def test_clusters_of_a_chain_a_star_and_nothing(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(500, 400 + i) for i in range(30)] + [(1, 1), (None, 2)]
    df = spark.createDataFrame(e, "a long, b long")
    got = {r.node: r.cluster for r in connected(df, "a", "b").collect()}
    want = {i: 0 for i in range(41)} | {200 + i: 100 for i in range(30)} | {100: 100} | {400 + i: 400 for i in range(30)} | {500: 400}
    assert got == want
    assert connected(df.limit(0), "a", "b").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b1.json").write_text('[{"a": 1, "t": ["x"]}, {"a": 2}]')
    (tmp_path / "j" / "b2.json").write_text('[{"b": "y"}]')
    rows = files.read_json_batches(spark, f"{base}/j/*.json", "a long, b string, t array<string>")
    assert sorted((r.source_file, r.a, r.b) for r in rows.collect() if r.a) == [("b1.json", 1, None), ("b1.json", 2, None)]
    flat = files.serialize_complex(rows)
    assert files.rehydrate(flat, rows.schema).select("t").where("t is not null").first().t == ["x"]
    assert files.write_once(rows, f"{base}/out") and not files.write_once(rows, f"{base}/out")
    (tmp_path / "x.csv").write_text("a,b\n1,u\n2,v\n")
    assert files.read_csv(spark, f"{base}/x.csv", "a int, b string").count() == 2
    assert files.read_csv(spark, f"{base}/none.csv", "a int") is None
    (tmp_path / "t").mkdir()
    for n in ("sea_chapter_02.txt", "sea_chapter_01.txt", "hill_chapter_01.txt", "notes.txt"):
        (tmp_path / "t" / n).write_text("text\nof " + n)
    got = files.chapters(files.read_texts(spark, f"{base}/t/*.txt"), books=["sea"], limit=1).collect()
    assert [(r.book, r.chapter, r.text) for r in got] == [("sea", 1, "text\nof sea_chapter_01.txt")]
    files.write_batches(spark.range(7), "id", 3, f"{base}/batches")
    assert sorted(tuple(r) for r in spark.read.json(f"{base}/batches").groupBy("batch").count().collect()) == [(0, 3), (1, 3), (2, 1)]
