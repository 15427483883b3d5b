import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lorekiln.functions import dates, embedding, statistics
from lorekiln.operators import judge
from lorekiln.operators.similar import similar_pairs
from lorekiln.plans.order import with_ordinal
from lorekiln.plans.reference_queries import tfidf
from lorekiln.plans.reference_queries_4 import ingest_checked
from lorekiln.sources import files, reports


def test_enforced_parquet(spark, tmp_path):
    schema = StructType([StructField("id", LongType(), False), StructField("x", DoubleType()), StructField("t", StringType())])
    df = spark.createDataFrame([(1, float("nan"), "a", 9), (2, 2.5, None, 9)], "id int, x double, t string, extra int")
    files.write_enforced(df, f"file://{tmp_path}/t", schema)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [(1, None, "a"), (2, 2.5, None)]
    bad = spark.createDataFrame([(None, 1.0, "a")], "id int, x double, t string")
    with pytest.raises(Exception, match="null in id"):
        files.enforce_columns(bad, schema).collect()
    assert files.versioned("base/", "table", "v2", "sub") == "base/sub/table_v2"


def test_compile_outputs(spark):
    texts = ['[{"question": "a?"}, 3, {"question_text": "b?"}]', "no list", None, "[]", '{"question": "c"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run int, text string")
    assert sorted((r.run, r.item, r.question) for r in files.compile_outputs(df, "text").collect()) == [(0, 0, "a?"), (0, 2, "b?")]


def test_reports(spark, tmp_path):
    base = f"file://{tmp_path}"
    turns = spark.createDataFrame([("s1", 2, "b"), ("s1", 1, "a"), ("s2", 1, None)], "session string, turn int, said string")
    got = {r.session: r for r in spark.read.json(reports.session_reports(turns, "session", "turn", base)).collect()}
    assert [t.turn for t in got["s1"].turns] == [1, 2] and got["s2"].n_turns == 1
    assert reports.run_manifest(spark, base, "r1", {"k": 1}) and not reports.run_manifest(spark, base, "r1", {"k": 2})
    assert json.loads(reports.read_text(spark, f"{base}/r1/manifest.json"))["settings"] == {"k": 1}
    assert reports.run_receipt(spark, base, "r1", {"calls": 3}) and reports.read_text(spark, f"{base}/none") is None
    plan = reports.run_plan([{"name": "a", "runs": [{"temperature": 0.1}, {}]}])
    done = json.loads(reports.set_status(plan, "a_002", "done"))
    assert [r["status"] for r in done["experiments"][0]["runs"]] == ["planned", "done"]
    with pytest.raises(KeyError):
        reports.set_status(plan, "b_001", "done")
    assert reports.metrics_report(turns.groupBy("session").count(), f"{base}/m.json")
    assert "| session | n |" in reports.markdown_report("x", {"t": turns.groupBy("session").agg(F.count("*").alias("n"))})
    calls = []
    make = lambda: calls.append(1) or turns
    assert [reports.cached(spark, f"{base}/c", make).count() for _ in range(2)] == [3, 3] and calls == [1]
    w = tfidf(spark.createDataFrame([(1, "a b"), (2, "a c")], "id long, t string"), "id", F.split("t", " "))
    reports.save_vocabulary(w, f"{base}/v")
    assert {r.term for r in reports.load_vocabulary(spark, f"{base}/v").collect()} == {"a", "b", "c"}


@pytest.mark.parametrize(("text", "want"), [
    ("October 31st, 1981", (31, 10, 1981)), ("it was the 3rd of may (or june)", (3, 5, None)), ("Halloween", (31, 10, None)), ("1998-05-02", (2, 5, 1998)),
    ("in 1463", (None, None, 1463)), ("no date here", None), ("", None), (None, None), ("13/45/1999", None), ("march 1207", (None, 3, 1207)),
])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(dates.date_entities(F.col("t")).alias("d")).first().d
    assert (tuple(got) if got else None) == want


def test_judges_in_turn(spark):
    def busy(q, p, g):
        raise TimeoutError("deadline exceeded")

    def broken(q, p, g):
        raise ValueError("bad key")

    df = spark.createDataFrame([(1, "q", "the red hen", "red hen"), (2, None, None, "red hen")], "id long, question string, player string, gold string")
    ask = lambda *m: {r.id: (r.verdict, r.model, r.status) for r in judge.judge_answers(df, "id", list(m)).collect()}
    good = ("good", judge.overlap_judge)
    assert ask(("busy", busy), good) == {1: (True, "good", "success"), 2: (False, "good", "success")}
    assert ask(("broken", broken), good)[1] == (False, "broken", "failed")
    assert ask(("busy", busy))[1] == (False, "busy", "transient")
    assert judge.judge_answers(df.limit(0), "id", [good]).collect() == []


def test_embedders(spark):
    df = spark.createDataFrame([(1, "red hen"), (2, None), (3, "hen red red")], "id long, t string")
    rows = {r.id: r.e for r in df.select("id", embedding.embed(F.col("t")).alias("e")).collect()}
    assert sum(rows[1]) == 2 and sum(rows[2]) == 0 and len(rows[3]) == 64
    sim = df.select("id", embedding.similarity(F.col("t"), F.lit("red hen")).alias("s"))
    assert {r.id: r.s for r in sim.collect()} == {1: 1.0, 2: 0.0, 3: pytest.approx(0.948683)}
    got = embedding.embed_with(df, "id", "t", lambda ts: [[len(t)] for t in ts]).collect()
    assert {r.id: r.embedding for r in got} == {1: [7.0], 2: [0.0], 3: [11.0]}
    with pytest.raises(Exception, match="0 vectors for"):
        embedding.embed_with(df, "id", "t", lambda ts: []).collect()


def test_statistics(spark):
    assert statistics.correlation_p(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert statistics.correlation_p(0.9, 5) == pytest.approx(0.03739, abs=1e-4)
    assert statistics.correlation_p(None, 5) is None and statistics.correlation_p(0.3, 2) is None and statistics.correlation_p(1.0, 5) == 0
    df = spark.createDataFrame([("The cat sat on the mat.",), (None,), ("",)], "t string").select(statistics.readability("t").alias("r")).select("r.*")
    rows = df.collect()
    assert rows[0].flesch == pytest.approx(206.835 - 1.015 * 6 - 84.6) and rows[1].flesch is None and rows[2].fog is None


def test_similar_pairs_against_all_pairs(spark):
    texts = [f"{a} {b} the the of {c}" for a in ("red", "blue", "green") for b in ("hen", "cock") for c in ("house", "barn", "red")] + ["the of", "red hen the the of house"]
    w = tfidf(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.split("t", " ")).cache()
    v = {}
    for r in w.collect():
        v.setdefault(r.id, {})[r.term] = r.w
    dot = lambda a, b: round(sum(x * v[b].get(k, 0) for k, x in v[a].items()), 6)
    for least in (0.3, 0.6, 0.95):
        want = {(a, b): dot(a, b) for a in v for b in v if a < b and dot(a, b) >= least}
        got = {(r.id_a, r.id_b): r.sim for r in similar_pairs(w, "id", least).collect()}
        assert got == pytest.approx(want)


def test_ordinals_and_forced_ingestion(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1009).alias("k"))
    rows = sorted((r.k, r.i) for r in with_ordinal(df, ["k"], "i").collect())
    assert [i for _, i in rows] == list(range(1000))
    new = spark.createDataFrame([(1, "q", "a", " Mcq "), (2, "q", "a", "MCQ"), (3, "q", None, "FR"), (4, "z", "a", "?")], "staging_id int, question string, answer string, question_type string")
    assert {r.staging_id: r.status for r in ingest_checked(new).collect()} == {1: "valid", 2: "duplicate_dropped", 3: "null_rejected", 4: "null_rejected"}
    assert {r.staging_id: r.status for r in ingest_checked(new, force=True).collect()}[2] == "valid"
    with pytest.raises(ValueError, match="answer"):
        ingest_checked(new.drop("answer"))
