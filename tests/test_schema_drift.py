import json

from pyspark.sql import functions as F

from lorekiln.operators.schema_drift import cast_json, field_lineage, leaves, migration_steps, name_parts, schema_changes, typed_records, unify_records
from lorekiln.plans.order import with_previous

SHAPE = "file_id long, series string, file_seq int, line_no int, payload string, path string, n int"


def table(spark, files):
    rows = []
    for fid, series, seq, records in files:
        for i, r in enumerate(records):
            rows.append((fid, series, seq, i, r if r is None or isinstance(r, str) else json.dumps(r), "clash", 1))
    return spark.createDataFrame(rows, SHAPE)


def text(i):
    return f"The quote repeats the whole passage about the place number {i}."


def records(n, make):
    return [make(i) for i in range(n)]


FILES = [
    (1, "s", 1, records(12, lambda i: {"temp_qid": f"SYN_{i}", "flags": {"quote_failed": i % 2 == 0, "logic_failed": True}, "trace": {"step_1_quote": text(i), "step_2_logic": text(i)}, "note": None})),
    (2, "s", 5, records(12, lambda i: {"trace": {"step_2_logic": text(i), "step_1_quote": text(i)}, "temp_qid": f"SYN_{i}", "flags": {"logic_failed": True, "quote_failed": i % 2 == 0}, "note": "x"}) + ["", None, "{broken", "[1]", '"s"', "NaN"]),
    (3, "s", 6, records(12, lambda i: {"tempQid": i, "flags": {"source_quote_failed": i % 2, "logic_failed": True}, "evaluation_trace": {"step_1_quote": text(i), "step_2_logic": text(i)}, "note": "x"})),
    (4, "s", 7, records(12, lambda i: {"tempQid": i, "flags": {"source_quote_failed": i % 2}, "evaluation_trace": {"step_1_quote": text(i), "step_2_logic": text(i)}, "note": ["x"], "severity": 1})),
    (5, "other", 1, records(3, lambda i: {"a": 1})),
    (6, None, 1, [""]),
]
WANT = {
    (3, "renamed", "temp_qid", "tempQid"), (3, "type_changed", "temp_qid", "tempQid"),
    (3, "renamed", "flags.quote_failed", "flags.source_quote_failed"), (3, "type_changed", "flags.quote_failed", "flags.source_quote_failed"),
    (3, "renamed", "trace.step_1_quote", "evaluation_trace.step_1_quote"), (3, "renamed", "trace.step_2_logic", "evaluation_trace.step_2_logic"),
    (4, "removed", "flags.logic_failed", ""), (4, "type_changed", "note", "note"), (4, "added", "", "severity"),
}


def test_parts_and_leaves():
    assert name_parts("flags.sourceQuoteFailed") == ["flag", "source", "quote", "failed"]
    assert name_parts("meta.temp_qid") == ["meta", "temp", "q", "id"]
    assert leaves('{"a": {"b": null, "c": [1]}, "d": {}}') == [("a.b", "", "null", 0), ("a.c", "array", "[1]", 4)]
    assert leaves("[" * 100_000) == [] and leaves(None) == []


def test_changes_lineage_and_unified_table(spark):
    df = table(spark, FILES)
    df = df.unionByName(df.where("file_id = 3 and line_no < 4")).repartition(5)
    changes, schemas, files = schema_changes(df)
    assert {tuple(r) for r in changes.select("file_id", "change_kind", "old_path", "new_path").collect()} == WANT
    prints = {r.file: r.fingerprint for r in files.collect()}
    assert prints[1] != prints[2] != prints[3] and prints[6] is None
    lineage = field_lineage(changes, schemas, files)
    got = {(r.file, r.path): r.field for r in lineage.collect()}
    assert got[(4, "tempQid")] == "temp_qid" and got[(4, "severity")] == "severity"
    rows = unify_records(df, lineage, files).collect()
    assert len(rows) == 12 * 4 + 3
    one = next(r for r in rows if r.file_id == 4 and r.line_no == 3)
    assert one.fields["temp_qid"] == "3" and one.fields["flags.quote_failed"] == "1" and one.fields["severity"] == "1"


def test_empty_table(spark):
    changes, schemas, files = schema_changes(table(spark, []))
    assert changes.count() == schemas.count() == files.count() == 0


def test_previous_within_hot_group(spark):
    rows = [("a", i) for i in range(100)] + [("b", 7), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, n int").repartition(6)
    got = {(r.g, r.n): r.back for r in with_previous(df, ["g"], ["n"], "n", "back").collect()}
    assert got == {(g, n): (n - 1 if (g, n) not in {("a", 0), ("b", 7), (None, 1)} else None) for g, n in rows}


def test_steps_give_one_name_and_type_a_field_and_nulls(spark):
    more = FILES + [(7, "far", 1, records(12, lambda i: {"tempQid": f"SYN_{i}", "flags": {"source_quote_failed": str(i % 2 == 0).lower()}, "severity": "high"}) + ["{}"])]
    df = table(spark, more)
    df = df.unionByName(df.where("file_id = 7 and line_no = 3").withColumn("payload", F.lit("!broken")))
    changes, schemas, files = schema_changes(df)
    lineage = field_lineage(changes, schemas, files)
    steps = migration_steps(df, lineage, schemas, files).collect()
    done = {(r.file, r.path, r.step): r for r in steps}
    assert done[(3, "tempQid", "rename")].name == "temp_qid" and done[(3, "tempQid", "cast")].new_type == "string"
    assert done[(7, "tempQid", "rename")].name == "temp_qid" and (1, "temp_qid", "keep") in done
    assert {r.name for r in steps if r.file == 1 and r.step == "default"} == {"a", "severity"}
    rows = unify_records(df, lineage, files, steps=migration_steps(df, lineage, schemas, files)).collect()
    assert len(rows) == 12 * 5 + 4 and len({tuple(sorted(r.fields)) for r in rows}) == 1
    at = {(r.file_id, r.line_no): r.fields for r in rows}
    assert at[(4, 3)]["temp_qid"] == '"3"' and at[(1, 3)]["temp_qid"] == '"SYN_3"' and at[(7, 3)]["temp_qid"] == '"SYN_3"'
    assert set(at[(7, 12)].values()) == {None}
    quote = next(r.name for r in steps if r.file == 1 and r.path == "flags.quote_failed")
    assert [at[(f, 3)][quote] for f in (1, 2, 3, 4, 7)] == ["false", "false", "true", "true", "false"]
    assert at[(4, 3)]["severity"] == '"1"' and at[(4, 3)]["note"] == '["x"]' and at[(2, 3)]["note"] == '["x"]'


def test_casts():
    assert cast_json("boolean", "true", "number") == "1" and cast_json("string", '"3"', "number") == "3"
    assert cast_json("number", "3", "string") == '"3"' and cast_json("number", "3", "array") == "[3]"
    assert cast_json("string", '"Yes"', "boolean") == "true" and cast_json("", "null", "array") == "null"


def test_two_lineages_of_one_name_keep_their_values(spark):
    """A field moves, and later another one appears under its old name: both keep all their values."""
    make = [lambda i: {"alpha_score": i}, lambda i: {"total": {"alpha_score": i}}, lambda i: {"total": {"alpha_score": i}, "alpha_score": 100 + i}]
    df = table(spark, [(k + 1, "s", k + 1, records(10, m)) for k, m in enumerate(make)])
    changes, schemas, files = schema_changes(df)
    lineage = field_lineage(changes, schemas, files)
    got = {(r.file, r.path): r.field for r in lineage.collect()}
    assert got[(2, "total.alpha_score")] == got[(3, "total.alpha_score")] == got[(1, "alpha_score")] == "alpha_score"
    assert got[(3, "alpha_score")] == "alpha_score#2"
    rows = unify_records(df, lineage, files).collect()
    assert sorted(r.fields["alpha_score"] for r in rows if r.file_id == 3) == sorted(map(str, range(10)))
    assert sorted(r.fields["alpha_score#2"] for r in rows if r.file_id == 3) == [str(100 + i) for i in range(10)]
    steps = migration_steps(df, lineage, schemas, files)
    typed = typed_records(unify_records(df, lineage, files, steps=steps), steps)
    numbers = [c for c, t in typed.dtypes if t == "double"]
    assert len(numbers) == 2
    total = sorted(x for r in typed.collect() for x in (r[c] for c in numbers) if x is not None)
    assert total == sorted([float(i) for i in range(10)] * 3 + [100.0 + i for i in range(10)])


def test_typed_columns_lines_without_number_and_differing_copies(spark):
    rows = [(1, "s", 1, None, '{"a": "x", "b": [1], "series": true}', "c", 1), (1, "s", 1, None, '{"a": "y"}', "c", 1), (1, "s", 1, None, '{"a": "y"}', "c", 1), (1, "s", 1, 4, '{"a": "p"}', "c", 1), (1, "s", 1, 4, '{"a": "q"}', "c", 1)]
    df = spark.createDataFrame(rows, SHAPE)
    changes, schemas, files = schema_changes(df)
    lineage = field_lineage(changes, schemas, files)
    steps = migration_steps(df, lineage, schemas, files)
    got = typed_records(unify_records(df, lineage, files, steps=steps), steps)
    assert got.columns == ["file_id", "series", "seq", "line_no", "fingerprint", "versions", "a", "b", "series_2"]
    assert sorted((r.line_no or 0, r.a, r.b, r.series_2, r.versions) for r in got.collect()) == [(0, "x", ["1"], True, 1), (0, "y", None, None, 1), (4, "p", None, None, 2)]
