"""Schemas that drift between files: versioned fingerprints, recorded changes and chained migration.

Each file of JSON records gets a schema: the dotted paths of its non-object values with their JSON types. Held against
the file before it in its series, every difference becomes a step: added, removed, renamed or type_changed. The steps
of a series chain into field lineages, by which every record is routed into one consistent table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.plans.order import with_previous
from lorekiln.plans.stage import Stages

LONG, SHORT = 32.0, 24.0  # mean characters from which a field counts as prose, or up to which it does not
SPECIFIC = 0.02  # share of files up to which a name part may stand in two fields at once and still tell them apart
LEAST = 0.2  # least likeness of two names
MAX_DEPTH = 64


def _reject(_: str) -> None:
    raise ValueError("not JSON")


def leaves(payload: str | None) -> list[tuple[str, str, str, int]]:
    """(path, JSON type, JSON text, characters) of every non-object value of one record; none if it cannot be read or
    is no object. Nulls have the type ''. The characters of an array are those of its longest part."""
    try:
        record = json.loads(payload, parse_constant=_reject) if payload else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(record, dict):
        return []
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, dict]] = [("", record)]
    while stack:
        at, obj = stack.pop()
        for k, v in obj.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is None:
                out.append((path, "", "null", 0))
            elif isinstance(v, bool):
                out.append((path, "boolean", "true" if v else "false", 1))
            elif isinstance(v, (int, float)):
                out.append((path, "number", json.dumps(v), 4))
            elif isinstance(v, str):
                out.append((path, "string", json.dumps(v, ensure_ascii=False), len(v)))
            else:
                size = max((len(x) if isinstance(x, str) else 4 for x in v), default=0)
                out.append((path, "array", json.dumps(v, ensure_ascii=False), size))
    return out


def is_record(payload: str | None) -> bool:
    """Whether a payload can be read and is an object."""
    try:
        return isinstance(json.loads(payload, parse_constant=_reject) if payload else None, dict)
    except (ValueError, RecursionError):
        return False


def name_parts(path: str) -> list[str]:
    """Lower-case parts of a path's names, plural and numbers aside; short ids ("qid") give up their "id"."""
    out = []
    for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", path):
        w = w.lower()
        if len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if re.fullmatch(r"[a-z]{1,2}id", w):
            out.append(w[:-2])
            w = "id"
        out.append(w)
    return list(dict.fromkeys(out))


def schema_profile(files: DataFrame, file_id: str, payload: str) -> DataFrame:
    """(file, path, json_type, n, chars, distinct_share): the schema of each file, one row a path.

    The type is the most frequent one of the non-null values ('' if there are none; ties by name). Values are counted
    before they are shuffled, so a file with a third of all records is no burden.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, p, t, n, zlib.crc32(v.encode())) for f, doc in zip(b["f"], b["d"]) for p, t, v, n in leaves(doc)]
            if rows:
                yield pd.DataFrame(rows, columns=["file", "path", "type", "chars", "value"])

    kind = files.schema[file_id].dataType.simpleString()
    src = files.where(F.col(file_id).isNotNull()).select(F.col(file_id).alias("f"), F.col(payload).alias("d"))
    flat = src.mapInPandas(flatten, f"file {kind}, path string, type string, chars long, value long")
    by_type = flat.groupBy("file", "path", "type").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.approx_count_distinct("value", 0.05).alias("values")
    )
    real = F.col("type") != ""
    prof = by_type.groupBy("file", "path").agg(
        F.max_by(F.when(real, F.col("type")), F.when(real, F.struct(F.col("n"), F.col("type")))).alias("json_type"),
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(real, F.col("chars"))).alias("chars"),
        F.sum(F.when(real, F.col("values")).otherwise(0)).alias("values"),
    )
    mean = F.when(F.col("n") > 0, F.col("chars") / F.col("n"))
    share = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("values") / F.col("n")))
    return prof.select("file", "path", F.coalesce("json_type", F.lit("")).alias("json_type"), "n", mean.alias("chars"), share.alias("distinct_share"))


def _prose(chars: float | None) -> int:
    """1 prose, -1 not, 0 either."""
    if chars is None or chars != chars or SHORT < chars < LONG:
        return 0
    return 1 if chars >= LONG else -1


def likeness(a: dict, b: dict) -> float:
    """How likely two fields of neighbouring files hold the same information, 0 if their values or names speak
    against it. ``a``/``b``: path, parts {part: weight}, own (the parts that tell
    fields of one file apart), chars, distinct_share, n."""
    if _prose(a["chars"]) * _prose(b["chars"]) < 0:
        return 0.0
    low, high = sorted((a["distinct_share"], b["distinct_share"])) if min(a["n"], b["n"]) >= 8 else (0.5, 0.5)
    if low < 0.3 and high > 0.85:
        return 0.0
    common = a["parts"].keys() & b["parts"].keys()
    if not common:
        return 0.0
    weight = {**a["parts"], **b["parts"]}
    same_leaf = a["path"].rsplit(".", 1)[-1] == b["path"].rsplit(".", 1)[-1]
    if not same_leaf and not common & a["own"] & b["own"]:
        return 0.0
    score = sum(weight[p] for p in common) / sum(weight.values())
    return max(score, 0.9) if same_leaf else score


def match_renames(removed: list[dict], added: list[dict]) -> list[tuple[dict, dict]]:
    """One-to-one pairs, likeliest first; ties by path."""
    scored = sorted(
        ((-likeness(r, a), r["path"], a["path"], r, a) for r in removed for a in added), key=lambda x: x[:3]
    )
    out, gone, come = [], set(), set()
    for s, p, q, r, a in scored:
        if -s >= LEAST and p not in gone and q not in come:
            gone.add(p)
            come.add(q)
            out.append((r, a))
    return out


def with_parts(prof: DataFrame) -> DataFrame:
    """``schema_profile`` with the weighted parts of each name: the fewer fields of one file share a part, the more it
    tells."""
    @F.pandas_udf("array<string>")
    def split(paths: pd.Series) -> pd.Series:
        return paths.map(name_parts)

    paths = prof.select("path").distinct().withColumn("parts", split("path"))
    prose = F.when(F.col("chars") >= LONG, 1).when(F.col("chars") <= SHORT, -1).otherwise(0)
    used = prof.select("file", "path", prose.alias("prose")).join(paths, "path").select("file", "prose", F.explode("parts").alias("part"))
    weight = used.groupBy("file", "prose", "part").count().groupBy("prose", "part").agg(
        (1 / F.avg("count")).alias("w"), (F.avg((F.col("count") > 1).cast("double")) <= SPECIFIC).alias("own")
    )
    named = prof.select("path", prose.alias("prose")).distinct().join(paths, "path")
    named = named.select("path", "prose", F.explode("parts").alias("part")).join(weight, ["prose", "part"])
    named = named.groupBy("path", "prose").agg(F.collect_list(F.struct("part", "w", "own")).alias("parts"))
    return prof.withColumn("prose", prose).join(named, ["path", "prose"], "left").drop("prose")


def _with_weights(x: dict, path: str) -> dict:
    parts = x["parts"] if x["parts"] is not None else []
    return x | {"path": path, "parts": {p["part"]: p["w"] for p in parts}, "own": {p["part"] for p in parts if p["own"]}}


def schema_changes(
    records: DataFrame, file_id: str = "file_id", series: str = "series", seq: str = "file_seq", payload: str = "payload"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, schemas, files).

    changes (``file_id``, change_kind, old_path, new_path): differences of each file from the one before it in its
    series. schemas: one row a file and path with its type. files: (``file_id``, series, seq, prev, fingerprint).

    A file has a field if any readable record has the path; broken, empty, null and non-object payloads have none. A
    file without any readable record has no fields; repeated lines count once. Null types differ from nothing. Rows
    with a null file id are left out; a null series is a series of its own; other columns are not read.
    """
    work = Stages(records.sparkSession, "drift")
    prof = work.put(schema_profile(records, file_id, payload), "profile")
    listed = records.where(F.col(file_id).isNotNull()).groupBy(F.col(file_id).alias("file"))
    listed = listed.agg(F.min(series).alias("series"), F.min(seq).alias("seq"))
    prints = prof.groupBy("file").agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "json_type"))), "\n")).alias("fingerprint")
    )
    files = with_previous(listed.join(prints, "file", "left"), ["series"], ["seq", "file"], "file", "prev")
    files = work.put(files, "files")

    rich = work.put(with_parts(prof), "named")

    side = ["json_type", "n", "chars", "distinct_share", "parts"]
    later = files.where("prev is not null")
    now = later.select("file").join(rich, "file").select("file", "path", F.struct(*side).alias("new"))
    was = later.select(F.col("file").alias("f"), F.col("prev").alias("file")).join(rich, "file")
    was = was.select(F.col("f").alias("file"), "path", F.struct(*side).alias("old"))
    both = work.put(now.join(was, ["file", "path"], "full"), "both")
    kept = both.where("old is not null and new is not null")
    moved = both.where("old is null or new is null")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        fields: list[list[dict]] = [[], []]
        for path, old, new in zip(pdf["path"], pdf["old"], pdf["new"]):
            x = dict(old if new is None else new)
            x = _with_weights(x, path)
            fields[new is not None].append(x)
        pairs = match_renames(*fields)
        out = []
        for r, a in pairs:
            out.append(("renamed", r["path"], a["path"]))
            if r["json_type"] and a["json_type"] and r["json_type"] != a["json_type"]:
                out.append(("type_changed", r["path"], a["path"]))
        gone, come = {r["path"] for r, _ in pairs}, {a["path"] for _, a in pairs}
        out.extend(("removed", r["path"], "") for r in fields[0] if r["path"] not in gone)
        out.extend(("added", "", a["path"]) for a in fields[1] if a["path"] not in come)
        got = pd.DataFrame(out, columns=["change_kind", "old_path", "new_path"])
        got.insert(0, "file", pdf["file"].iloc[0])
        return got

    kind = records.schema[file_id].dataType.simpleString()
    steps = moved.groupBy("file").applyInPandas(resolve, f"file {kind}, change_kind string, old_path string, new_path string")
    types = kept.where("old.json_type <> '' and new.json_type <> '' and old.json_type <> new.json_type").select(
        "file", F.lit("type_changed").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path")
    )
    changes = work.put(steps.unionByName(types), "changes")
    return changes.withColumnRenamed("file", file_id), prof, files


def field_lineage(changes: DataFrame, schemas: DataFrame, files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file, path, field): the name under which a lineage of kept and renamed fields first appeared in its series. Of
    several lineages of a series that began under one name, the later ones have a number behind it, so that two fields
    of one file never share a name.

    Each field points to its counterpart in the file before; pointers are doubled until all reach the first one, so a
    series of n files takes about log2(n) joins.
    """
    work = Stages(schemas.sparkSession, "lineage")
    renames = changes.where("change_kind = 'renamed'").select(F.col(file_id).alias("file"), F.col("new_path").alias("path"), "old_path")
    at = schemas.select("file", "path").join(files.select("file", "prev"), "file").join(renames, ["file", "path"], "left")
    back = schemas.select(F.col("file").alias("prev"), F.col("path").alias("up"))
    at = at.withColumn("up", F.coalesce("old_path", "path")).join(back.withColumn("there", F.lit(True)), ["prev", "up"], "left")
    ptr = at.select("file", "path", F.when(F.col("there"), F.struct(F.col("prev").alias("file"), F.col("up").alias("path"))).alias("to"))
    ptr = work.put(ptr, "pointers")
    while True:
        far = ptr.select(F.struct("file", "path").alias("to"), F.col("to").alias("next"))
        nxt = work.put(ptr.join(far, "to", "left").select("file", "path", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("hop")), "pointers")
        hops = nxt.where("hop").limit(1).count()
        work.drop(ptr)
        ptr = nxt.drop("hop")
        ptr._staged_at = nxt._staged_at  # noqa: SLF001
        if not hops:
            break
    at = ptr.select("file", "path", F.coalesce("to", F.struct("file", "path")).alias("root"))
    roots = at.select("root").distinct().join(files.select(F.col("file").alias("f"), "series", "seq"), F.col("root.file") == F.col("f"))
    k = F.row_number().over(Window.partitionBy("series", "root.path").orderBy("seq", "root.file"))  # a row a beginning
    name = F.when(F.col("k") == 1, F.col("root.path")).otherwise(F.concat(F.col("root.path"), F.lit("#"), F.col("k").cast("string")))
    named = roots.withColumn("k", k).select("root", name.alias("field"))
    return work.put(at.join(named, "root").select("file", "path", "field"), "lineage")


def common_fields(series: list[list[dict]]) -> list[dict[str, str]]:
    """One map {field: common name} a series. Fields of a series (dicts as for ``likeness``) meet the fields known from
    the series before it, first by a name known there, then as renames; a field without counterpart is a new one. The
    common name is the one most values have."""
    known: list[dict] = []
    at: list[dict[str, int]] = []
    for fields in series:
        mine: dict[str, int] = {}
        for f in fields:
            same = [k for k, x in enumerate(known) if f["path"] in x["names"] and k not in mine.values()]
            if same:
                mine[f["path"]] = max(same, key=lambda k: (known[k]["names"][f["path"]], -k))
        free = {x["fields"][0]["path"]: k for k, x in enumerate(known) if k not in mine.values()}
        for old, new in match_renames([known[k]["fields"][0] for k in free.values()], [f for f in fields if f["path"] not in mine]):
            mine[new["path"]] = free[old["path"]]
        for f in fields:
            if f["path"] not in mine:
                mine[f["path"]] = len(known)
                known.append({"fields": [f], "names": {}})
            names = known[mine[f["path"]]]["names"]
            names[f["path"]] = names.get(f["path"], 0) + f["n"]
        at.append(mine)
    taken: list[str] = []
    for k, x in enumerate(known):
        order = sorted(x["names"], key=lambda p: (-x["names"][p], p))
        taken.append(next((p for p in order if p not in taken), f"{order[0]}#{k}"))
    return [{p: taken[k] for p, k in mine.items()} for mine in at]


TYPES = ("boolean", "number", "string", "array")
_TRUE = {"true": "true", "yes": "true", "1": "true", "false": "false", "no": "false", "0": "false"}


def _casts(kind: str, value: str) -> tuple[bool, bool]:
    """Whether a JSON text of a type reads as boolean and as number without loss."""
    text = json.loads(value) if kind == "string" else value
    as_number = kind in ("boolean", "number")
    if kind == "string":
        try:
            as_number = json.dumps(json.loads(text, parse_constant=_reject)) == text and text not in ("null", "true", "false")
            as_number = as_number and text[:1] not in "[{\""
        except (ValueError, RecursionError):
            pass
    return kind != "array" and text.lower() in _TRUE, as_number


def cast_json(kind: str, value: str, target: str | None) -> str:
    """A JSON text of type ``kind`` as one of type ``target``, which ``migration_steps`` chose so that it fits."""
    if kind == target or target not in TYPES or kind == "":
        return value
    if target == "array":
        return f"[{value}]"
    text = json.loads(value) if kind == "string" else value
    if target == "boolean":
        return _TRUE[text.lower()]
    if target == "number":
        return {"true": "1", "false": "0"}.get(text, text)
    return json.dumps(text, ensure_ascii=False)


def _once(records: DataFrame, file_id: str, line: str, payload: str) -> DataFrame:
    """(f, rec, n, d, versions): one readable copy of each line, the smallest, and how many different readable ones it
    has. A record without a line number is told by its text."""

    @F.pandas_udf("boolean")
    def readable(docs: pd.Series) -> pd.Series:
        return docs.map(is_record)

    r = records.where(F.col(file_id).isNotNull() & F.col(payload).isNotNull())
    rec = F.coalesce(F.col(line).cast("string"), F.concat(F.lit("#"), F.md5(payload)))
    r = r.select(F.col(file_id).alias("f"), rec.alias("rec"), F.col(line).alias("n"), F.col(payload).alias("d")).distinct()
    return r.where(readable("d")).groupBy("f", "rec").agg(F.min("n").alias("n"), F.min("d").alias("d"), F.count("*").alias("versions"))


def _flat(once: DataFrame) -> DataFrame:
    """(file, rec, path, kind, value, boolean, number) of every non-object value."""

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, r, p, t, v, *_casts(t, v)) for f, r, doc in zip(b["f"], b["rec"], b["d"]) for p, t, v, _ in leaves(doc)]
            if rows:
                yield pd.DataFrame(rows, columns=["file", "rec", "path", "kind", "value", "boolean", "number"])

    ids = once.schema["f"].dataType.simpleString()
    return once.select("f", "rec", "d").mapInPandas(flatten, f"file {ids}, rec string, path string, kind string, value string, boolean boolean, number boolean")


def migration_steps(
    records: DataFrame, lineage: DataFrame, schemas: DataFrame, files: DataFrame, file_id: str = "file_id", line: str = "line_no", payload: str = "payload"
) -> DataFrame:
    """(file, fingerprint, path, name, step, old_type, new_type): what each file's schema needs to become the common
    one. 'rename' to the common name, 'cast' to the field's one type, 'default' (path '') for a field it lacks, which
    is null; 'keep' where neither is needed. A field that needs a rename and a cast has both.

    Root names of all series are matched on the driver (as many as series have fields). A field's type is boolean or
    number if it has such values and all others read as one without loss, array if any value is one (others become
    arrays of one), else string.
    """
    work = Stages(schemas.sparkSession, "steps")
    rich = with_parts(schemas).join(lineage, ["file", "path"]).join(files.select("file", "series"), "file")
    weight = F.greatest("n", F.lit(1))
    began = F.col("path").isin(F.col("field"), F.regexp_replace("field", "#[0-9]+$", ""))
    roots = rich.where(began).groupBy("series", "field").agg(
        F.max_by("parts", "n").alias("parts"), F.sum("n").alias("n"), F.avg("distinct_share").alias("distinct_share"),
        (F.sum(F.col("chars") * weight) / F.sum(F.when(F.col("chars").isNotNull(), weight))).alias("chars"),
    )
    by_series: dict[str | None, list[dict]] = {}
    for r in sorted(roots.collect(), key=lambda r: (r.series is not None, r.series or "", r.field)):
        x = r.asDict()
        x["distinct_share"] = 0.5 if x["distinct_share"] is None else x["distinct_share"]
        by_series.setdefault(r.series, []).append(_with_weights(x, r.field))
    # the series with most fields first, so that the others meet it
    order = sorted(by_series, key=lambda k: (-len(by_series[k]), k is not None, k or ""))
    names = [(k, f, n) for k, m in zip(order, common_fields([by_series[k] for k in order])) for f, n in m.items()]
    common = schemas.sparkSession.createDataFrame(names, "of string, root string, name string")
    same = F.col("series").eqNullSafe(F.col("of")) & (F.col("field") == F.col("root"))
    at = rich.join(F.broadcast(common), same).select("file", "path", "name", "json_type")
    at = work.put(at, "names")
    values = _flat(_once(records, file_id, line, payload)).where("kind <> ''").join(at.select("file", "path", "name"), ["file", "path"])
    seen = values.groupBy("name").agg(
        F.bool_and("boolean").alias("b"), F.bool_and("number").alias("d"), *[F.bool_or(F.col("kind") == k).alias(k) for k in TYPES]
    )
    target = F.when(F.col("array"), "array").when(F.col("boolean") & F.col("b"), "boolean").when(F.col("number") & F.col("d"), "number")
    types = seen.select("name", target.otherwise("string").alias("new_type"))
    types = work.put(at.select("name").distinct().join(types, "name", "left").select("name", F.coalesce("new_type", F.lit("string")).alias("new_type")), "types")
    need = at.join(types, "name")
    rename = F.when(F.col("path") != F.col("name"), F.lit("rename"))
    cast = F.when((F.col("json_type") != "") & (F.col("json_type") != F.col("new_type")), F.lit("cast"))
    found = F.array_compact(F.array(rename, cast))
    need = need.withColumn("step", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("keep")))))
    cols = ["file", "path", "name", "step", F.col("json_type").alias("old_type"), "new_type"]
    lacks = files.select("file").crossJoin(F.broadcast(types)).join(at.select("file", "name"), ["file", "name"], "left_anti")
    lacks = lacks.select("file", F.lit("").alias("path"), "name", F.lit("default").alias("step"), F.lit("").alias("old_type"), "new_type")
    return work.put(need.select(*cols).unionByName(lacks).join(files.select("file", "fingerprint"), "file"), "steps")


def unify_records(
    records: DataFrame, lineage: DataFrame, files: DataFrame, file_id: str = "file_id", line: str = "line_no", payload: str = "payload",
    steps: DataFrame | None = None,
) -> DataFrame:
    """One consistent table of all readable records: (``file_id``, series, seq, ``line``, fingerprint, versions, fields).

    With ``steps`` (of ``migration_steps``) ``fields`` maps every common field to its JSON text in the field's one
    type, null where the record or its file has none. Files whose schemas need the same steps share one set of rules,
    by which their records are routed. Without, it maps the fields a record has, by lineage name, to their JSON text as
    it stands. Lines delivered twice appear once: the smallest readable payload; ``versions`` counts the different ones.
    """
    once = Stages(records.sparkSession, "unify").put(_once(records, file_id, line, payload), "once")
    if steps is None:
        rules = lineage.select("file", "path", F.col("field").alias("name"), F.lit(None).cast("string").alias("new_type"))
    else:
        rules = steps.where("path <> ''").select("file", "path", "name", "new_type").distinct()

    @F.pandas_udf("string")
    def cast(kind: pd.Series, value: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([cast_json(k, v, x) for k, v, x in zip(kind, value, target)], dtype=object)

    rule = F.concat_ws("\x1f", "path", "name", "new_type")
    route = rules.groupBy("file").agg(F.md5(F.array_join(F.sort_array(F.collect_list(rule)), "\n")).alias("route"))
    rules = rules.join(route, "file").select("route", "path", "name", "new_type").distinct()
    named = _flat(once).join(route, "file").join(rules, ["route", "path"])
    if steps is not None:
        named = named.withColumn("value", cast("kind", "value", "new_type"))
    rows = named.groupBy("file", "rec", "name").agg(F.max(F.when(F.col("kind") != "", F.col("value"))).alias("value"))
    rows = rows.groupBy("file", "rec").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))
    rows = once.select(F.col("f").alias("file"), "rec", F.col("n").alias("line"), "versions").join(rows, ["file", "rec"], "left")
    if steps is not None:
        every = steps.agg(F.sort_array(F.collect_set("name")).alias("names"))
        filled = F.map_from_arrays("names", F.transform("names", lambda n: F.col("fields")[n]))
        rows = rows.crossJoin(F.broadcast(every)).select("file", "line", "versions", filled.alias("fields"))
    out = rows.join(files.select("file", "series", "seq", "fingerprint"), "file")
    return out.select(F.col("file").alias(file_id), "series", "seq", F.col("line").alias(line), "fingerprint", "versions", "fields")


def typed_records(unified: DataFrame, steps: DataFrame) -> DataFrame:
    """``unify_records`` with a column of its own for every common field: numbers as doubles, booleans, strings, and
    arrays of strings (of JSON texts where their parts are no strings). Dots in names become underscores; a name that is
    taken gets a number. The fields are those of ``steps``, one row each on the driver."""
    kinds = sorted((r.name, r.new_type) for r in steps.select("name", "new_type").distinct().collect())
    keys = [c for c in unified.columns if c != "fields"]
    taken, cols = set(keys), []
    for name, kind in kinds:
        base = column = name.replace(".", "_").replace("#", "_")
        k = 2
        while column in taken:
            column, k = f"{base}_{k}", k + 1
        taken.add(column)
        v = F.col("fields")[name]
        if kind == "number":
            v = v.try_cast("double")
        elif kind == "boolean":
            v = F.when(v.isNotNull(), v == "true")
        elif kind == "array":
            v = F.from_json(v, "array<string>")
        else:
            v = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
        cols.append(v.alias(column))
    return unified.select(*keys, *cols)
