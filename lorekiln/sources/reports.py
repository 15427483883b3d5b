"""Reports, manifests and fitted vocabularies: what a run leaves behind beside its tables.

Aggregates are made in Spark; only reports of a bounded size are formatted on the driver. Files are written once, through
the file system that their address names.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_GROUPS = 10_000  # groups of a report that the driver formats


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small text file; False, and nothing written, where one is there already."""
    p, fs = _fs(spark, path)
    if fs.exists(p) and not replace:
        return False
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def session_reports(turns: DataFrame, session: str, order: str, path: str) -> str:
    """One JSON record a session with its turns in order, as a table of JSON lines in a folder named by time; returns
    the folder. A session's turns are held by one task."""
    turn = F.struct(order, *[c for c in turns.columns if c not in (session, order)])
    out = turns.groupBy(session).agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    at = f"{path.rstrip('/')}/sessions_{time.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:6]}"
    out.write.mode("errorifexists").json(at)
    return at


def metrics_report(metrics: DataFrame, path: str) -> bool:
    """A table of metrics (at most ``MOST_GROUPS`` rows) as one JSON file; more rows stop the report."""
    rows = [r.asDict(recursive=True) for r in metrics.limit(MOST_GROUPS + 1).collect()]
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: write the table itself")
    return write_text(metrics.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=1, default=str))


def run_manifest(spark: SparkSession, folder: str, run_id: str, settings: dict) -> bool:
    """What a run was started with; False where the run has one already."""
    return write_text(spark, f"{folder}/{run_id}/manifest.json", json.dumps({"run_id": run_id, "status": "started", "settings": settings}, indent=1))


def run_receipt(spark: SparkSession, folder: str, run_id: str, totals: dict, status: str = "done") -> bool:
    return write_text(spark, f"{folder}/{run_id}/receipt.json", json.dumps({"run_id": run_id, "status": status, "totals": totals}, indent=1))


def run_plan(experiments: list[dict], common: dict | None = None) -> str:
    """A plan of experiments as text that both JSON and YAML readers take; each run gets an id and the status planned."""
    out = []
    for e in experiments:
        runs = [{"id": f"{e['name']}_{i:03d}", "status": "planned", **r} for i, r in enumerate(e.get("runs") or [{}], 1)]
        out.append({**{k: v for k, v in e.items() if k != "runs"}, "runs": runs})
    return json.dumps({"common": common or {}, "experiments": out}, indent=1, ensure_ascii=False)


def set_status(plan: str, run_id: str, status: str) -> str:
    """The plan with one run's status changed; an unknown run is an error."""
    got = json.loads(plan)
    hit = [r for e in got["experiments"] for r in e["runs"] if r["id"] == run_id]
    if not hit:
        raise KeyError(run_id)
    for r in hit:
        r["status"] = status
    return json.dumps(got, indent=1, ensure_ascii=False)


def save_vocabulary(weights: DataFrame, path: str) -> None:
    """The fitted part of ``tfidf``: (term, idf), one row a term."""
    weights.groupBy("term").agg(F.max("idf").alias("idf")).write.mode("errorifexists").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, idf double").parquet(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made by ``make()`` and written there if there is none."""
    p, fs = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown_report(title: str, tables: dict[str, DataFrame]) -> str:
    """A title and a table for each frame of at most ``MOST_GROUPS`` rows; more rows stop the report."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(MOST_GROUPS + 1).collect()
        if len(rows) > MOST_GROUPS:
            raise ValueError(f"{name}: more than {MOST_GROUPS} rows")
        cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ") if v is not None else ""
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows] + [""]
    return "\n".join(lines)
