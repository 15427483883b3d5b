"""More registered queries over the given tables: nested data, parsing, vectors, gates and compositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekiln.functions import questions as fq
from lorekiln.operators.clusters import connected
from lorekiln.plans.order import with_ordinal
from lorekiln.plans.reference_queries import AW, KEYWORD, TOK, _TFIDF, query, t, tfidf
from lorekiln.sources.files import serialize_complex

# ---------------------------------------------------------------- nested data and projection


@query("SELECT answer, question, record_id AS id FROM validation_batch")
def project_reorder(s, d):
    return t(s, d, "validation_batch").select("answer", "question", "record_id").withColumnsRenamed({"record_id": "id"})


@query(
    "SELECT file_id, line_no, json_extract_string(payload, '$.flags.quote_failed') AS quote_failed, json_extract_string(payload, '$.severity') AS severity FROM judge_raw WHERE json_valid(payload)"
)
def json_flatten(s, d):
    r = t(s, d, "judge_raw").where("try_parse_json(payload) is not null")
    return r.select("file_id", "line_no", F.get_json_object("payload", "$.flags.quote_failed").alias("quote_failed"), F.get_json_object("payload", "$.severity").alias("severity"))


@query("SELECT record_id, CASE WHEN answer_variations IS NULL THEN NULL ELSE to_json(answer_variations) END AS answer_variations FROM validation_batch")
def complex_serialise(s, d):
    v = serialize_complex(t(s, d, "validation_batch").select("record_id", "answer_variations"))
    return v


@query("SELECT record_id, answer_variations FROM validation_batch")
def json_rehydrate(s, d):
    v = serialize_complex(t(s, d, "validation_batch").select("record_id", "answer_variations"))
    return v.select("record_id", F.from_json("answer_variations", "array<string>").alias("answer_variations"))


@query("SELECT DISTINCT source FROM documents WHERE starts_with(source, 'copper_psalter') AND CAST(regexp_extract(source, '_chapter_([0-9]+)', 1) AS INT) <= 10 ORDER BY source LIMIT 8")
def chapter_listing(s, d):
    c = t(s, d, "documents").where(F.col("source").startswith("copper_psalter")).select("source").distinct()
    n = F.regexp_extract("source", "_chapter_([0-9]+)", 1).cast("int")
    return c.where(n <= 10).orderBy("source").limit(8)


@query(
    "SELECT batch_no, staging_id, 'run1_' || batch_no || '_' || row_number() OVER (PARTITION BY batch_no ORDER BY staging_id) AS lineage_id FROM staging_batch"
)
def jsonl_lineage(s, d):
    # numbered over all batches by range partitions, then from each batch's first on: a large batch is no task of its own
    rows = with_ordinal(t(s, d, "staging_batch").select("batch_no", "staging_id"), ["batch_no", "staging_id"], "i")
    first = rows.groupBy("batch_no").agg(F.min("i").alias("first"))
    n = F.col("i") - F.col("first") + 1
    return rows.join(first, "batch_no").select("batch_no", "staging_id", F.concat_ws("_", F.lit("run1"), "batch_no", n).alias("lineage_id"))


@query("SELECT vec_id, label, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS pos FROM embeddings QUALIFY pos IN (0, 7, 11)")
def position_lookup(s, d):
    e = t(s, d, "embeddings").select("vec_id", "label")
    return with_ordinal(e, ["vec_id"], "pos").where(F.col("pos").isin(0, 7, 11))


@query("SELECT question_type, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id, count(DISTINCT batch_name) AS batches FROM validation_batch GROUP BY 1")
def join_index_aggs(s, d):
    return t(s, d, "validation_batch").groupBy("question_type").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"), F.countDistinct("batch_name").alias("batches"))


@query("SELECT v.record_id, o.trust_rank FROM validation_batch v JOIN origin_trust o USING (generation_model) WHERE o.trust_rank <= 2")
def join_lookup_map(s, d):
    return t(s, d, "validation_batch").join(t(s, d, "origin_trust").where("trust_rank <= 2"), "generation_model").select("record_id", "trust_rank")


@query(
    "SELECT (SELECT count(*) FROM judge_batch j SEMI JOIN staging_batch s ON j.source_reference = s.source_reference) AS n_semi, (SELECT count(*) FROM judge_batch j ANTI JOIN staging_batch s ON j.source_reference = s.source_reference) AS n_anti"
)
def semi_anti(s, d):
    j = t(s, d, "judge_batch").select("source_reference")
    known = t(s, d, "staging_batch").select("source_reference").distinct().withColumn("hit", F.lit(1))
    m = j.join(known, "source_reference", "left")
    return m.agg(F.count("hit").alias("n_semi"), F.count_if(F.col("hit").isNull()).alias("n_anti"))


# ---------------------------------------------------------------- parsing


@query()
def normalize_value(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.normalize_text("answer").alias("answer"))


@query(r"SELECT record_id, regexp_matches(lower(answer), '\b(bc|bce|b\.c\.|b\.c\.e\.)(\b|$| )') AS bc FROM validation_batch")
def bc_indicator(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.bc_indicator(F.col("answer")).alias("bc"))


@query(r"SELECT record_id, regexp_replace(replace(trim(lower(answer), ' '), ',', ''), '- +([0-9])', '-\1', 'g') AS number_text FROM validation_batch")
def normalize_numeric_text(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.normalize_numeric(F.col("answer")).alias("number_text"))


@query(
    """SELECT file_id, line_no, coalesce(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.temp_qid') END, nullif(regexp_extract(payload, '"temp_qid"\\s*:\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(payload, '"temp_qid"\\s*:\\s*(-?[0-9]+)\\s*[,}]', 1), '')) AS temp_qid FROM judge_raw"""
)
def extract_json_fallback(s, d):
    r = t(s, d, "judge_raw")
    # a number counts only if something follows it: it may be cut off
    rule = r'"temp_qid"\s*:\s*(?:"([^"]*)"|(-?[0-9]+)\s*[,}])'
    found = F.coalesce(*[F.nullif(F.regexp_extract("payload", rule, k), F.lit("")) for k in (1, 2)])
    parsed = F.when(F.expr("try_parse_json(payload) is not null"), F.get_json_object("payload", "$.temp_qid"))
    return r.select("file_id", "line_no", F.coalesce(parsed, found).alias("temp_qid"))


_FACT = ",".join(f"'{x}'" for x in fq.FACTUAL)
_YES = ",".join(f"'{x}'" for x in fq.YES_NO)


@query(
    f"SELECT record_id, CASE WHEN list_has_any({TOK}, [{_FACT}]) THEN 'FR' WHEN list_has_any({TOK}, ['why']) THEN 'EX' WHEN list_has_any(regexp_extract_all(lower(coalesce(answer,'')), '[a-z0-9]+'), [{_YES}]) THEN 'YN' ELSE 'Other' END AS category FROM validation_batch"
)
def categorize_cascade_v0(s, d):
    q, a = fq.tokens(F.col("question")), fq.tokens(F.col("answer"))
    any_of = lambda tok, words: F.arrays_overlap(tok, F.array(*map(F.lit, words)))
    c = F.when(any_of(q, fq.FACTUAL), "FR").when(any_of(q, fq.EXPLANATORY), "EX").when(any_of(a, fq.YES_NO), "YN").otherwise("Other")
    return t(s, d, "validation_batch").select("record_id", c.alias("category"))


# ---------------------------------------------------------------- vectors


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


_PAIRS = f"p AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, {_COS} AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"
_TWO = f"{_PAIRS}, r AS (SELECT label, id_a, cos, row_number() OVER (PARTITION BY id_a ORDER BY cos DESC) AS rn FROM p)"


TILE = 1024  # vectors a side of a tile


def _label_tiles(s, d, compare, shape: str):
    """``compare`` over every two chunks of a label: a frame of two chunks (``chunk`` i and j, i <= j) a task."""
    e = t(s, d, "embeddings").where("label is not null and vec_id is not null").select("label", "vec_id", "embedding")
    m = e.groupBy("label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("m"))
    e = e.join(m, "label").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("m")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    e = e.select("label", "vec_id", "embedding", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return e.groupBy("label", "i", "j").applyInPandas(compare, shape)


def _cosines(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both sides and their cosines, NaN where a norm is zero and between a vector and itself."""
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    first = (pdf["chunk"] == pdf["i"]).to_numpy()
    x, y = pdf[first], pdf if one else pdf[~first]
    if not len(x) or not len(y):
        return x["vec_id"].to_numpy(), y["vec_id"].to_numpy(), np.zeros((len(x), len(y)))
    p, q = (np.stack([np.asarray(v, np.float64) for v in side["embedding"]]) for side in (x, y))
    with np.errstate(invalid="ignore", divide="ignore"):
        p, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (p, q))
        cos = p @ q.T
    if one:
        np.fill_diagonal(cos, np.nan)
    return x["vec_id"].to_numpy(), y["vec_id"].to_numpy(), cos


def _all_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b, cos = _cosines(pdf)
    if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
        p, q = np.nonzero(a[:, None] < b[None, :])
    else:
        p, q = (k.ravel() for k in np.indices(cos.shape))
    return pd.DataFrame({"id_a": np.minimum(a[p], b[q]), "id_b": np.maximum(a[p], b[q]), "cos": cos[p, q]})


def _best_two(pdf: pd.DataFrame) -> pd.DataFrame:
    """The two largest cosines of each vector of the tile with the other side's; -2 for none."""
    a, b, cos = _cosines(pdf)
    cos = np.where(np.isnan(cos), -2.0, cos)
    out = []
    for ids, c in ((a, cos), (b, cos.T))[: 1 if pdf["i"].iloc[0] == pdf["j"].iloc[0] else 2]:
        c = np.sort(np.pad(c, ((0, 0), (0, 2)), constant_values=-2.0), axis=1)
        out.append(pd.DataFrame({"label": pdf["label"].iloc[0], "id_a": ids, "first": c[:, -1], "second": c[:, -2]}))
    return pd.concat(out)


def _top_two(s, d):
    """(label, id_a, best, margin): each vector's largest cosine with any other of its label, and what the second lacks."""
    each = _label_tiles(s, d, _best_two, "label int, id_a long, first double, second double")
    x = F.filter(F.flatten(F.collect_list(F.array("first", "second"))), lambda v: v > -2)
    top = each.groupBy("label", "id_a").agg(F.sort_array(x, asc=False).alias("c"))
    return top.select("label", "id_a", F.get("c", F.lit(0)).alias("best"), (F.get("c", F.lit(0)) - F.get("c", F.lit(1))).alias("margin"))


@query(f"WITH {_PAIRS} SELECT id_a, id_b, round(cos, 6) AS cos FROM p WHERE id_a < id_b")
def pairwise_cosine_batch(s, d):
    pairs = _label_tiles(s, d, _all_pairs, "id_a long, id_b long, cos double")
    return pairs.select("id_a", "id_b", F.round(F.nanvl("cos", F.lit(None).cast("double")), 6).alias("cos"))


@query(f"WITH {_TWO} SELECT id_a, round(greatest(max(cos), 0.0), 6) AS best FROM r GROUP BY 1")
def nearest_vector(s, d):
    return _top_two(s, d).select("id_a", F.round(F.greatest("best", F.lit(0.0)), 6).alias("best"))


@query(f"WITH {_TWO} SELECT id_a, round(max(cos) FILTER (rn = 1) - max(cos) FILTER (rn = 2), 6) AS margin FROM r GROUP BY 1")
def nearest_vector_margin(s, d):
    return _top_two(s, d).select("id_a", F.round("margin", 6).alias("margin"))


@query(f"WITH {_TWO} SELECT label, round(max(cos), 6) AS collision FROM r GROUP BY 1")
def label_collision(s, d):
    return _top_two(s, d).groupBy("label").agg(F.round(F.max("best"), 6).alias("collision"))


# ---------------------------------------------------------------- gates and compositions


@query(
    "SELECT record_id, question, answer, explanation FROM validation_batch WHERE question_type IN ('EX','FR','MCQ') AND answer IS NOT NULL AND explanation IS NOT NULL AND (question_type <> 'MCQ' OR len(mcq_options) = 4)"
)
def promote_gold(s, d):
    k = F.col("question_type")
    v = t(s, d, "validation_batch").where(k.isin("EX", "FR", "MCQ")).dropna(subset=["answer", "explanation"])
    return v.where((k != "MCQ") | (F.size("mcq_options") == 4)).select("record_id", "question", "answer", "explanation")


