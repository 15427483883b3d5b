"""Registered queries: ingestion, duplicates, alignment, gates, sources and reports in full."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lorekiln.functions import embedding, statistics
from lorekiln.functions import questions as fq
from lorekiln.operators.clusters import connected
from lorekiln.operators.similar import best_earlier, most_similar, similar_pairs
from lorekiln.plans.reference_queries import _TFIDF, AW, KEYWORD, TOK, query, t, tfidf
from lorekiln.plans.reference_queries_3 import _OTHERS, sql_buckets, sql_similar, sql_tokens
from lorekiln.plans.stage import Stages
from lorekiln.sources import files

# ---------------------------------------------------------------- similar texts

_STAGED = _TFIDF.replace("validation_batch", "staging_batch").replace("record_id", "staging_id")
_DOTS = "SELECT x.staging_id AS id_a, y.staging_id AS id_b, round(sum(x.w*y.w), 6) AS sim FROM w x JOIN w y ON x.term = y.term AND x.staging_id < y.staging_id GROUP BY 1, 2"
_EARLIER = f"dots AS ({_DOTS}), e AS (SELECT CASE WHEN q.batch_no > p.batch_no THEN id_b ELSE id_a END AS id, CASE WHEN q.batch_no > p.batch_no THEN id_a ELSE id_b END AS known, sim FROM dots JOIN staging_batch p ON p.staging_id = id_a JOIN staging_batch q ON q.staging_id = id_b WHERE p.batch_no <> q.batch_no AND sim >= 0.7), best AS (SELECT id AS staging_id, arg_min(known, (-sim, known)) AS known_id, max(sim) AS sim FROM e GROUP BY 1)"


def _weights(s, d):
    return tfidf(t(s, d, "staging_batch").select("staging_id", "question"), "staging_id", fq.tokens(F.col("question")))


def _best_known(s, d, least: float = 0.7):
    b = t(s, d, "staging_batch").select("staging_id", "batch_no")
    return best_earlier(similar_pairs(_weights(s, d), "staging_id", least), b, "staging_id", "batch_no")


@query(f"WITH {_STAGED}, dots AS ({_DOTS}) SELECT id_a, id_b, sim AS cos FROM dots JOIN staging_batch p ON p.staging_id = id_a JOIN staging_batch q ON q.staging_id = id_b WHERE p.batch_no = q.batch_no AND sim >= 0.6")
def cosine_tfidf_pairs(s, d):
    w = _weights(s, d).join(t(s, d, "staging_batch").select("staging_id", "batch_no"), "staging_id")
    return similar_pairs(w, "staging_id", 0.6, "batch_no").withColumnRenamed("sim", "cos")


@query(f"WITH {_STAGED}, dots AS ({_DOTS}) SELECT id_a, id_b, sim FROM dots JOIN staging_batch p ON p.staging_id = id_a JOIN staging_batch q ON q.staging_id = id_b WHERE p.batch_no <> q.batch_no AND sim >= 0.9")
def cross_pairs_threshold(s, d):
    b = t(s, d, "staging_batch")
    p, q = b.select(F.col("staging_id").alias("id_a"), F.col("batch_no").alias("x")), b.select(F.col("staging_id").alias("id_b"), F.col("batch_no").alias("y"))
    return similar_pairs(_weights(s, d), "staging_id", 0.9).join(p, "id_a").join(q, "id_b").where("x <> y").select("id_a", "id_b", "sim")


@query(f"WITH {_STAGED}, dots AS ({_DOTS}) SELECT id_a, id_b, sim FROM dots WHERE sim >= 0.6 AND sim >= (SELECT max(sim) FROM dots) - 1e-6 ORDER BY id_a, id_b LIMIT 20")
def max_similarity_pairs(s, d):
    """The first 20 of the pairs that reach the largest similarity."""
    return most_similar(_weights(s, d), "staging_id", 0.6, 20, Stages(s, "similar"))


@query(
    f"WITH {_STAGED}, {_EARLIER} SELECT s.staging_id, known_id, sim, CASE WHEN sim >= 0.9 THEN 'critical' WHEN sim >= 0.7 THEN 'caution' ELSE 'new' END AS status FROM staging_batch s LEFT JOIN best USING (staging_id)"
)
def ingest_duplicate_check(s, d):
    b = t(s, d, "staging_batch").select("staging_id").join(_best_known(s, d), "staging_id", "left")
    q = F.col("sim")
    return b.select("staging_id", "known_id", "sim", F.when(q >= 0.9, "critical").when(q >= 0.7, "caution").otherwise("new").alias("status"))


@query(
    f"WITH {_STAGED}, {_EARLIER}, x AS (SELECT s.staging_id, known_id, sim, {sql_buckets('s.answer')} AS a, {sql_buckets('k.answer')} AS b FROM staging_batch s LEFT JOIN best USING (staging_id) LEFT JOIN staging_batch k ON k.staging_id = known_id), y AS (SELECT *, CASE WHEN known_id IS NOT NULL THEN {sql_similar('a', 'b')} END AS answer_sim FROM x) SELECT staging_id, known_id, sim AS question_sim, answer_sim, CASE WHEN sim >= 0.9 AND answer_sim >= 0.9 THEN 'AUTO_DELETE' WHEN sim >= 0.7 THEN 'REVIEW' ELSE 'KEEP' END AS action FROM y"
)
def dedup_vs_canonical(s, d):
    """The best earlier question of each row, then the similarity of the answers at that row."""
    b = t(s, d, "staging_batch").select("staging_id", "answer")
    k = b.select(F.col("staging_id").alias("known_id"), F.col("answer").alias("known_answer"))
    x = b.join(_best_known(s, d), "staging_id", "left").join(k, "known_id", "left")
    x = x.withColumn("answer_sim", F.when(F.col("known_id").isNotNull(), embedding.similarity(F.col("answer"), F.col("known_answer"))))
    action = F.when((F.col("sim") >= 0.9) & (F.col("answer_sim") >= 0.9), "AUTO_DELETE").when(F.col("sim") >= 0.7, "REVIEW").otherwise("KEEP")
    return x.select("staging_id", "known_id", F.col("sim").alias("question_sim"), "answer_sim", action.alias("action"))


@query(f"WITH {_TFIDF}, a AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest({sql_tokens('answer')}) AS term FROM validation_batch) GROUP BY 1, 2), x AS (SELECT record_id, term, tf * idf AS x FROM a JOIN idf USING (term)) SELECT record_id, term, round(x / sqrt(sum(x*x) OVER (PARTITION BY record_id)), 6) AS w FROM x")
def tfidf_transform(s, d):
    """Answers in the vocabulary fitted on the questions; terms that no question has are dropped."""
    v = t(s, d, "validation_batch")
    idf = tfidf(v.select("record_id", "question"), "record_id", fq.tokens(F.col("question"))).groupBy("term").agg(F.max("idf").alias("idf"))
    a = v.select("record_id", F.explode(fq.tokens(F.col("answer"))).alias("term")).groupBy("record_id", "term").agg(F.count("*").alias("tf"))
    x = a.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = x.groupBy("record_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, "record_id").select("record_id", "term", F.round(F.col("x") / F.col("norm"), 6).alias("w"))


@query(
    f"WITH {_TFIDF}, a AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest({sql_tokens('answer')}) AS term FROM validation_batch) GROUP BY 1, 2), x AS (SELECT record_id, term, tf * idf AS x FROM a JOIN idf USING (term)), y AS (SELECT record_id, term, x / sqrt(sum(x*x) OVER (PARTITION BY record_id)) AS y FROM x), c AS (SELECT v.record_id, round(coalesce(sum(w.w * y.y), 0), 6) AS c FROM validation_batch v LEFT JOIN w ON w.record_id = v.record_id LEFT JOIN y ON y.record_id = v.record_id AND y.term = w.term GROUP BY 1) SELECT CASE WHEN c > 0.5 THEN 'high' WHEN c > 0.1 THEN 'related' WHEN c > 0 THEN 'weak' ELSE 'zero' END AS bin, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM validation_batch), 4) AS share FROM c GROUP BY 1"
)
def qa_similarity_bins(s, d):
    """Cosine of each question with its own answer, in bins."""
    v = t(s, d, "validation_batch")
    q = tfidf(v.select("record_id", "question"), "record_id", fq.tokens(F.col("question"))).select("record_id", "term", F.col("w").alias("wq"))
    a = tfidf_exact_answers(v)
    c = v.select("record_id").join(q.join(a, ["record_id", "term"]).groupBy("record_id").agg(F.sum(F.col("wq") * F.col("wa")).alias("c")), "record_id", "left")
    x = F.round(F.coalesce("c", F.lit(0.0)), 6)
    g = c.groupBy(F.when(x > 0.5, "high").when(x > 0.1, "related").when(x > 0, "weak").otherwise("zero").alias("bin")).agg(F.count("*").alias("n"))
    total = v.agg(F.count("*").alias("total"))  # one row
    return g.join(F.broadcast(total)).select("bin", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


def tfidf_exact_answers(v):
    """(record_id, term, wa): answers weighted by the questions' idf, each of length one."""
    idf = tfidf(v.select("record_id", "question"), "record_id", fq.tokens(F.col("question"))).groupBy("term").agg(F.max("idf").alias("idf"))
    a = v.select("record_id", F.explode(fq.tokens(F.col("answer"))).alias("term")).groupBy("record_id", "term").agg(F.count("*").alias("tf"))
    x = a.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = x.groupBy("record_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, "record_id").select("record_id", "term", (F.col("x") / F.col("norm")).alias("wa"))


BLOCKS = 16  # blocks of rows that a query set meets one by one


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0")
def cosine_similarity(s, d):
    """Every vector whose id is divisible by 50 against all others, block by block."""
    e = t(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    rows = e.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(BLOCKS)).cast("int").alias("block"))
    return q.join(rows, "block").where("id_a <> id_b").select("id_a", "id_b", F.round(fq.cosine(F.col("x"), F.col("y")), 6).alias("cos"))


# ---------------------------------------------------------------- groups

LEVELS = (0.95, 0.9, 0.8)


def _reach(name: str, edges: str) -> str:
    """CTEs e_, r_ and c_: edges both ways, what each node reaches, and its cluster."""
    return f"e_{name} AS (SELECT a, b FROM ({edges}) WHERE a <> b UNION SELECT b, a FROM ({edges}) WHERE a <> b), r_{name} AS (SELECT a AS node, a AS reach FROM e_{name} UNION SELECT r_{name}.node, e_{name}.b FROM r_{name} JOIN e_{name} ON r_{name}.reach = e_{name}.a), c_{name} AS (SELECT node, min(reach) AS cluster FROM r_{name} GROUP BY 1)"


def _level_sql() -> str:
    parts, out = [], []
    for i, level in enumerate(LEVELS):
        edges = f"SELECT temp_qid_a AS a, temp_qid_b AS b FROM quote_matches WHERE quote_similarity >= {level} AND NOT isnan(quote_similarity)"
        parts.append(_reach(str(i), edges))
        before = f"SELECT node FROM c_{i - 1}" if i else "SELECT NULL::VARCHAR AS node WHERE false"
        parts.append(
            f"g_{i} AS (SELECT cluster, count(*) AS n, CAST(count_if(node IN ({before})) AS BIGINT) AS old FROM c_{i} GROUP BY 1)"
        )
        out.append(
            f"SELECT {level}::DOUBLE AS level, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, CAST(sum(n - old) AS BIGINT) AS new_members, CAST(count_if(old = 0) AS BIGINT) AS new_groups, CAST(count_if(old > 0 AND old < n) AS BIGINT) AS expanded FROM g_{i}"
        )
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_level_sql())
def threshold_sweep_new_members(s, d):
    """Per descending threshold: groups, members, pairs within groups, and what the level before had not."""
    q = F.col("quote_similarity")
    m = t(s, d, "quote_matches").where(q.isNotNull() & ~F.isnan(q))
    before, out = None, None
    for level in LEVELS:
        c = connected(m.where(q >= level), "temp_qid_a", "temp_qid_b")
        if before is None:
            known = c.withColumn("old", F.lit(0))
        else:
            known = c.join(before.select("node", F.lit(1).alias("hit")), "node", "left").withColumn("old", F.coalesce("hit", F.lit(0)))
        g = known.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("old").alias("old"))
        n, old = F.col("n"), F.col("old")
        row = g.agg(
            F.lit(level).alias("level"), F.count("*").alias("groups"), F.sum(n).alias("members"), F.sum(F.floor(n * (n - 1) / 2)).cast("long").alias("pairs"),
            F.sum(n - old).alias("new_members"), F.count_if(old == 0).alias("new_groups"), F.count_if((old > 0) & (old < n)).alias("expanded"),
        )
        before, out = c, row if out is None else out.unionByName(row)
    return out


_ONE = "(SELECT temp_qid, arg_min(question_type, received_at) AS question_type, arg_min(coalesce(question,''), received_at) AS question, arg_min(coalesce(answer,''), received_at) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY temp_qid ORDER BY received_at, question, answer) AS rn FROM judge_batch) WHERE rn = 1 GROUP BY 1)"
_CLOSE = "SELECT temp_qid_a AS a, temp_qid_b AS b FROM quote_matches WHERE quote_similarity > 0.95 AND NOT isnan(quote_similarity)"
_RANK = "CASE upper(coalesce(question_type,'')) WHEN 'EX' THEN 0 WHEN 'MCQ' THEN 1 WHEN 'FR' THEN 2 ELSE 3 END"


@query(
    f"WITH RECURSIVE {_reach('q', _CLOSE)}, o AS {_ONE}, m AS (SELECT c.cluster, o.temp_qid, question, answer, {_RANK} AS rank FROM c_q c JOIN o ON o.temp_qid = c.node), g AS (SELECT cluster, arg_min(temp_qid, (rank, temp_qid)) AS golden FROM m GROUP BY 1), x AS (SELECT m.cluster, golden, m.temp_qid, {sql_buckets('m.question')} AS q1, {sql_buckets('o.question')} AS q2, {sql_buckets('m.answer')} AS a1, {sql_buckets('o.answer')} AS a2 FROM m JOIN g USING (cluster) JOIN o ON o.temp_qid = golden), y AS (SELECT cluster, golden, temp_qid, {sql_similar('q1', 'q2')} AS question_sim, {sql_similar('a1', 'a2')} AS answer_sim FROM x) SELECT cluster, golden, temp_qid, question_sim, answer_sim, temp_qid <> golden AND round((question_sim + answer_sim) / 2, 6) > 0.6 AND answer_sim > 0.5 AS duplicate FROM y"
)
def group_duplicates(s, d):
    """Groups by quotes, the golden record of each by type, and who of the others asks and answers the same."""
    q = F.col("quote_similarity")
    c = connected(t(s, d, "quote_matches").where((q > 0.95) & ~F.isnan(q)), "temp_qid_a", "temp_qid_b")
    j = t(s, d, "judge_batch").withColumn("question", F.coalesce("question", F.lit(""))).withColumn("answer", F.coalesce("answer", F.lit("")))
    first = F.min(F.struct("received_at", "question", "answer", "question_type")).alias("r")
    one = j.groupBy("temp_qid").agg(first).select("temp_qid", "r.question_type", "r.question", "r.answer")
    k = F.upper(F.coalesce("question_type", F.lit("")))
    rank = F.when(k == "EX", 0).when(k == "MCQ", 1).when(k == "FR", 2).otherwise(3)
    m = c.withColumnRenamed("node", "temp_qid").join(one, "temp_qid").withColumn("rank", rank)
    g = m.groupBy("cluster").agg(F.min(F.struct("rank", "temp_qid", "question", "answer")).alias("g"))
    x = m.join(g, "cluster")
    x = x.select("cluster", F.col("g.temp_qid").alias("golden"), "temp_qid", embedding.similarity(F.col("question"), F.col("g.question")).alias("question_sim"), embedding.similarity(F.col("answer"), F.col("g.answer")).alias("answer_sim"))
    composite = F.round((F.col("question_sim") + F.col("answer_sim")) / 2, 6)
    return x.withColumn("duplicate", (F.col("temp_qid") != F.col("golden")) & (composite > 0.6) & (F.col("answer_sim") > 0.5))


_QUOTE_PAIRS = f"SELECT a.staging_id AS a, b.staging_id AS b FROM x a JOIN x b ON a.batch_no = b.batch_no AND a.source_reference = b.source_reference AND a.staging_id < b.staging_id WHERE {sql_similar('a.v', 'b.v')} > 0.95"


@query(
    f"WITH RECURSIVE x AS (SELECT staging_id, batch_no, source_reference, {sql_buckets('source_quote')} AS v FROM staging_batch WHERE source_quote IS NOT NULL), k AS ({_QUOTE_PAIRS}), {_reach('b', 'SELECT a, b FROM k')} SELECT s.staging_id, coalesce(cluster, s.staging_id) AS golden, coalesce(cluster <> s.staging_id, false) AS duplicate FROM staging_batch s LEFT JOIN c_b ON node = s.staging_id"
)
def dedup_batch_pipeline(s, d):
    """Within a batch and a chapter: quotes as vectors, pairs above the threshold, groups, the first as golden record."""
    b = t(s, d, "staging_batch")
    x = b.where("source_quote is not null").select("batch_no", "source_reference", "staging_id", F.col("source_quote").alias("v"))
    y = x.withColumnsRenamed({"staging_id": "other", "v": "w"})
    near = x.join(y, ["batch_no", "source_reference"]).where("staging_id < other").where(embedding.similarity(F.col("v"), F.col("w")) > 0.95)
    c = connected(near.select("staging_id", "other"), "staging_id", "other").withColumnRenamed("node", "staging_id")
    out = b.select("staging_id").join(c, "staging_id", "left")
    return out.select("staging_id", F.coalesce("cluster", "staging_id").alias("golden"), F.coalesce(F.col("cluster") != F.col("staging_id"), F.lit(False)).alias("duplicate"))


_MANUAL = "SELECT temp_qid_a AS temp_qid, bool_or(is_match) AS manual FROM quote_matches WHERE temp_qid_a IS NOT NULL AND is_match IS NOT NULL GROUP BY 1"
_MATCHED = "SELECT temp_qid_a AS a, temp_qid_b AS b FROM quote_matches WHERE is_match"


def _manual(s, d):
    m = t(s, d, "quote_matches").where("temp_qid_a is not null and is_match is not null")
    return m.groupBy(F.col("temp_qid_a").alias("temp_qid")).agg(F.bool_or("is_match").alias("manual"))


@query(f"SELECT DISTINCT j.temp_qid, coalesce(manual, j.source_quote IS NULL) AS flagged FROM judge_batch j LEFT JOIN ({_MANUAL}) m USING (temp_qid)")
def join_manual_override(s, d):
    j = t(s, d, "judge_batch").select("temp_qid", F.col("source_quote").isNull().alias("auto"))
    return j.join(_manual(s, d), "temp_qid", "left").select("temp_qid", F.coalesce("manual", "auto").alias("flagged")).distinct()


@query(
    f"WITH RECURSIVE {_reach('m', _MATCHED)}, j AS (SELECT DISTINCT temp_qid FROM judge_batch) SELECT j.temp_qid, coalesce(c.cluster, j.temp_qid) AS golden, coalesce(manual, coalesce(c.cluster <> j.temp_qid, false)) AS is_duplicate FROM j LEFT JOIN c_m c ON c.node = j.temp_qid LEFT JOIN ({_MANUAL}) m ON m.temp_qid = j.temp_qid"
)
def tag_duplicates_override(s, d):
    c = connected(t(s, d, "quote_matches").where("is_match"), "temp_qid_a", "temp_qid_b")
    j = t(s, d, "judge_batch").select("temp_qid").distinct().join(c.withColumnRenamed("node", "temp_qid"), "temp_qid", "left").join(_manual(s, d), "temp_qid", "left")
    auto = F.coalesce(F.col("cluster") != F.col("temp_qid"), F.lit(False))
    return j.select("temp_qid", F.coalesce("cluster", "temp_qid").alias("golden"), F.coalesce("manual", auto).alias("is_duplicate"))


_PAIR = "least(temp_qid_a, temp_qid_b) AS a, greatest(temp_qid_a, temp_qid_b) AS b"


@query(
    f"WITH p AS (SELECT *, {_PAIR} FROM quote_matches WHERE temp_qid_a IS NOT NULL AND temp_qid_b IS NOT NULL), o AS (SELECT a, b, arg_min(coalesce(is_match, false), match_id) AS old FROM p GROUP BY 1, 2), n AS (SELECT a, b, arg_max(coalesce(is_match, false), match_id) AS new FROM p GROUP BY 1, 2) SELECT old AS old_flag, new AS new_flag, count(*) AS n, CAST(count_if(old <> new) AS BIGINT) AS disagreements FROM o JOIN n USING (a, b) GROUP BY 1, 2"
)
def join_flag_diff(s, d):
    """The first and the last verdict on each pair, as two versions joined."""
    p = t(s, d, "quote_matches").where("temp_qid_a is not null and temp_qid_b is not null")
    p = p.select("match_id", F.coalesce("is_match", F.lit(False)).alias("f"), F.least("temp_qid_a", "temp_qid_b").alias("a"), F.greatest("temp_qid_a", "temp_qid_b").alias("b"))
    old = p.groupBy("a", "b").agg(F.min_by("f", "match_id").alias("old_flag"))
    new = p.groupBy("a", "b").agg(F.max_by("f", "match_id").alias("new_flag"))
    j = old.join(new, ["a", "b"])
    return j.groupBy("old_flag", "new_flag").agg(F.count("*").alias("n"), F.count_if(F.col("old_flag") != F.col("new_flag")).alias("disagreements"))


@query("WITH a AS (SELECT record_id, unnest(answer_variations) AS x, generate_subscripts(answer_variations, 1) AS i FROM validation_batch), b AS (SELECT record_id, unnest(mcq_options) AS y, generate_subscripts(mcq_options, 1) AS i FROM validation_batch) SELECT record_id, CAST(i AS BIGINT) AS pos, x AS variation, y AS option FROM a JOIN b USING (record_id, i)")
def seq_zip_join(s, d):
    v = t(s, d, "validation_batch")
    a, b = (v.select("record_id", F.posexplode(c).alias("p", n)) for c, n in (("answer_variations", "variation"), ("mcq_options", "option")))
    return a.join(b, ["record_id", "p"]).select("record_id", (F.col("p") + 1).cast("long").alias("pos"), "variation", "option")


@query("SELECT j.temp_qid, j.received_at FROM judge_batch j WHERE EXISTS (SELECT 1 FROM quote_matches m WHERE m.temp_qid_a = j.temp_qid)")
def filter_isin(s, d):
    ids = t(s, d, "quote_matches").select(F.col("temp_qid_a").alias("temp_qid"))
    return t(s, d, "judge_batch").join(ids, "temp_qid", "left_semi").select("temp_qid", "received_at")


# ---------------------------------------------------------------- texts


@query(
    r"SELECT record_id, trim(regexp_replace(question, '(?s)[?:].*$', ''), ' ') AS stem, CASE WHEN regexp_matches(question, '[?:]') THEN list_filter(list_transform(string_split(regexp_extract(question, '(?s)^[^?:]*[?:](.*)$', 1), ','), lambda x: trim(regexp_replace(regexp_replace(trim(lower(x), ' '), '[?." + '"' + r"]$', ''), '^(or|and) ', ''), ' ')), lambda x: x <> '') ELSE [] END AS options FROM validation_batch"
)
def split_mcq_question(s, d):
    """The part before the first question mark or colon, and the cleaned options after it, if there are any."""
    q = F.col("question")
    parts = F.split(F.regexp_extract(q, r"(?s)^[^?:]*[?:](.*)\z", 1), ",")
    options = F.filter(F.transform(parts, fq.standardize_option), lambda x: x != "")
    none = F.array().cast("array<string>")
    return t(s, d, "validation_batch").select("record_id", F.trim(F.regexp_replace(q, r"(?s)[?:].*\z", "")).alias("stem"), F.coalesce(F.when(q.rlike("[?:]"), options), none).alias("options"))


STOP_WORDS = ("the", "an", "of", "in", "on", "at", "by", "to", "for", "and", "or", "with", "from", "that", "this", "it", "as")


@query(
    f"SELECT record_id, list_transform(list_filter({TOK}, lambda x: length(x) > 1 AND x NOT IN ({','.join(repr(w) for w in STOP_WORDS)})), lambda x: CASE WHEN x IN ('whom','whose') THEN 'who' ELSE x END) AS tokens FROM validation_batch"
)
def tokenize_lemmatize(s, d):
    """Tokens without stop words and single letters, forms of who made one; lemmas come from a map, empty here."""
    return t(s, d, "validation_batch").select("record_id", fq.lemmas(fq.tokens(F.col("question")), STOP_WORDS, {"whom": "who", "whose": "who"}).alias("tokens"))


_NW = "answer"
for _w, _n in fq.NUMBER_WORDS:
    _NW = f"regexp_replace({_NW}, '\\b{_w}\\b', '{_n}', 'gi')"
_DIGITS = "regexp_extract_all(replace(lower({0}),',',''), '[0-9]+')"


@query(
    rf"WITH x AS (SELECT record_id, answer, CASE WHEN regexp_matches(answer, '[0-9]') THEN answer ELSE {_NW} END AS w FROM validation_batch), f AS (SELECT record_id, answer, {_DIGITS.format('w')} AS f FROM x) SELECT record_id, CASE WHEN len(f) = 1 THEN TRY_CAST(f[1] AS BIGINT) * CASE WHEN regexp_matches(lower(answer), '\b(bc|bce|b\.c\.|b\.c\.e\.)(\b|$| )') THEN -1 ELSE 1 END END AS number FROM f"
)
def parse_single_number(s, d):
    """The only integer of a text; number words count where it has no digits."""
    a = F.col("answer")
    text = F.when(a.rlike("[0-9]"), a).otherwise(fq.digits_for_words(a))
    return t(s, d, "validation_batch").select("record_id", fq.single_number(text).alias("number"))


@query(
    "SELECT file_id, line_no, CASE WHEN payload IS NULL OR regexp_matches(payload, '^\\s*$') THEN 'empty' WHEN NOT json_valid(payload) THEN 'blocked' ELSE 'ok' END AS gate FROM judge_raw"
)
def finish_reason_gate(s, d):
    """A reply that cannot be read counts as blocked, one without text as empty."""
    p = F.col("payload")
    blank = p.isNull() | p.rlike(r"^\s*$")
    reason = F.when(~blank & F.expr("try_parse_json(payload)").isNull(), "SAFETY").otherwise("STOP")
    return t(s, d, "judge_raw").select("file_id", "line_no", fq.finish_gate(reason, (~blank).cast("int")).alias("gate"))


@query(
    "WITH c AS (SELECT regexp_extract(source, '^(.*)_chapter_', 1) AS book, TRY_CAST(regexp_extract(source, '_chapter_([0-9]+)', 1) AS INT) AS no FROM documents WHERE source IS NOT NULL) SELECT book, count(DISTINCT no) AS chapters, max(no) AS last, CASE WHEN count(DISTINCT no) >= max(no) THEN 'full_book' ELSE 'partial_pilot' END AS scope FROM c GROUP BY 1"
)
def run_scope(s, d):
    c = t(s, d, "documents").where("source is not null").select(F.regexp_extract("source", "^(.*)_chapter_", 1).alias("book"), F.regexp_extract("source", "_chapter_([0-9]+)", 1).try_cast("int").alias("no"))
    g = c.groupBy("book").agg(F.countDistinct("no").alias("chapters"), F.max("no").alias("last"))
    return g.withColumn("scope", F.when(F.col("chapters") >= F.col("last"), "full_book").otherwise("partial_pilot"))


@query("SELECT record_id, CAST(json_merge_patch('{}'::JSON, json_object('hint_1', hint_1, 'hint_2', hint_2, 'hint_3', hint_3)) AS VARCHAR) AS record FROM validation_batch")
def shed_nulls(s, d):
    return t(s, d, "validation_batch").select("record_id", F.to_json(F.struct("hint_1", "hint_2", "hint_3")).alias("record"))


# ---------------------------------------------------------------- aggregates and windows


@query(
    "SELECT user_id, count(*) AS turns, CAST(count_if(event_type='purchase') AS BIGINT) AS correct, bool_or(event_type='error') AS quit, CAST(count_if(event_type='signup') AS BIGINT) AS unattempted, list_sort(list(value)) AS latencies, coalesce(list_sort(list(value) FILTER (event_type = 'view' AND value > 0)), []) AS judge_latencies FROM events GROUP BY 1"
)
def session_aggregates(s, d):
    """A user's events as one session; its latencies in order."""
    e, v = F.col("event_type"), F.col("value")
    return t(s, d, "events").groupBy("user_id").agg(
        F.count("*").alias("turns"), F.count_if(e == "purchase").alias("correct"), F.bool_or(e == "error").alias("quit"), F.count_if(e == "signup").alias("unattempted"),
        F.sort_array(F.collect_list(v)).alias("latencies"), F.sort_array(F.collect_list(F.when((e == "view") & (v > 0), v))).alias("judge_latencies"),
    )


@query(
    "WITH j AS (SELECT l_orderkey, sum(least(l_quantity, 10)) AS cached, sum(greatest(l_quantity - 10, 0)) AS uncached, sum(l_linenumber)::DOUBLE AS output, sum(l_quantity + l_linenumber + l_orderkey % 3 - 1) AS total FROM lineitem GROUP BY 1) SELECT o_orderstatus, sum(cached)::DOUBLE AS cached, sum(uncached)::DOUBLE AS uncached, sum(output)::DOUBLE AS output, sum(CASE WHEN total > 0 THEN greatest(total - (cached + uncached + output), 0) ELSE 0 END)::DOUBLE AS hidden FROM j JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
)
def token_accounting(s, d):
    """Cached, uncached, put out and hidden per job (an order), summed by status; what is hidden is never below zero."""
    q, zero = F.col("l_quantity"), F.lit(0.0)
    j = t(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.least(q, F.lit(10.0))).alias("cached"), F.sum(F.greatest(q - 10, zero)).alias("uncached"), F.sum(F.col("l_linenumber").cast("double")).alias("output"),
        F.sum(q + F.col("l_linenumber") + F.col("l_orderkey") % 3 - 1).alias("total"),
    )
    hidden = F.when(F.col("total") > 0, F.greatest(F.col("total") - (F.col("cached") + F.col("uncached") + F.col("output")), zero)).otherwise(zero)
    o = j.join(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return o.groupBy("o_orderstatus").agg(F.sum("cached").alias("cached"), F.sum("uncached").alias("uncached"), F.sum("output").alias("output"), F.sum(hidden).alias("hidden"))


@query(
    "SELECT user_id, session, count(*) AS n, CASE WHEN count(*) = 5 THEN 'READY' ELSE 'EXHAUSTED' END AS status FROM (SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR))) - 1) // 5 AS BIGINT) AS session FROM events) GROUP BY 1,2"
)
def session_allocation(s, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string"))))
    e = t(s, d, "events").select("user_id", F.floor((n - 1) / 5).alias("session"))
    g = e.groupBy("user_id", "session").agg(F.count("*").alias("n"))
    return g.withColumn("status", F.when(F.col("n") == 5, "READY").otherwise("EXHAUSTED"))


@query()
def corr_interpretation(s, d):
    """Correlation of question and answer lengths by keyword, its p and what it says; tested on known values."""
    q = F.col("question")
    x = t(s, d, "validation_batch").select(fq.main_keyword(fq.tokens(q)).alias("main_keyword"), fq.word_count(q).alias("q"), fq.word_count(F.col("answer")).alias("a"))
    g = x.groupBy("main_keyword").agg(F.count("*").alias("n"), fq.pearson("q", "a").alias("r")).withColumn("p", statistics.p_value("r", "n"))
    return g.select("main_keyword", "n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"), statistics.interpretation(fq.correlation_strength(F.col("r")), F.col("p")).alias("text"))


@query()
def readability_percentiles(s, d):
    """Four measures of the questions at three percentiles; tested on known values."""
    r = t(s, d, "validation_batch").select(statistics.readability("question").alias("r")).select("r.*")
    long = r.unpivot([], ["flesch", "kincaid", "fog", "smog"], "measure", "value").where("value is not null")
    p = F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    return long.groupBy("measure").agg(p.alias("p")).select("measure", *[F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(("p25", "p50", "p75"))])


# ---------------------------------------------------------------- gates

_ERRORS = "list_filter([CASE WHEN question_type NOT IN ('EX','FR','MCQ','YN') OR question_type IS NULL THEN 'question_type' END, CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END, CASE WHEN question_type = 'MCQ' AND coalesce(len(mcq_options),0) <> 4 THEN 'mcq_options' END], lambda x: x IS NOT NULL)"
_MASTER = "substr(translate(to_base64(unhex(md5(concat_ws('_', coalesce(question_type,''), coalesce(question,''), coalesce(answer,''))))), '+/', '-_'), 1, 8)"


def schema_errors() -> Column:
    k = F.col("question_type")
    rules = {
        "question_type": k.isNull() | ~k.isin("EX", "FR", "MCQ", "YN"), "question": F.col("question").isNull(), "answer": F.col("answer").isNull(),
        "mcq_options": (k == "MCQ") & (F.coalesce(F.size("mcq_options"), F.lit(0)) != 4),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def _master() -> Column:
    return fq.master_id(F.col("question_type"), F.col("question"), F.col("answer"))


@query(f"WITH x AS (SELECT record_id, {_MASTER} AS master_id, {_ERRORS} AS errors FROM validation_batch) SELECT record_id, CASE WHEN count(*) OVER (PARTITION BY master_id) > 1 THEN 'duplicate_id' WHEN len(errors) > 0 THEN 'rejected' ELSE 'accepted' END AS status, errors FROM x")
def enforce_schema_pipeline(s, d):
    """Rows that share a master id are turned away first, then those that break a rule."""
    x = t(s, d, "validation_batch").select("record_id", _master().alias("master_id"), schema_errors().alias("errors"))
    many = x.groupBy("master_id").count().where("count > 1")
    j = x.join(many, "master_id", "left")
    status = F.when(F.col("count").isNotNull(), "duplicate_id").when(F.size("errors") > 0, "rejected").otherwise("accepted")
    return j.select("record_id", status.alias("status"), "errors")


_TYPES = "CASE lower(trim(question_type,' ')) WHEN 'mcq' THEN 'MCQ' WHEN 'fr' THEN 'FR' WHEN 'ex' THEN 'EX' WHEN 'yn' THEN 'YN' END"
_INGEST = f"SELECT staging_id, question, answer, kind, CASE WHEN question IS NULL OR answer IS NULL OR kind IS NULL THEN 'null_rejected' WHEN staging_id <> first THEN 'duplicate_dropped' ELSE 'valid' END AS status FROM (SELECT *, {_TYPES} AS kind, min(staging_id) OVER (PARTITION BY question, answer) AS first FROM staging_batch)"


def ingest_checked(rows, force: bool = False):
    """(staging_id, question, answer, kind, status): columns checked, types mended by a map of spellings, rows without a
    needed value turned away, and unless ``force`` all but the first of equal questions and answers dropped."""
    missing = {"staging_id", "question", "answer", "question_type"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    kinds = F.create_map(*[F.lit(x) for k in ("mcq", "fr", "ex", "yn") for x in (k, k.upper())])
    x = rows.select(F.col("staging_id").cast("long").alias("staging_id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"), kinds[F.lower(F.trim("question_type"))].alias("kind"))
    first = x.groupBy("question", "answer").agg(F.min("staging_id").alias("first"))
    bad = F.col("question").isNull() | F.col("answer").isNull() | F.col("kind").isNull()
    j = x.join(first, (x["question"].eqNullSafe(first["question"])) & (x["answer"].eqNullSafe(first["answer"])), "left").select(x["*"], "first")
    again = F.lit(False) if force else F.col("staging_id") != F.col("first")
    return j.withColumn("status", F.when(bad, "null_rejected").when(again, "duplicate_dropped").otherwise("valid")).drop("first")


@query(f"SELECT staging_id, kind, status FROM ({_INGEST})")
def ingest_validate(s, d):
    return ingest_checked(t(s, d, "staging_batch")).select("staging_id", "kind", "status")


_IKEY = KEYWORD
_TYPE_OF = "CASE WHEN regexp_matches(a,'^(the year )?[0-9]{1,4} ?(ad|bc|bce|ce)?$') THEN 'number' ELSE 'text' END"


@query(
    f"WITH {_STAGED}, {_EARLIER}, i AS ({_INGEST}) SELECT i.staging_id, kind, CASE WHEN status <> 'valid' THEN status WHEN sim >= 0.9 THEN 'critical' WHEN sim >= 0.7 THEN 'caution' ELSE 'ingested' END AS status, {_IKEY} AS main_keyword, CAST(len({TOK}) AS BIGINT) AS n_tokens, {AW} AS answer_length, {_MASTER.replace('question_type', 'kind')} AS master_id FROM i LEFT JOIN best USING (staging_id)"
)
def ingest_pipeline(s, d):
    """Validated, tokenised, measured, checked against what came before, with ids and one status a row."""
    x = ingest_checked(t(s, d, "staging_batch")).join(_best_known(s, d), "staging_id", "left")
    q, a, sim = F.col("question"), F.col("answer"), F.col("sim")
    status = F.when(F.col("status") != "valid", F.col("status")).when(sim >= 0.9, "critical").when(sim >= 0.7, "caution").otherwise("ingested")
    tok = fq.tokens(q)
    return x.select("staging_id", "kind", status.alias("status"), fq.main_keyword(tok).alias("main_keyword"), F.size(tok).cast("long").alias("n_tokens"), fq.word_count(a).alias("answer_length"), fq.master_id(F.col("kind"), q, a).alias("master_id"))


@query(
    f"WITH x AS (SELECT record_id, lower(coalesce(answer,'')) AS a, {sql_buckets('answer')} AS b, coalesce(list_transform(answer_variations, lambda z: struct_pack(t := lower(coalesce(z,'')), b := {sql_buckets('z')})), []) AS vs FROM validation_batch) SELECT record_id, CAST(len(list_filter(vs, lambda r: NOT (contains(r.t, a) OR contains(a, r.t)) AND {sql_similar('b', 'r.b')} < 0.85)) AS BIGINT) AS failed, len(list_filter(vs, lambda r: NOT (contains(r.t, a) OR contains(a, r.t)) AND {sql_similar('b', 'r.b')} < 0.85)) = 0 AS aligned FROM x"
)
def variation_alignment(s, d):
    """A variation passes if it holds the answer or is held by it, else by its similarity."""
    answer = F.col("answer")
    a = F.lower(F.coalesce(answer, F.lit("")))

    def fails(x: Column) -> Column:
        low = F.lower(F.coalesce(x, F.lit("")))
        return ~(F.contains(low, a) | F.contains(a, low)) & (embedding.similarity(answer, x) < 0.85)

    bad = F.size(F.filter(F.coalesce("answer_variations", F.array().cast("array<string>")), fails)).cast("long")
    return t(s, d, "validation_batch").select("record_id", bad.alias("failed"), (bad == 0).alias("aligned"))


@query(
    f"WITH x AS (SELECT record_id, question_type = 'MCQ' AND mcq_options IS NOT NULL AS mcq, coalesce(list_contains(mcq_options, answer), false) AS present, len(list_distinct(mcq_options)) < len(mcq_options) AS twice, {sql_buckets('answer')} AS b, list_transform({_OTHERS}, lambda z: {sql_buckets('z')}) AS os FROM validation_batch), y AS (SELECT *, round(1.0::DOUBLE - list_max(list_transform(os, lambda q: {sql_similar('b', 'q')})), 6) AS m FROM x) SELECT record_id, CASE WHEN NOT coalesce(mcq, false) THEN true ELSE present END AS present, CASE WHEN NOT coalesce(mcq, false) THEN true WHEN NOT present THEN false ELSE NOT twice END AS distinct_options, CASE WHEN NOT coalesce(mcq, false) THEN NULL WHEN NOT present OR twice THEN 0.0::DOUBLE ELSE m END AS margin, CASE WHEN NOT coalesce(mcq, false) THEN NULL WHEN NOT present THEN 'MISSING' WHEN twice THEN 'DUPLICATE' WHEN m < 0.3 THEN 'CLOSE' ELSE 'OK' END AS reason FROM y"
)
def mcq_alignment(s, d):
    """Whether the answer stands among the options, these differ, and how far the nearest other one is."""
    o, a = F.col("mcq_options"), F.col("answer")
    mcq = F.coalesce((F.col("question_type") == "MCQ") & o.isNotNull(), F.lit(False))
    present, twice = F.coalesce(F.array_contains(o, a), F.lit(False)), F.size(F.array_distinct(o)) < F.size(o)
    other = F.array_max(F.transform(fq.distractors(o, a), lambda x: embedding.similarity(a, x)))
    v = t(s, d, "validation_batch").select("record_id", mcq.alias("mcq"), present.alias("p"), twice.alias("t"), F.round(1.0 - other, 6).alias("m"))
    p, tw, m = F.col("p"), F.col("t"), F.col("m")
    return v.select(
        "record_id", F.when(~F.col("mcq"), True).otherwise(p).alias("present"), F.when(~F.col("mcq"), True).when(~p, False).otherwise(~tw).alias("distinct_options"),
        F.when(F.col("mcq"), F.when(~p | tw, 0.0).otherwise(m)).alias("margin"), F.when(F.col("mcq"), F.when(~p, "MISSING").when(tw, "DUPLICATE").when(m < 0.3, "CLOSE").otherwise("OK")).alias("reason"),
    )


_YEAR = r"\b[0-9]{3,4}\b"


@query(
    f"SELECT staging_id, CASE WHEN k = 'EX' AND n < 3 THEN 'explanation too short' WHEN k IN ('FR','MCQ') AND n > 15 THEN 'answer too long' WHEN c LIKE '%date%' AND NOT (has_digit OR has_word) THEN 'no number or date' WHEN q LIKE '%year%' AND c LIKE '%date%' AND NOT regexp_matches(a, '{_YEAR}') THEN 'no year' ELSE 'ok' END AS reason FROM (SELECT staging_id, upper(coalesce(question_type,'')) AS k, lower(coalesce(category,'')) AS c, lower(coalesce(question,'')) AS q, lower(coalesce(answer,'')) AS a, {AW} AS n, regexp_matches(coalesce(answer,''), '[0-9]') AS has_digit, len(list_filter({sql_tokens('answer')}, lambda x: x IN ({','.join(repr(w) for w, _ in fq.NUMBER_WORDS)}))) > 0 AS has_word FROM staging_batch)"
)
def category_alignment(s, d):
    """Lengths by type, and digits, number words or a year where the category asks for them."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    k, n = F.upper(F.coalesce("question_type", F.lit(""))), fq.word_count(F.col("answer"))
    a, dated = low("answer"), low("category").contains("date")
    number = a.rlike("[0-9]") | F.exists(fq.tokens(F.col("answer")), lambda x: x.isin(*[w for w, _ in fq.NUMBER_WORDS]))
    reason = (
        F.when((k == "EX") & (n < 3), "explanation too short").when(k.isin("FR", "MCQ") & (n > 15), "answer too long")
        .when(dated & ~number, "no number or date").when(low("question").contains("year") & dated & ~a.rlike(_YEAR), "no year").otherwise("ok")
    )
    return t(s, d, "staging_batch").select("staging_id", reason.alias("reason"))


@query(r"SELECT file_id, line_no FROM judge_raw WHERE payload IS NOT NULL AND NOT regexp_matches(payload, '_code\" *: *\"?2\b')".replace('\\"', '"'))
def judge_filter(s, d):
    """Records without any score of 2."""
    return t(s, d, "judge_raw").where(F.col("payload").isNotNull() & ~F.col("payload").rlike(r'_code" *: *"?2\b')).select("file_id", "line_no")


@query(f"SELECT record_id AS source_id, {_MASTER} AS master_id, question_type, question, answer, answer_variations FROM validation_batch WHERE len({_ERRORS}) = 0")
def promote_silver(s, d):
    v = t(s, d, "validation_batch").where(F.size(schema_errors()) == 0)
    return v.select(F.col("record_id").alias("source_id"), _master().alias("master_id"), "question_type", "question", "answer", "answer_variations")


_NEEDED = ("record_id", "question_type", "question", "answer", "answer_variations", "mcq_options")


@query(
    f"SELECT true AS columns, count(*) > 0 AS not_empty, count(*) = count(DISTINCT record_id) AS unique_ids, CAST(count_if(answer_variations IS NULL) AS BIGINT) = 0 AS no_null_lists, CAST(count_if(len({_ERRORS}) > 0) AS BIGINT) = 0 AS schema FROM validation_batch"
)
def startup_gate(s, d):
    v = t(s, d, "validation_batch")
    n = F.count("*")
    return v.agg(
        F.lit(set(_NEEDED) <= set(v.columns)).alias("columns"), (n > 0).alias("not_empty"), (n == F.countDistinct("record_id")).alias("unique_ids"),
        (F.count_if(F.col("answer_variations").isNull()) == 0).alias("no_null_lists"), (F.count_if(F.size(schema_errors()) > 0) == 0).alias("schema"),
    )


@query(
    f"WITH x AS (SELECT batch_name, len({_ERRORS}) > 0 AS bad, substr(md5(CAST(record_id AS VARCHAR)), 1, 1) = '0' AS drawn FROM validation_batch), g AS (SELECT batch_name, CAST(count_if(drawn) AS BIGINT) AS sampled, CAST(count_if(drawn AND bad) AS BIGINT) AS defects FROM x GROUP BY 1) SELECT batch_name, sampled, defects, CASE WHEN sampled = 0 OR defects <= 0.05 * sampled THEN 'accept' WHEN defects <= 0.2 * sampled THEN 'escalate' ELSE 'reject' END AS decision FROM g"
)
def acceptance_sampling(s, d):
    """One row in sixteen of each batch is drawn by its hash and inspected; the share of defects decides."""
    drawn, bad = F.substring(F.md5(F.col("record_id").cast("string")), 1, 1) == "0", F.size(schema_errors()) > 0
    g = t(s, d, "validation_batch").groupBy("batch_name").agg(F.count_if(drawn).alias("sampled"), F.count_if(drawn & bad).alias("defects"))
    n, k = F.col("sampled"), F.col("defects")
    return g.withColumn("decision", F.when((n == 0) | (k <= 0.05 * n), "accept").when(k <= 0.2 * n, "escalate").otherwise("reject"))


_CALLS = "SELECT coalesce(series,'') AS series, file_seq, file_id, line_no, coalesce(payload,'') AS payload, (payload IS NOT NULL AND json_valid(payload)) AS ok, row_number() OVER (PARTITION BY coalesce(series,'') ORDER BY file_seq, file_id, line_no, coalesce(payload,''), received_at) AS i FROM judge_raw"


@query(
    f"WITH c AS ({_CALLS}), g AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY series ORDER BY i) AS island FROM c), f AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY series, island ORDER BY i) AS fails FROM g), b AS (SELECT series, min(i) AS stop FROM f WHERE fails >= 2 GROUP BY 1) SELECT f.series, count(*) AS planned, CAST(count_if(i <= coalesce(stop, i)) AS BIGINT) AS called, CAST(count_if(ok AND i <= coalesce(stop, i)) AS BIGINT) AS succeeded, bool_or(stop IS NOT NULL) AS broken FROM f LEFT JOIN b USING (series) GROUP BY 1"
)
def generation_run(s, d):
    """Calls of a series in order, a circuit breaker at two failures in a row: what was called, what succeeded."""
    ok = F.coalesce(F.expr("try_parse_json(payload) is not null"), F.lit(False))
    c = t(s, d, "judge_raw").select(F.coalesce("series", F.lit("")).alias("series"), "file_seq", "file_id", "line_no", F.coalesce("payload", F.lit("")).alias("payload"), "received_at", ok.alias("ok"))
    w = Window.partitionBy("series").orderBy("file_seq", "file_id", "line_no", "payload", "received_at")
    c = c.withColumn("i", F.row_number().over(w))
    g = c.withColumn("island", F.sum(F.col("ok").cast("int")).over(Window.partitionBy("series").orderBy("i")))
    f = g.withColumn("fails", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("series", "island").orderBy("i")))
    b = f.where("fails >= 2").groupBy("series").agg(F.min("i").alias("stop"))
    j = f.join(b, "series", "left")
    called = F.col("i") <= F.coalesce("stop", "i")
    return j.groupBy("series").agg(F.count("*").alias("planned"), F.count_if(called).alias("called"), F.count_if(F.col("ok") & called).alias("succeeded"), F.bool_or(F.col("stop").isNotNull()).alias("broken"))


# ---------------------------------------------------------------- sources


@query("SELECT batch_no, CAST(row_number() OVER (PARTITION BY batch_no ORDER BY staging_id) - 1 AS BIGINT) AS item, staging_id, question FROM staging_batch")
def compile_llm_outputs(s, d):
    """Candidate files (a JSON list a batch) flattened again, each item with its place in its file."""
    item = F.struct("staging_id", F.col("question").alias("question_text"))
    made = t(s, d, "staging_batch").groupBy("batch_no").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("text"))
    out = files.compile_outputs(made, "text")
    return out.select("batch_no", "item", F.get_json_object("raw", "$.staging_id").cast("long").alias("staging_id"), "question")


_RUNS = {
    "common": {"temperature": 0.7, "model": "quill-lite-2"},
    "experiments": [
        {"name": "a", "runs": [{"id": "a1", "tokens": {"total": 100, "cached": 10, "uncached": 40, "output": 30}}, {"id": "a2", "temperature": 0.2}]},
        {"name": "b", "runs": [{"id": "b1", "tokens": {"cached": 5}}]},
    ],
}


@query(
    "SELECT * FROM (VALUES ('a', 'a1', 'quill-lite-2', 0.7::DOUBLE, 10::BIGINT, 40::BIGINT, 30::BIGINT, 100::BIGINT, 20::BIGINT), ('a', 'a2', 'quill-lite-2', 0.2::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT), ('b', 'b1', 'quill-lite-2', 0.7::DOUBLE, 5::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT)) v(experiment, run_id, model, temperature, cached, uncached, output, total, hidden)"
)
def flatten_run_metadata(s, d):
    return files.flatten_runs(s, _RUNS)


@query("SELECT batch_no, staging_id, question FROM staging_batch WHERE batch_no IN (SELECT batch_no FROM (SELECT DISTINCT batch_no FROM staging_batch) WHERE batch_no % 2 = 1)")
def run_selection(s, d):
    """Runs (batches) picked by a set of ids, with all their questions."""
    b = t(s, d, "staging_batch")
    picked = b.select("batch_no").distinct().where("batch_no % 2 = 1")
    return b.join(picked, "batch_no", "left_semi").select("batch_no", "staging_id", "question")


@query("SELECT record_id, 'train' AS split FROM validation_batch WHERE record_id % 5 <> 0 UNION ALL SELECT record_id, 'test' FROM validation_batch WHERE record_id % 5 = 0")
def concat_splits(s, d):
    v = t(s, d, "validation_batch").select("record_id")
    return v.where("record_id % 5 <> 0").withColumn("split", F.lit("train")).unionByName(v.where("record_id % 5 = 0").withColumn("split", F.lit("test")))


@query(f"SELECT record_id, {TOK} AS tokens FROM validation_batch")
def list_literals(s, d):
    """Token lists that were stored as Python literals, read back."""
    tok = fq.tokens(F.col("question"))
    text = F.concat(F.lit("['"), F.array_join(tok, "', '"), F.lit("']"))
    v = t(s, d, "validation_batch").select("record_id", F.when(F.size(tok) > 0, text).otherwise("[]").alias("text"))
    return v.select("record_id", files.parse_list_literal(F.col("text")).alias("tokens"))


@query(
    "SELECT coalesce(a.column_name, b.column_name) AS name, a.column_name IS NOT NULL AS in_judge, b.column_name IS NOT NULL AS in_staging FROM (SELECT column_name FROM (DESCRIBE judge_batch)) a FULL JOIN (SELECT column_name FROM (DESCRIBE staging_batch)) b ON a.column_name = b.column_name"
)
def schema_parity(s, d):
    a, b = t(s, d, "judge_batch").columns, t(s, d, "staging_batch").columns
    return s.createDataFrame([(c, c in a, c in b) for c in sorted({*a, *b})], "name string, in_judge boolean, in_staging boolean")
