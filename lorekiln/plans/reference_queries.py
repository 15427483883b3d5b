"""Registered queries over the given tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.functions import questions as fq
from lorekiln.operators import evaluate
from lorekiln.operators.clusters import connected
from lorekiln.plans.order import quantile, with_ordinal
from lorekiln.streaming.telemetry import windowed_rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


TOK = "regexp_extract_all(lower(coalesce(question,'')), '[a-z0-9]+')"
ATOK = "regexp_extract_all(lower(coalesce(answer,'')), '[a-z0-9]+')"
WC = "CAST(len(regexp_extract_all(coalesce({0},''), '[A-Za-z0-9_]+')) AS BIGINT)"


def _list(xs) -> str:
    return "(" + ",".join(f"'{x}'" for x in xs) + ")"


KEYWORD = (
    f"coalesce(list_filter({TOK}, lambda x: x IN {_list(fq.PRIORITY_1)})[1], list_filter({TOK}, lambda x: x IN {_list(fq.PRIORITY_2)})[1], "
    f"{TOK}[1], 'unassigned')"
)

# ---------------------------------------------------------------- sources and projection


@query("SELECT temp_qid, question_type, question, answer FROM judge_batch")
def read_parquet_projection(s, d):
    return t(s, d, "judge_batch").select("temp_qid", "question_type", "question", "answer")


@query("SELECT record_id, answer AS reply, question AS prompt, 'v1' AS pipeline_version, 'validation' AS stage FROM validation_batch")
def add_constants(s, d):
    v = t(s, d, "validation_batch").select("record_id", F.col("answer").alias("reply"), F.col("question").alias("prompt"))
    return v.withColumns({"pipeline_version": F.lit("v1"), "stage": F.lit("validation")})


@query("SELECT s_suppkey AS s_suppkey_v0, s_name AS s_name_v0, s_nationkey AS s_nationkey_v0, s_acctbal AS s_acctbal_v0 FROM supplier")
def suffix_columns(s, d):
    x = t(s, d, "supplier")
    return x.toDF(*[f"{c}_v0" for c in x.columns])


@query(
    "SELECT record_id, CASE question_type WHEN 'mcq' THEN 'MCQ' WHEN 'fr' THEN 'FR' WHEN 'ex' THEN 'EX' ELSE question_type END AS question_type FROM validation_batch"
)
def replace_map(s, d):
    return t(s, d, "validation_batch").select("record_id", "question_type").replace({"mcq": "MCQ", "fr": "FR", "ex": "EX"}, subset=["question_type"])


@query(
    "SELECT staging_id, coalesce(map{'Easy':'easy','EASY':'easy','Medium':'medium','MEDIUM':'medium','Hard':'hard','HARD':'hard'}[difficulty], difficulty) AS difficulty FROM staging_batch"
)
def map_with_fallback(s, d):
    m = F.create_map(*[F.lit(x) for p in (("Easy", "easy"), ("EASY", "easy"), ("Medium", "medium"), ("MEDIUM", "medium"), ("Hard", "hard"), ("HARD", "hard")) for x in p])
    return t(s, d, "staging_batch").select("staging_id", F.coalesce(m[F.col("difficulty")], "difficulty").alias("difficulty"))


@query("SELECT record_id, CASE WHEN regexp_matches(coalesce(hint_1,''), '^ *$') THEN 'no hint' ELSE hint_1 END AS hint_1 FROM validation_batch")
def masked_update(s, d):
    h = F.col("hint_1")
    return t(s, d, "validation_batch").select("record_id", F.when(F.coalesce(h, F.lit("")).rlike("^ *$"), "no hint").otherwise(h).alias("hint_1"))


@query(
    "SELECT v.record_id, coalesce(c.question_type, v.question_type) AS question_type FROM validation_batch v LEFT JOIN (VALUES (1,'EX'),(2,'FR'),(3,'MCQ')) c(record_id, question_type) ON v.record_id = c.record_id"
)
def dict_corrections(s, d):
    fix = s.createDataFrame([(1, "EX"), (2, "FR"), (3, "MCQ")], "record_id long, fixed string")  # a fixed list
    v = t(s, d, "validation_batch").join(F.broadcast(fix), "record_id", "left")
    return v.select("record_id", F.coalesce("fixed", "question_type").alias("question_type"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
def case_select(s, d):
    z = F.col("p_size")
    return t(s, d, "part").select("p_partkey", F.when(z < 10, "small").when(z < 30, "medium").otherwise("large").alias("size_class"))


@query("SELECT event_id, TRY_CAST(props AS BIGINT) AS props_number, CAST(value AS BIGINT) AS value_int FROM (SELECT event_id, props, trunc(value) AS value FROM events)")
def cast_columns(s, d):
    return t(s, d, "events").select("event_id", F.expr("try_cast(props as bigint)").alias("props_number"), F.expr("cast(value as bigint)").alias("value_int"))


@query("SELECT match_id, CASE WHEN isnan(quote_similarity) THEN NULL ELSE quote_similarity END AS quote_similarity FROM quote_matches")
def nan_to_null(s, d):
    return t(s, d, "quote_matches").select("match_id", F.when(~F.isnan("quote_similarity"), F.col("quote_similarity")).alias("quote_similarity"))


@query(
    "SELECT record_id, CASE WHEN n > 0 AND n <= 5 THEN '(0,5]' WHEN n > 5 AND n <= 10 THEN '(5,10]' WHEN n > 10 AND n <= 20 THEN '(10,20]' WHEN n > 20 AND n <= 1000 THEN '(20,1000]' END AS length_bin FROM (SELECT record_id, "
    + WC.format("answer")
    + " AS n FROM validation_batch)"
)
def bin_right_closed(s, d):
    bins = fq.right_closed_bin(fq.word_count(F.col("answer")), [0, 5, 10, 20, 1000], ["(0,5]", "(5,10]", "(10,20]", "(20,1000]"])
    return t(s, d, "validation_batch").select("record_id", bins.alias("length_bin"))


@query(
    "SELECT temp_qid, CASE WHEN source_reference IS NULL THEN 'N/A' ELSE split_part(source_reference,' ',1) END AS book, CASE WHEN source_reference IS NULL THEN 'N/A' ELSE substr(source_reference, length(split_part(source_reference,' ',1)) + 2) END AS chapter FROM judge_batch"
)
def split_reference(s, d):
    r = F.col("source_reference")
    book = F.split_part(r, F.lit(" "), F.lit(1))
    rest = F.substr(r, F.length(book) + 2)
    return t(s, d, "judge_batch").select("temp_qid", F.coalesce(book, F.lit("N/A")).alias("book"), F.coalesce(rest, F.lit("N/A")).alias("chapter"))


@query(
    "SELECT question_source, string_agg(question_type || ' (' || n || ')', ', ' ORDER BY n DESC, question_type) AS top_types FROM (SELECT question_source, question_type, count(*) AS n, row_number() OVER (PARTITION BY question_source ORDER BY count(*) DESC, question_type) AS rn FROM validation_batch WHERE question_type IS NOT NULL GROUP BY 1,2) WHERE rn <= 3 GROUP BY 1"
)
def format_topk_string(s, d):
    n = t(s, d, "validation_batch").where("question_type is not null").groupBy("question_source", "question_type").count()
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("question_source").orderBy(F.desc("count"), "question_type"))).where("rn <= 3")
    part = F.sort_array(F.collect_list(F.struct("rn", F.concat("question_type", F.lit(" ("), "count", F.lit(")")).alias("x"))))
    return top.groupBy("question_source").agg(F.concat_ws(", ", part["x"]).alias("top_types"))


# ---------------------------------------------------------------- filters


@query(f"SELECT record_id, {KEYWORD} AS main_keyword FROM validation_batch WHERE {KEYWORD} = 'who'")
def filter_by_keyword(s, d):
    v = t(s, d, "validation_batch").select("record_id", fq.main_keyword(fq.tokens(F.col("question"))).alias("main_keyword"))
    return v.where("main_keyword = 'who'")


@query("SELECT record_id FROM validation_batch WHERE coalesce(list_contains(answer_variations, answer), false)")
def find_rows_with_token(s, d):
    return t(s, d, "validation_batch").where(F.coalesce(F.array_contains("answer_variations", F.col("answer")), F.lit(False))).select("record_id")


@query("SELECT j.temp_qid, j.received_at FROM judge_batch j WHERE NOT EXISTS (SELECT 1 FROM quote_matches m WHERE m.temp_qid_a = j.temp_qid OR m.temp_qid_b = j.temp_qid)")
def filter_not_isin(s, d):
    m = t(s, d, "quote_matches")
    ids = m.select(F.explode(F.array("temp_qid_a", "temp_qid_b")).alias("temp_qid")).where("temp_qid is not null").distinct()
    return t(s, d, "judge_batch").join(ids, "temp_qid", "left_anti").select("temp_qid", "received_at")


@query(f"SELECT record_id FROM validation_batch WHERE list_contains({TOK},'who') AND list_contains({TOK},'at')")
def filter_token_subset(s, d):
    tok = fq.tokens(F.col("question"))
    return t(s, d, "validation_batch").where(F.size(F.array_except(F.array(F.lit("who"), F.lit("at")), tok)) == 0).select("record_id")


@query("SELECT record_id, CAST(len(answer_variations) AS BIGINT) AS n FROM validation_batch WHERE len(answer_variations) > 1")
def filter_list_len(s, d):
    return t(s, d, "validation_batch").where(F.size("answer_variations") > 1).select("record_id", F.size("answer_variations").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[.!?] +[A-Z][^.!?]*[.!?] +[A-Z]')")
def filter_regex(s, d):
    return t(s, d, "documents").where(F.col("text").rlike("[.!?] +[A-Z][^.!?]*[.!?] +[A-Z]")).select("doc_id")


@query("SELECT record_id FROM validation_batch WHERE hint_1 = 'tbd' OR hint_2 = 'tbd' OR hint_3 = 'tbd'")
def filter_any_column(s, d):
    return t(s, d, "validation_batch").where("array_contains(array(hint_1, hint_2, hint_3), 'tbd')").select("record_id")


@query("SELECT record_id FROM validation_batch WHERE hint_1 IS NOT NULL AND hint_2 IS NOT NULL AND hint_3 IS NOT NULL AND explanation IS NOT NULL")
def filter_all_columns(s, d):
    return t(s, d, "validation_batch").dropna(subset=["hint_1", "hint_2", "hint_3", "explanation"]).select("record_id")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(s, d):
    return t(s, d, "orders").where("o_orderkey = 7")


@query("SELECT temp_qid, received_at, (source_quote IS NULL OR source_reference IS NULL OR question IS NULL OR answer IS NULL) AS has_null FROM judge_batch")
def null_rows_split(s, d):
    bad = F.col("source_quote").isNull() | F.col("source_reference").isNull() | F.col("question").isNull() | F.col("answer").isNull()
    return t(s, d, "judge_batch").select("temp_qid", "received_at", bad.alias("has_null"))


@query("SELECT record_id FROM validation_batch WHERE len(list_filter(semantic_entity_refs, lambda x: contains(answer, x))) > 0")
def alias_risk_filter(s, d):
    return t(s, d, "validation_batch").where(F.exists("semantic_entity_refs", lambda x: F.col("answer").contains(x))).select("record_id")


@query(f"SELECT record_id FROM validation_batch WHERE len(list_filter({ATOK}, lambda x: x IN ('eleven','twelve','thirteen','fourteen','fifteen','sixteen','twenty','thirty','forty'))) > 0")
def number_word_gt_10(s, d):
    big = ("eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "twenty", "thirty", "forty")
    return t(s, d, "validation_batch").where(F.exists(fq.tokens(F.col("answer")), lambda x: x.isin(*big))).select("record_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)")
def percentile_filter(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_totalprice")
    p = quantile(o, "o_totalprice", 0.9, "p90")
    return o.join(F.broadcast(p), F.col("o_totalprice") >= F.col("p90")).drop("p90")


@query(f"SELECT term, record_id FROM validation_batch, (SELECT unnest(['who','where','number']) AS term) WHERE list_contains({TOK}, term)")
def multi_token_search(s, d):
    terms = F.array(F.lit("who"), F.lit("where"), F.lit("number"))
    v = t(s, d, "validation_batch").select("record_id", F.explode(F.array_intersect(terms, fq.tokens(F.col("question")))).alias("term"))
    return v.select("term", "record_id")


@query(f"SELECT record_id FROM validation_batch WHERE list_contains({TOK},'how') AND NOT list_has_any({TOK}, ['old','long','much'])")
def all_not_any_tokens(s, d):
    tok = fq.tokens(F.col("question"))
    return t(s, d, "validation_batch").where(F.array_contains(tok, "how") & ~F.arrays_overlap(tok, F.array(*map(F.lit, ("old", "long", "much"))))).select("record_id")


# ---------------------------------------------------------------- joins


@query("SELECT v.record_id, v.generation_model, o.trust_rank FROM validation_batch v LEFT JOIN origin_trust o USING (generation_model)")
def join_left_enrich(s, d):
    return t(s, d, "validation_batch").join(t(s, d, "origin_trust"), "generation_model", "left").select("record_id", "generation_model", "trust_rank")


@query("SELECT m.match_id, j.temp_qid, j.question_type, m.is_match FROM quote_matches m JOIN judge_batch j ON m.temp_qid_a = j.temp_qid")
def join_inner_judge(s, d):
    m, j = t(s, d, "quote_matches"), t(s, d, "judge_batch")
    return m.join(j, m.temp_qid_a == j.temp_qid).select("match_id", "temp_qid", "question_type", "is_match")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_one_to_one(s, d):
    c, n, r = t(s, d, "customer"), t(s, d, "nation"), t(s, d, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def join_run_metadata(s, d):
    l, o = t(s, d, "lineitem"), t(s, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey, "left").select("l_orderkey", "l_linenumber", "o_orderdate")


@query(
    "SELECT batch_no, a.staging_id AS id_a, b.staging_id AS id_b FROM staging_batch a JOIN staging_batch b USING (batch_no) WHERE a.staging_id < b.staging_id AND a.source_reference = b.source_reference"
)
def self_pairs_in_batch(s, d):
    x = t(s, d, "staging_batch").select("batch_no", "source_reference", "staging_id")
    a, b = x.withColumnRenamed("staging_id", "id_a"), x.withColumnRenamed("staging_id", "id_b")
    return a.join(b, ["batch_no", "source_reference"]).where("id_a < id_b").select("batch_no", "id_a", "id_b")


# ---------------------------------------------------------------- set operations


@query("SELECT question, answer, temp_qid, NULL::BIGINT AS record_id FROM judge_batch UNION ALL SELECT question, answer, NULL, record_id FROM validation_batch")
def union_by_name(s, d):
    a = t(s, d, "judge_batch").select("question", "answer", "temp_qid")
    return a.unionByName(t(s, d, "validation_batch").select("question", "answer", "record_id"), allowMissingColumns=True)


@query("SELECT DISTINCT temp_qid FROM judge_batch EXCEPT SELECT temp_qid_a FROM quote_matches")
def except_ids(s, d):
    return t(s, d, "judge_batch").select("temp_qid").subtract(t(s, d, "quote_matches").select("temp_qid_a"))


@query("SELECT temp_qid FROM judge_batch INTERSECT SELECT temp_qid_b FROM quote_matches")
def intersect_ids(s, d):
    return t(s, d, "judge_batch").select("temp_qid").intersect(t(s, d, "quote_matches").select("temp_qid_b"))


@query("SELECT count(*) AS n_shared FROM (SELECT question FROM judge_batch INTERSECT SELECT question FROM validation_batch)")
def disjointness_check(s, d):
    return t(s, d, "judge_batch").select("question").intersect(t(s, d, "validation_batch").select("question")).agg(F.count("*").alias("n_shared"))


# ---------------------------------------------------------------- sorting and limits


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT record_id, question_type, batch_name FROM validation_batch ORDER BY question_type, batch_name DESC, record_id")
def sort_multi(s, d):
    return t(s, d, "validation_batch").select("record_id", "question_type", "batch_name").orderBy("question_type", F.desc("batch_name"), "record_id")


@query(
    "SELECT file_name, CAST(row_number() OVER (ORDER BY CASE WHEN file_name LIKE 'iteration%' THEN 0 WHEN file_name LIKE 'prompt%' THEN 1 ELSE 2 END, coalesce(TRY_CAST(nullif(regexp_extract(file_name, '([0-9]+)[^0-9]*$', 1),'') AS BIGINT),0), file_name) AS BIGINT) AS rank FROM (SELECT DISTINCT file_name FROM judge_raw)"
)
def order_by_custom_rank(s, d):
    f = F.col("file_name")
    names = t(s, d, "judge_raw").select("file_name").distinct()
    kind = F.when(f.startswith("iteration"), 0).when(f.startswith("prompt"), 1).otherwise(2)
    last = F.coalesce(F.expr("try_cast(nullif(regexp_extract(file_name, '([0-9]+)[^0-9]*$', 1), '') as bigint)"), F.lit(0))
    ranked = with_ordinal(names.select("file_name", kind.alias("kind"), last.alias("last")), ["kind", "last", "file_name"], "i")
    return ranked.select("file_name", (F.col("i") + 1).cast("long").alias("rank"))


@query("SELECT record_id FROM validation_batch WHERE question_type = 'EX' ORDER BY record_id LIMIT 10")
def limit_after_filter(s, d):
    return t(s, d, "validation_batch").where("question_type = 'EX'").select("record_id").orderBy("record_id").limit(10)


@query()
def random_sample(s, d):
    return t(s, d, "validation_batch").orderBy(F.xxhash64("record_id", F.lit(42)), "record_id").limit(100).select("record_id")


@query()
def shuffle_frac1(s, d):
    return t(s, d, "validation_batch").select("record_id").orderBy(F.xxhash64("record_id", F.lit(7)), "record_id")


# ---------------------------------------------------------------- aggregates

AW = WC.format("answer")


@query(
    f"SELECT question_type, count(*) AS n, count(DISTINCT answer) AS n_answers, quantile_cont({AW}, 0.5) AS median_words, round(100.0*count(*)/(SELECT count(*) FROM validation_batch), 4) AS share FROM validation_batch GROUP BY 1"
)
def dataset_status_map(s, d):
    v = t(s, d, "validation_batch").select("question_type", "answer", fq.word_count(F.col("answer")).alias("w"))
    total = v.agg(F.count("*").alias("total"))  # one row
    g = v.groupBy("question_type").agg(F.count("*").alias("n"), F.countDistinct("answer").alias("n_answers"), F.percentile("w", F.lit(0.5)).alias("median_words"))
    return g.join(F.broadcast(total)).select("question_type", "n", "n_answers", "median_words", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("SELECT batch_name, count(*) AS n FROM validation_batch GROUP BY 1")
def value_counts(s, d):
    return t(s, d, "validation_batch").groupBy("batch_name").agg(F.count("*").alias("n"))


@query(
    f"SELECT token, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({TOK}) AS token FROM validation_batch) WHERE token NOT IN ('the','at','in','did') GROUP BY 1) ORDER BY n DESC, token LIMIT 20"
)
def top_keywords(s, d):
    x = t(s, d, "validation_batch").select(F.explode(fq.tokens(F.col("question"))).alias("token")).where("token not in ('the','at','in','did')")
    return x.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query(
    f"WITH t AS (SELECT unnest({TOK}) AS token FROM validation_batch) SELECT token, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM t), 4) AS share FROM t GROUP BY 1 HAVING count(*) > 20"
)
def token_frequency(s, d):
    n = t(s, d, "validation_batch").select(F.explode(fq.tokens(F.col("question"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.where("n > 20").join(F.broadcast(total)).select("token", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query(
    f"SELECT count(w) AS n, round(avg(w),6) AS mean, round(stddev_samp(w),6) AS std, min(w) AS min, max(w) AS max, quantile_cont(w,0.25) AS q25, quantile_cont(w,0.5) AS median, quantile_cont(w,0.75) AS q75, quantile_cont(w,0.75)-quantile_cont(w,0.25) AS iqr, max(w)-min(w) AS range, round(skewness(w),6) AS skew FROM (SELECT {AW} AS w FROM validation_batch)"
)
def len_descriptive_stats(s, d):
    w = F.col("w")
    n, q = F.count(w), [F.percentile(w, F.lit(p)) for p in (0.25, 0.5, 0.75)]
    # bias-corrected like the adjusted Fisher-Pearson coefficient
    skew = F.try_divide(F.skewness(w) * F.sqrt(n * (n - 1)), n - 2)
    return t(s, d, "validation_batch").select(fq.word_count(F.col("answer")).alias("w")).agg(
        n.alias("n"), F.round(F.avg(w), 6).alias("mean"), F.round(F.stddev_samp(w), 6).alias("std"), F.min(w).alias("min"), F.max(w).alias("max"),
        q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), (q[2] - q[0]).alias("iqr"), (F.max(w) - F.min(w)).alias("range"), F.round(skew, 6).alias("skew"),
    )


QW = WC.format("question")


@query(
    f"SELECT kw AS main_keyword, count(*) AS n, round(avg(a),6) AS mean_answer, round(CASE WHEN count(*) >= 2 AND stddev_samp(q) > 0 AND stddev_samp(a) > 0 THEN corr(q,a) END,6) AS r FROM (SELECT {KEYWORD} AS kw, {QW} AS q, {AW} AS a FROM validation_batch) GROUP BY 1"
)
def keyword_metrics(s, d):
    x = t(s, d, "validation_batch").select(fq.main_keyword(fq.tokens(F.col("question"))).alias("main_keyword"), fq.word_count(F.col("question")).alias("q"), fq.word_count(F.col("answer")).alias("a"))
    return x.groupBy("main_keyword").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_answer"), F.round(fq.pearson("q", "a"), 6).alias("r"))


@query(
    f"SELECT kw AS main_keyword, CASE WHEN kw IN {_list(fq.FACTUAL)} THEN 'FR' ELSE 'non-FR' END AS label, count(*) AS n FROM (SELECT {KEYWORD} AS kw FROM validation_batch) WHERE kw IN ('who','where','why','how') GROUP BY 1,2"
)
def keyword_summary(s, d):
    k = F.col("main_keyword")
    x = t(s, d, "validation_batch").select(fq.main_keyword(fq.tokens(F.col("question"))).alias("main_keyword")).where(k.isin("who", "where", "why", "how"))
    return x.groupBy("main_keyword", F.when(k.isin(*fq.FACTUAL), "FR").otherwise("non-FR").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT round(corr(l_quantity, l_extendedprice),6) AS r, count(*) AS n FROM lineitem")
def pearson_corr(s, d):
    return t(s, d, "lineitem").agg(F.round(fq.pearson("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n"))


@query("SELECT l_returnflag, CASE WHEN count(*) < 10 THEN NULL ELSE round(corr(l_quantity, l_extendedprice),6) END AS r FROM lineitem GROUP BY 1")
def corr_by_group(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.when(F.count("*") >= 10, F.round(fq.pearson("l_quantity", "l_extendedprice"), 6)).alias("r"))


@query(
    "SELECT r, CASE WHEN r IS NULL OR isnan(r) THEN 'Undefined' WHEN abs(r) < 0.2 THEN 'Very weak' WHEN abs(r) < 0.4 THEN 'Weak' WHEN abs(r) < 0.6 THEN 'Moderate' WHEN abs(r) < 0.8 THEN 'Strong' ELSE 'Very strong' END AS strength FROM (SELECT DISTINCT quote_similarity AS r FROM quote_matches)"
)
def corr_strength_label(s, d):
    r = t(s, d, "quote_matches").select(F.col("quote_similarity").alias("r")).distinct()
    return r.select("r", fq.correlation_strength(F.col("r")).alias("strength"))


@query(
    f"WITH w AS (SELECT record_id, {AW} AS n FROM validation_batch), q AS (SELECT quantile_cont(n,0.25) AS q1, quantile_cont(n,0.75) AS q3 FROM w) SELECT record_id, CASE WHEN n < q1 THEN 'short' WHEN n <= q3 THEN 'common' WHEN n <= q3 + 1.5*(q3-q1) THEN 'long' ELSE 'outlier' END AS length_class FROM w, q"
)
def iqr_outlier_split(s, d):
    w = t(s, d, "validation_batch").select("record_id", fq.word_count(F.col("answer")).alias("n"))
    q = w.agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"))  # one row
    n, q1, q3 = F.col("n"), F.col("q1"), F.col("q3")
    cls = F.when(n < q1, "short").when(n <= q3, "common").when(n <= q3 + 1.5 * (q3 - q1), "long").otherwise("outlier")
    return w.join(F.broadcast(q)).select("record_id", cls.alias("length_class"))


@query(
    f"SELECT length_bin, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM validation_batch),4) AS share FROM (SELECT CASE WHEN n > 0 AND n <= 5 THEN '(0,5]' WHEN n > 5 AND n <= 10 THEN '(5,10]' WHEN n > 10 THEN '(10,inf)' END AS length_bin FROM (SELECT {AW} AS n FROM validation_batch)) GROUP BY 1"
)
def length_bin_summary(s, d):
    b = fq.right_closed_bin(fq.word_count(F.col("answer")), [0, 5, 10, float("inf")], ["(0,5]", "(5,10]", "(10,inf)"])
    v = t(s, d, "validation_batch").groupBy(b.alias("length_bin")).agg(F.count("*").alias("n"))
    total = v.agg(F.sum("n").alias("total"))  # one row
    return v.join(F.broadcast(total)).select("length_bin", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query(f"SELECT w AS n_words, count(DISTINCT answer) AS n_unique, count(*) AS n, round(100.0*count(DISTINCT answer)/count(*),4) AS share FROM (SELECT {AW} AS w, answer FROM validation_batch) GROUP BY 1")
def nonrepeating_answers_by_len(s, d):
    g = t(s, d, "validation_batch").groupBy(fq.word_count(F.col("answer")).alias("n_words")).agg(F.countDistinct("answer").alias("n_unique"), F.count("*").alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n_unique") / F.col("n"), 4))


@query(
    "SELECT generation_model, count(*) FILTER (question_type='EX') AS \"EX\", count(*) FILTER (question_type='FR') AS \"FR\", count(*) FILTER (question_type='MCQ') AS \"MCQ\" FROM validation_batch GROUP BY 1"
)
def pivot_counts(s, d):
    return t(s, d, "validation_batch").groupBy("generation_model").pivot("question_type", ["EX", "FR", "MCQ"]).count().na.fill(0)


@query(
    "SELECT question_source, round(count(*) FILTER (question_type='EX')/count(*)::DOUBLE,6) AS ex_share, round(count(*) FILTER (question_type='FR')/count(*)::DOUBLE,6) AS fr_share FROM validation_batch GROUP BY 1"
)
def row_percent(s, d):
    g = t(s, d, "validation_batch").groupBy("question_source")
    part = lambda k: F.round(F.count_if(F.col("question_type") == k) / F.count("*"), 6)
    return g.agg(F.coalesce(part("EX"), F.lit(0.0)).alias("ex_share"), F.coalesce(part("FR"), F.lit(0.0)).alias("fr_share"))


@query(
    "SELECT field, value, count(*) AS n FROM (SELECT 'question_source' AS field, question_source AS value FROM validation_batch UNION ALL SELECT 'question_type', question_type FROM validation_batch) GROUP BY 1,2"
)
def wide_value_counts(s, d):
    v = t(s, d, "validation_batch").select("question_source", "question_type").unpivot([], ["question_source", "question_type"], "field", "value")
    return v.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("SELECT CAST(count_if(is_match) AS BIGINT) AS matched, CAST(count_if(is_match IS NULL) AS BIGINT) AS open FROM quote_matches")
def bool_true_counts(s, d):
    return t(s, d, "quote_matches").agg(F.count_if("is_match").alias("matched"), F.count_if(F.col("is_match").isNull()).alias("open"))


@query(
    "WITH b AS (SELECT split_part(source_reference,' ',1) AS book, source_reference AS ch FROM judge_batch WHERE source_reference IS NOT NULL), c AS (SELECT book, ch, count(*) AS n FROM b GROUP BY 1,2) SELECT book, CAST(sum(n) AS BIGINT) AS questions, count(*) AS chapters, arg_max(ch, (n, ch)) AS top_chapter FROM c GROUP BY 1"
)
def coverage_table(s, d):
    r = F.col("source_reference")
    c = t(s, d, "judge_batch").where(r.isNotNull()).groupBy(F.split_part(r, F.lit(" "), F.lit(1)).alias("book"), r.alias("ch")).agg(F.count("*").alias("n"))
    return c.groupBy("book").agg(F.sum("n").alias("questions"), F.count("*").alias("chapters"), F.max_by("ch", F.struct("n", "ch")).alias("top_chapter"))


@query("SELECT question_type, count(*) FILTER (question_source='legacy') AS legacy, count(*) FILTER (question_source='synthetic') AS synthetic FROM validation_batch GROUP BY 1")
def type_source_split(s, d):
    return t(s, d, "validation_batch").groupBy("question_type").pivot("question_source", ["legacy", "synthetic"]).count().na.fill(0)


@query("SELECT temp_qid, question, answer, source_quote, count(*) AS n FROM judge_batch GROUP BY ALL HAVING count(*) > 1")
def duplicate_row_counts(s, d):
    return t(s, d, "judge_batch").groupBy("temp_qid", "question", "answer", "source_quote").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "SELECT count(*) AS n, round(100.0*count(*) FILTER (q > 0)/count(*),4) AS non_zero, round(avg(q),6) AS mean, quantile_cont(q,0.5) AS p50, quantile_cont(q,0.9) AS p90, quantile_cont(q,0.99) AS p99 FROM (SELECT quote_similarity AS q FROM quote_matches WHERE quote_similarity IS NOT NULL AND NOT isnan(quote_similarity))"
)
def similarity_stats(s, d):
    q = F.col("q")
    x = t(s, d, "quote_matches").select(F.col("quote_similarity").alias("q")).where(q.isNotNull() & ~F.isnan(q))
    p = F.percentile(q, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    g = x.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(q > 0) / F.count("*"), 4).alias("non_zero"), F.round(F.avg(q), 6).alias("mean"), p.alias("p"))
    return g.select("n", "non_zero", "mean", *[F.col("p")[i].alias(k) for i, k in enumerate(("p50", "p90", "p99"))])


@query(
    "SELECT CASE WHEN is_match IS NULL THEN 'unresolved' WHEN is_match THEN 'exact' ELSE 'fuzzy' END AS category, count(*) AS n FROM quote_matches GROUP BY 1"
)
def tier_category(s, d):
    tier = F.when(F.col("is_match").isNull(), "open").when(F.col("is_match"), "fr_exact").otherwise("fr_fuzzy_pass")
    return t(s, d, "quote_matches").groupBy(fq.tier_category(tier).alias("category")).agg(F.count("*").alias("n"))


@query(
    "SELECT c.category, count(m.match_id) AS n FROM (VALUES ('exact'),('fuzzy'),('sbert'),('llm'),('unresolved')) c(category) LEFT JOIN (SELECT match_id, CASE WHEN is_match IS NULL THEN 'unresolved' WHEN is_match THEN 'exact' ELSE 'fuzzy' END AS category FROM quote_matches) m USING (category) GROUP BY 1"
)
def tier_distribution(s, d):
    n = tier_category(s, d)
    all_ = s.createDataFrame([(x,) for x in ("exact", "fuzzy", "sbert", "llm", "unresolved")], "category string")
    return all_.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "SELECT event_type, round(coalesce(avg(value),0),6) AS mean, coalesce(quantile_cont(value,0.95),0) AS p95, coalesce(min(value),0) AS min, coalesce(max(value),0) AS max FROM events GROUP BY 1"
)
def performance_metrics(s, d):
    z = F.lit(0.0)
    return t(s, d, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), z), 6).alias("mean"), F.coalesce(F.percentile("value", F.lit(0.95)), z).alias("p95"), F.coalesce(F.min("value"), z).alias("min"), F.coalesce(F.max("value"), z).alias("max"))


@query(
    "SELECT source_reference, count(*) AS n, round(avg(CASE WHEN is_match THEN 1.0 ELSE 0.0 END),6) AS accuracy, CAST(count_if(is_match IS NULL) AS BIGINT) AS escalated FROM quote_matches GROUP BY 1"
)
def evaluator_accuracy(s, d):
    m = F.col("is_match")
    return t(s, d, "quote_matches").groupBy("source_reference").agg(F.count("*").alias("n"), F.round(F.avg(F.when(m, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count_if(m.isNull()).alias("escalated"))


BOOK = "regexp_extract(source, '^(.*)_chapter_', 1)"


@query(
    f"SELECT {BOOK} AS book, count(*) AS docs, count(DISTINCT source) AS chapters, CAST(sum(n_chars) AS BIGINT) AS chars, arg_max(source, (n_chars, doc_id)) AS longest FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1"
)
def corpus_chapter_stats(s, d):
    x = t(s, d, "documents").where("source is not null and n_chars is not null")
    return x.groupBy(F.regexp_extract("source", "^(.*)_chapter_", 1).alias("book")).agg(F.count("*").alias("docs"), F.countDistinct("source").alias("chapters"), F.sum("n_chars").alias("chars"), F.max_by("source", F.struct("n_chars", "doc_id")).alias("longest"))


@query(
    "SELECT batch_no, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY batch_no) AS BIGINT) AS total FROM staging_batch GROUP BY 1"
)
def dataset_growth(s, d):
    g = t(s, d, "staging_batch").groupBy("batch_no").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.orderBy("batch_no")))  # one row a batch


@query("SELECT arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders")
def max_row(s, d):
    return t(s, d, "orders").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


@query("SELECT times, count(*) AS n_values FROM (SELECT answer, count(*) AS times FROM validation_batch GROUP BY 1) GROUP BY 1")
def repeated_values(s, d):
    a = t(s, d, "validation_batch").groupBy("answer").agg(F.count("*").alias("times"))
    return a.groupBy("times").agg(F.count("*").alias("n_values"))


# ---------------------------------------------------------------- ordered operators


@query(
    f"SELECT question_source, original_question_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY question_source, original_question_id ORDER BY {AW} DESC, {QW} DESC, record_id) AS rn FROM validation_batch WHERE original_question_id IS NOT NULL) WHERE rn = 1"
)
def golden_record(s, d):
    v = t(s, d, "validation_batch").where("original_question_id is not null")
    # the best of a struct is found by partial aggregation, so a hot group never meets in one task
    key = F.struct((-fq.word_count(F.col("answer"))).alias("a"), (-fq.word_count(F.col("question"))).alias("q"), F.col("record_id").alias("i"))
    return v.groupBy("question_source", "original_question_id").agg(F.min(key)["i"].alias("record_id"))


@query(
    "SELECT question, record_id, record_id <> first_value(record_id) OVER (PARTITION BY question ORDER BY CASE question_type WHEN 'EX' THEN 0 WHEN 'MCQ' THEN 1 WHEN 'FR' THEN 2 ELSE 3 END, record_id) AS is_duplicate FROM validation_batch"
)
def golden_by_hierarchy(s, d):
    k = F.col("question_type")
    rank = F.when(k == "EX", 0).when(k == "MCQ", 1).when(k == "FR", 2).otherwise(3)
    v = t(s, d, "validation_batch").select("question", "record_id", rank.alias("rank"))
    best = v.groupBy("question").agg(F.min(F.struct("rank", "record_id"))["record_id"].alias("best"))
    return v.alias("v").join(best.alias("b"), F.expr("v.question <=> b.question")).select("v.question", "v.record_id", (F.col("v.record_id") != F.col("b.best")).alias("is_duplicate"))


@query("SELECT min(record_id) AS record_id, question, answer FROM validation_batch GROUP BY question, answer")
def drop_duplicates_keep_first(s, d):
    return t(s, d, "validation_batch").groupBy("question", "answer").agg(F.min("record_id").alias("record_id"))


@query("SELECT batch_name, record_id FROM (SELECT batch_name, record_id, row_number() OVER (PARTITION BY batch_name ORDER BY record_id) AS rn FROM validation_batch) WHERE rn <= 3")
def head_per_group(s, d):
    w = Window.partitionBy("batch_name").orderBy("record_id")
    return t(s, d, "validation_batch").select("batch_name", "record_id", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query()
def stratified_sample(s, d):
    w = Window.partitionBy("question_source", "question_type").orderBy(F.xxhash64("record_id", F.lit(42)), "record_id")
    v = t(s, d, "validation_batch").select("record_id", "question_source", "question_type", F.row_number().over(w).alias("rn"))
    return v.where("rn <= 5").drop("rn")


@query(
    "SELECT temp_qid, 'SYN_' || lpad(CAST(row_number() OVER (ORDER BY temp_qid) AS VARCHAR), 6, '0') AS new_id FROM (SELECT DISTINCT temp_qid FROM judge_batch)"
)
def assign_sequential_ids(s, d):
    rows = with_ordinal(t(s, d, "judge_batch").select("temp_qid").distinct(), ["temp_qid"], "i").withColumn("n", F.col("i") + 1)
    return rows.select("temp_qid", F.concat(F.lit("SYN_"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("new_id"))


@query(
    "SELECT match_id, temp_qid_a, temp_qid_b FROM (SELECT match_id, temp_qid_a, temp_qid_b, row_number() OVER (PARTITION BY temp_qid_a ORDER BY quote_similarity DESC, match_id) AS rn FROM quote_matches WHERE quote_similarity IS NOT NULL AND NOT isnan(quote_similarity) AND temp_qid_a IS NOT NULL) WHERE rn = 1"
)
def best_match_argmax(s, d):
    q = F.col("quote_similarity")
    m = t(s, d, "quote_matches").where(q.isNotNull() & ~F.isnan(q) & F.col("temp_qid_a").isNotNull())
    best = m.groupBy("temp_qid_a").agg(F.max_by(F.struct("match_id", "temp_qid_b"), F.struct(q, (-F.col("match_id")).alias("i"))).alias("b"))
    return best.select("b.match_id", "temp_qid_a", "b.temp_qid_b")


@query(
    "WITH e AS (SELECT user_id, event_id, CAST(event_type = 'error' AS INT) AS wrong, CAST(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before, CAST(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS score FROM events) SELECT user_id, event_id, score, 3 - coalesce(before,0) - wrong AS chances FROM e WHERE coalesce(before,0) < 3"
)
def game_replay(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    wrong = (F.col("event_type") == "error").cast("long")
    e = t(s, d, "events").select(
        "user_id", "event_id", wrong.alias("wrong"), F.coalesce(F.sum(wrong).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum((F.col("event_type") == "purchase").cast("long")).over(w).alias("score"),
    )
    return e.where("before < 3").select("user_id", "event_id", "score", (3 - F.col("before") - F.col("wrong")).alias("chances"))


@query(
    "SELECT user_id, CASE WHEN n <= 0 THEN 'Unknown' WHEN k/n::DOUBLE <= 0.3 THEN 'Novice' WHEN k/n::DOUBLE <= 0.6 THEN 'Enthusiast' WHEN k/n::DOUBLE <= 0.8 THEN 'Expert' ELSE 'Master' END AS rank FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS k FROM events GROUP BY 1)"
)
def player_rank(s, d):
    g = t(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("r"))
    r = F.col("r")
    return g.select("user_id", F.when(r <= 0.3, "Novice").when(r <= 0.6, "Enthusiast").when(r <= 0.8, "Expert").otherwise("Master").alias("rank"))


@query(
    "SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS BIGINT) AS chunk FROM events"
)
def chunk_list(s, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(s, d, "events").select("user_id", "event_id", F.floor((n - 1) / 10).alias("chunk"))


@query(
    f"SELECT source, {BOOK} AS book, CAST(chars AS BIGINT) AS chars, round(chars / avg(chars) OVER (PARTITION BY {BOOK}), 6) AS share FROM (SELECT source, sum(n_chars) AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1)"
)
def chapter_word_share(s, d):
    c = t(s, d, "documents").where("source is not null").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    c = c.withColumn("book", F.regexp_extract("source", "^(.*)_chapter_", 1))
    return c.withColumn("share", F.round(F.col("chars") / F.avg("chars").over(Window.partitionBy("book")), 6))


# ---------------------------------------------------------------- scalar functions


@query(f"SELECT record_id, {AW} AS n_words FROM validation_batch")
def clean_word_count(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.word_count(F.col("answer")).alias("n_words"))


@query(r"SELECT record_id, coalesce(trim(regexp_replace(question, '[ \t\n\r\f\x0b　]+', ' ', 'g'), ' '), '') AS text FROM validation_batch")
def clean_text(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.clean_text(F.col("question")).alias("text"))


@query()
def clean_input_string(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.clean_input_text("answer").alias("text"))


@query(
    "SELECT record_id, o AS option, trim(regexp_replace(regexp_replace(trim(lower(o), ' '), '[?.\"]$', ''), '^(or|and) ', ''), ' ') AS standard FROM (SELECT record_id, unnest(mcq_options) AS o FROM validation_batch)"
)
def standardize_option(s, d):
    v = t(s, d, "validation_batch").select("record_id", F.explode("mcq_options").alias("option"))
    return v.select("record_id", "option", fq.standardize_option(F.col("option")).alias("standard"))


@query(r"SELECT record_id, regexp_replace(explanation, '^(\[[^\]]*\]|[A-Za-z]+): *', '') AS text FROM validation_batch")
def strip_labels(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.strip_label(F.col("explanation")).alias("text"))


@query(f"SELECT record_id, {TOK} AS question_tokens, {ATOK} AS answer_tokens FROM validation_batch")
def token_columns(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.tokens(F.col("question")).alias("question_tokens"), fq.tokens(F.col("answer")).alias("answer_tokens"))


@query(f"SELECT record_id, list_filter({TOK}, lambda x: x IN {_list(fq.PRIORITY_1)}) AS tagged FROM validation_batch")
def tag_keywords(s, d):
    return t(s, d, "validation_batch").select("record_id", F.filter(fq.tokens(F.col("question")), lambda x: x.isin(*fq.PRIORITY_1)).alias("tagged"))


@query(f"SELECT record_id, {KEYWORD} AS main_keyword FROM validation_batch")
def main_keyword(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.main_keyword(fq.tokens(F.col("question"))).alias("main_keyword"))


_OPEN = " OR ".join(f"starts_with(lower(question),'{p}')" for p in fq.MCQ_PHRASES)
_HOW = " OR ".join(f"contains(lower(question),'{p}')" for p in fq.FACTUAL_HOW)


@query(
    f"SELECT record_id, CASE WHEN {_OPEN} OR regexp_matches(lower(question), '{fq.MCQ_FORMAT}') THEN 'MCQ' WHEN k IN {_list(fq.FACTUAL)} THEN 'FR' WHEN k = 'why' THEN 'EX' WHEN k IN {_list(fq.YES_NO)} THEN 'YN' WHEN k = 'how' AND ({_HOW}) THEN 'FR' WHEN k = 'how' THEN 'EX' ELSE 'Other' END AS category FROM (SELECT *, {KEYWORD} AS k FROM validation_batch)"
)
def categorize_question(s, d):
    q = F.col("question")
    return t(s, d, "validation_batch").select("record_id", fq.categorize(q, fq.main_keyword(fq.tokens(q))).alias("category"))


@query(
    "SELECT record_id, CASE WHEN regexp_matches(a, '\\b(" + "|".join(fq.MONTHS) + r")\b') AND regexp_matches(a,'[0-9]') THEN 'date' WHEN regexp_matches(a,'^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$') OR regexp_matches(a,'^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(a,'^(the year )?[0-9]{1,4} ?(ad|bc|bce|ce)?$') AND (regexp_matches(a,'[a-z]') OR regexp_matches(a,'^[0-9]{4}$')) THEN 'year' WHEN regexp_matches(a,'^[0-9]+(st|nd|rd|th) century$') THEN 'year' WHEN NOT regexp_matches(a,'[a-z]') AND regexp_matches(a,'^[0-9]+([.,][0-9]*)?$') THEN 'numeric' ELSE 'text' END AS answer_type FROM (SELECT record_id, trim(lower(answer),' ') AS a FROM validation_batch)"
)
def classify_answer_type(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.answer_type(F.col("answer")).alias("answer_type"))


_NW = "answer"
for _w, _n in fq.NUMBER_WORDS:
    _NW = f"regexp_replace({_NW}, '\\b{_w}\\b', '{_n}', 'gi')"


@query(f"SELECT record_id, {_NW} AS answer FROM validation_batch")
def number_words_to_digits(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.digits_for_words(F.col("answer")).alias("answer"))


@query(
    "SELECT record_id, substr(translate(to_base64(unhex(md5(concat_ws('_', coalesce(question_type,''), coalesce(question,''), coalesce(answer,''))))), '+/', '-_'), 1, 8) AS master_id FROM validation_batch"
)
def master_id(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.master_id(F.col("question_type"), F.col("question"), F.col("answer")).alias("master_id"))


@query("SELECT record_id, list_filter(mcq_options, lambda o: lower(trim(o,' ')) <> lower(trim(answer,' '))) AS distractors FROM validation_batch WHERE answer IS NOT NULL")
def mcq_distractors(s, d):
    return t(s, d, "validation_batch").where("answer is not null").select("record_id", fq.distractors(F.col("mcq_options"), F.col("answer")).alias("distractors"))


@query("SELECT match_id, round(quote_similarity, 4) AS rounded FROM quote_matches WHERE quote_similarity IS NOT NULL AND NOT isnan(quote_similarity)")
def round4(s, d):
    return t(s, d, "quote_matches").where(F.col("quote_similarity").isNotNull() & ~F.isnan("quote_similarity")).select("match_id", F.round("quote_similarity", 4).alias("rounded"))


@query("SELECT record_id, concat_ws(' | ', 'Q: ' || question, 'A: ' || answer, 'E: ' || explanation) AS prompt FROM validation_batch")
def prompt_context(s, d):
    part = lambda k, c: F.concat(F.lit(k), F.col(c))
    return t(s, d, "validation_batch").select("record_id", F.concat_ws(" | ", part("Q: ", "question"), part("A: ", "answer"), part("E: ", "explanation")).alias("prompt"))


@query(f"SELECT record_id, CASE WHEN len(k) >= 2 THEN list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i+1]) ELSE [] END AS bigrams FROM (SELECT record_id, {TOK} AS k FROM validation_batch)")
def word_ngrams(s, d):
    return t(s, d, "validation_batch").select("record_id", fq.ngrams(fq.tokens(F.col("question")), 2).alias("bigrams"))


# ---------------------------------------------------------------- n-grams and TF-IDF

_BI = f"SELECT record_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i+1])) AS gram FROM (SELECT record_id, {TOK} AS k FROM validation_batch) WHERE len(k) >= 2"


@query(f"SELECT gram, count(*) AS n FROM ({_BI}) GROUP BY 1 ORDER BY n DESC, gram LIMIT 50")
def common_ngrams(s, d):
    g = t(s, d, "validation_batch").select(F.explode(fq.ngrams(fq.tokens(F.col("question")), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query(f"SELECT gram, count(*) AS n FROM ({_BI}) WHERE starts_with(gram, 'how ') OR gram = 'how' GROUP BY 1")
def keyword_ngrams(s, d):
    g = t(s, d, "validation_batch").select(F.explode(fq.ngrams(fq.tokens(F.col("question")), 2)).alias("gram"))
    return g.where(F.col("gram").startswith("how ") | (F.col("gram") == "how")).groupBy("gram").agg(F.count("*").alias("n"))


def tfidf(docs: DataFrame, doc: str, terms) -> DataFrame:
    """(doc, term, w): smoothed idf times term count, each document scaled to length one."""
    tf = docs.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))  # one row
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, doc).select(doc, "term", "idf", (F.col("x") / F.col("norm")).alias("w"))


_TFIDF = f"""d AS (SELECT record_id, {TOK} AS k FROM validation_batch), tf AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest(k) AS term FROM d) GROUP BY 1,2),
 idf AS (SELECT term, ln((1.0+(SELECT count(*) FROM d))/(1+count(*)))+1 AS idf FROM tf GROUP BY 1), raw AS (SELECT record_id, term, idf, tf*idf AS x FROM tf JOIN idf USING (term)),
 w AS (SELECT record_id, term, idf, x/sqrt(sum(x*x) OVER (PARTITION BY record_id)) AS w FROM raw)"""


@query(f"WITH {_TFIDF} SELECT term, round(max(idf),4) AS idf, round(sum(w),4) AS weight FROM w GROUP BY 1")
def tfidf_ngram_rank(s, d):
    w = tfidf(t(s, d, "validation_batch").select("record_id", "question"), "record_id", fq.tokens(F.col("question")))
    return w.groupBy("term").agg(F.round(F.max("idf"), 4).alias("idf"), F.round(F.sum("w"), 4).alias("weight"))


@query(f"WITH {_TFIDF} SELECT record_id, term, round(w,6) AS w FROM w")
def tfidf_fit(s, d):
    w = tfidf(t(s, d, "validation_batch").select("record_id", "question"), "record_id", fq.tokens(F.col("question")))
    return w.select("record_id", "term", F.round("w", 6).alias("w"))


# ---------------------------------------------------------------- vectors and matching


@query("SELECT record_id, lower(trim(answer,' ')) = lower(trim(answer_variations[1],' ')) AS exact FROM validation_batch WHERE answer IS NOT NULL")
def exact_match(s, d):
    f = lambda c: F.lower(F.trim(c))
    v = t(s, d, "validation_batch").where("answer is not null")
    return v.select("record_id", (f(F.col("answer")) == f(F.get("answer_variations", F.lit(0)))).alias("exact"))


# ---------------------------------------------------------------- validation


@query(
    "SELECT record_id, list_filter([CASE WHEN question_type NOT IN ('EX','FR','MCQ','YN') OR question_type IS NULL THEN 'question_type' END, CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END, CASE WHEN question_type = 'MCQ' AND coalesce(len(mcq_options),0) <> 4 THEN 'mcq_options' END], lambda x: x IS NOT NULL) AS errors FROM validation_batch"
)
def enforce_schema(s, d):
    k = F.col("question_type")
    rules = {
        "question_type": k.isNull() | ~k.isin("EX", "FR", "MCQ", "YN"), "question": F.col("question").isNull(), "answer": F.col("answer").isNull(),
        "mcq_options": (k == "MCQ") & (F.coalesce(F.size("mcq_options"), F.lit(0)) != 4),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return t(s, d, "validation_batch").select("record_id", errors.alias("errors"))


@query(
    "SELECT CAST(count_if(question IS NULL) AS BIGINT) AS question_nulls, CAST(count_if(answer IS NULL) AS BIGINT) AS answer_nulls, CAST(count_if(mcq_options IS NULL) AS BIGINT) AS option_nulls FROM validation_batch"
)
def null_integrity(s, d):
    return t(s, d, "validation_batch").agg(*[F.count_if(F.col(c).isNull()).alias(a) for c, a in (("question", "question_nulls"), ("answer", "answer_nulls"), ("mcq_options", "option_nulls"))])


# ---------------------------------------------------------------- clusters, evaluation, streams


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT temp_qid_a AS a, temp_qid_b AS b FROM quote_matches WHERE is_match AND temp_qid_a <> temp_qid_b UNION SELECT temp_qid_b, temp_qid_a FROM quote_matches WHERE is_match AND temp_qid_a <> temp_qid_b), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS cluster FROM r GROUP BY 1"
)
def connected_components(s, d):
    return connected(t(s, d, "quote_matches").where("is_match"), "temp_qid_a", "temp_qid_b")


def _number_sql(c: str) -> str:
    words = c
    for w, n in fq.NUMBER_WORDS:
        words = f"regexp_replace({words}, '\\b{w}\\b', '{n}', 'gi')"
    got = f"regexp_extract_all(replace(lower({words}),',',''), '[0-9]+')"
    sign = rf"CASE WHEN regexp_matches(lower({words}), '\b(bc|bce|b\.c\.|b\.c\.e\.)(\b|$| )') THEN -1 ELSE 1 END"
    return f"CASE WHEN len({got}) = 1 THEN TRY_CAST({got}[1] AS BIGINT) * {sign} END"


@query(
    f"SELECT record_id, CASE WHEN g IS NULL THEN 'numeric_exact_fail_invalid_gold' WHEN p IS NULL THEN 'numeric_exact_fail_invalid_or_no_num' WHEN p = g THEN 'numeric_exact_pass' ELSE 'numeric_exact_fail' END AS tier FROM (SELECT record_id, {_number_sql('answer')} AS p, {_number_sql('answer_variations[1]')} AS g FROM validation_batch)"
)
def eval_numeric(s, d):
    v = t(s, d, "validation_batch")
    return v.select("record_id", evaluate.evaluate_numeric(F.col("answer"), F.get("answer_variations", F.lit(0))).alias("tier"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def windowed_telemetry(s, d):
    w = windowed_rollup(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query(
    f"WITH q AS (SELECT question_type, quantile_cont({AW}, 0.25) AS q1, quantile_cont({AW}, 0.75) AS q3 FROM validation_batch WHERE question_type IN ('EX','FR','MCQ') GROUP BY 1) SELECT a.question_type AS type_a, b.question_type AS type_b, a.q1 <= b.q3 AND b.q1 <= a.q3 AS overlap FROM q a, q b WHERE a.question_type < b.question_type"
)
def answer_shape_drift(s, d):
    v = t(s, d, "validation_batch").where(F.col("question_type").isin("EX", "FR", "MCQ")).select("question_type", fq.word_count(F.col("answer")).alias("w"))
    q = v.groupBy("question_type").agg(F.percentile("w", F.lit(0.25)).alias("q1"), F.percentile("w", F.lit(0.75)).alias("q3"))  # three rows
    a, b = q.toDF("type_a", "a1", "a3"), q.toDF("type_b", "b1", "b3")
    return a.join(F.broadcast(b), F.col("type_a") < F.col("type_b")).select("type_a", "type_b", ((F.col("a1") <= F.col("b3")) & (F.col("b1") <= F.col("a3"))).alias("overlap"))
