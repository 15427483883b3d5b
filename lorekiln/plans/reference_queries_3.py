"""Registered queries: dates, vectors of texts, the evaluation cascades with real ratios, similarities and judges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions import dates, embedding
from lorekiln.functions import questions as fq
from lorekiln.operators import evaluate, judge
from lorekiln.operators.grounding import best_windows
from lorekiln.plans.reference_queries import query, t

# ---------------------------------------------------------------- SQL of the shared parts


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c},'')), '[a-z0-9]+')"


def sql_buckets(c: str) -> str:
    digit = "(instr('0123456789abcdef', substr(md5(t), {0}, 1)) - 1)".format
    return f"list_transform({sql_tokens(c)}, lambda t: {digit(1)} * 4 + {digit(2)} % 4)"


def sql_similar(x: str, y: str) -> str:
    """Cosine of two columns of buckets."""
    dot = "list_sum(list_transform({0}, lambda v: len(list_filter({1}, lambda w: w = v))))::DOUBLE".format
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN round({dot(x, y)} / sqrt({dot(x, x)} * {dot(y, y)}), 6) ELSE 0.0::DOUBLE END"


def sql_ratio(a: str, b: str) -> str:
    """2 * LCS / (m + n) by a row of the programme after the other."""
    step = f"list_reduce(range(1, length({b}) + 1), lambda row, j: list_append(row, greatest(row[len(row)], prev[j + 1], prev[j] + CASE WHEN substr({b}, j, 1) = c THEN 1 ELSE 0 END)), [0::BIGINT])"
    lcs = f"list_reduce(string_split({a}, ''), lambda prev, c: {step}, list_transform(range(length({b}) + 1), lambda i: 0::BIGINT))[length({b}) + 1]"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {lcs} / (length({a}) + length({b})) END"


def sql_words(c: str) -> str:
    return f"len(regexp_extract_all(coalesce({c},''), '[A-Za-z0-9_]+'))"


def sql_judge(p: str, g: str) -> str:
    shared = f"len(list_distinct(list_filter({g}, lambda x: list_contains({p}, x))))"
    return f"(len({g}) > 0 AND {shared} >= 0.5 * len(list_distinct({g})))"


def sql_date_text(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(trim(lower({c}), ' '), '\(.*?\)', '', 'g'), '([0-9])(st|nd|rd|th|rst)\b', '\1', 'g')"
    for name, date in dates.HOLIDAYS:
        out = f"replace({out}, '{name.replace(chr(39), chr(39) * 2)}', '{date}')"
    return out


def sql_date(c: str) -> str:
    """A struct of day, month and year of a column of normalised text."""
    cases = []
    for pattern, day, month, year, name in dates.FORMATS:
        num = lambda g: f"TRY_CAST(regexp_extract({c}, '{pattern}', {g}) AS INT)" if g else "NULL::INT"  # noqa: E731, B023
        m = f"CAST((instr('{dates.STARTS}', substr(regexp_extract({c}, '{pattern}', {month}), 1, 3)) + 2) // 3 AS INT)" if name else num(month)
        cases.append(f"WHEN regexp_matches({c}, '{pattern}') THEN struct_pack(day := {num(day)}, month := {m}, year := {num(year)})")
    return f"CASE {' '.join(cases)} END"


def sql_date_fits(d: str) -> str:
    return f"CASE WHEN coalesce({d}.day, 1) BETWEEN 1 AND 31 AND coalesce({d}.month, 1) BETWEEN 1 AND 12 THEN {d} END"


def judged(player: Column, gold: Column) -> Column:
    """The offline judge as an expression: half of the gold answer's distinct words are in the player's."""
    p, g = fq.tokens(player), F.array_distinct(fq.tokens(gold))
    return (F.size(g) > 0) & (F.size(F.array_intersect(g, p)) >= 0.5 * F.size(g))


# ---------------------------------------------------------------- dates


@query(f"SELECT record_id, {sql_date_text('explanation')} AS date_text FROM validation_batch")
def normalize_date_text(s, d):
    return t(s, d, "validation_batch").select("record_id", dates.normalize_date_text(F.col("explanation")).alias("date_text"))


#: Texts of dates made from the order dates, in several spellings, so that every format is met.
_SPELT = "CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 1 THEN 'it was on ' || strftime(o_orderdate, '%B %-d') || 'th, ' || year(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN strftime(o_orderdate, '%B %Y') WHEN 5 THEN 'Christmas (or so)' ELSE 'in ' || year(o_orderdate) END"


def _spelt() -> Column:
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    return (
        F.when(k == 0, F.date_format(o, "d MMMM yyyy")).when(k == 1, F.concat(F.lit("it was on "), F.date_format(o, "MMMM d"), F.lit("th, "), F.year(o)))
        .when(k == 2, F.date_format(o, "yyyy-MM-dd")).when(k == 3, F.date_format(o, "MM/dd/yyyy")).when(k == 4, F.date_format(o, "MMMM yyyy"))
        .when(k == 5, "Christmas (or so)").otherwise(F.concat(F.lit("in "), F.year(o)))
    )


@query(
    f"WITH x AS (SELECT o_orderkey, {sql_date_text(_SPELT)} AS txt FROM orders UNION ALL SELECT -record_id, {sql_date_text('answer')} FROM validation_batch), e AS (SELECT o_orderkey AS k, {sql_date('txt')} AS d FROM x), f AS (SELECT k, {sql_date_fits('d')} AS d FROM e) SELECT k, d.day AS day, d.month AS month, d.year AS year FROM f"
)
def extract_date_entities(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), _spelt().alias("txt"))
    v = t(s, d, "validation_batch").select((-F.col("record_id")).alias("k"), F.col("answer").alias("txt"))
    e = o.unionByName(v).select("k", dates.date_entities(F.col("txt")).alias("e"))
    return e.select("k", "e.day", "e.month", "e.year")


@query(
    f"WITH x AS (SELECT record_id, {sql_date_text('answer_variations[1]')} AS p, {sql_date_text('answer')} AS g FROM validation_batch), e AS (SELECT record_id, {sql_date('p')} AS p, {sql_date('g')} AS g FROM x), f AS (SELECT record_id, {sql_date_fits('p')} AS p, {sql_date_fits('g')} AS g FROM e) SELECT record_id, CASE WHEN g IS NULL THEN 'date_exact_fail_invalid_gold' WHEN p IS NULL THEN 'date_exact_fail_invalid_player_ans' WHEN p.day IS NOT DISTINCT FROM g.day AND p.month IS NOT DISTINCT FROM g.month AND p.year IS NOT DISTINCT FROM g.year THEN 'date_exact_pass' ELSE 'date_exact_fail' END AS tier FROM f"
)
def eval_date(s, d):
    v = t(s, d, "validation_batch")
    return v.select("record_id", dates.evaluate_date(F.get("answer_variations", F.lit(0)), F.col("answer")).alias("tier"))


# ---------------------------------------------------------------- vectors of texts


@query(f"WITH x AS (SELECT record_id, {sql_buckets('question')} AS b FROM validation_batch) SELECT record_id, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS embedding FROM x")
def embed_text(s, d):
    return t(s, d, "validation_batch").select("record_id", embedding.embed(F.col("question")).alias("embedding"))


@query(
    "WITH e AS (SELECT label, count(*) AS n_texts, count(embedding) AS n_vectors, CAST(count_if(len(embedding) <> 64 OR len(list_filter(embedding, lambda x: isnan(x))) > 0) AS BIGINT) AS n_bad FROM embeddings GROUP BY 1) SELECT label, n_texts, n_vectors, n_bad, n_vectors <> n_texts OR n_bad > 0 AS halt FROM e"
)
def embedding_audit(s, d):
    bad = (F.size("embedding") != 64) | F.exists("embedding", F.isnan)
    e = t(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n_texts"), F.count("embedding").alias("n_vectors"), F.count_if(bad).alias("n_bad"))
    return e.withColumn("halt", (F.col("n_vectors") != F.col("n_texts")) | (F.col("n_bad") > 0))


@query(
    "SELECT vec_id, nullif(len(embedding), 0) AS dim, len(embedding) IS NOT NULL AND len(embedding) > 0 AS hydrated, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS norm, bool_or(embedding IS NULL OR len(embedding) = 0) OVER () AS abort FROM embeddings"
)
def tensor_hydrate(s, d):
    e = t(s, d, "embeddings").withColumn("v", F.when(F.size("embedding") > 0, F.col("embedding")))
    gate = e.agg(F.bool_or(F.col("v").isNull()).alias("abort"))  # one row
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.join(F.broadcast(gate)).select("vec_id", F.size("v").cast("long").alias("dim"), F.col("v").isNotNull().alias("hydrated"), F.round(norm, 5).alias("norm"), "abort")


@query(
    "WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), p AS (SELECT vec_id, exp(x) / (exp(x)+exp(y)+exp(z)) AS c, exp(y) / (exp(x)+exp(y)+exp(z)) AS e, exp(z) / (exp(x)+exp(y)+exp(z)) AS n FROM l) SELECT vec_id, CASE WHEN c >= e AND c >= n THEN 'contradiction' WHEN e >= n THEN 'entailment' ELSE 'neutral' END AS label, round(greatest(c, e, n), 6) AS confidence FROM p"
)
def nli_entailment(s, d):
    e = [F.exp(F.get("embedding", F.lit(i)).cast("double")) for i in range(3)]
    p = t(s, d, "embeddings").select("vec_id", *[(x / (e[0] + e[1] + e[2])).alias(k) for x, k in zip(e, "cen")])
    label = F.when((F.col("c") >= F.col("e")) & (F.col("c") >= F.col("n")), "contradiction").when(F.col("e") >= F.col("n"), "entailment").otherwise("neutral")
    return p.select("vec_id", label.alias("label"), F.round(F.greatest("c", "e", "n"), 6).alias("confidence"))


def _best(player: Column, texts: Column) -> Column:
    """Largest similarity of a text with any of a list; null without a list."""
    return F.array_max(F.transform(texts, lambda x: embedding.similarity(player, x)))


@query(
    f"WITH x AS (SELECT record_id, {sql_buckets('explanation')} AS p, {sql_buckets('answer')} AS g, list_transform(answer_variations, lambda z: {sql_buckets('z')}) AS vs FROM validation_batch), y AS (SELECT record_id, {sql_similar('p', 'g')} AS main, list_max(list_transform(vs, lambda q: {sql_similar('p', 'q')})) AS var FROM x) SELECT record_id, main, var, greatest(main, coalesce(var, 0.0), 0.0) AS best, coalesce(var > main, false) AS var_better FROM y"
)
def best_variation_score(s, d):
    e = F.col("explanation")
    v = t(s, d, "validation_batch").select("record_id", embedding.similarity(e, F.col("answer")).alias("main"), _best(e, F.col("answer_variations")).alias("var"))
    return v.select("record_id", "main", "var", F.greatest("main", F.coalesce("var", F.lit(0.0)), F.lit(0.0)).alias("best"), F.coalesce(F.col("var") > F.col("main"), F.lit(False)).alias("var_better"))


_OTHERS = "list_filter(mcq_options, lambda o: lower(trim(o, ' ')) <> lower(trim(answer, ' ')))"


@query(
    f"WITH x AS (SELECT record_id, {sql_buckets('answer_variations[1]')} AS p, {sql_buckets('answer')} AS g, list_transform({_OTHERS}, lambda z: {sql_buckets('z')}) AS os FROM validation_batch WHERE mcq_options IS NOT NULL), y AS (SELECT record_id, {sql_similar('p', 'g')} AS correct, list_max(list_transform(os, lambda q: {sql_similar('p', 'q')})) AS other FROM x) SELECT record_id, correct, other, round(correct - other, 6) AS margin FROM y"
)
def distractor_margin(s, d):
    v = t(s, d, "validation_batch").where("mcq_options is not null")
    p, a = F.get("answer_variations", F.lit(0)), F.col("answer")
    v = v.select("record_id", embedding.similarity(p, a).alias("correct"), _best(p, fq.distractors(F.col("mcq_options"), a)).alias("other"))
    return v.withColumn("margin", F.round(F.col("correct") - F.col("other"), 6))


@query(
    f"WITH x AS (SELECT record_id, {sql_buckets('answer')} AS g, list_transform({_OTHERS}, lambda z: {sql_buckets('z')}) AS os FROM validation_batch WHERE mcq_options IS NOT NULL) SELECT record_id, list_max(list_transform(os, lambda q: {sql_similar('g', 'q')})) AS collision FROM x"
)
def collision_risk(s, d):
    v = t(s, d, "validation_batch").where("mcq_options is not null")
    return v.select("record_id", _best(F.col("answer"), fq.distractors(F.col("mcq_options"), F.col("answer"))).alias("collision"))


_SENTENCES = r"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_WINDOWS = "CASE WHEN len(s) = 1 THEN s ELSE list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i+1]) END"


def sentences(c: Column) -> Column:
    """Trimmed, non-empty parts of a text between runs of full stops, question and exclamation marks."""
    return F.filter(F.transform(F.split(c, "[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_windows(s: Column, n: int) -> Column:
    """Sliding windows of ``n`` sentences joined by a space; a shorter text is one window."""
    last = F.greatest(F.size(s) - n, F.lit(0))
    return F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(s, i + 1, n)))).otherwise(F.array().cast("array<string>"))


@query(f"WITH x AS (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(s) = 0 THEN [] ELSE {_WINDOWS} END AS windows FROM x")
def sentence_ngrams(s, d):
    x = t(s, d, "documents").where("text is not null").select("doc_id", sentences(F.col("text")).alias("s"))
    return x.select("doc_id", sentence_windows(F.col("s"), 2).alias("windows"))


_CHAPTER = "replace(lower(source_reference), ' chapter ', '_chapter_')"


@query(
    rf"WITH q AS (SELECT DISTINCT temp_qid, source_quote, regexp_extract(source_reference, '^(\S+)', 1) AS book, TRY_CAST(regexp_extract(source_reference, '([0-9]+)$', 1) AS INT) AS no FROM judge_batch WHERE source_quote IS NOT NULL AND source_reference IS NOT NULL AND TRY_CAST(regexp_extract(temp_qid, '([0-9]+)$', 1) AS BIGINT) % 50 = 0), x AS (SELECT regexp_extract(source, '^(.*)_chapter_', 1) AS book, TRY_CAST(regexp_extract(source, '_chapter_([0-9]+)', 1) AS INT) AS no, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), w AS (SELECT DISTINCT book, no, unnest({_WINDOWS}) AS win FROM x WHERE len(s) > 0), b AS (SELECT book, no, {sql_buckets('win')} AS wb FROM w), p AS (SELECT temp_qid, {sql_buckets('source_quote')} AS qb, wb FROM q LEFT JOIN b USING (book, no)) SELECT temp_qid, max({sql_similar('qb', 'wb')}) AS grounding FROM p GROUP BY 1"
)
def grounding_score(s, d):
    """Every quote whose number is divisible by 50, against all windows of two sentences of its chapter."""
    r = F.col("source_reference")
    q = t(s, d, "judge_batch").where("source_quote is not null and source_reference is not null")
    q = q.where((F.regexp_extract("temp_qid", "([0-9]+)$", 1).try_cast("long") % 50) == 0)
    q = q.select("temp_qid", F.col("source_quote").alias("quote"), F.regexp_extract(r, r"^(\S+)", 1).alias("book"), F.regexp_extract(r, "([0-9]+)$", 1).try_cast("int").alias("no"))
    x = t(s, d, "documents").where("source is not null")
    x = x.select("text", F.regexp_extract("source", "^(.*)_chapter_", 1).alias("book"), F.regexp_extract("source", "_chapter_([0-9]+)", 1).try_cast("int").alias("no"))
    return best_windows(q, x, "temp_qid")


# ---------------------------------------------------------------- evaluation


@query(f"SELECT record_id, variation, round({sql_ratio('x', 'y')}, 6) AS ratio FROM (SELECT record_id, variation, lower(coalesce(answer,'')) AS x, lower(coalesce(variation,'')) AS y FROM (SELECT record_id, answer, unnest(answer_variations) AS variation FROM validation_batch))")
def fuzzy_ratio(s, d):
    v = t(s, d, "validation_batch").select("record_id", "answer", F.explode("answer_variations").alias("variation"))
    return v.select("record_id", "variation", F.round(fq.indel_ratio(F.lower("answer"), F.lower("variation")), 6).alias("ratio"))


# the first variation plays the player's answer, the stored one is the gold answer, the others are its variations
_TURN = "SELECT *, lower(trim(answer_variations[1],' ')) AS p, lower(trim(answer,' ')) AS g, answer_variations[2:] AS vs FROM validation_batch WHERE answer IS NOT NULL AND answer_variations[1] IS NOT NULL"


def _turns(s, d):
    v = t(s, d, "validation_batch").withColumn("p", F.lower(F.trim(F.get("answer_variations", F.lit(0))))).withColumn("g", F.lower(F.trim("answer")))
    v = v.withColumn("vs", F.slice("answer_variations", 2, 1_000_000))
    return v.where("g is not null and p is not null").withColumn("fuzzy", fq.indel_ratio("p", "g"))


_BEST = f"greatest({sql_similar('pb', 'gb')}, coalesce(list_max(list_transform(vb, lambda q: {sql_similar('pb', 'q')})), 0.0))"
_HIT = r"len(list_filter(semantic_entity_refs, lambda r: regexp_matches(p, '\b' || regexp_escape(lower(r)) || '\b'))) > 0"


@query(
    f"WITH x AS ({_TURN}), y AS (SELECT record_id, p, g, {sql_ratio('p', 'g')} AS fuzzy, {sql_buckets('p')} AS pb, {sql_buckets('g')} AS gb, list_transform(vs, lambda z: {sql_buckets('z')}) AS vb, coalesce({_HIT}, false) AS hit, {sql_words('p')} AS pw, {sql_words('g')} AS gw, {sql_judge(sql_tokens('p'), sql_tokens('g'))} AS ok FROM x), z AS (SELECT *, {_BEST} AS sim FROM y) SELECT record_id, CASE WHEN p = g THEN 'fr_exact' WHEN fuzzy >= 0.85 THEN 'fr_fuzzy' WHEN pw > 6 OR (pw >= 2*gw AND pw >= 8) THEN CASE WHEN ok THEN 'fr_llm_judge_pass' ELSE 'fr_llm_judge_fail' END WHEN sim >= 0.8 THEN 'fr_passed_primary_semantic' WHEN sim >= 0.5 AND hit AND least(round(sim + 0.1, 6), 1.0) >= 0.8 THEN 'fr_passed_semantic_boosted' ELSE 'fr_failed_primary_semantic' END AS tier FROM z"
)
def eval_fr(s, d):
    v = _turns(s, d)
    p, g = F.col("p"), F.col("g")
    sim = F.greatest(embedding.similarity(p, g), F.coalesce(_best(p, F.col("vs")), F.lit(0.0)))
    hit = F.coalesce(F.exists("semantic_entity_refs", lambda r: F.regexp_like(p, F.concat(F.lit(r"\b\Q"), F.lower(r), F.lit(r"\E\b")))), F.lit(False))
    return v.select("record_id", evaluate.evaluate_fr(p, g, F.col("fuzzy"), sim, hit, judged(p, g)).alias("tier"))


@query(
    f"WITH x AS ({_TURN}), y AS (SELECT record_id, p, g, {sql_ratio('p', 'g')} AS fuzzy, {sql_buckets('p')} AS pb, {sql_buckets('g')} AS gb, list_transform({_OTHERS}, lambda z: {sql_buckets('z')}) AS ob FROM x WHERE mcq_options IS NOT NULL), z AS (SELECT *, {sql_similar('pb', 'gb')} AS sim, list_max(list_transform(ob, lambda q: {sql_similar('pb', 'q')})) AS other FROM y) SELECT record_id, CASE WHEN p = g THEN 'mcq_exact' WHEN fuzzy >= 0.85 THEN 'mcq_fuzzy' WHEN sim >= 0.75 AND round(sim - coalesce(other, 0.0), 6) >= 0.3 THEN 'mcq_passed_semantic' ELSE 'mcq_failed_semantic' END AS tier FROM z"
)
def eval_mcq(s, d):
    v = _turns(s, d).where("mcq_options is not null")
    p, g = F.col("p"), F.col("g")
    sim = embedding.similarity(p, g)
    margin = F.round(sim - F.coalesce(_best(p, fq.distractors(F.col("mcq_options"), F.col("answer"))), F.lit(0.0)), 6)
    return v.select("record_id", evaluate.evaluate_mcq(p, g, F.col("fuzzy"), sim, margin).alias("tier"))


@query(
    f"WITH x AS ({_TURN}), y AS (SELECT record_id, p, g, {sql_ratio('p', 'g')} AS fuzzy, {sql_buckets('p')} AS pb, {sql_buckets('g')} AS gb, {sql_words('p')} AS pw, {sql_words('g')} AS gw, {sql_judge(sql_tokens('p'), sql_tokens('g'))} AS ok FROM x), z AS (SELECT *, {sql_similar('pb', 'gb')} AS sim FROM y) SELECT record_id, CASE WHEN p = g THEN 'ex_exact' WHEN fuzzy >= 0.95 THEN 'ex_fuzzy' WHEN sim < 0.4 AND NOT (pw >= 2*gw) THEN 'ex_failed_semantic' WHEN ok THEN 'ex_llm_judge_pass' ELSE 'ex_llm_judge_fail' END AS tier FROM z"
)
def eval_ex(s, d):
    v = _turns(s, d)
    p, g = F.col("p"), F.col("g")
    return v.select("record_id", evaluate.evaluate_ex(p, g, F.col("fuzzy"), embedding.similarity(p, g), judged(p, g)).alias("tier"))


def _route() -> Column:
    p, k = F.trim(F.coalesce(F.get("answer_variations", F.lit(0)), F.lit(""))), F.upper(F.trim(F.coalesce("question_type", F.lit(""))))
    kind = fq.answer_type(F.col("answer"))
    return (
        F.when(p == "", "empty_submission").when(kind == "numeric", "numeric").when(kind.isin("date", "year"), "date")
        .when(k.isin("MCQ", "FR", "EX"), F.lower(k)).otherwise("error")
    )


_KIND = (
    "CASE WHEN regexp_matches(a, '\\b(" + "|".join(fq.MONTHS) + r")\b') AND regexp_matches(a,'[0-9]') THEN 'date' WHEN regexp_matches(a,'^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$') OR regexp_matches(a,'^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(a,'^(the year )?[0-9]{1,4} ?(ad|bc|bce|ce)?$') AND (regexp_matches(a,'[a-z]') OR regexp_matches(a,'^[0-9]{4}$')) THEN 'year' WHEN regexp_matches(a,'^[0-9]+(st|nd|rd|th) century$') THEN 'year' WHEN NOT regexp_matches(a,'[a-z]') AND regexp_matches(a,'^[0-9]+([.,][0-9]*)?$') THEN 'numeric' ELSE 'text' END"
)
_ROUTE = f"SELECT record_id, CASE WHEN p = '' THEN 'empty_submission' WHEN kind = 'numeric' THEN 'numeric' WHEN kind IN ('date','year') THEN 'date' WHEN k IN ('MCQ','FR','EX') THEN lower(k) ELSE 'error' END AS route FROM (SELECT *, {_KIND} AS kind FROM (SELECT record_id, trim(coalesce(answer_variations[1],''), ' ') AS p, upper(trim(coalesce(question_type,''), ' ')) AS k, trim(lower(answer), ' ') AS a FROM validation_batch))"


@query(_ROUTE)
def route_eval(s, d):
    return t(s, d, "validation_batch").select("record_id", _route().alias("route"))


@query(f"SELECT record_id, route, 'dispatch=' || route || ' id=' || record_id AS entry FROM ({_ROUTE})")
def eval_dispatch_log(s, d):
    r = route_eval(s, d)
    return r.select("record_id", "route", F.concat(F.lit("dispatch="), "route", F.lit(" id="), F.col("record_id").cast("string")).alias("entry"))


def dispatch(turns):
    """(record_id, route, tier): each turn evaluated by the cascade its route names; null tier where none does."""
    p, g = F.lower(F.trim(F.get("answer_variations", F.lit(0)))), F.lower(F.trim("answer"))
    v = turns.withColumn("p", p).withColumn("g", g).withColumn("route", _route()).withColumn("fuzzy", fq.indel_ratio("p", "g"))
    p, g, fuzzy = F.col("p"), F.col("g"), F.col("fuzzy")
    sim = embedding.similarity(p, g)
    margin = F.round(sim - F.coalesce(_best(p, fq.distractors(F.col("mcq_options"), F.col("answer"))), F.lit(0.0)), 6)
    hit = F.coalesce(F.exists("semantic_entity_refs", lambda r: F.regexp_like(p, F.concat(F.lit(r"\b\Q"), F.lower(r), F.lit(r"\E\b")))), F.lit(False))
    tier = {
        "numeric": evaluate.evaluate_numeric(p, g), "date": dates.evaluate_date(p, g), "mcq": evaluate.evaluate_mcq(p, g, fuzzy, sim, margin),
        "fr": evaluate.evaluate_fr(p, g, fuzzy, sim, hit, judged(p, g)), "ex": evaluate.evaluate_ex(p, g, fuzzy, sim, judged(p, g)),
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, x in tier.items():
        out = out.when((F.col("route") == k) & g.isNotNull(), x)
    return v.select("record_id", "route", out.alias("tier"))


@query()
def eval_dispatch(s, d):
    return dispatch(t(s, d, "validation_batch"))


def _flaky(name: str, bad: str, error: str):
    def model(question: str, player: str, gold: str) -> tuple[bool, str]:
        import hashlib

        if hashlib.md5((name + question).encode()).hexdigest()[0] in bad:
            raise RuntimeError(error)
        return judge.overlap_judge(question, player, gold)

    return model


_STATUS = "CASE WHEN instr('0123', substr(md5('a' || coalesce(question,'')), 1, 1)) = 0 THEN 'success' WHEN instr('01', substr(md5('b' || coalesce(question,'')), 1, 1)) > 0 THEN 'failed' ELSE 'success' END"


@query(
    f"WITH x AS (SELECT record_id, {sql_tokens('answer_variations[1]')} AS p, {sql_tokens('answer')} AS g, {_STATUS} AS status, instr('0123', substr(md5('a' || coalesce(question,'')), 1, 1)) = 0 AS first FROM validation_batch) SELECT record_id, status = 'success' AND {sql_judge('p', 'g')} AS verdict, CASE WHEN first THEN 'main' ELSE 'spare' END AS model, status FROM x"
)
def llm_judge(s, d):
    """Two stand-in models: the first is busy for some prompts, the second fails for some of those."""
    v = t(s, d, "validation_batch").select("record_id", "question", F.get("answer_variations", F.lit(0)).alias("player"), F.col("answer").alias("gold"))
    models = [("main", _flaky("a", "0123", "503 busy")), ("spare", _flaky("b", "01", "bad key"))]
    return judge.judge_answers(v, "record_id", models).select("record_id", "verdict", "model", "status")


@query(f"SELECT health, count(*) AS n FROM (SELECT CASE {_STATUS} WHEN 'success' THEN 'OK' WHEN 'transient' THEN 'DEGRADED' ELSE 'FAILED' END AS health FROM validation_batch) GROUP BY 1")
def llm_health(s, d):
    return llm_judge(s, d).groupBy(judge.health(F.col("status")).alias("health")).agg(F.count("*").alias("n"))


@query(
    "SELECT record_id, 'option' AS kind, unnest(mcq_options) AS text FROM validation_batch UNION ALL SELECT record_id, 'variation', unnest(answer_variations) FROM validation_batch"
)
def flatten_test_suite(s, d):
    suite = F.create_map(F.lit("option"), F.col("mcq_options"), F.lit("variation"), F.col("answer_variations"))
    cases = t(s, d, "validation_batch").select("record_id", F.explode(suite).alias("kind", "texts"))
    return cases.select("record_id", "kind", F.explode("texts").alias("text"))


@query(
    "SELECT tier, count(*) AS n, round(avg(q), 6) AS mean_similarity, CAST(count_if(source_reference IS NULL) AS BIGINT) AS no_reference, count(DISTINCT run_id) AS runs FROM (SELECT CASE WHEN is_match IS NULL THEN 'open' WHEN is_match THEN 'pass' ELSE 'fail' END AS tier, CASE WHEN NOT isnan(quote_similarity) THEN quote_similarity END AS q, source_reference, run_id FROM quote_matches) GROUP BY 1"
)
def fail_summary_by_tier(s, d):
    q, m = F.col("quote_similarity"), F.col("is_match")
    tier = F.when(m.isNull(), "open").when(m, "pass").otherwise("fail")
    return t(s, d, "quote_matches").groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(~F.isnan(q), q)), 6).alias("mean_similarity"), F.count_if(F.col("source_reference").isNull()).alias("no_reference"), F.countDistinct("run_id").alias("runs")
    )
