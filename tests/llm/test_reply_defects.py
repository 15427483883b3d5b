import pytest
from pyspark.sql import functions as F

from lorekiln.llm import reply_defects as D

GOOD = "Anna mended the {0} clocks at Weir Tower in {1}, because the bells had already rung twice that night."


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.createDataFrame([(D.SEED_TEXT[k], k) for k in D.LANGUAGES] + [(None, "en"), ("", None), ("x", "und")], "text string, lang string")
    n = [(f"r{i}", GOOD.format(w, 1100 + i % 7)) for i in range(300) for w in ("old", "red", "blue")]
    n += [(f"a{i}", "because the bells had already rung twice that night") for i in range(200)]
    texts = spark.createDataFrame([("explanation" if k[0] == "r" else "answer", t) for k, t in n], "field string, text string")
    return D.fit_languages(docs), D.fit_refusals(texts), D.fit_ends(texts)


CASES = [
    ("Who mended the old clocks at Weir Tower?", "Anna", None),
    ("Who mended the old clocks at Weir Tower?", None, "empty"),
    ("Who mended the old clocks at Weir Tower?", " ​ ", "empty"),
    ("Who mended the old clocks at Weir Tower?", "N/A", "empty"),
    ("Who mended the old clocks at Weir Tower?", "who  mended the OLD clocks at weir tower", "copied_question"),
    ("Who mended the old clocks at Weir Tower?", "You asked: Who mended the old clocks at Weir Tower?", "copied_question"),
    ("Who mended the old clocks at Weir Tower?", "I'm sorry, but I cannot help with that.", "refusal"),
    ("Who mended the old clocks at Weir Tower?", "The content policy blocks a reply.", "refusal"),
    ("Why did Anna wait?", 'as she later told us, "i cannot leave the tower"', None),
    ("Who mended the old clocks at Weir Tower?", "der alte Mann hat niemandem die Straßen gezeigt", "other_language"),
    ("Pourquoi la fille est-elle partie avec les autres ?", "parce que l'hiver était venu et la route était longue", None),
    ("Pourquoi la fille est-elle partie avec les autres ?", "because the winter was long and they had nothing left to eat", "other_language"),
    ("Why did Anna mend the clocks?", "because the bells had already rung twice that night", None),
    ("Why did Anna mend the clocks?", "because the bells had alrea", "truncated"),
    ("Why did Anna mend the clocks?", "because the bells had already rung twice (see also", "truncated"),
    ("Why did Anna mend the clocks?", "because the bells had", "truncated"),
    (None, "because the bells had", "truncated"),
    (None, "because the bells had already rung twice that night", None),
    ("", "We are not able to answer this.", "refusal"),
]


def test_each_defect(spark, models):
    df = spark.createDataFrame([(i, q, a, GOOD.format("old", 1101), "x") for i, (q, a, _) in enumerate(CASES)], "record_id long, question string, answer string, explanation string, defect string")
    got = {(r.record_id, r.field_name): r.defect for r in D.reply_defects(df, *models).collect()}
    for i, (q, a, want) in enumerate(CASES):
        assert got.get((i, "answer")) == want, (q, a, want, got.get((i, "answer")))
    wrong_language = {i for i, (q, *_) in enumerate(CASES) if q and q.startswith("Pourquoi")}
    assert {i for i, f in got if f == "explanation"} == wrong_language


def test_long_empty_and_repeated_rows(spark, models):
    rows = [(1, "Why?", GOOD.format("old", 1101) * 5000, ""), (1, "Why?", "none given", "")]
    df = spark.createDataFrame(rows, "record_id long, question string, answer string, explanation string")
    got = sorted((r.field_name, r.defect) for r in D.reply_defects(df, *models).collect())
    assert got == [("answer", "empty"), ("explanation", "empty"), ("explanation", "empty")]
    assert D.reply_defects(df.limit(0), *models).collect() == []


def test_models_of_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    texts = spark.createDataFrame([], "field string, text string")
    lm, em = D.fit_languages(docs, docs.select(F.lit("q").alias("question"))), D.fit_ends(texts)
    assert D.refuses(D.fit_refusals(texts), "I cannot answer that.")
    assert D.other_language(lm, "Where did the old man live before?", "la casa vecchia sotto il ponte della città")
    key = em.words.end_key("answer", ["a"])
    assert em.p_end(spark.createDataFrame([(key,)], "end string")).first().p > 0


def test_keys_of_ends_hold_all_contexts(models):
    words = models[2].words
    for text in ("night", "the bells", "because the bells had already rung", ""):
        tokens = D.tokens_of(text)
        k = ["<s>", "<s>", *(D.word_class(words.words, t) for t in tokens)]
        if tokens:
            assert D.contexts_of(words.end_key("answer", tokens)) == D.contexts_at("answer", k, len(k) - 1)


@pytest.mark.parametrize(("reply", "want"), [
    ("The rules of the guild prevent smiths from selling.", False), ("No explanation was given by the queen, so the guards left.", False),
    ("as a way to apologise to Anna, who had never answered", False), ("because he would not say what he had seen", False),
    ("Leider kann ich dazu keine Auskunft geben.", True), ("Let us talk about something else.", True), ("My programming keeps me from discussing this.", True),
    ("Hmm. This request falls outside what I am allowed to do", True), ("no puedo hablar de eso, lo siento", True),
])
def test_refusals(models, reply, want):
    assert D.refuses(models[1], reply) == want
