"""Column functions over question and answer texts (JVM-side but for the fuzzy ratio)."""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Keyword sets, phrases and names of the question classifiers.
PRIORITY_1 = ("what", "name", "who", "where", "when", "which", "how", "why")
PRIORITY_2 = ("be", "do", "can", "have", "would", "could", "should", "true", "false")
FACTUAL = ("what", "who", "which", "where", "when", "name")
EXPLANATORY = ("why",)
YES_NO = ("be", "do", "can", "is", "are", "was", "were", "did", "true", "false")
FACTUAL_HOW = ("how many", "how old", "how long", "how much")
MCQ_PHRASES = (
    "which of the following", "which of these", "which one of the following", "which one of these", "select the correct",
    "choose the best answer", "choose the one that", "identify the option that", "all of the following are",
    "which statement is true", "which statement is false", "who of the following", "who among the following",
)
MCQ_FORMAT = r"[:?]\s*.*,\s*.*\s*or\s*.*"
MONTHS = (
    "january", "jan", "february", "feb", "march", "mar", "april", "apr", "may", "june", "jun", "july", "jul", "august",
    "aug", "september", "sep", "october", "oct", "november", "nov", "december", "dec",
)
NUMBER_WORDS = (
    ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"),
    ("nine", "9"), ("ten", "10"), ("eleven", "11"), ("twelve", "12"), ("thirteen", "13"),
)


_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


def tokens(c: Column) -> Column:
    """Lower-case ASCII words and numbers in order; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>"))


def lemmas(t: Column, stop_words: tuple[str, ...] = (), forms: dict[str, str] | None = None) -> Column:
    """Tokens without stop words and single characters, forms replaced by their lemma where ``forms`` has one."""
    kept = F.filter(t, lambda x: (F.length(x) > 1) & ~x.isin(*stop_words)) if stop_words else F.filter(t, lambda x: F.length(x) > 1)
    if not forms:
        return kept
    known = F.create_map(*[F.lit(x) for p in forms.items() for x in p])
    return F.transform(kept, lambda x: F.coalesce(known[x], x))


def word_count(c: Column) -> Column:
    """Number of word runs; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[A-Za-z0-9_]+")), F.lit(0)).cast("long")


def clean_text(c: Column) -> Column:
    """Whitespace and ideographic spaces collapsed to one space, ends trimmed; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"[ \t\n\r\f\u000b　]+", " ")), F.lit(""))


def clean_input(c: Column) -> Column:
    """Lower case without ASCII punctuation, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""))


@F.pandas_udf(StringType())
def normalize_text(c: pd.Series) -> pd.Series:
    """NFKC, ends stripped of any white space, lower case; null and '' give null, white space alone gives ''."""
    return c.map(lambda x: unicodedata.normalize("NFKC", x).strip().lower() if x else None)


@F.pandas_udf(StringType())
def clean_input_text(c: pd.Series) -> pd.Series:
    """``clean_input`` for any characters: lower case without ASCII punctuation, ends stripped of any white space; null
    gives ''."""
    return c.map(lambda x: x.lower().translate(_NO_PUNCTUATION).strip() if x else "")


def standardize_option(c: Column) -> Column:
    """An answer option in lower case, without one closing mark and a leading conjunction."""
    t = F.regexp_replace(F.trim(F.lower(c)), '[?."]$', "")
    return F.trim(F.regexp_replace(t, "^(or|and) ", ""))


def strip_label(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\[[^\]]*\]|[A-Za-z]+): *", "")


def main_keyword(t: Column) -> Column:
    """First high-priority word of a token list, else first of the second rank, else the first token."""
    return F.coalesce(
        F.get(F.filter(t, lambda x: x.isin(*PRIORITY_1)), F.lit(0)),
        F.get(F.filter(t, lambda x: x.isin(*PRIORITY_2)), F.lit(0)),
        F.get(t, F.lit(0)),
        F.lit("unassigned"),
    )


def categorize(question: Column, keyword: Column) -> Column:
    """MCQ, FR, EX, YN or Other by opening phrase, list format, keyword and 'how' bigrams, in that order."""
    q = F.lower(question)
    opening = reduce(lambda a, b: a | b, (q.startswith(p) for p in MCQ_PHRASES))
    factual_how = reduce(lambda a, b: a | b, (q.contains(p) for p in FACTUAL_HOW))
    return (
        F.when(opening | q.rlike(MCQ_FORMAT), "MCQ")
        .when(keyword.isin(*FACTUAL), "FR")
        .when(keyword.isin(*EXPLANATORY), "EX")
        .when(keyword.isin(*YES_NO), "YN")
        .when((keyword == "how") & factual_how, "FR")
        .when(keyword == "how", "EX")
        .otherwise("Other")
    )


def answer_type(answer: Column) -> Column:
    """date, year, numeric or text by the look of an answer."""
    a = F.trim(F.lower(answer))
    month = r"\b(" + "|".join(MONTHS) + r")\b"
    return (
        F.when(a.rlike(month) & a.rlike("[0-9]"), "date")
        .when(a.rlike(r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$") | a.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(a.rlike(r"^(the year )?[0-9]{1,4} ?(ad|bc|bce|ce)?$") & (a.rlike("[a-z]") | a.rlike("^[0-9]{4}$")), "year")
        .when(a.rlike(r"^[0-9]+(st|nd|rd|th) century$"), "year")
        .when(~a.rlike("[a-z]") & a.rlike(r"^[0-9]+([.,][0-9]*)?$"), "numeric")
        .otherwise("text")
    )


def bc_indicator(c: Column) -> Column:
    return F.lower(c).rlike(r"\b(bc|bce|b\.c\.|b\.c\.e\.)(\b|$| )")


def normalize_numeric(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), ",", ""), "- +([0-9])", "-$1")


def single_number(c: Column) -> Column:
    """The only integer of a text, negative before the common era; null if there is none or several."""
    found = F.regexp_extract_all(normalize_numeric(c), F.lit("([0-9]+)"), 1)
    n = F.when(F.size(found) == 1, F.try_to_number(F.get(found, F.lit(0)), F.lit("999999999999")).cast("long"))
    return F.when(bc_indicator(c), -n).otherwise(n)


def digits_for_words(c: Column) -> Column:
    """Number words replaced by digits, whole words in any case, in order."""
    return reduce(lambda t, p: F.regexp_replace(t, rf"(?i)\b{p[0]}\b", p[1]), NUMBER_WORDS, c)


def master_id(kind: Column, question: Column, answer: Column) -> Column:
    """First 8 characters of the URL-safe base64 of an MD5 over type, question and answer."""
    text = F.concat_ws("_", F.coalesce(kind, F.lit("")), F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
    return F.substring(F.translate(F.base64(F.unhex(F.md5(text))), "+/", "-_"), 1, 8)


def ngrams(t: Column, n: int) -> Column:
    """Word n-grams of a token list, joined by spaces."""
    span = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(span, lambda i: F.concat_ws(" ", F.slice(t, i + 1, n)))


def distractors(options: Column, answer: Column) -> Column:
    """Options other than the answer, by trimmed lower case; null for null options."""
    return F.filter(options, lambda o: F.lower(F.trim(o)) != F.lower(F.trim(answer)))


def finish_gate(reason: Column, candidates: Column) -> Column:
    return F.when(reason == "SAFETY", "blocked").when(F.coalesce(candidates, F.lit(0)) == 0, "empty").otherwise("ok")


def tier_category(tier: Column) -> Column:
    """Resolution tier by name; the judge outranks similarity, that exact, that fuzzy matches."""
    t = F.lower(tier)
    return (
        F.when(t.contains("llm"), "llm")
        .when(t.contains("semantic") | t.contains("sbert"), "sbert")
        .when(t.contains("exact"), "exact")
        .when(t.contains("fuzzy"), "fuzzy")
        .otherwise("unresolved")
    )


def correlation_strength(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(r.isNull() | F.isnan(r), "Undefined").when(a < 0.2, "Very weak").when(a < 0.4, "Weak").when(a < 0.6, "Moderate")
        .when(a < 0.8, "Strong").otherwise("Very strong")
    )


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns as an aggregate; null below two rows or without variance."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def right_closed_bin(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (low, high] that holds a value; null outside."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((c > low) & (c <= high), label)
    return out


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the programme at a time as bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (m + n) over characters; 1 for two empty texts, null counts as empty."""
    out = []
    for x, y in zip(a, b):
        x, y = x or "", y or ""
        out.append(2.0 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0)
    return pd.Series(out, dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null where a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = (F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) for t in (a, b))
    return F.when((na > 0) & (nb > 0), dot / (na * nb))
