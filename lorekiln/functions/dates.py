"""Dates in free text, within a list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that have names, replaced in this order.
HOLIDAYS = (
    ("halloween", "october 31"), ("valentines day", "february 14"), ("valentine's day", "february 14"), ("christmas", "december 25"),
    ("christmas eve", "december 24"), ("new years eve", "december 31"), ("new year's eve", "december 31"),
)
#: Fixed value: an ordinal's ending behind its number.
ORDINAL = r"([0-9])(st|nd|rd|th|rst)\b"
STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = (
    "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
)
#: (pattern, group of the day, of the month, of the year, whether the month is a name); 0 for none. The first that is found counts.
FORMATS = (
    (r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", 3, 2, 1, False),
    (r"\b([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})\b", 2, 1, 3, False),
    (rf"\b([0-9]{{1,2}}) (?:of )?{MONTH},? ([0-9]{{3,4}})\b", 1, 2, 3, True),
    (rf"\b{MONTH} ([0-9]{{1,2}}),? ([0-9]{{3,4}})\b", 2, 1, 3, True),
    (rf"\b([0-9]{{1,2}}) (?:of )?{MONTH}\b", 1, 2, 0, True),
    (rf"\b{MONTH} ([0-9]{{1,2}})\b", 2, 1, 0, True),
    (rf"\b{MONTH},? ([0-9]{{3,4}})\b", 0, 1, 2, True),
    (r"\b(?:in|year) ([0-9]{3,4})\b", 0, 0, 1, False),
    (r"^([0-9]{3,4}) ?(?:ad|ce)?$", 0, 0, 1, False),
)


def normalize_date_text(c: Column) -> Column:
    """Lower case and trimmed, without asides in brackets and endings of ordinals, days with names as dates."""
    t = F.regexp_replace(F.trim(F.lower(c)), r"\(.*?\)", "")
    t = F.regexp_replace(t, ORDINAL, "$1")
    for name, date in HOLIDAYS:
        t = F.replace(t, F.lit(name), F.lit(date))
    return t


def date_entities(c: Column) -> Column:
    """struct(day, month, year) of the first date of a text, null parts where it names none; null without a date, and
    where day or month cannot be one."""
    # bound to a name, so that the text is made once and not once a format
    return F.get(F.transform(F.array(normalize_date_text(c)), _parts), F.lit(0))


def _parts(t: Column) -> Column:
    none = F.lit(None).cast("struct<day:int,month:int,year:int>")
    out = F.when(F.lit(False), none)

    def part(pattern: str, group: int, name: bool = False) -> Column:
        if not group:
            return F.lit(None).cast("int")
        x = F.regexp_extract(t, pattern, group)
        return ((F.instr(F.lit(STARTS), F.substring(x, 1, 3)) + 2) / 3).cast("int") if name else x.try_cast("int")

    for pattern, day, month, year, name in FORMATS:
        found = F.struct(part(pattern, day).alias("day"), part(pattern, month, name).alias("month"), part(pattern, year).alias("year"))
        out = out.when(t.rlike(pattern), found)
    out = F.array(out.otherwise(none))
    fits = lambda e: F.coalesce(e["day"], F.lit(1)).between(1, 31) & F.coalesce(e["month"], F.lit(1)).between(1, 12)
    return F.get(F.filter(out, fits), F.lit(0))


def evaluate_date(player: Column, gold: Column) -> Column:
    """Tier of a date answer: all three parts equal, missing ones included."""
    return F.get(F.transform(F.array(F.struct(date_entities(player).alias("p"), date_entities(gold).alias("g"))), _tier), F.lit(0))


def _tier(x: Column) -> Column:
    p, g = x["p"], x["g"]
    same = p["day"].eqNullSafe(g["day"]) & p["month"].eqNullSafe(g["month"]) & p["year"].eqNullSafe(g["year"])
    return (
        F.when(g.isNull(), "date_exact_fail_invalid_gold").when(p.isNull(), "date_exact_fail_invalid_player_ans")
        .when(same, "date_exact_pass").otherwise("date_exact_fail")
    )
