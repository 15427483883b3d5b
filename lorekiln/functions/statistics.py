"""Significance of a correlation and readability of a text (Arrow functions)."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by the t distribution; None below three pairs or without one."""
    if r is None or r != r or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_share((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(None if pd.isna(x) else float(x), int(k)) for x, k in zip(r, n)], dtype="float64")


def interpretation(strength: Column, p: Column, alpha: float = 0.05) -> Column:
    """What a correlation says: its strength, and whether chance explains it."""
    sure = F.when(p.isNull() | F.isnan(p), "Not enough data").when(p < alpha, "Statistically significant").otherwise("Not statistically significant")
    return F.concat(sure, F.lit(" ("), F.lower(strength), F.lit(")"))


def syllables(word: str) -> int:
    """Groups of vowels, a silent e at the end aside; at least one."""
    n = len(re.findall(r"[aeiouy]+", word))
    if word.endswith("e") and not word.endswith(("le", "ee")) and n > 1:
        n -= 1
    return max(1, n)


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in ("flesch", "kincaid", "fog", "smog")]))
def readability(texts: pd.Series) -> pd.DataFrame:
    """Flesch ease, Flesch-Kincaid grade, Gunning fog and SMOG of each text; null without words."""
    out = []
    for t in texts:
        words = re.findall(r"[a-z']*[a-z]", (t or "").lower())
        if not words:
            out.append((None,) * 4)
            continue
        parts = max(1, len(re.findall(r"[.!?]+", t)))
        counts = [syllables(w) for w in words]
        long, n = sum(c > 2 for c in counts), len(words)
        per, beat = n / parts, sum(counts) / n
        out.append((206.835 - 1.015 * per - 84.6 * beat, 0.39 * per + 11.8 * beat - 15.59, 0.4 * (per + 100 * long / n), 1.043 * math.sqrt(long * 30 / parts) + 3.1291))
    return pd.DataFrame(out, columns=["flesch", "kincaid", "fog", "smog"], dtype="float64")
