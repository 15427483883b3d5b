"""Texts as vectors: an interface for embedders and a deterministic default without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import questions as fq

DIMENSIONS = 64
_HEX = "0123456789abcdef"


def token_buckets(tokens: Column) -> Column:
    """The dimension (0 to 63) of each token, by its MD5."""
    digit = lambda t, i: F.instr(F.lit(_HEX), F.substring(F.md5(t), i, 1)) - 1
    return F.transform(tokens, lambda t: digit(t, 1) * 4 + F.pmod(digit(t, 2), F.lit(4)))


def embed(c: Column) -> Column:
    """Hashed bag of words: how many tokens of a text fall on each dimension."""
    buckets = token_buckets(fq.tokens(c))
    return F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of the bags of two texts to six places, straight from the buckets; 0 where one has no tokens."""
    x, y = token_buckets(fq.tokens(a)), token_buckets(fq.tokens(b))

    def common(p: Column, q: Column) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, v: s + F.size(F.filter(q, lambda w: w == v)))

    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, F.round(common(x, y) / F.sqrt(common(x, x) * common(y, y)), 6)).otherwise(0.0)


def embed_with(table: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """(``key``, embedding) by any model that takes a list of texts; null texts count as ''. A model that returns another
    number of vectors than it got texts stops the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = [t or "" for t in b[text]], []
            for k in range(0, len(texts), batch):
                out.extend(model(texts[k : k + batch]))
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
            yield pd.DataFrame({key: b[key], "embedding": [[float(x) for x in v] for v in out]})

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")
