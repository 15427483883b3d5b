"""The most similar window of two sentences for each of many quotes, blocks of quotes against blocks of sentences."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.embedding import DIMENSIONS
from lorekiln.plans.stage import spread

SENTENCES = 1024  # sentences a block
QUOTES = 256  # quotes a block
PARTS = 8  # parts of a group's sentences, so that a group of many texts is no task of its own
_END, _TOKEN = re.compile(r"[.!?]+"), re.compile(r"[a-z0-9]+")


@functools.lru_cache(1 << 18)
def _bucket(token: str) -> int:
    """``embedding.token_buckets`` of one token."""
    h = hashlib.md5(token.encode()).digest()[0]
    return (h >> 4) * 4 + h % 4


def _buckets(text: str) -> bytes:
    return bytes(map(_bucket, _TOKEN.findall(text)))


def _bags(buckets: list[bytes]) -> np.ndarray:
    """Count of each dimension, a row a text."""
    rows = np.repeat(np.arange(len(buckets)), list(map(len, buckets)))
    at = rows * DIMENSIONS + np.frombuffer(b"".join(buckets), np.uint8)
    return np.bincount(at, minlength=len(buckets) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float64)


def _sentence_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(book, no, buckets, texts): buckets of sentences, and how many sentences each text has, a block. A text of more
    than ``SENTENCES`` goes on in the next block from its last sentence here, so no window is lost."""
    for b in batches:
        out = []
        for (book, no), texts in b.groupby(["book", "no"])["text"]:
            buckets, sizes = [], []
            for text in texts:
                told = [_buckets(x) for x in _END.split(text) if x.strip(" ")]
                for k in range(0, max(len(told) - 1, 1) if told else 0, SENTENCES):
                    part = told[k : k + SENTENCES + 1]
                    buckets.extend(part)
                    sizes.append(len(part))
                    if len(buckets) >= SENTENCES:
                        out.append((book, no, buckets, sizes))
                        buckets, sizes = [], []
            if sizes:
                out.append((book, no, buckets, sizes))
        yield pd.DataFrame(out, columns=["book", "no", "buckets", "texts"])


def _windows(buckets: list[bytes], texts: list[int]) -> np.ndarray:
    """Bags of every two neighbours of a text; a text of one sentence is a window itself."""
    one, sizes = _bags(buckets), np.asarray(texts)
    last = np.cumsum(sizes) - 1
    first = np.delete(np.arange(len(one)), last)
    return np.concatenate([one[first] + one[first + 1], one[last[sizes == 1]]])


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for ids, quotes, buckets, texts in zip(b["ids"], b["quotes"], b["buckets"], b["texts"]):
            q, w = _bags(list(quotes)), _windows(list(buckets), texts)
            xx, yy = (q * q).sum(axis=1), (w * w).sum(axis=1)
            w, yy = w[yy > 0], yy[yy > 0]
            if len(w):
                at = (q @ (w / np.sqrt(yy)[:, None]).T).argmax(axis=1)
                dot, some = (q * w[at]).sum(axis=1), xx > 0
                yield pd.DataFrame({"id": np.asarray(ids)[some], "sim": dot[some] / np.sqrt(xx[some] * yy[at[some]])})


def best_windows(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(``key``, grounding): for each key the largest cosine, to six places, of the bags (``embedding.embed``) of any of
    its quotes and any window of two sentences of the texts of that quote's (book, no); 0 without one.

    ``quotes``: (``key``, quote, book, no); ``texts``: (text, book, no). Each text is split into tokens once and all
    products are exact; they are taken as products of matrices.
    """
    kind = quotes.schema[key].dataType.simpleString()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(quote=[_buckets(x) for x in b["quote"]])

    q = quotes.where("book is not null and no is not null").select(F.col(key).alias("id"), F.lower("quote").alias("quote"), "book", "no").distinct()
    n = q.groupBy("book", "no").agg(F.ceil(F.count("*") / QUOTES).alias("m"))
    q = q.mapInPandas(mark, f"id {kind}, quote binary, book string, no int").join(n, ["book", "no"])
    q = q.groupBy("book", "no", F.pmod(F.xxhash64("id", "quote"), F.col("m")).alias("chunk"))
    q = q.agg(F.collect_list("id").alias("ids"), F.collect_list("quote").alias("quotes"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    x = texts.where("text is not null and book is not null and no is not null").select(F.lower("text").alias("text"), "book", "no")
    x = spread(x).mapInPandas(_sentence_blocks, "book string, no int, buckets array<binary>, texts array<int>")
    x = x.withColumn("part", F.pmod(F.xxhash64("buckets"), F.lit(PARTS)).cast("int"))
    found = q.join(x, ["book", "no", "part"]).select("ids", "quotes", "buckets", "texts").mapInPandas(_best, f"id {kind}, sim double")
    every = quotes.select(F.col(key).alias("id"), F.lit(0.0).alias("sim")).unionByName(found)
    return every.groupBy(F.col("id").alias(key)).agg(F.round(F.max("sim"), 6).alias("grounding"))
