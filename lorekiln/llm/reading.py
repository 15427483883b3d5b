"""Reading level of documents: interpolated n-gram models per level, surprisal over the whole document, isotonic map.

For each known level an interpolated word n-gram model (orders 3, 2, 1 and a uniform floor) is trained on the graded
passages. A document is cut into windows of ``WINDOW`` words; each window's surprisal under every level's model gives
the window's posterior over levels, and the distribution of these over the document its expected level. That score is
mapped to the graded scale by isotonic regression, fitted on passages scored by models that had not seen them.

Full stops play no part (they are lost or misleading in places); words carry the evidence. Names and other words that
occur in a single passage share one class, as they say nothing of the level.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 16
FOLDS = 6
PASSAGES_PER_LEVEL = 1_000  # graded passages a level that the models are fitted on
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
_ASIDE = re.compile(r"\([^()]{0,80}\)")
_DIRT = re.compile("[­​-‏⁠﻿]")


def words_of(text: str) -> list[str]:
    """Lower-case words of a text without soft hyphens, invisible signs and short asides in brackets."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _DIRT.sub("", text)).replace("’", "'")
    if "(" in text:
        text = _ASIDE.sub(" ", text)
    return _WORD.findall(text.lower())


class LevelModels:
    """Interpolated trigram, bigram and unigram models of all levels over one vocabulary.

    Probabilities are laid out as sorted n-gram keys with one row of level-wise terms; a word's probability at a level
    is the sum of its terms, so a whole batch is scored by three look-ups in sorted arrays."""

    WEIGHTS = (0.35, 0.3, 0.3, 0.05)  # trigram, bigram, unigram, uniform

    def __init__(self, passages: list[list[str]], levels: list[int]):
        self.levels = sorted(set(levels))
        seen = Counter(w for p in passages for w in set(p))
        kept = sorted(w for w, n in seen.items() if n > 1)
        self.vocabulary = {w: i + 2 for i, w in enumerate(kept)}  # 0: before the text, 1: the class of rare words
        self.size = len(kept) + 2
        grams: list[dict[int, np.ndarray]] = [{}, {}, {}]
        width = len(self.levels)
        counts: list[list[Counter]] = [[Counter() for _ in self.levels] for _ in range(3)]
        for p, level in zip(passages, levels):
            k = self.levels.index(level)
            ids = self.ids(p)
            u = np.concatenate([[0, 0], ids])
            for keys, c in zip(self.keys(u), counts):
                c[k].update(keys.tolist())
        total = [max(1, sum(c.values())) for c in counts[0]]
        for order, by_level in enumerate(counts):
            weight = self.WEIGHTS[2 - order]
            for k, c in enumerate(by_level):
                if order == 0:
                    for key, n in c.items():
                        grams[0].setdefault(key, np.zeros(width))[k] = weight * n / total[k]
                    continue
                context: Counter = Counter()
                for key, n in c.items():
                    context[key // self.size] += n
                for key, n in c.items():
                    # a context seen n times is believed the more, the larger n (plus a fixed count for the unseen)
                    grams[order].setdefault(key, np.zeros(width))[k] = weight * n / (context[key // self.size] + 1.0)
        self.tables = []
        for g in grams:
            keys = np.array(sorted(g), np.int64)
            rows = np.array([g[x] for x in keys.tolist()]) if len(keys) else np.zeros((0, width))
            self.tables.append((keys, rows))
        self.floor = self.WEIGHTS[3] / self.size

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 1) for w in words), np.int64, len(words))

    def keys(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unigram, bigram and trigram keys of every word of a padded sequence (two pads before it)."""
        a, b, c = u[:-2], u[1:-1], u[2:]
        return c, b * self.size + c, (a * self.size + b) * self.size + c

    def surprisal(self, u: np.ndarray) -> np.ndarray:
        """Negative log probability of each word (rows) at each level (columns)."""
        p = np.full((len(u) - 2, len(self.levels)), self.floor)
        for keys, (known, rows) in zip(self.keys(u), self.tables):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                p[hit] += rows[at[hit]]
        return -np.log(p)

    def scores(self, documents: list[list[str]]) -> np.ndarray:
        """Expected level of each document over its windows; nan for a document without words."""
        out = np.full(len(documents), np.nan)
        lengths = [len(d) for d in documents]
        if not sum(lengths):
            return out
        u = np.zeros(sum(n + 2 for n in lengths), np.int64)
        real = np.zeros(len(u), bool)
        owner, window = [], []
        at = 0
        for i, d in enumerate(documents):
            n = lengths[i]
            u[at + 2 : at + 2 + n] = self.ids(d)
            real[at + 2 : at + 2 + n] = True
            at += n + 2
        s = self.surprisal(np.concatenate([[0, 0], u]))
        rare = (u == 1)[real]
        s = s[real]
        s[rare] = 0  # no evidence either way
        first = 0
        w = 0
        for i, n in enumerate(lengths):
            if n:
                k = max(1, n // WINDOW)
                window.append(first + (np.arange(k) * n) // k)
                owner.append(np.full(k, i))
                w += k
            first += n
        starts, owner_of = np.concatenate(window), np.concatenate(owner)
        total = np.add.reduceat(s, starts, axis=0)
        weight = np.diff(np.append(starts, len(s)))
        z = np.exp(total.min(axis=1, keepdims=True) - total)
        expected = (z / z.sum(axis=1, keepdims=True)) @ np.array(self.levels, float)
        num = np.bincount(owner_of, weights=expected * weight, minlength=len(documents))
        den = np.bincount(owner_of, weights=weight, minlength=len(documents))
        some = den > 0
        out[some] = num[some] / den[some]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators: (knots, values) for ``np.interp``."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order].astype(float)
    value: list[float] = []
    weight: list[float] = []
    for v in y:
        value.append(float(v))
        weight.append(1.0)
        while len(value) > 1 and value[-2] >= value[-1]:
            w = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / w]
            weight[-2:] = [w]
    return x, np.repeat(value, np.array(weight, int))


class ReadingScale:
    """Models of all levels and the isotonic map from score to level."""

    def __init__(self, texts: list[str], levels: list[int]):
        passages = [words_of(t) for t in texts]
        self.models = LevelModels(passages, levels)
        held = np.zeros(len(texts))
        for fold in range(FOLDS):
            out = [i for i in range(len(texts)) if i % FOLDS == fold]
            rest = [i for i in range(len(texts)) if i % FOLDS != fold]
            if out and rest:
                m = LevelModels([passages[i] for i in rest], [levels[i] for i in rest])
                held[out] = m.scores([passages[i] for i in out])
        good = ~np.isnan(held)
        self.held_out = held
        self.knots, self.values = isotonic(held[good], np.array(levels)[good])

    def level(self, score: np.ndarray) -> np.ndarray:
        got = np.interp(np.nan_to_num(score, nan=1.0), self.knots, self.values)
        return np.clip(np.rint(got), self.models.levels[0], self.models.levels[-1]).astype(np.int64)


def fit_scale(passages: DataFrame, text: str = "text", level: str = "reading_level", key: str = "passage_id") -> ReadingScale:
    """Fit on at most ``PASSAGES_PER_LEVEL`` graded passages of each level, the ones of smallest hash, so that no level
    is left out however many passages the others have; rows without text or level are left out."""
    rows = passages.where(F.col(text).isNotNull() & F.col(level).isNotNull()).select(key, text, level)
    lot = F.row_number().over(Window.partitionBy(level).orderBy(F.xxhash64(text, F.col(key)), key, text))
    rows = rows.withColumn("lot", lot).where(F.col("lot") <= PASSAGES_PER_LEVEL).orderBy(level, key, text).collect()
    if not rows:
        raise ValueError("no graded passages to learn from")
    return ReadingScale([r[text] for r in rows], [int(r[level]) for r in rows])


def reading_levels(
    documents: DataFrame, scale: ReadingScale, doc_id: str = "doc_id", text: str = "text", where: Column | None = None,
    min_words: int = 40,
) -> DataFrame:
    """(``doc_id``, reading_level BIGINT, score DOUBLE) of the documents of ``where`` with at least ``min_words`` words.

    Words for the limit are separated by white space (of any Unicode kind). Null and empty texts have no words;
    repeated rows are graded each; other columns are not read. Whole texts are scored, however long.
    """
    rows = documents if where is None else documents.where(where)
    sent = documents.sparkSession.sparkContext.broadcast(scale)  # bounded by PASSAGES_PER_LEVEL

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(1).to_pylist()
                long = [i for i, t in enumerate(texts) if t and len(t.split()) >= min_words]
                score = s.models.scores([words_of(texts[i]) for i in long])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(long, pa.int64())), pa.array(s.level(score)), pa.array(score)],
                    ["id", "reading_level", "score"],
                )

    kind = documents.schema[doc_id].dataType.simpleString()
    out = rows.select(doc_id, text).mapInArrow(grade, f"id {kind}, reading_level long, score double")
    return out.withColumnRenamed("id", doc_id)
