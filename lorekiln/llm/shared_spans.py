"""Long exact spans shared between records, by a count-min prefilter and an exact second pass.

Every window of ``length`` characters has an anchor: of its stretches of half that length, the one of smallest hash, the
leftmost if several. Equal windows have equal anchors at equal places, so a window stands in two records only if its
anchor does. First pass: each partition counts its records by anchor in a count-min sketch; the sketches are merged. An
estimate is never below the true count, so a window whose anchor is estimated below two stands in one record only.
Second pass: neighbouring windows of one anchor travel as one run, as the text they span, to where all runs of that
anchor meet; there every window is held exactly against the others. Anchors that the sketch counts as very frequent are
salted by record, and what a salted part cannot settle alone is settled by partial aggregation. Nothing is paired.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages

DEPTH = 2
MAX_CELLS = 2**28  # cells of a sketch row that is sent to the workers, at most: 64 MB in all, at one bit a cell
HEAVY = 255  # records from which on an anchor is salted; where the counters end
SALT_RECORDS = 50_000  # records a salted part of a frequent anchor
_BLOCK = 2**20
_CHARS = 1 << 20  # characters that are hashed at once
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)  # odd, hence invertible modulo 2**64
_SALTS = (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Joined:
    """Texts laid end to end, with rolling hashes of all their windows at once; power tables grow with the longest."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, texts: list[str]):
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    @classmethod
    def _power(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls._tables or len(cls._tables[which][0]) < n:
            m, b = max(2 * _CHARS, n), _BASES[which]
            cls._tables[which] = _powers(b, m), _powers(pow(b, -1, 2**64), m)
        up, down = cls._tables[which]
        return up[:n], down[:n]

    def hashes(self, k: int, which: int) -> np.ndarray:
        """Hash of the ``k`` characters from every place on, also across the ends of texts (see ``inside``)."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = self._power(which, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(self.code + np.uint64(_SALTS[which])) * up[:n], out=total[1:])
        return _mix((total[k:] - total[:-k]) * down[: n - k + 1])

    def inside(self, k: int) -> np.ndarray:
        """Whether the ``k`` characters from a place on lie in one text."""
        n = len(self.code)
        mark = np.zeros(n + 1, np.int32)
        some = self.sizes >= k
        np.add.at(mark, self.starts[some], 1)
        np.add.at(mark, self.starts[some] + self.sizes[some] - k + 1, -1)
        return np.cumsum(mark[: max(0, n - k + 1)]) > 0


def anchored_runs(j: Joined, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: (first, end) window places in ``j`` and the anchor's hash."""
    k = max(1, length // 2)
    w = length - k + 1
    ok = j.inside(length)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = j.hashes(k, 0)
    bits = np.uint64(max(24, int(len(h)).bit_length()))
    # the order of the anchors: a hash's high bits, then the place
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(ok)
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    place = np.where(ok, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), -1)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, end = np.r_[0, cut], np.r_[cut, n]
    real = place[first] >= 0
    first, end = first[real], end[real]
    return first, end, h[place[first]]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``_CHARS`` characters, at least one text each."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= _CHARS:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def record_anchors(texts: list[str], length: int) -> Iterator[tuple[Joined, int, tuple, np.ndarray]]:
    """For every slice of ``texts``: the joined texts, the number of the first, the runs, and the text of each run."""
    for lo, hi in slices(texts):
        j = Joined(texts[lo:hi])
        runs = anchored_runs(j, length)
        yield j, lo, runs, np.searchsorted(j.starts, runs[0], "right") - 1


def cells_of(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * odd) >> np.uint64(64 - bits)).astype(np.int64) for odd in _ODD]


class Sketch:
    """What is asked of the merged sketch: bitmaps of the cells counted twice or more, and the cells that are full."""

    def __init__(self, bits: int):
        self.bits = bits
        self.twice = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
        self.full: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]

    def take(self, depth: int, at: int, counters: np.ndarray) -> None:
        some = np.packbits(counters >= 2, bitorder="little")
        self.twice[depth][at // 8 : at // 8 + len(some)] = some
        self.full[depth].append(at + np.flatnonzero(counters >= HEAVY))

    def close(self) -> Sketch:
        self.full = [np.sort(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in self.full]
        return self

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """False where the estimate is below two."""
        out = np.ones(len(h), bool)
        for bitmap, at in zip(self.twice, cells_of(h, self.bits)):
            out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def heavy(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for full, at in zip(self.full, cells_of(h, self.bits)):
            out &= np.isin(at, full)
        return out


def anchor_sketch(texts: DataFrame, text: str, length: int, bits: int) -> Sketch:
    """Count-min sketch of the records by anchor: a sketch a partition, merged block by block."""
    block = min(_BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(1 << bits, np.uint8) for _ in range(DEPTH)]
        held: list[np.ndarray] = []

        def add() -> None:
            h = np.concatenate(held)
            for row, at in zip(rows, cells_of(h, bits)):
                where, times = np.unique(at, return_counts=True)
                row[where] = np.minimum(HEAVY, row[where].astype(np.int64) + times)
            held.clear()

        for b in batches:
            for _, _, (_, _, anchor), owner in record_anchors(b.column(0).to_pylist(), length):
                order = np.lexsort((owner, anchor))
                a, o = anchor[order], owner[order]
                held.append(a[np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])][: len(a)]])  # once a record
                if sum(map(len, held)) > 1_000_000:
                    add()
        if held:
            add()
        out: dict[str, list] = {"depth": [], "block": [], "data": []}
        for d, row in enumerate(rows):
            for k in range(0, len(row), block):
                part = row[k : k + block]
                if part.any():
                    for name, x in zip(out, (d, k // block, zlib.compress(part.tobytes(), 1))):
                        out[name].append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["depth"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["data"], pa.binary())], list(out)
        )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for data in pdf["data"]:
            total += np.frombuffer(zlib.decompress(data), np.uint8)
        data = zlib.compress(np.minimum(HEAVY, total).astype(np.uint8).tobytes(), 1)
        return pd.DataFrame({"depth": pdf["depth"].iloc[:1], "block": pdf["block"].iloc[:1], "data": [data]})

    shape = "depth int, block int, data binary"
    merged = texts.select(text).mapInArrow(count, shape).groupBy("depth", "block").applyInPandas(merge, shape)
    sketch = Sketch(bits)
    for r in merged.toLocalIterator():  # a block at a time, MAX_CELLS bounds what is kept
        sketch.take(r.depth, r.block * block, np.frombuffer(zlib.decompress(r.data), np.uint8))
    return sketch.close()


_RUN = "a long, salt int, r long, q long, p long, at int, text string"
_MARK = "r long, at int, n int, h1 long, h2 long, q long, p long"


def window_runs(rows: DataFrame, sent, length: int, salts: int) -> DataFrame:
    """The runs whose anchor may be repeated. ``rows``: (r, q, p, text, keep); ``keep`` null or the anchors to take."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for b in batches:
            r, q, p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts, keep = b.column(3).to_pylist(), b.column(4).to_pylist()
            for j, lo, (first, end, anchor), owner in record_anchors(texts, length):
                some = sketch.repeated(anchor)
                mine = keep[lo : lo + len(j.sizes)]
                if mine and mine[0] is not None:
                    for i in np.unique(owner):
                        at = owner == i
                        some[at] &= np.isin(anchor[at].view(np.int64), np.array(mine[i], np.int64))
                first, end, anchor, owner = first[some], end[some], anchor[some], owner[some]
                if not len(first):
                    continue
                at = first - j.starts[owner]
                row = lo + owner
                salt = np.where(sketch.heavy(anchor), (_mix(r[row].view(np.uint64)) % np.uint64(salts)).astype(np.int64) + 1, 0)
                spans = [texts[k][x : x + n] for k, x, n in zip(row.tolist(), at.tolist(), (end - first + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(r[row]), pa.array(q[row]), pa.array(p[row]),
                     pa.array(at.astype(np.int32)), pa.array(spans)],
                    ["a", "salt", "r", "q", "p", "at", "text"],
                )

    return rows.select("r", "q", "p", "text", "keep").mapInArrow(emit, _RUN)


def settle(runs: DataFrame, length: int) -> DataFrame:
    """Marks of the windows that runs of one anchor share: (r, at, n) for n neighbouring windows from ``at`` on. For
    salted runs also what is open: single windows by hash (n 0) that only one record of the salted part has, and one
    witness (r null) of each window that is shared there."""

    def shared_windows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = t.column("text").to_pylist()
        r, q, p, at, salt = (t.column(c).to_numpy() for c in ("r", "q", "p", "at", "salt"))
        j = Joined(texts)
        ok = np.flatnonzero(j.inside(length))
        h1, h2 = (j.hashes(length, d)[ok] for d in (0, 1))
        row = np.searchsorted(j.starts, ok, "right") - 1
        place = at[row] + (ok - j.starts[row])
        order = np.lexsort((h2, h1))
        new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
        begin = np.flatnonzero(new)
        both = np.zeros(len(begin), bool)
        for x in (q, p):
            v = x[row][order]
            both |= np.minimum.reduceat(v, begin) != np.maximum.reduceat(v, begin)
        shared = np.zeros(len(order), bool)
        shared[order] = np.repeat(both, np.diff(np.r_[begin, len(order)]))
        kind = np.where(shared, row, -1)
        cut = np.flatnonzero((kind[1:] != kind[:-1])) + 1
        first, end = np.r_[0, cut], np.r_[cut, len(kind)]
        real = kind[first] >= 0
        first, end = first[real], end[real]
        none = pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(r[row[first]]), pa.array(place[first].astype(np.int32)), pa.array((end - first).astype(np.int32)), none, none, none, none],
            ["r", "at", "n", "h1", "h2", "q", "p"],
        )
        salted = salt[row] > 0
        open_ = np.flatnonzero(salted & ~shared)
        seen = order[begin[both]]
        seen = seen[salted[seen]]
        for which, named in ((open_, True), (seen, False)):
            if len(which):
                mine = row[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r[mine]) if named else pa.nulls(len(which), pa.int64()), pa.array(place[which].astype(np.int32)),
                     pa.array(np.zeros(len(which), np.int32)), pa.array(h1[which].view(np.int64)), pa.array(h2[which].view(np.int64)),
                     pa.array(q[mine]), pa.array(p[mine])],
                    ["r", "at", "n", "h1", "h2", "q", "p"],
                )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs; those of one anchor and salt are settled together, many anchors at once."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows < 16_000:
                continue
            t = pa.Table.from_batches(held)
            a, s = t.column("a").to_numpy(), t.column("salt").to_numpy()
            last = int(np.flatnonzero((a != a[-1]) | (s != s[-1]))[-1]) + 1 if (a[0], s[0]) != (a[-1], s[-1]) else 0
            if last:
                yield from shared_windows(t.slice(0, last))
            held = t.slice(last).to_batches()
            rows = t.num_rows - last
        if rows:
            yield from shared_windows(pa.Table.from_batches(held))

    parts = runs.repartition("a", "salt").sortWithinPartitions("a", "salt")
    return parts.mapInArrow(exact, _MARK)


def shared_spans(records: DataFrame, record_id: str = "temp_qid", text: str = "source_quote", length: int = 100) -> DataFrame:
    """(``record_id``, shared_chars): characters that lie in a stretch of at least ``length`` characters found verbatim
    in a text of another record; only records with more than none, each once.

    Characters are Unicode code points. Rows with a null id or text, and texts shorter than ``length``, share nothing;
    a text delivered twice under one id is one text; several texts of one id do not share with each other, and their
    shared characters are summed. Windows and ids are told apart by 128 bits each. Other columns are not read. Empty
    tables: an empty result.

    The sketch grows with the number of anchors up to ``MAX_CELLS``. Beyond, it lets more anchors through, and those are
    counted exactly, by partial aggregation, before any text travels.
    """
    spark = records.sparkSession
    work = Stages(spark, "spans")
    rows = records.where(F.col(record_id).isNotNull() & (F.char_length(text) >= length))
    rows = rows.select(F.col(record_id).alias("id"), F.col(text).alias("text")).distinct()
    marked = [F.monotonically_increasing_id().alias("r"), F.xxhash64("id").alias("q"), F.xxhash64(F.lit("p"), "id").alias("p")]
    rows = work.put(rows.select(*marked, "id", "text"), "texts")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.char_length("text") - (length - 1)).alias("w")).first()
    anchors = 1 + 2 * int(total.w or 0) // (length - length // 2 + 2)
    wanted = max(12, (2 * anchors).bit_length())
    bits = min(wanted, MAX_CELLS.bit_length() - 1)
    sent = spark.sparkContext.broadcast(anchor_sketch(rows, "text", length, bits))  # MAX_CELLS
    salts = max(8, math.ceil(total.n / SALT_RECORDS))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for b in batches:
            r = b.column(0).to_numpy(zero_copy_only=False)
            for _, lo, (_, _, anchor), owner in record_anchors(b.column(1).to_pylist(), length):
                some = sketch.repeated(anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[some].view(np.int64)), pa.array(r[lo + owner[some]])], ["a", "r"])

    if bits == wanted:
        asked = rows.withColumn("keep", F.lit(None).cast("array<long>"))
    else:
        found = work.put(rows.select("r", "text").mapInArrow(listed, "a long, r long"), "anchors")
        twice = found.groupBy("a").agg(F.min("r").alias("x"), F.max("r").alias("y")).where("x <> y").select("a")
        kept = found.join(twice, "a").groupBy("r").agg(F.collect_set("a").alias("keep"))  # as many as a text has
        asked = rows.join(kept, "r")
    marks = work.put(settle(window_runs(asked, sent, length, salts), length), "marks")
    left = marks.where("n = 0")
    both = (F.min("q") != F.max("q")) | (F.min("p") != F.max("p"))
    more = left.groupBy("h1", "h2").agg(both.alias("both")).where("both").select("h1", "h2")
    late = left.where("r is not null").join(more, ["h1", "h2"], "left_semi").select("r", "at", F.lit(1).alias("n"))
    each = marks.where("n > 0").select("r", "at", "n").unionByName(late)
    # runs of a text do not overlap, so their ends rise with their beginnings
    end = F.col("at") + F.col("n") + (length - 1)
    before = F.lag(end).over(Window.partitionBy("r").orderBy("at"))
    span = F.least(end - F.col("at"), F.coalesce(end - before, end - F.col("at")))
    cover = each.select("r", span.alias("chars")).groupBy("r").agg(F.sum("chars").alias("chars"))
    named = cover.join(rows.select("r", F.col("id").alias(record_id)), "r")
    return named.groupBy(record_id).agg(F.sum("chars").alias("shared_chars"))
