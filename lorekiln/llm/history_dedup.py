"""New batches against all history: bit-difference fingerprints in rotated block tables.

A row asks for something (its question's kind: who, when, how many, ...) about one sentence of its quote. The words of
the question, as they stand, in the spelling of that sentence and as far as that sentence has them, and each of these
less any one word are the views of that fact: reworded, mistyped, cut and extended questions differ in most of their words' signs but share a view. Each view
gives a 64-bit fingerprint whose bits differ in few places where the words differ little (similarity hashing of character
trigrams). Rotations of the fingerprints form block tables, keyed by kind and leading bits; rows that share a block are
candidates, verified by bit distance and then by text. New facts are appended to the tables in runs, so a batch touches
of history the blocks it shares and the texts of its candidates, nothing else.

Keys are of one width at every size, so what is found does not depend on how much is stored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages

ROTATIONS = (0, 32)
BLOCK_BITS = 32  # leading bits that a rotation looks at; of fingerprints MAX_DISTANCE apart, one half differs in one bit at most
SPARED = (0, 8, 16, 24)  # each table leaves one byte of them out, so that bit may be anywhere
MAX_DISTANCE = 3
PAIR_BLOCK = 64  # rows of a block that are compared pair by pair; of larger ones first all with the earliest
CHUNKS = 32  # parts of a large block
PARTS = 64  # folders of a history's block table, by block
SAME = 0.75

#: Number words and words without content of their own.
NUMBERS = {
    w: i
    for i, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
        "eighteen nineteen twenty".split()
    )
} | {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
CUES = {
    "when": ("year", "when", "date"),
    "count": ("many", "number", "much"),
    "why": ("why", "reason", "made"),
    "where": ("where", "place", "location"),
    "who": ("who", "whom", "person", "whose"),
}
EMPTY_WORDS = frozenset(
    "the a an of in on at by to for and or was were is are did do does had has have that which what it its this name give "
    "one tell me quick story please according passage text exactly precisely so just question answer asked know how".split()
)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»“)]*\s+|\.{3,}|…)")


def _plain(t: str | None) -> str:
    if not t:
        return ""
    t = unicodedata.normalize("NFKC", t)
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) if not t.isascii() else t


def stem(w: str) -> str:
    """A crude stem: verb and plural endings off, so that asked and told forms meet."""
    for end in ("ing", "ied", "ies", "ed", "es", "s", "d", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def near(a: str, b: str) -> bool:
    """Equal up to slips: one edit in short words, two in longer ones (neighbours swapped count as one)."""
    if a == b:
        return True
    most = 0 if min(len(a), len(b)) < 3 else 1 if max(len(a), len(b)) < 6 else 2
    if abs(len(a) - len(b)) > most:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        rows.append(row)
    return rows[-1][-1] <= most


def asked_kind(words: list[str]) -> str:
    """What a question asks for, by its cue words; slips are forgiven where no cue is spelled right."""
    for kind, cues in CUES.items():
        if any(c in words for c in cues):
            return kind
    for kind, cues in CUES.items():
        if any(len(c) > 3 and near(c, w) for c in cues for w in words):
            return kind
    return "other"


def content(words: list[str]) -> list[str]:
    cues = {c for cs in CUES.values() for c in cs}
    return [stem(w) for w in words if w not in EMPTY_WORDS and w not in cues and w not in NUMBERS and not w.isdigit()]


def numbers(words: list[str]) -> list[int]:
    return sorted({int(w) if w.isdigit() else NUMBERS[w] for w in words if w in NUMBERS or (w.isdigit() and len(w) < 10 and w.isascii())})


def overlap(a: list[str], b: list[str]) -> float:
    """Letters of ``a`` in words that ``b`` has too (up to slips), as a share."""
    total = sum(map(len, a))
    if not total:
        return 0.0
    exact = set(b)
    return sum(len(w) for w in a if w in exact or any(near(w, x) for x in b)) / total


_BITS = np.arange(64, dtype=np.uint64)


@functools.lru_cache(1 << 18)
def word_signs(w: str) -> np.ndarray:
    """Sum of the signs that the trigrams of a word give to each of 64 bits."""
    w = f"^{w}$"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    h = np.array([zlib.crc32(g.encode()) | zlib.crc32(b"~" + g.encode(), 7) << 32 for g in grams], np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (((h[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) * 2 - 1).sum(axis=0)


def view_prints(sets: list[list[str]]) -> list[list[int]]:
    """Fingerprints of the views of each set of words: all of it, and where three words or more, all but one."""
    words = [list(dict.fromkeys(s)) for s in sets]
    size = np.fromiter(map(len, words), np.int64, len(words))
    if not size.sum():
        return [[] for _ in sets]
    signs = np.stack([word_signs(w) for ws in words for w in ws])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(words)), size)
    total = np.zeros((len(words), 64), np.int64)
    np.add.at(total, owner, signs)
    less = total[owner] - signs
    full, part = (np.packbits(v > 0, axis=1, bitorder="little").view(np.int64)[:, 0].tolist() for v in (total, less))
    return [
        [full[i], *(part[at : at + n] if n > 2 else [])] if n else [] for i, (at, n) in enumerate(zip(starts.tolist(), size.tolist()))
    ]


def simhash(words: list[str]) -> int:
    """64-bit fingerprint of a set of words; 0 for none."""
    got = view_prints([words])[0]
    return got[0] if got else 0


def fact_of(question: str | None, quote: str | None) -> tuple[str, list[str], list[str], list[str], list[int], list[str]]:
    """(kind, content of the question, what of it the sentence it points at has, in that sentence's spelling, content
    of that sentence, its numbers, all content of the question with the sentence's spelling where it has one)."""
    words = _WORD.findall(_plain(question).lower())
    asked = content(words)
    best: tuple[float, list[str]] = (0.0, [])
    for s in _SENTENCE.split(_plain(quote)):
        told = _WORD.findall(s.lower())
        if not told:
            continue
        have = {stem(w) for w in told}
        exact = sum(len(w) for w in asked if w in have)
        if exact > best[0] or not best[1]:
            best = (exact, told)
    told = best[1]
    tell = content(told)
    # what the question shares with its sentence, in the sentence's spelling: slips and fillers of the question go,
    # slips of the sentence come; one of the two is mostly clean
    shared, spelt = [], []
    for w in asked:
        found = [w] if w in tell else [x for x in tell if near(w, x)][:1]
        shared.extend(found)
        spelt.extend(found or [w])
    shared = list(dict.fromkeys(shared))
    return asked_kind(words), asked, shared if len(shared) > 2 else asked, tell, numbers(told), spelt


SHAPE = "kind string, asked array<string>, shared array<string>, told array<string>, nums array<int>, prints array<long>"


def fingerprints(rows: DataFrame, row_id: str, batch: str, question: str, quote: str) -> DataFrame:
    """One row each: id, batch, the fact of ``fact_of`` and the fingerprints of its views. Questions without content
    are left out."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            facts = [fact_of(q, s) for q, s in zip(b["q"], b["s"])]
            keep = [i for i, f in enumerate(facts) if f[1]]
            if keep:
                out = pd.DataFrame([facts[i][:5] for i in keep], columns=["kind", "asked", "shared", "told", "nums"])
                views = [view_prints([facts[i][k] for i in keep]) for k in (1, 2, 5)]
                out["prints"] = [sorted(set().union(*x)) for x in zip(*views)]
                out.insert(0, "id", b["id"].to_numpy()[keep])
                out.insert(1, "batch", b["batch"].to_numpy()[keep])
                yield out

    ids, no = (rows.schema[c].dataType.simpleString() for c in (row_id, batch))
    src = rows.where(F.col(row_id).isNotNull() & F.col(batch).isNotNull()).select(
        F.col(row_id).alias("id"), F.col(batch).alias("batch"), F.col(question).alias("q"), F.col(quote).alias("s")
    )
    return src.mapInPandas(mark, f"id {ids}, batch {no}, {SHAPE}")


def block_rows(prints: DataFrame) -> DataFrame:
    """(block, at, f): the fingerprints of all views in every table, so that any view of one row may meet any of another.
    A block is named by rotation, byte left out, kind and the other leading bits: of two fingerprints up to
    ``MAX_DISTANCE`` = 3 bits apart one half differs in one bit or none, and the table without that bit's byte holds both
    in one block. ``at`` is (batch, id), the order of rows."""
    each = prints.select(F.struct("batch", "id").alias("at"), "kind", F.explode("prints").alias("f"))

    def lead(r: int, spared: int) -> Column:
        f = F.col("f")
        turned = f if r == 0 else F.shiftleft(f, r).bitwiseOR(F.shiftrightunsigned(f, 64 - r))
        kept = F.shiftrightunsigned(turned, 64 - BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1 ^ 0xFF << spared))
        return F.xxhash64(F.lit(r), F.lit(spared), "kind", kept)

    return each.select(F.explode(F.array(*[lead(r, b) for r in ROTATIONS for b in SPARED])).alias("block"), "at", "f")


def same_fact(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) of (batch, id) that ask for the same fact, by kind, numbers and text."""
    fact = prints.select(F.struct("batch", "id").alias("at"), F.struct("kind", "asked", "shared", "told", "nums").alias("fact"))
    p, q = fact.toDF("a", "p"), fact.toDF("b", "q")
    flat = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("batch", "id")]
    both = pairs.join(p, "a").join(q, "b").where("p.kind = q.kind").select(*flat, "p", "q")
    shape = both.drop("p", "q").schema

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [agree(p, q) for p, q in zip(b["p"], b["q"])]
            if any(keep):
                yield b.loc[keep, ["a_batch", "a_id", "b_batch", "b_id"]]

    got = both.mapInPandas(check, shape)
    side = lambda x: F.struct(F.col(f"{x}_batch").alias("batch"), F.col(f"{x}_id").alias("id")).alias(x)
    return got.select(side("a"), side("b"))


def agree(p: dict, q: dict) -> bool:
    """Texts of two facts of one kind: their years and counts do not differ, their questions (in their own or their
    sentences' spelling) share ``SAME`` of their letters both ways, and the shorter of the sentences shares three
    fifths with the longer one."""
    for low, high in ((0, 99), (100, 10**10)):
        m, n = ({int(v) for v in x["nums"] if low <= v <= high} for x in (p, q))
        if m and n and not m & n:
            return False
    views = [[list(x["asked"]), list(x["shared"])] for x in (p, q)]
    if all(min(overlap(a, b), overlap(b, a)) < SAME for a in views[0] for b in views[1]):
        return False
    s, t = sorted((list(p["told"]), list(q["told"])), key=lambda w: sum(map(len, w)))
    return not s or overlap(s, t) >= 0.6


def _close(f: str = "f", g: str = "g") -> Column:
    return F.bit_count(F.col(f).bitwiseXOR(F.col(g))) <= MAX_DISTANCE


def linked_facts(blocks: DataFrame, prints: DataFrame, work: Stages) -> DataFrame:
    """Edges (a, b), a before b and b new, of rows that share a block and ask for the same fact. ``blocks``: (block, at,
    f, new).

    Blocks of up to ``PAIR_BLOCK`` rows are compared pair by pair. In larger ones all rows first meet the earliest, and
    those that do not ask what it asks meet all others, in ``CHUNKS`` parts: a fact that a third of all rows ask costs
    one comparison a row, and no pair is left out that would link what is not linked through the earliest.
    """
    size = blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("lead"), F.max("at").alias("last"), F.bool_or("new").alias("any"))
    rest = work.put(blocks.join(size.where("lead <> last and any").select("block", "n", "lead"), "block"), "blocks")
    x = rest.where(F.col("n") <= PAIR_BLOCK)
    left = x.select("block", F.col("at").alias("a"), "f")
    right = x.where("new").select("block", F.col("at").alias("b"), F.col("f").alias("g"))
    pairs = left.join(right, "block").where(F.col("a") < F.col("b")).where(_close()).select("a", "b").distinct()
    edges = work.put(same_fact(pairs, prints), "edges")
    large = rest.where(F.col("n") > PAIR_BLOCK)
    if not large.limit(1).count():
        return edges
    led = large.where("at <> lead").select("block", F.col("lead").alias("a"), F.col("at").alias("b"), "new").distinct()
    with_lead = work.put(same_fact(led.select("a", "b").distinct(), prints), "led")
    apart = led.join(with_lead, ["a", "b"], "left_anti").select("block", F.col("b").alias("u"), "new")
    apart = apart.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    apart = apart.join(large.select("block", F.col("at").alias("u"), F.col("f").alias("g")).distinct(), ["block", "u"])
    others = large.select("block", "at", "f", F.col("new").alias("at_new"), F.pmod(F.xxhash64("at"), F.lit(CHUNKS)).cast("int").alias("chunk"))
    met = apart.join(others, ["block", "chunk"]).where(_close()).where("u <> at")
    late = F.when(F.col("u") > F.col("at"), F.col("new")).otherwise(F.col("at_new"))
    met = met.where(late).select(F.least("u", "at").alias("a"), F.greatest("u", "at").alias("b")).distinct()
    new_led = with_lead.join(large.where("new").select(F.col("at").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    return edges.unionByName(new_led).unionByName(work.put(same_fact(met, prints), "met"))


def first_asked(edges: DataFrame, known: DataFrame | None, work: Stages) -> DataFrame:
    """(at, root) of every new row with an earlier one: the earliest that is reached by going from a row to rows before
    it. ``known``: (at, root) of history. Each round every row takes the earliest root of its neighbours and then the
    root of that root, so that long chains need few rounds."""
    if not hasattr(edges, "_staged_at"):
        edges = work.put(edges, "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("at")).distinct()
    if known is None:
        roots = ends.select("at", F.col("at").alias("root"))
    else:
        roots = ends.join(known, "at", "left").select("at", F.coalesce("root", "at").alias("root"))
    roots = work.put(roots, "roots")
    while True:
        near_by = edges.join(roots.select(F.col("at").alias("a"), F.col("root").alias("r")), "a").groupBy("b").agg(F.min("r").alias("r"))
        nxt = roots.join(near_by.withColumnRenamed("b", "at"), "at", "left").select("at", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        far = roots.select(F.col("at").alias("root"), F.col("root").alias("far"))
        nxt = work.put(nxt.join(far, "root", "left").select("at", "was", F.least("root", "far").alias("root")), "roots")
        moved = nxt.where("root < was").limit(1).count()
        work.drop(roots)
        roots = nxt
        if not moved:
            work.drop(edges)
            return roots.select("at", "root")


class FingerprintHistory:
    """Accepted rows in a folder, as facts and block tables, matched and extended run by run. A run is one batch or
    several; within it rows are taken in the order of their batches, so that it does not matter how batches are cut into
    runs.

    Tables: ``prints`` (facts), ``firsts`` (the row that first asked each), ``blocks`` (fingerprints, in ``PARTS``
    folders by block). A run is written into folders of its own name and counts only once its mark in ``runs`` is
    there; taking a run again replaces it, so a retried one is not stored twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{at}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        path, fs = self._path("runs")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, table: str, but: str) -> DataFrame | None:
        runs = [r for r in self.runs() if r != but]
        if not runs:
            return None
        base = f"{self.folder}/{table}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/run={r}" for r in runs])

    def _write(self, df: DataFrame, at: str, by: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.folder}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{at}")

    def accept(self, rows: DataFrame, run: str, row_id: str = "staging_id", batch: str = "batch_no", question: str = "question", quote: str = "source_quote") -> DataFrame:
        """(accepted_id, new_id): every row of the run that asks what a row of an earlier batch asked, of history or of
        the run; accepted_id is the first that asked it (the smallest id of the earliest batch). A row is held against
        rows before it only: what was accepted as new stays so, whatever comes later.

        All batches of a run must be later than those of the runs before. Rows of one fact, equal word for word, are
        stored once. Rows with a null id or batch, and questions without content, are left out; other columns are not
        read. An empty run adds nothing.
        """
        work = Stages(self.spark, "history")
        mark, fs = self._path(f"runs/{run}")
        old, old_blocks, old_firsts = (self._read(t, run) for t in ("prints", "blocks", "firsts"))
        fs.delete(mark, True)
        prints = work.put(fingerprints(rows, row_id, batch, question, quote), "prints")
        fact = [F.xxhash64(F.lit(k), "kind", F.sort_array("asked"), F.sort_array("shared"), "told", "nums").alias(f"fact{k}") for k in (0, 1)]
        copies = prints.select(F.struct("batch", "id").alias("at"), *fact)
        first = copies.groupBy("fact0", "fact1").agg(F.min("at").alias("rep"))
        # facts and blocks go to their place at once; without the mark nobody counts them
        reps = self._write(prints.join(first.select("rep.*"), ["batch", "id"]).select(*prints.columns), f"prints/run={run}")
        part = F.pmod("block", F.lit(PARTS)).cast("int")
        mine = self._write(block_rows(reps).withColumn("part", part).repartition("part"), f"blocks/run={run}", "part")
        new = F.lit(True).alias("new")
        blocks, facts = mine.select("block", "at", "f", new), reps.drop("prints")
        if old is not None:
            # the part comes first: folders without a block of the run are not read
            touched = old_blocks.join(mine.select("part", "block").distinct(), ["part", "block"], "left_semi")
            blocks = blocks.unionByName(touched.select("block", "at", "f", F.lit(False).alias("new")))
            facts = facts.unionByName(old.select(*facts.columns))
        roots = first_asked(linked_facts(blocks, facts, work), old_firsts, work)
        named = copies.join(first, ["fact0", "fact1"]).join(roots.withColumnRenamed("at", "rep"), "rep", "left")
        named = named.select("at", F.coalesce("root", "rep").alias("root"))
        firsts = reps.select(F.struct("batch", "id").alias("at")).join(roots, "at", "left").select("at", F.coalesce("root", "at").alias("root"))
        found = work.put(named.where(F.col("at.batch") > F.col("root.batch")).select(F.col("root.id").alias("accepted_id"), F.col("at.id").alias("new_id")), "found")
        self._write(firsts, f"firsts/run={run}")
        fs.create(mark, True).close()
        work.drop(prints)
        return found


def history_duplicates(
    rows: DataFrame, row_id: str = "staging_id", batch: str = "batch_no", question: str = "question", quote: str = "source_quote", runs: int = 2
) -> DataFrame:
    """``FingerprintHistory.accept`` for a table of many batches: they are taken in ``runs`` runs of about as many
    batches each, in order, into a history of their own. The number of runs decides nothing but the work."""
    spark = rows.sparkSession
    work = Stages(spark, "batches")
    history = FingerprintHistory(spark, f"{work.base}/history")
    no = rows.where(F.col(batch).isNotNull()).select(F.col(batch).alias("b"))
    cuts = no.agg(F.percentile_approx("b", F.array(*[F.lit(k / runs) for k in range(1, runs)]) if runs > 1 else F.array(F.lit(1.0)))).first()[0] or []
    out, low = None, None
    for k, high in enumerate(sorted(set(cuts[: runs - 1])) + [None]):
        part = rows.where(F.col(batch).isNotNull())
        part = part if low is None else part.where(F.col(batch) > low)
        part = part if high is None else part.where(F.col(batch) <= high)
        found = history.accept(part, f"{k:06d}", row_id, batch, question, quote)
        out, low = found if out is None else out.unionByName(found), high
    return out
