import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorekiln.llm import history_dedup
from lorekiln.llm.history_dedup import FingerprintHistory, agree, asked_kind, fact_of, history_duplicates, near, simhash, view_prints

Q = "In the year 868 Trehurorn assembled twenty folded charts at Elddefis Cairn."
ROWS = [
    (1, 1, "How many folded charts did Trehurorn assemble at Elddefis Cairn?", Q),
    (2, 1, "Who assembled the folded charts at Elddefis Cairn?", Q),
    (3, 2, "What number of folded charts were assembled by Trehurorn at Elddefis Cairn?", "Some bell rang. " + Q),
    (4, 2, "In which year did Trehurorn assemble the folded charts at Elddefis Cairn?", Q),
    (5, 3, "How amny folded chatrs did Trehurorn assemble at Elddefis Cairn?", Q[:-14]),
    (6, 3, "Tell me: how many folded charts did Trehurorn assemble at Elddefis Cairn?", "“in 868 Trheurorn assembled 20 fooded charts at Elddefis Cairn.”"),
    (7, 4, "How many folded charts did Trehurorn assemble at Elddefis Cairn?", "In the year 1200 Trehurorn assembled nine folded charts at Elddefis Cairn."),
    (8, 4, None, None),
    (9, 4, "", Q),
    (10, 5, None, None),
    (11, 5, "By whom were the folded charts assembled at Elddefis Cairn?", Q),
    (12, 5, "By whom were the folded charts assembled at Elddefis Cairn?", Q),
    (13, None, "By whom were the folded charts assembled at Elddefis Cairn?", Q),
]
SHAPE = "staging_id long, batch_no long, question string, source_quote string, block string, id string"
WANT = {(1, 3), (1, 5), (1, 6), (2, 11), (2, 12)}


def test_parts():
    assert near("charts", "chatrs") and not near("oar", "jars") and near("", "")
    assert asked_kind("in hwich yaer did".split()) == "when"
    assert bin((simhash(["chart", "fold"]) ^ simhash(["fold", "chart"])) & (2**64 - 1)).count("1") == 0
    assert fact_of(None, None)[0] == "other" and simhash([]) == 0
    a, b = (set(view_prints([w.split()])[0]) for w in ("chart fold cairn mend", "chart fold carin mend"))
    assert len(a) == 5 and len(a & b) == 1 and view_prints([[], ["chart", "fold"]])[0] == []
    keys = ("kind", "asked", "shared", "told", "nums")
    a, b = (dict(zip(keys, fact_of(*ROWS[i][2:]))) for i in (0, 6))
    assert not agree(a, b) and agree(a, a)


def test_all_batches_at_once(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SHAPE).repartition(3)
    assert {tuple(r) for r in history_duplicates(df).collect()} == WANT
    assert history_duplicates(df.limit(0)).collect() == []


def test_batch_by_batch_gives_the_same_and_a_retry_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SHAPE)
    history, got = FingerprintHistory(spark, f"file://{tmp_path}/h"), set()
    for n in range(1, 6):
        for _ in range(1 + (n == 3)):
            found = history.accept(df.where(f"batch_no = {n}"), f"{n:03d}")
            got |= {tuple(r) for r in found.collect()}
    assert got == WANT
    assert history.runs() == [f"{n:03d}" for n in range(1, 6)]
    stored = spark.read.parquet(f"file://{tmp_path}/h/firsts")
    assert stored.count() == stored.select("at").distinct().count() == 8
    assert history.accept(df.limit(0), "999").collect() == []


def test_what_was_accepted_as_new_stays_new(spark, monkeypatch):
    """3 asks what 1 and 2 ask, which do not ask the same: it is a repeat of 1, and 2 stays what it was."""
    word = lambda k: hashlib.md5(str(k).encode()).hexdigest()[:9].translate(str.maketrans("0123456789", "ghijklmnop"))
    texts = {1: [word(k) for k in range(2, 10)], 2: [word(k) for k in range(6, 14)], 3: [word(k) for k in range(4, 12)]}

    def prints(rows, *_):
        out = [(i, i, "who", w, w, ["told"], [], [7]) for i, w in texts.items()]
        return spark.createDataFrame(out, f"id long, batch long, {history_dedup.SHAPE}").join(rows.select(F.col("b").alias("batch")), "batch").select("id", "batch", "kind", "asked", "shared", "told", "nums", "prints")

    monkeypatch.setattr(history_dedup, "fingerprints", prints)
    rows = spark.range(1, 4).select(F.col("id").alias("b"), "id")
    for runs in (3,):
        got = {tuple(r) for r in history_duplicates(rows, batch="b", runs=runs).collect()}
        assert got == {(1, 3)}


def test_a_fact_that_a_third_of_all_rows_ask(spark):
    rows = [(i, 1 + i // 10, f"How many folded charts did Trehurorn assemble at Elddefis Cairn{' please' * (i % 3)}?", Q + f" Bell {i} rang.") for i in range(200)]
    slips = [(1000 + i, 50 + i, "How many folded charts did Trehurorn assemble at Elddefis Cairn?", Q.replace("Trehurorn", f"Trehuror{chr(97 + i % 26)}{'' if i < 26 else chr(97 + i // 26)}")) for i in range(100)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + slips], SHAPE)
    got = {tuple(r) for r in history_duplicates(df).collect()}
    assert got == {(0, r[0]) for r in rows + slips if r[1] > 1}


@pytest.mark.parametrize("runs", [2])
def test_large_blocks_lose_no_link(spark, monkeypatch, runs):
    """1 is the first of a block of more than PAIR_BLOCK rows; 2 asks what 1 asks, 3 what 2 asks but not what 1 asks."""
    word = lambda k: hashlib.md5(str(k).encode()).hexdigest()[:9].translate(str.maketrans("0123456789", "ghijklmnop"))
    texts = {i: [word(k) for k in range(2 * i, 2 * i + 8)] for i in (1, 2, 3)}
    texts |= {10 + i: [word(100 + 8 * i + k) for k in range(8)] for i in range(100)}
    texts[200] = texts[50][:7] + [word(9999)]

    def prints(rows, *_):
        out = [(i, i, "who", w, w, ["told"], [], [1, 5 + i % 2]) for i, w in texts.items()]
        all_ = spark.createDataFrame(out, f"id long, batch long, {history_dedup.SHAPE}")
        return all_.join(rows.select(F.col("b").alias("batch")), "batch").select(*all_.columns)

    monkeypatch.setattr(history_dedup, "fingerprints", prints)
    as_fact = lambda i: {"asked": texts[i], "shared": texts[i], "told": ["told"], "nums": []}
    assert agree(as_fact(1), as_fact(2)) and agree(as_fact(2), as_fact(3)) and not agree(as_fact(1), as_fact(3))
    rows = spark.range(1, 300).select(F.col("id").alias("b"), "id")
    got = {tuple(r) for r in history_duplicates(rows, batch="b", runs=runs).collect()}
    assert got == {(1, 2), (1, 3), (50, 200)}


def test_one_bit_apart_always_meets():
    """Fingerprints a bit apart share a block in one of the rotations."""
    for bit in range(64):
        f, g = 0x123456789ABCDEF1, 0x123456789ABCDEF1 ^ 1 << bit
        turned = [[((x << r | x >> (64 - r)) & (2**64 - 1)) >> (64 - history_dedup.BLOCK_BITS) if r else x >> 32 for r in history_dedup.ROTATIONS] for x in (f, g)]
        assert any(p == q for p, q in zip(*turned))


def test_all_within_the_distance_share_a_block(spark):
    """Every pair of fingerprints up to MAX_DISTANCE bits apart meets, wherever the bits are."""
    rng, f = random.Random(5), 0x123456789ABCDEF1
    flips = [c for n in range(history_dedup.MAX_DISTANCE) for c in itertools.combinations(range(64), n)] + [tuple(rng.sample(range(64), 3)) for _ in range(500)]
    signed = lambda v: v - 2**64 if v >> 63 else v
    rows = [(1, i, "who", [signed(f ^ sum(1 << b for b in c))]) for i, c in enumerate(flips)]
    blocks = history_dedup.block_rows(spark.createDataFrame(rows, "batch long, id long, kind string, prints array<long>"))
    first = blocks.where("at.id = 0").select("block")
    assert blocks.join(first, "block").select("at.id").distinct().count() == len(flips)
