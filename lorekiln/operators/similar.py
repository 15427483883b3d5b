"""Pairs of texts above a cosine, by prefix filtering, and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages

LEVELS = (0.999999, 0.97, 0.94, 0.9, 0.85, 0.8, 0.7)  # where the most similar pairs are looked for, in turn


def similar_pairs(weights: DataFrame, key: str, least: float, group: str | None = None) -> DataFrame:
    """(id_a, id_b, sim): all pairs, ids ascending, whose dot product of ``weights`` (key, term, idf, w; length one a
    document) is at least ``least``, to six places; within ``group`` only, if one is given.

    Terms are ordered from the rarest on; of each document only the head counts whose tail is shorter than ``least``:
    two documents above it share a term of both heads, so frequent words, which stand in tails, join nothing. The
    products of the candidates are exact. A candidate goes no further than the join where the terms that only one of the two
    can have (those in places of a 64-bit mask that the other leaves empty) already weigh too much.
    """
    keys = [group] if group else []
    base = weights.select(*keys, F.col(key).alias("id"), "term", "idf", "w")
    tail = Window.partitionBy("id").orderBy(F.desc("idf"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole, weight = Window.partitionBy("id"), F.col("w") * F.col("w")
    head = base.withColumn("tail", F.sum(weight).over(tail)).withColumn("lightest", F.min(weight).over(whole))
    head = head.withColumn("mask", F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(term), 64) as int))")).over(whole))
    head = head.where(F.col("tail") >= least * least - 1e-9)
    x = head.select(*keys, "term", F.col("id").alias("id_a"), F.col("mask").alias("mask_a"), F.col("lightest").alias("lightest_a"))
    y = head.select(*keys, "term", F.col("id").alias("id_b"), F.col("mask").alias("mask_b"), F.col("lightest").alias("lightest_b"))
    most = 1 - max(least - 1e-6, 0.0) ** 2 + 1e-9  # weight that a pair at the threshold has apart
    apart = [F.bit_count(F.col(f"mask_{p}").bitwiseAND(F.bitwise_not(f"mask_{q}"))) * F.col(f"lightest_{p}") <= most for p, q in ("ab", "ba")]
    found = x.join(y, [*keys, "term"]).where("id_a < id_b").where(apart[0] & apart[1]).select("id_a", "id_b").distinct()
    a = base.select(F.col("id").alias("id_a"), "term", F.col("w").alias("wa"))
    b = base.select(F.col("id").alias("id_b"), "term", F.col("w").alias("wb"))
    dots = found.join(a, "id_a").join(b, ["id_b", "term"]).groupBy("id_a", "id_b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("sim"))
    return dots.where(F.col("sim") >= least)


def most_similar(weights: DataFrame, key: str, least: float, count: int, work: Stages) -> DataFrame:
    """(id_a, id_b, sim): the first ``count`` by ids of all pairs whose product is at least ``least`` and, up to 1e-6, the
    largest of all.

    Documents of the same weights are one: they meet as a group, and their product is 1. The largest product is looked
    for from above, so pairs far below it are not made; what is made is one row a pair of groups. Of the ids only those
    that stand first in the ``count`` first pairs meet their partners one by one.
    """
    weights = work.put(weights.where(F.col(key).isNotNull()), "weights")
    text = F.sort_array(F.collect_list(F.struct("term", "w")))
    text = weights.groupBy(F.col(key).alias("id")).agg(text.alias("bag"))
    # rows of equal terms and counts have equal weights but for the order in which their lengths were summed
    alike = F.transform("bag", lambda x: F.struct(x["term"], F.round(x["w"], 9)))
    text = text.select("id", *[F.xxhash64(F.lit(k), alike).alias(f"h{k}") for k in (0, 1)])
    member = work.put(text, "member")
    group = work.put(member.groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n")), "group")
    member = member.join(group.select("h0", "h1", "rep"), ["h0", "h1"]).select("id", "rep")
    same = group.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("sim"))
    reps = weights.join(group.select(F.col("rep").alias(key)), key, "left_semi")
    most = 1.0 if same.limit(1).count() else None
    for level in [x for x in LEVELS if x > least] + [least]:
        # from a little below the level, for pairs that are as good up to 1e-6 as one just at it
        low = max(least, min(level, most or level) - 2e-6)
        found = work.put(similar_pairs(reps, key, low).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "sim"), "found")
        top = found.agg(F.max("sim")).first()[0]
        most = max((x for x in (most, top) if x is not None), default=None)
        if most is not None and most >= level:
            break
        if level > least:
            work.drop(found)
    linked = found.unionByName(same).where(F.col("sim") >= F.lit(most).cast("double") - 1e-6)
    linked = work.put(linked.unionByName(linked.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")), "linked")
    # an id stands first in a pair where its group has a partner with a larger id
    far = linked.join(group.select(F.col("rep").alias("b"), "last"), "b").groupBy("a").agg(F.max("last").alias("far"))
    first = member.join(far.withColumnRenamed("a", "rep"), "rep").where("id < far").orderBy("id").limit(count).select(F.col("id").alias("id_a"), F.col("rep").alias("a"))
    pairs = linked.join(F.broadcast(first), "a").join(member.select(F.col("id").alias("id_b"), F.col("rep").alias("b")), "b").where("id_a < id_b")
    return pairs.select("id_a", "id_b", "sim").orderBy("id_a", "id_b").limit(count)


def best_earlier(pairs: DataFrame, order: DataFrame, key: str, batch: str) -> DataFrame:
    """(``key``, known_id, sim): for each row the most similar row of an earlier batch; ties go to the smallest id."""
    p = order.select(F.col(key).alias("id_a"), F.col(batch).alias("batch_a"))
    q = order.select(F.col(key).alias("id_b"), F.col(batch).alias("batch_b"))
    both = pairs.join(p, "id_a").join(q, "id_b").where("batch_a <> batch_b")
    late = F.col("batch_b") > F.col("batch_a")
    both = both.select(F.when(late, F.col("id_b")).otherwise(F.col("id_a")).alias(key), F.when(late, F.col("id_a")).otherwise(F.col("id_b")).alias("known"), "sim")
    best = F.min(F.struct((-F.col("sim")).alias("s"), "known")).alias("b")
    return both.groupBy(key).agg(best).select(key, F.col("b.known").alias("known_id"), (-F.col("b.s")).alias("sim"))
