"""Best representative of each duplicate group, with a two-sided model of source quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorekiln.functions.text import identity_form, is_missing
from lorekiln.llm.components import grid_components
from lorekiln.plans.stage import Stages


@F.pandas_udf(StringType())
def question_key(t: pd.Series) -> pd.Series:
    """``identity_form`` of each text; null where nothing is left."""
    return t.map(lambda x: identity_form(x) or None)


def duplicate_groups(records: DataFrame, record_id: str, keys: list[Column], cell_edges: int = 50_000) -> DataFrame:
    """(``record_id``, group): records that share any key, directly or through others; singles are left out.

    A record is tied to each of its keys, never to the other records of the key, so a key that holds a third of all
    rows costs one edge a record. Null keys tie nothing; a repeated record id is one record.
    """
    ties = [F.md5(F.concat(F.lit(f"{i}\x1f"), k)) for i, k in enumerate(keys)]
    edges = records.where(F.col(record_id).isNotNull()).select(
        F.concat(F.lit("r"), F.col(record_id).cast("string")).alias("_r"),
        F.explode(F.array_compact(F.array(*ties))).alias("_k"),
    )
    edges = edges.select("_r", F.concat(F.lit("s"), "_k").alias("_k"))
    own = grid_components(edges, "_r", "_k", cell_edges).where(F.col("vertex").startswith("r"))
    back = F.expr("substring(vertex, 2)").cast(records.schema[record_id].dataType)
    return own.select(back.alias(record_id), F.col("label").alias("group"))


PATTERN_ROWS = 1_000_000  # votes of patterns up to which the rounds run on the driver
SENSITIVITY, SPECIFICITY = (0.8, 10.0), (0.9, 100.0)  # prior means and how many values they weigh; they fade with the data
PRIOR = 0.5  # share of claimed values that are true, before any is looked at


def source_quality(claims: DataFrame, rounds: int = 100, close: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Latent two-sided quality model over multi-valued claims, by expectation-maximisation.

    ``claims``: (group, field, value, source). A source that speaks about a field of a group claims some of its values
    and, by silence, denies the rest. Each value is true or not, independently of the others, so a field may keep
    several. Sensitivity is the share of true values a source claims, specificity the share of false ones it leaves
    out. Rounds end when no parameter moves by ``close``. Returns (facts, quality): facts (group, field, value,
    p_true), quality (source, sensitivity, specificity, n_values).

    Only distinct patterns of claiming and denying sources enter the rounds, with their counts. Up to ``PATTERN_ROWS``
    votes of patterns (a handful of sources has a few hundred) the rounds run on the driver; beyond, as jobs of which
    one row per source comes back.
    """
    spark = claims.sparkSession
    work = Stages(spark, "quality")
    c = claims.dropna(subset=["group", "field", "value", "source"]).distinct()
    spoke = c.groupBy("group", "field").agg(F.sort_array(F.collect_set("source")).alias("spoke"))
    facts = c.groupBy("group", "field", "value").agg(F.sort_array(F.collect_set("source")).alias("said"))
    facts = facts.join(spoke, ["group", "field"]).withColumn("pattern", F.md5(F.concat_ws("\x1e", F.concat_ws("\x1f", "said"), F.concat_ws("\x1f", "spoke"))))
    facts = work.put(facts, "facts")
    patterns = facts.groupBy("pattern").agg(F.count("*").alias("n"), F.first("said").alias("said"), F.first("spoke").alias("spoke"))
    votes = patterns.select("pattern", "n", "said", F.size("spoke").alias("peers"), F.explode("spoke").alias("source"))
    votes = votes.select("pattern", "n", "peers", "source", F.array_contains("said", F.col("source")).cast("int").alias("hit"))
    votes = work.put(votes, "votes")
    names = sorted(r.source for r in votes.select("source").distinct().collect())  # one row per source
    params = {s: (SENSITIVITY[0], SPECIFICITY[0]) for s in names}
    counted: dict[str, float] = {}
    odds = math.log(PRIOR / (1 - PRIOR))

    def scored() -> DataFrame:
        rows = [(s, math.log(a / (1 - z)), math.log((1 - a) / z)) for s, (a, z) in params.items()]
        table = spark.createDataFrame(rows, "source string, yes double, no double")
        vote = F.when(F.col("hit") == 1, F.col("yes")).otherwise(F.col("no"))
        total = votes.join(table, "source").groupBy("pattern").agg(F.sum(vote).alias("score"))
        return total.select("pattern", (1 / (1 + F.exp(-(F.col("score") + odds)))).alias("p_true"))

    # one source alone tells nothing of its own quality
    told = votes.where("peers > 1")
    local = told.toPandas() if told.count() <= PATTERN_ROWS else None

    def sums() -> pd.DataFrame:
        if local is None:
            w = told.join(scored(), "pattern")
            t, f = F.col("n") * F.col("p_true"), F.col("n") * (1 - F.col("p_true"))
            return w.groupBy("source").agg(
                F.sum(t * F.col("hit")).alias("tp"), F.sum(t).alias("t"), F.sum(f * F.col("hit")).alias("fp"), F.sum(f).alias("f"), F.sum("n").alias("n")
            ).toPandas()  # one row per source
        yes = local["source"].map({s: math.log(a / (1 - z)) for s, (a, z) in params.items()})
        no = local["source"].map({s: math.log((1 - a) / z) for s, (a, z) in params.items()})
        score = yes.where(local["hit"] == 1, no).groupby(local["pattern"]).transform("sum")
        p = 1 / (1 + np.exp(-(score + odds)))
        t, f = local["n"] * p, local["n"] * (1 - p)
        w = pd.DataFrame({"source": local["source"], "tp": t * local["hit"], "t": t, "fp": f * local["hit"], "f": f, "n": local["n"]})
        return w.groupby("source", as_index=False).sum()

    for _ in range(rounds if names else 0):
        moved = 0.0
        for r in sums().itertuples(index=False):
            sens = (r.tp + SENSITIVITY[0] * SENSITIVITY[1]) / (r.t + SENSITIVITY[1])
            spec = (r.f - r.fp + SPECIFICITY[0] * SPECIFICITY[1]) / (r.f + SPECIFICITY[1])
            new = (min(max(sens, 1e-3), 1 - 1e-3), min(max(spec, 1e-3), 1 - 1e-3))
            moved = max(moved, *(abs(x - y) for x, y in zip(new, params[r.source])))
            params[r.source] = new
            counted[r.source] = float(r.n)
        if moved < close:
            break
    quality = spark.createDataFrame(
        [(s, float(a), float(z), counted.get(s, 0.0)) for s, (a, z) in params.items()],
        "source string, sensitivity double, specificity double, n_values double",
    )
    if not names:
        return facts.select("group", "field", "value", F.lit(PRIOR).alias("p_true")), quality
    out = facts.join(scored(), "pattern").select("group", "field", "value", "p_true")
    return out, quality


def members(records: DataFrame, groups: DataFrame, record_id: str, columns: list[str]) -> DataFrame:
    """The rows of all groups with ``columns`` and their group."""
    r = records.where(F.col(record_id).isNotNull()).select(record_id, *columns)
    return r.join(groups.select(record_id, "group"), record_id)


def claimed_values(r: DataFrame, multi: list[str], source: str) -> DataFrame:
    """(group, field, value, source, spelling) of ``members``: what each source says; letter case and outer blanks tell
    no values apart."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("field"), F.col(m).alias("values")) for m in multi]))
    one = r.select("group", F.col(source).alias("source"), each.alias("m"))
    one = one.select("group", "source", "m.field", F.explode("m.values").alias("spelling")).where(~is_missing(F.col("spelling")))
    return one.withColumn("value", F.lower(F.trim("spelling")))


def best_representatives(
    records: DataFrame, groups: DataFrame, record_id: str, fields: list[str], source: str, recency: str, trust: DataFrame, multi: list[str]
) -> DataFrame:
    """One surviving record per group, field by field: picks (group_id, field_name, record_id).

    Of the records whose value is not missing, the one of the most trusted source, then the latest, then the smallest
    id. A source with a rank in ``trust`` (source, trust_rank) has it; sources without one follow behind, in the order
    of the quality that the model infers for them from the ``multi`` array fields, unknown sources last. Where every
    source has a rank the model would decide nothing and is not fitted. No row where all values are missing; null dates
    count as oldest. ``group_id`` is the smallest id of the group; groups of one record are left out. The smallest of a
    struct is taken by partial aggregation, so a group with a third of all rows never meets in one task.
    """
    work = Stages(records.sparkSession, "survivor")
    r = work.put(members(records, groups, record_id, [*fields, *multi, source, recency]), "records")
    ranks = trust.groupBy(F.col(trust.columns[0]).alias("_s")).agg(F.min(trust.columns[1]).cast("double").alias("_given"))
    ranks = ranks.where("_s is not null and _given is not null")
    unranked = r.select(F.col(source).alias("_s")).where("_s is not null").distinct().join(ranks, "_s", "left_anti")
    if unranked.limit(1).count():
        quality = work.put(source_quality(claimed_values(r, multi, source).drop("spelling"))[1], "sources")
        merit = quality.select(F.col("source").alias("_s"), (2 - F.col("sensitivity") - F.col("specificity")).alias("_merit"))
        order = ranks.join(merit, "_s", "full").select("_s", F.coalesce("_given", F.lit(1e9) + F.col("_merit")).alias("_rank"))
    else:
        order = ranks.withColumnRenamed("_given", "_rank")
    # one row per source; the optimiser broadcasts it only while it is small
    ranked = r.join(order, r[source] == order["_s"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(1e12)))
    age = F.coalesce(-F.unix_micros(F.col(recency).cast("timestamp")), F.lit(2**62))
    best = [
        F.min(F.when(~is_missing(F.col(f)), F.struct(F.col("_rank"), age.alias("_age"), F.col(record_id).alias("_id")))).alias(f)
        for f in fields
    ]
    picks = ranked.groupBy("group").agg(F.min(record_id).alias("group_id"), F.max(record_id).alias("_last"), *best)
    picks = picks.where("group_id <> _last")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["_id"].alias("record_id")) for f in fields]))
    return picks.select("group_id", long.alias("_p")).select("group_id", "_p.*").where("record_id is not null")


def retained_values(records: DataFrame, groups: DataFrame, record_id: str, source: str, multi: list[str]) -> tuple[DataFrame, DataFrame]:
    """(retained, quality). retained (group_id, field_name, value, p_true): every value of the ``multi`` array fields
    that the model judges true, in its most frequent spelling (ties: the smallest). quality: the fitted sources. Groups
    of one record are left out, values without a source claim nothing."""
    work = Stages(records.sparkSession, "retained")
    r = work.put(members(records, groups, record_id, [*multi, source]), "records")
    ids = r.groupBy("group").agg(F.min(record_id).alias("group_id"), F.max(record_id).alias("last")).where("group_id <> last")
    claims = work.put(claimed_values(r, multi, source), "claims")
    facts, quality = source_quality(claims.drop("spelling"))
    spelt = claims.groupBy("group", "field", "value", "spelling").agg((-F.count("*")).alias("n"))
    spelt = spelt.groupBy("group", "field", "value").agg(F.min(F.struct("n", "spelling"))["spelling"].alias("spelling"))
    kept = facts.where("p_true > 0.5").join(spelt, ["group", "field", "value"]).join(ids, "group")
    return kept.select("group_id", F.col("field").alias("field_name"), F.col("spelling").alias("value"), "p_true"), quality
