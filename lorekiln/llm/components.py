"""Connected components on a two-dimensional grid of edge blocks.

Vertices are hashed into blocks; an edge belongs to the cell (block of one end, block of the other). Each cell runs a
union-find over its own edges and offers, for every vertex it holds, the cell's representative (its smallest vertex).
A vertex then sees one offer from each cell of its row and column: it takes the smallest as parent, and the others
are joined to that parent by new edges. Rounds repeat on these new edges, which only join representatives, until no
offers differ. Parents of all rounds are composed from the last, smallest round back to the first.

The number of blocks follows from the number of edges, at every size. Hot vertices: a cell that holds more than twice
its share of edges is cut into sub-cells by a hash of the edge, so a hub's edges are spread over many tasks; only
offers, one per sub-cell at most, meet again at the hub. When parents are composed, representatives that more than a
thousandth of all vertices share travel apart, at most a thousand rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages

HOT = 1000  # a representative of more than one in so many vertices is hot


def local_offers(src: pd.Series, dst: pd.Series) -> pd.DataFrame:
    """Union-find over one block of edges; a row (x, rep) for every vertex, its own representatives included: one that
    is a root here and not elsewhere must keep the two components tied."""
    codes, names = pd.factorize(pd.concat([src, dst], ignore_index=True), sort=True)
    parent = list(range(len(names)))
    n = len(src)
    for a, b in zip(codes[:n].tolist(), codes[n:].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i, p in enumerate(parent):  # parents are smaller, so one ascending pass ends at the roots
        parent[i] = parent[p]
    return pd.DataFrame({"x": names, "rep": names[parent]})


def grid_components(edges: DataFrame, src: str, dst: str, cell_edges: int = 50_000) -> DataFrame:
    """(vertex, label) for every vertex that has an edge to another one; label is the smallest vertex of its component.

    ``src`` and ``dst`` are of one type, long or string (strings compare by code point). Edges with a null end and
    loops join nothing; repeated edges and edges in either direction count once. No edges: an empty result.
    """
    spark = edges.sparkSession
    work = Stages(spark, "components")
    kind = edges.schema[src].dataType.simpleString()
    e = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
    # least/greatest skip nulls, so an edge with a null end turns into a loop
    e = work.put(e.where("u <> v").distinct(), "edges")
    parents: list[DataFrame] = []

    def offers(pdf: pd.DataFrame) -> pd.DataFrame:
        return local_offers(pdf["u"], pdf["v"])

    n = e.count()
    while n:
        # b * (b + 1) / 2 cells of about cell_edges each; two blocks at least, but for what is left in later rounds
        b = max(1 if parents else 2, math.ceil(math.sqrt(2 * n / cell_edges)) if n > cell_edges else 1)
        p, q = (F.pmod(F.xxhash64(c), F.lit(b)).cast("int") for c in "uv")
        cells = e.select("u", "v", F.least(p, q).alias("row"), F.greatest(p, q).alias("col"))
        size = cells.groupBy("row", "col").count().where(F.col("count") > 2 * cell_edges)
        split = size.select("row", "col", F.ceil(F.col("count") / cell_edges).cast("int").alias("k"))
        cells = cells.join(split, ["row", "col"], "left").select(
            "u", "v", "row", "col", F.pmod(F.hash("u", "v"), F.coalesce("k", F.lit(1))).alias("sub")
        )
        seen = cells.groupBy("row", "col", "sub").applyInPandas(offers, f"x {kind}, rep {kind}")
        seen = seen.groupBy("x").agg(F.collect_set("rep").alias("reps"))  # one offer a sub-cell at most
        seen = work.put(seen.select("x", F.array_min("reps").alias("p"), "reps"), "offers")
        parents.append(seen)
        nxt = seen.where(F.size("reps") > 1).select(F.col("p").alias("u"), F.explode("reps").alias("v"))
        nxt = work.put(nxt.where("u <> v").distinct(), "edges")
        work.drop(e)
        e, n = nxt, nxt.count()

    if not parents:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("label")).limit(0)
    labels, was = parents[-1].select(F.col("x").alias("vertex"), F.col("p").alias("label")), None
    for up in reversed(parents[:-1]):
        low = labels.select(F.col("vertex").alias("p"), F.col("label").alias("top"))
        hot = up.groupBy("p").count().where(F.col("count") * HOT > up.count()).select("p")  # fewer than HOT rows
        # without a row in low, a representative is a root
        known = hot.join(low, "p", "left").select("p", F.coalesce("top", "p").alias("hot_top"))
        marked = up.select("x", "p").join(F.broadcast(known), "p", "left")
        joined = marked.where("hot_top is null").join(low, "p", "left")
        labels = joined.select(F.col("x").alias("vertex"), F.coalesce("top", "p").alias("label")).unionByName(
            marked.where("hot_top is not null").select(F.col("x").alias("vertex"), F.col("hot_top").alias("label"))
        )
        labels = work.put(labels, "labels")
        work.drop(was)
        was = labels
    if was is None:
        labels = work.put(labels, "labels")
    work.drop(e, *parents)
    return labels
