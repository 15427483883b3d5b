"""Filling prompts of fixed capacity with whole documents: sum-of-squares packing in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages

BLOCK_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, largest items first: each goes where the sum over residual gaps of the squared number
    of open bins with that gap becomes smallest (a new bin counts as a gap of the whole capacity); ties go to the
    smallest gap. Sizes must lie in 1..capacity."""
    bins = np.zeros(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins (gap 0) are closed
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        gaps = s + np.flatnonzero(n[s:capacity])  # open bins that can take the item
        best, gap = (2 * n[capacity - s] + 1 if s < capacity else 0), capacity
        if len(gaps):
            after = gaps - s
            delta = -2 * n[gaps] + 1 + np.where(after > 0, 2 * n[after] + 1, 0)
            k = int(np.argmin(delta))
            if delta[k] <= best:
                gap = int(gaps[k])
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = open_at[gap].pop()
            n[gap] -= 1
        bins[i] = b
        if gap > s:
            open_at[gap - s].append(b)
            n[gap - s] += 1
    return bins


def _packer(turn: int):
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc", "piece_no", "uid"]).reset_index(drop=True)
        b = sum_of_squares(pdf["size"].to_numpy(), int(pdf["cap"].iloc[0]))
        pdf["prompt_id"] = [f"{key[0]}-{turn}-{key[1]}-{x}" for x in b]
        pdf["fill"] = pdf["size"].groupby(b).transform("sum")
        return pdf.drop(columns=["block"])

    return pack


def pack_documents(
    sizes: DataFrame,
    windows: DataFrame,
    doc_id: str = "doc_id",
    size: str = "n_tokens",
    block_items: int = BLOCK_ITEMS,
    slack: float = 0.02,
) -> DataFrame:
    """(window_id, prompt_id, ``doc_id``, piece_no, start, n_tokens): every document or piece and its prompt.

    Only a document larger than the window is split, into full windows and a rest; the full pieces fill prompts of
    their own. Items are hashed into blocks of about ``block_items`` and each block is packed by itself; prompts left
    with more than ``slack`` of their capacity unused are dissolved and packed again in fewer blocks, until one block
    is left or a round no longer halves the loose items. Documents without tokens need no room: one row with a null prompt_id. Windows with a null or
    non-positive capacity are left out, and of several rows of one window the largest capacity counts; repeated rows
    are packed as often as they stand. Empty tables: an empty result.
    """
    spark = sizes.sparkSession
    work = Stages(spark, "pack")
    caps = windows.where("window_id is not null and capacity_tokens > 0").groupBy(F.col("window_id").cast("int").alias("window_id"))
    caps = caps.agg(F.max("capacity_tokens").cast("int").alias("cap"))
    # one row that holds all windows: every document goes through each of them
    all_caps = caps.agg(F.sort_array(F.collect_list(F.struct("window_id", "cap"))).alias("caps"))
    kind = sizes.schema[doc_id].dataType.simpleString()
    base = work.put(sizes.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")), "sizes")
    each = base.withColumn("uid", F.monotonically_increasing_id()).join(F.broadcast(all_caps)).select("uid", "doc", "n", F.explode("caps").alias("w"))
    each = each.select("uid", "doc", "n", "w.window_id", "w.cap")
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("cast((n - 1) div cap as int)"))))
    items = each.withColumn("piece_no", piece)
    items = items.withColumn("start", F.col("piece_no") * F.col("cap"))
    items = items.withColumn("size", F.least("cap", F.col("n") - F.col("start")).cast("long"))
    items = work.put(items.select("window_id", "cap", "uid", "doc", "piece_no", "start", "size"), "items")
    own = F.concat_ws("-", "window_id", F.lit("full"), "uid", "piece_no")
    result = [
        items.where("size = cap or size <= 0").select(
            "window_id", F.when(F.col("size") > 0, own).alias("prompt_id"), "doc", "piece_no", "start", "size"
        )
    ]
    left = items.where("size < cap and size > 0")
    done, before = 0, math.inf
    shape = f"window_id int, cap int, uid long, doc {kind}, piece_no int, start int, size long, prompt_id string, fill long"
    while True:
        most = max((r["count"] for r in left.groupBy("window_id").count().collect()), default=0)  # a row per window
        if not most:
            break
        last = most <= block_items or most > before / 2
        blocks, before = math.ceil(most / block_items), most
        blocked = left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(done)), F.lit(blocks)).cast("int"))
        packed = work.put(blocked.groupBy("window_id", "block").applyInPandas(_packer(done), shape), "packed")
        loose = F.col("cap") - F.col("fill") > slack * F.col("cap")
        keep = packed if last else packed.where(~loose)
        result.append(keep.select("window_id", "prompt_id", "doc", "piece_no", "start", "size"))
        done += 1
        if last:
            break
        left = packed.where(loose).select("window_id", "cap", "uid", "doc", "piece_no", "start", "size")
    out = result[0]
    for r in result[1:]:
        out = out.unionByName(r)
    return out.withColumnsRenamed({"doc": doc_id, "size": "n_tokens"})
