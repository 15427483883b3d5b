"""A judge for open answers behind an interface: two models in turn, transient failures pass on to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a failure as transient.
TRANSIENT = ("429", "503", "timeout", "deadline")
Model = Callable[[str, str, str], tuple[bool, str]]


def is_transient(error: BaseException | str) -> bool:
    return any(t in str(error).lower() for t in TRANSIENT)


def judge_answers(
    rows: DataFrame, key: str, models: list[tuple[str, Model]], question: str = "question", player: str = "player", gold: str = "gold"
) -> DataFrame:
    """(``key``, verdict, reason, model, status). The models are asked in order; after a transient failure the next one
    is, any other failure ends the row. status: 'success' (the last model asked answered), 'transient' (all failed for
    the time being) or 'failed'. Without an answer the verdict is false. Rows are judged where they lie, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, q, p, g in b.itertuples(index=False):
                got = (False, "no judge", None, "failed")
                for name, model in models:
                    try:
                        verdict, reason = model(q or "", p or "", g or "")
                        got = (bool(verdict), reason, name, "success")
                        break
                    except Exception as e:  # noqa: BLE001  # whatever a model raises is an outcome of the row
                        got = (False, str(e), name, "transient" if is_transient(e) else "failed")
                        if not is_transient(e):
                            break
                out.append((k, *got))
            if out:
                yield pd.DataFrame(out, columns=[key, "verdict", "reason", "model", "status"])

    kind = rows.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, verdict boolean, reason string, model string, status string"
    return rows.select(key, question, player, gold).mapInPandas(run, shape)


def health(status: Column) -> Column:
    return F.when(status == "success", "OK").when(status == "transient", "DEGRADED").otherwise("FAILED")


def overlap_judge(_question: str, player: str, gold: str) -> tuple[bool, str]:
    """Offline stand-in for a model: at least half of the gold answer's distinct words are in the player's."""
    import re

    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    g = words(gold)
    share = len(g & words(player)) / len(g) if g else 0.0
    return share >= 0.5, "enough shared words" if share >= 0.5 else "too few shared words"
