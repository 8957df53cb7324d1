"""Scorers: what gives a sentence's tokens their self-information.

A scorer maps sentences to arrays of (token, self_info) whose tokens concatenate to the sentence.
``unigram`` and ``bigram`` read frozen tables of the corpus. A language model is registered as a
function over a batch of sentences, which runs in Arrow batches and loads its model once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terseforge.operators import units as U

#: A function over a batch of sentences; each gets its list of (token, self_info).
BatchScorer = Callable[[list[str]], list[list[tuple[str, float]]]]
MODELS: dict[str, Callable[[], BatchScorer]] = {}


def register(name: str, load: Callable[[], BatchScorer]) -> None:
    """Registers a model; ``load`` is called once per Python worker."""
    MODELS[name] = load


def model_tokens(sentences: DataFrame, key: str, name: str) -> DataFrame:
    """key, sent_idx, pos, token, self_info of every sentence by a registered model."""
    if name not in MODELS:
        raise ValueError(f"no scorer named {name!r}; registered: {sorted(MODELS)}")
    load = MODELS[name]

    @F.pandas_udf("array<struct<token:string,self_info:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for batch in batches:
            yield pd.Series([[{"token": t, "self_info": float(s)} for t, s in one] for one in score(list(batch))])

    scored = sentences.select(key, "sent_idx", F.posexplode(run("sentence")).alias("pos", "x"))
    return scored.select(key, "sent_idx", "pos", "x.token", "x.self_info")


def bigram_tokens(rows: DataFrame, key: str, model: DataFrame, broadcast_bytes: int | None = None, complete: bool = False, weight: float = U.WEIGHT) -> DataFrame:
    """Token rows scored by their predecessor in the sentence; the table is broadcast if its size allows it.

    A bigram that the model has not counted backs off to the unigram part of the interpolation, with
    the tokens' counts in the model, smoothed as there; a model without counts gives it its highest
    self_info. ``complete`` says that the model was counted on these rows, so that none is missing.
    """
    w = Window.partitionBy(key, "sent_idx").orderBy("pos")
    before = rows.withColumn("prev", F.coalesce(F.lag("token").over(w), F.lit("<s>")))
    counted = "n" in model.columns
    table, size = U.held(model.select("prev", "token", *["n"] * counted, "self_info"), complete)
    if complete:
        return U.looked_up(before, table, size, ["prev", "token"], "inner", broadcast_bytes).drop("prev")
    found = U.looked_up(before, table, size, ["prev", "token"], "left", broadcast_bytes).drop("prev")
    if not counted:
        most = table.agg(F.coalesce(F.max("self_info"), F.lit(0.0)).alias("__floor"))  # one row
        return found.join(F.broadcast(most)).withColumn("self_info", F.coalesce("self_info", "__floor")).drop("__floor")
    single, single_size = U.held(table.groupBy("token").agg(F.sum("n").alias("n")))
    total = single.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*"), F.lit(1)).alias("__all"))  # one row
    rest = -F.ln((1 - weight) * (F.coalesce("__n", F.lit(0)) + 1) / F.col("__all"))
    counts = single.select("token", "n", F.col("n").alias("__n"))
    return U.looked_up(found, counts, single_size, ["token"], "left", broadcast_bytes).join(F.broadcast(total)).withColumn("self_info", F.coalesce("self_info", rest)).drop("__n", "__all")
