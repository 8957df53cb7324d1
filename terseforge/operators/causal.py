"""A causal language model of counts, for use where no neural one is at hand.

A token's probability depends on the tokens before it in its sentence, as far back as two, through
interpolated counts: each order trusts its own counts by how many different tokens followed the same
history (Witten and Bell), and the rest falls to the shorter history, at last to an even share among
the known tokens and one unknown. The counts come from a sample of sentences, the first ``SAMPLE`` by
the hash of their text, so the model is bounded; every sentence is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.operators import scorers
from terseforge.runtime import hashed_sample

#: Sentences that the model is counted on at most, and characters of each.
SAMPLE, SAMPLE_CHARS = 20_000, 2_000
ORDER = 3
START = "<s>"

_TOKEN = re.compile(r" ?\w+| ?[^\s\w]+|\s+")


class CausalCounts:
    """Counts of what follows each history of at most two tokens."""

    def __init__(self, sentences: list[str]) -> None:
        self.after: dict[tuple[str, ...], Counter] = defaultdict(Counter)
        for s in sentences:
            said = [START] * (ORDER - 1) + _TOKEN.findall(s)
            for k in range(ORDER - 1, len(said)):
                for n in range(ORDER):
                    self.after[tuple(said[k - n : k])][said[k]] += 1
        self.totals = {h: sum(c.values()) for h, c in self.after.items()}
        self.even = 1.0 / (len(self.after.get((), ())) + 1)

    def probability(self, history: tuple[str, ...], token: str) -> float:
        """Of a token after the tokens of its history, the longest first."""
        p = self.even
        for n in range(len(history) + 1):
            h = history[len(history) - n :]
            total = self.totals.get(h, 0)
            if total:
                own = self.after[h]
                p = (own.get(token, 0) + len(own) * p) / (total + len(own))
        return p

    def score(self, sentences: list[str]) -> list[list[tuple[str, float]]]:
        """(token, self-information in nats) of every sentence; the tokens concatenate to it."""
        out = []
        for s in sentences:
            found = _TOKEN.findall(s)
            said = [START] * (ORDER - 1) + found
            out.append([(t, -math.log(self.probability(tuple(said[k : k + ORDER - 1]), t))) for k, t in enumerate(found)])
        return out


def register(sentences: DataFrame, name: str = "counts", sentence: str = "sentence", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> CausalCounts:
    """Counts a model on a bounded sample of sentences and registers it under ``name``."""
    said = sentences.select(F.substring(sentence, 1, chars).alias("s")).where("s is not null")
    model = CausalCounts(sorted(r["s"] for r in hashed_sample(said, "s", sample, said.count())))  # bounded by sample and chars
    held = sentences.sparkSession.sparkContext.broadcast(model)
    scorers.register(name, lambda: held.value.score)
    return model
