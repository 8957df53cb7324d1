"""The public entry: compress a table of texts, or one text."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terseforge.functions import text as T
from terseforge.operators import masking as M
from terseforge.operators import scorers
from terseforge.operators import units as U

LEVELS = ("sent", "phrase", "token")


def compress(df: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = 0.35, level: str = "phrase", scorer: str = "unigram", model: DataFrame | None = None, max_tokens: int | None = None, lead: int = 0, mark: str = "", lang: str = "en") -> DataFrame:
    """``key``, context, masked_units, reduced: every text without its least informative units.

    ``ratio`` is a share of units, not of characters. ``scorer`` is "unigram", "bigram" or a
    registered model; ``model`` is a frozen table of the first two, and without it one is counted
    from ``df`` itself. Words that the table has not counted get the score of a count of zero. ``lang`` chooses the words at which phrases end.
    Texts of more than ``max_tokens`` tokens, null and blank ones drop out.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio must lie between 0 and 1, not {ratio}")
    body = T.collapse(F.col(text))
    kept = df.select(key, F.col(text).alias("__text"), body.alias("__body"))
    if max_tokens is not None:
        n = F.aggregate(F.transform(T.sentences(F.col("__body")), lambda s: F.size(T.tokens(s))), F.lit(0), lambda a, x: a + x)
        kept = kept.where(n <= max_tokens)
    kept = kept.repartition(key)  # sentences, tokens and units of a text then never move
    if scorer in ("unigram", "bigram"):
        rows = U.token_rows(kept, key, F.col("__body"))
        if scorer == "unigram":
            tokens = U.scored(rows, U.unigram_model(rows) if model is None else model, complete=model is None)
        else:
            tokens = scorers.bigram_tokens(rows, key, U.bigram_model(rows, key) if model is None else model, complete=model is None)
    else:
        tokens = scorers.model_tokens(U.sentence_rows(kept, key, F.col("__body")), key, scorer)
    if level == "sent":
        arrays = U.unit_arrays(U.sentence_units(tokens, key), key, ["sent_idx"])
    elif level == "phrase":
        arrays = U.unit_arrays(U.phrase_units(tokens, key, lang=lang), key, ["sent_idx", "phrase_idx"])
    else:
        arrays = U.unit_arrays(tokens.withColumnRenamed("token", "text"), key, ["sent_idx", "pos"])
    units = F.col("units")
    made = arrays.select(key, M.masked_text(units, ratio, level, lead, mark).alias("context"), M.masked_units(units, ratio).alias("masked_units"))
    return made.join(kept.select(key, "__body"), key).select(key, "context", "masked_units", M.reduced_ratio(F.col("__body"), F.col("context")).alias("reduced"))


class TextCompressor:
    """Compresses single texts: ``TextCompressor(spark)(text) -> (context, masked units)``."""

    def __init__(self, spark: SparkSession, scorer: str = "unigram", model: DataFrame | None = None, lang: str = "en") -> None:
        self.spark, self.scorer, self.model, self.lang = spark, scorer, model, lang

    def __call__(self, text: str, ratio: float = 0.35, level: str = "phrase") -> tuple[str, list[str]]:
        df = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        row = compress(df, ratio=ratio, level=level, scorer=self.scorer, model=self.model, lang=self.lang).first()
        return (row["context"], list(row["masked_units"])) if row else ("", [])


def main(argv: list[str] | None = None) -> None:
    """Compresses a file, to a file or to the console."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("file")
    p.add_argument("--out")
    p.add_argument("--ratio", type=float, default=0.35)
    p.add_argument("--level", choices=LEVELS, default="phrase")
    p.add_argument("--scorer", default="unigram")
    p.add_argument("--lang", default="en")
    a = p.parse_args(argv)
    from terseforge.runtime import session

    context, masked = TextCompressor(session(), a.scorer, lang=a.lang)(Path(a.file).read_text(encoding="utf-8"), a.ratio, a.level)
    if a.out:
        Path(a.out).write_text(context, encoding="utf-8")
    else:
        print(context)
        print(f"-- {len(masked)} units masked")


if __name__ == "__main__":
    main()
