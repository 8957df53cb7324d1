"""Contexts of articles and conversations by method, level and ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseforge.functions import text as T
from terseforge.operators import masking as M
from terseforge.operators import units as U

METHODS = ("no", "no2", "self-info", "Random")
LEVELS = ("sent", "phrase", "token")
#: Texts of more tokens are left out, when units are scored and again when contexts are made.
MAX_TOKENS = 1800


def first_sections(articles: DataFrame, key: str = "row_id", sections: str = "sections") -> DataFrame:
    """``key``, body: the only section that is scored, cleaned; articles without one drop out."""
    body = T.without_citations(F.try_element_at(sections, F.lit(1)))
    return articles.select(key, body.alias("body")).where(T.strip(F.col("body")) != "")


def token_count(body: Column) -> Column:
    """Tokens of a text over its sentences."""
    return F.aggregate(F.transform(T.sentences(body), lambda s: F.size(T.tokens(s))), F.lit(0), lambda a, x: a + x)


def within_length(texts: DataFrame, body: str = "body", most: int = MAX_TOKENS) -> DataFrame:
    """Texts of at most ``most`` tokens; null texts drop out."""
    return texts.where(token_count(F.col(body)) <= most)


def scored_units(texts: DataFrame, key: str, level: str, body: str = "body", model: DataFrame | None = None) -> DataFrame:
    """``key`` and the array of units of a level, scored by a model table or by the texts' own unigrams."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    placed = texts.repartition(key)  # sentences, tokens and units of a text then never move
    rows, sents = U.token_rows(placed, key, F.col(body)), U.sentence_rows(placed, key, F.col(body))
    complete = model is None
    model = U.unigram_model(rows) if complete else model
    if level == "sent":
        return U.unit_arrays(U.unit_scores(U.sentences_cut(sents, key), [key, "sent_idx"], model, complete), key, ["sent_idx"])
    if level == "phrase":
        return U.unit_arrays(U.unit_scores(U.phrases_cut(sents, key), [key, "sent_idx", "phrase_idx"], model, complete), key, ["sent_idx", "phrase_idx"])
    tokens = U.scored(rows, model, complete=complete)
    return U.unit_arrays(tokens.withColumnRenamed("token", "text"), key, ["sent_idx", "pos"])


def generate_context(texts: DataFrame, key: str, method: str, level: str = "sent", ratio: float = 0.2, limit: int | None = None, body: str = "body", model: DataFrame | None = None, most: int = MAX_TOKENS, lead: int = 3, mark: str = M.SENT_MASK) -> DataFrame:
    """``key``, context_type, context, context_masked, masked_units (null where nothing is masked by score).

    ``limit`` counts results, after the length filter, in order of the key.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    kept = within_length(texts, body, most)
    if limit is not None:
        kept = kept.orderBy(key).limit(limit)
    none = F.lit(None).cast("array<string>")
    if method in ("no", "no2"):
        made = kept.select(key, F.col(body).alias("context"), none.alias("masked_units"))
    else:
        units = F.col("units")
        arrays = scored_units(kept, key, level, body, model)
        if method == "Random":
            made = arrays.select(key, M.randomly_masked(F.col(key), units, ratio, level).alias("context"), none.alias("masked_units"))
        else:
            made = arrays.select(key, M.masked_text(units, ratio, level, lead if level == "sent" else 0, mark if level == "sent" else "").alias("context"), M.masked_units(units, ratio).alias("masked_units"))
    return made.select(key, F.lit(method).alias("context_type"), "context", F.lit(method != "no").alias("context_masked"), "masked_units")


def context_scored_sentences(texts: DataFrame, key: str, body: str, model: DataFrame) -> DataFrame:
    """``key``, unit, self_info of sentences when a text is scored as a whole.

    Tokens are those of the whole text, and sentences are credited by alignment over the text, not
    one by one.
    """
    text = T.strip(T.collapse(F.col(body)))
    tokens = texts.select(key, F.posexplode(T.tokens(text)).alias("pos", "token"))
    scored = U.scored(tokens, model)
    parts = T.sentences(text)
    glued = F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit(" "), s)))
    units = texts.select(key, F.posexplode(glued).alias("unit", "text"))
    return U.aligned(scored, units, [key])


def conversation_contexts(articles: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """conv_id, context_type, context, context_masked of conversations: "no" is the last response, "no2" the prompt.

    Conversations whose whole text, the last response included, has more than ``most`` tokens drop out.
    """
    kept = articles.where(token_count(F.col("text")) <= most)
    cells = F.explode(F.array(F.struct(F.lit("no").alias("context_type"), F.col("response").alias("context"), F.lit(False).alias("context_masked")), F.struct(F.lit("no2").alias("context_type"), F.col("prompt").alias("context"), F.lit(True).alias("context_masked"))))
    return kept.select("conv_id", cells.alias("c")).select("conv_id", "c.context_type", "c.context", "c.context_masked")
