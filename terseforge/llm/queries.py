"""Registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terseforge.llm.answers import defective_pairs
from terseforge.llm.langid import document_languages, label_faults
from terseforge.llm.leaks import leaks
from terseforge.llm.neardup import groups, near_duplicates, record_pairs
from terseforge.llm.pii import personal_data, redacted
from terseforge.llm.pieces import cut_levels, file_places, item_places, item_summaries, piece_offsets
from terseforge.llm.sentences import sentence_units
from terseforge.llm.tokens import mixture, token_counts
from terseforge.runtime import shared_folder, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs whose answer is unusable, with the type of the defect."""
    contexts = table(spark, sf_dir, "contexts").select(F.col("context_id").alias("id"), F.col("context").alias("text"), "lang")
    questions = table(spark, sf_dir, "question_bank").select(F.col("question_id").alias("id"), F.col("question").alias("text"), "lang")
    return defective_pairs(spread(table(spark, sf_dir, "qa_answers").select("answer_id", "question", "answer")), [contexts, questions])


RECORD = ["record_table", "id"]


def _record_duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates of articles and of whole conversations: three words, similarity 0.6."""
    articles = spread(table(spark, sf_dir, "articles").select("row_id", "text")).select(F.lit("articles").alias("record_table"), F.col("row_id").alias("id"), "text", F.lit(False).alias("markup"))
    turns = table(spark, sf_dir, "conv_turns").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    # Rows sent twice fall together before the shuffle; should their texts differ, one of them counts.
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "text"))).alias("said"))
    once = F.filter("said", lambda x, i: (i == 0) | ~x["turn"].eqNullSafe(F.get("said", i - 1)["turn"]))
    conversations = said.select(F.lit("conv_turns").alias("record_table"), F.col("conv_id").alias("id"), F.array_join(F.transform(once, lambda x: x["text"]), " ").alias("text"), F.lit(True).alias("markup"))
    return near_duplicates(articles.unionByName(conversations), RECORD, "text", threshold=0.6, size=3, markup="markup")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share at least 0.6 of their runs of three words, copies included."""
    return record_pairs(*_record_duplicates(spark, sf_dir), RECORD)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's group of near-duplicates and number of links."""
    return groups(*_record_duplicates(spark, sf_dir), RECORD)


UTTERANCE = ["record_table", "record_id", "turn"]


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored utterance of the turns and of the conversation articles."""
    turns = spread(table(spark, sf_dir, "conv_turns").select("turn_id", "turn", "text")).select(F.lit("conv_turns").alias("record_table"), F.col("turn_id").alias("record_id"), F.col("turn").cast("int").alias("turn"), "text")
    said = table(spark, sf_dir, "conversation_articles").select("conv_id", F.posexplode("context").alias("turn", "c"))
    return turns.unionByName(said.select(F.lit("conversation_articles").alias("record_table"), F.col("conv_id").alias("record_id"), "turn", F.col("c.utterance").alias("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal data in the stored utterances."""
    return personal_data(_utterances(spark, sf_dir), UTTERANCE, "text")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance with typed placeholders in the place of its personal data."""
    return redacted(_utterances(spark, sf_dir), UTTERANCE, "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit of the articles and of the sentence rows of lexical_units."""
    articles = spread(table(spark, sf_dir, "articles").select("row_id", "text")).select(F.lit("articles").alias("record_table"), F.col("row_id").alias("record_id"), "text")
    units = (
        table(spark, sf_dir, "lexical_units")
        .where(F.col("unit_type") == "sent")
        .select(F.lit("lexical_units").alias("record_table"), F.col("unit_id").alias("record_id"), F.array_join("text", " ").alias("text"))
    )
    return sentence_units(articles.unionByName(units), "record_id", "text", keep=("record_table",))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item: article texts, their sections, contexts."""
    articles, contexts = table(spark, sf_dir, "articles"), table(spark, sf_dir, "contexts")

    def items(df: DataFrame, name: str, key: str, section: Column, text: str) -> DataFrame:
        return df.select(F.lit(name).alias("item_table"), F.col(key).alias("item_id"), section.cast("int").alias("section_no"), F.col(text).alias("text"))

    sections = articles.select("row_id", F.posexplode("sections").alias("no", "section"))
    every = [items(articles, "articles", "row_id", F.lit(-1), "text"), items(sections, "sections", "row_id", F.col("no"), "section"), items(contexts, "contexts", "context_id", F.lit(-1), "context")]
    return every[0].unionByName(every[1]).unionByName(every[2])


ITEM = ["item_table", "item_id", "section_no"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over 6,000 characters and the coarsest boundary that alone brings them under it."""
    return cut_levels(item_summaries(_items(spark, sf_dir), ITEM, "text"), ITEM)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the items over 6,000 characters, by offset."""
    return piece_offsets(item_places(_items(spark, sf_dir), ITEM, "text"), ITEM)


#: Giant files that ``p5_files`` makes of the articles.
FILES = 4


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of giant files, read by byte range: all articles, written one after the other to a few files in the shared folder."""
    folder = f"{shared_folder(spark)}/giant-files-{uuid.uuid4().hex}"
    texts = table(spark, sf_dir, "articles").where(F.col("text").isNotNull()).select(F.pmod("row_id", F.lit(FILES)).alias("file"), "row_id", F.concat(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n")).alias("value"))
    texts.repartition("file").sortWithinPartitions("file", "row_id").select("file", "value").write.partitionBy("file").text(folder)
    pieces = piece_offsets(file_places(spark, folder), ["path"])
    return pieces.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file"), "piece_no", "start_pos", "end_pos", "cut_level")


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every context."""
    return token_counts(table(spark, sf_dir, "contexts"), ["context_id"], "context")


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens by dataset_type, language and domain, of all rows and of each source text once.

    A source text is an entry of a dataset; of its contexts the longest in tokens stands for it (the
    unreduced one). Dataset types are matched without case, outer blanks; languages by their first
    two letters; what is null is "unknown". Contexts are added up per entry before the domain is joined.
    """
    named = table(spark, sf_dir, "contexts").select(
        "context_id", "context", "entry_id",
        F.coalesce(F.nullif(F.lower(F.trim("dataset_type")), F.lit("")), F.lit("unknown")).alias("dataset_type"),
        F.coalesce(F.nullif(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("")), F.lit("unknown")).alias("lang"),
    )
    counts = token_counts(named, ["context_id", "dataset_type", "lang", "entry_id"], "context")
    per_entry = counts.groupBy("dataset_type", "lang", "entry_id").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.max(F.struct("n_tokens", (-F.col("context_id")).alias("k"))).alias("longest"))
    # An entry comes in few languages; the one of its longest text carries the source text.
    top = F.max(F.struct("longest", "lang")).over(Window.partitionBy("dataset_type", "entry_id"))
    chosen = per_entry.withColumn("source_text", F.struct("longest", "lang") == top)
    domains = table(spark, sf_dir, "articles").where(F.col("primary_category").isNotNull()).groupBy("entry_id").agg(F.max_by("primary_category", F.struct("crawled_at", "row_id")).alias("domain"))
    joined = chosen.join(domains, "entry_id", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    scopes = F.explode(F.array_compact(F.array(F.struct(F.lit("all_rows").alias("scope"), "n_texts", "n_tokens"), F.when(F.col("source_text"), F.struct(F.lit("source_texts").alias("scope"), F.lit(1).cast("bigint").alias("n_texts"), F.col("longest.n_tokens").alias("n_tokens"))))))
    both = joined.select("dataset_type", "lang", "domain", scopes.alias("s")).select("dataset_type", "lang", "domain", "s.scope", "s.n_texts", "s.n_tokens")
    return both.groupBy("scope", "dataset_type", "lang", "domain").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents that make up the mixture."""
    return mixture(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixture(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), table(spark, sf_dir, "mix_targets"))[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and evaluation items with twelve or more consecutive words in common."""
    return p7_leaks(spark, sf_dir).where(F.col("kind") == "verbatim").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of every document, verbatim or re-parameterised, with their windows."""
    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents in several languages, or whose label is missing or wrong."""
    return label_faults(document_languages(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), "doc_id", "text", "lang"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_files": p5_files, "p6_budget": p6_budget, "p6_tokens": p6_tokens, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p7_found": p7_found, "p7_leaks": p7_leaks, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {}
