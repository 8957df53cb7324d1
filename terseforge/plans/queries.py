"""Registered queries of the text-compression operators and the SQL that must give the same rows.

Every query reads its tables whole. Doubles are rounded to six places, integers are bigint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terseforge.api import compress
from terseforge.functions import text as T
from terseforge.operators import masking as M
from terseforge.operators import metrics as E
from terseforge.operators import scorers as S
from terseforge.operators import units as U
from terseforge.plans import contexts as X
from terseforge.plans import conversations as C
from terseforge.plans import reports as R
from terseforge.plans import tasks as K
from terseforge.runtime import shared_folder, table
from terseforge.sources import readers as S_
from terseforge.sources import writers as W

Query = Callable[[SparkSession, str], DataFrame]
RATIOS = (0.2, 0.35, 0.5, 0.65, 0.8)


def _six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _mean(c: str) -> Column:
    """A mean of rounded values, moved off the ties that the order of a sum would decide."""
    return F.round(F.col(c) + 1e-9, 6)


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- cleaning and cutting ---------------------------------------------------------------------


def beautify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("body"))


def strip_citations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("row_id", T.without_citations(F.col("text")).alias("body"))


def latex_comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    source = F.replace(F.col("text"), F.lit("percent"), F.lit("% of"))
    return table(spark, sf, "articles").select("row_id", T.latex_comments_removed(source).alias("body"))


def section_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "articles").select("row_id", F.posexplode(T.sections(F.col("text"))).alias("section_no", "section"))
    return rows.select("row_id", *_big("section_no"), "section")


def doc_id_tail(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("row_id", T.id_tail(F.col("entry_id")).alias("id"))


def published_range(spark: SparkSession, sf: str) -> DataFrame:
    """Articles submitted in a range of days, latest first, at most 8,000: the limit of the crawl."""
    at = F.try_to_timestamp("published", F.lit("yyyyMMddHHmmss"))
    rows = table(spark, sf, "articles").where(F.length("published") == 14).select("row_id", "entry_id", at.alias("at")).where((F.col("at") >= "2023-03-01") & (F.col("at") < "2023-04-01"))
    return rows.orderBy(F.desc("at"), "row_id").limit(8000).select("row_id", "entry_id", F.date_format("at", "yyyyMMddHHmmss").alias("published"))


def _body() -> Column:
    return T.collapse(F.col("text"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The texts dealt out by their key once; sentences, tokens and units of a document then never move."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return U.sentence_rows(_documents(spark, sf), "doc_id", _body())


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("doc_id", *_big("sent_idx"), "sentence")


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(_body())).cast("bigint").alias("n_sentences"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return U.token_rows(_documents(spark, sf), "doc_id", _body())


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("doc_id", *_big("sent_idx", "pos"), "token")


def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return U.token_offsets(_tokens(spark, sf), "doc_id").select("doc_id", *_big("sent_idx", "pos", "start_off", "end_off"))


def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of at most 300 tokens; a null text is dropped."""
    n = F.aggregate(F.transform(T.sentences(_body()), lambda s: F.size(T.tokens(s))), F.lit(0), lambda a, x: a + x)
    return table(spark, sf, "documents").select("doc_id", n.cast("bigint").alias("n_tokens")).where("n_tokens <= 300")


def limit_after_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 documents, in order of id, that pass the length filter."""
    return length_filter(spark, sf).orderBy("doc_id").limit(200)


# --- scores and units -------------------------------------------------------------------------


def unigram_self_info(spark: SparkSession, sf: str) -> DataFrame:
    return U.unigram_model(_tokens(spark, sf)).select("token", "n", _six("self_info").alias("self_info"))


def bigram_self_info(spark: SparkSession, sf: str) -> DataFrame:
    return U.bigram_model(_tokens(spark, sf), "doc_id").select("prev", "token", "n", _six("self_info").alias("self_info"))


def _model(spark: SparkSession, sf: str) -> DataFrame:
    return U.unigram_model(_tokens(spark, sf)).withColumn("self_info", _six("self_info"))


def token_units(spark: SparkSession, sf: str) -> DataFrame:
    return U.scored(_tokens(spark, sf), _model(spark, sf), complete=True).select("doc_id", *_big("sent_idx", "pos"), "token", "self_info")


def sent_units(spark: SparkSession, sf: str) -> DataFrame:
    return U.unit_scores(U.sentences_cut(_sentences(spark, sf), "doc_id"), ["doc_id", "sent_idx"], _model(spark, sf), True).select("doc_id", *_big("sent_idx"), "text", _mean("self_info").alias("self_info"))


def phrase_units(spark: SparkSession, sf: str) -> DataFrame:
    cut = U.phrases_cut(_sentences(spark, sf), "doc_id")
    return U.unit_scores(cut, ["doc_id", "sent_idx", "phrase_idx"], _model(spark, sf), True).select("doc_id", *_big("sent_idx", "phrase_idx"), "text", _mean("self_info").alias("self_info"))


def align_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Self-information of words from a scorer with another cut: pieces of five characters."""
    sents = _sentences(spark, sf)
    width = 5
    count = F.ceil(F.length("sentence") / width).cast("int")
    pieces = sents.select("doc_id", "sent_idx", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("sentence"), i * width + 1, F.lit(width)))).alias("pos", "token")).withColumn("self_info", (F.length(F.regexp_replace("token", "[^a-z]", "")) + 1).cast("double"))
    words = sents.select("doc_id", "sent_idx", F.posexplode(T.tokens(F.col("sentence"))).alias("unit", "text"))
    return U.aligned(pieces, words, ["doc_id", "sent_idx"]).select("doc_id", *_big("sent_idx", "unit"), _mean("self_info").alias("self_info"))


def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and mean number of sentences, phrases and tokens."""
    cut = U.phrases_cut(_sentences(spark, sf), "doc_id")
    per = cut.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("phrases"), F.sum(F.size("toks")).alias("tokens")).groupBy("doc_id").agg(F.count("*").alias("sents"), F.sum("phrases").alias("phrases"), F.sum("tokens").alias("tokens"))
    return per.agg(F.count("*").alias("n_docs"), _six(F.avg("sents")).alias("mean_sents"), _six(F.avg("phrases")).alias("mean_phrases"), _six(F.avg("tokens")).alias("mean_tokens"))


# --- masks --------------------------------------------------------------------------------------

_LEVELS = {"sent": (sent_units, ["sent_idx"]), "phrase": (phrase_units, ["sent_idx", "phrase_idx"])}


def _unit_arrays(level: str, spark: SparkSession, sf: str) -> DataFrame:
    if level == "token":
        rows, order = token_units(spark, sf).withColumnRenamed("token", "text"), ["sent_idx", "pos"]
    else:
        make, order = _LEVELS[level]
        rows = make(spark, sf)
    return U.unit_arrays(rows, "doc_id", order)


def _masked(level: str, spark: SparkSession, sf: str) -> DataFrame:
    docs = _unit_arrays(level, spark, sf)
    return docs.select("doc_id", M.masked_text(F.col("units"), 0.35, level).alias("context"), F.size(M.masked_units(F.col("units"), 0.35)).cast("bigint").alias("n_masked"))


def masked_units(spark: SparkSession, sf: str) -> DataFrame:
    rows = _unit_arrays("sent", spark, sf).select("doc_id", F.posexplode(M.masked_units(F.col("units"), 0.35)).alias("place", "text"))
    return rows.select("doc_id", *_big("place"), "text")


def mask_sent_lead3(spark: SparkSession, sf: str) -> DataFrame:
    return _unit_arrays("sent", spark, sf).select("doc_id", M.masked_text(F.col("units"), 0.35, "sent", 3, M.SENT_MASK).alias("context"))


def mask_random(spark: SparkSession, sf: str) -> DataFrame:
    return _unit_arrays("phrase", spark, sf).select("doc_id", M.randomly_masked(F.col("doc_id"), F.col("units"), 0.35).alias("context"))


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.zip_with("text", F.coalesce("self_info", F.transform("text", lambda _: F.lit(None).cast("double"))), lambda t, s: F.struct(t.alias("text"), s.alias("self_info")))
    return table(spark, sf, "lexical_units").where("text is not null").select("unit_id", "entry_id", "unit_type", pairs.alias("units"))


def threshold_by_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of every stored unit list at all ratios; NaN and null scores do not count."""
    known = _lexical(spark, sf).select("unit_id", M.known_scores(F.col("units")).alias("s"))
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), M.percentile_of(F.col("s"), r).alias("threshold")) for r in RATIOS])).alias("x")
    return known.select("unit_id", grid).select("unit_id", "x.ratio", _six("x.threshold").alias("threshold"))


def _joined(units: Column, level: Column, ratio: float) -> Column:
    return F.when(level == "sent", M.masked_text(units, ratio, "sent")).otherwise(M.masked_text(units, ratio, "phrase"))


def context_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of the stored units by method, level and ratio, and what they save against the unmasked text."""
    rows = _lexical(spark, sf)
    level, units = F.col("unit_type"), F.col("units")
    cells = [F.struct(F.lit("self-info").alias("method"), F.lit(r).alias("ratio"), _joined(units, level, r).alias("context"), F.size(M.masked_units(units, r)).cast("bigint").alias("n_masked")) for r in RATIOS]
    cells += [F.struct(F.lit("Random").alias("method"), F.lit(r).alias("ratio"), M.randomly_masked(F.col("unit_id"), units, r).alias("context"), F.lit(None).cast("bigint").alias("n_masked")) for r in RATIOS]
    cells += [F.struct(F.lit("no").alias("method"), F.lit(0.0).alias("ratio"), F.when(level == "sent", F.array_join(F.transform(units, lambda u: u["text"]), " ")).otherwise(F.array_join(F.transform(units, lambda u: u["text"]), "")).alias("context"), F.lit(0).cast("bigint").alias("n_masked"))]
    grid = rows.select("unit_id", level.alias("level"), F.explode(F.array(*cells)).alias("c"))
    return grid.select("unit_id", "level", "c.method", "c.ratio", "c.context", "c.n_masked")


def _reference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Masked contexts with the unmasked context of their entry; rows sent twice count once."""
    rows = table(spark, sf, "contexts").where("context is not null and dataset_type is not null").select(F.lower(F.trim("dataset_type")).alias("dataset"), "entry_id", "context_type", "mask_ratio", "context_id", "context")
    reference = rows.where("context_type = 'no'").groupBy("dataset", "entry_id").agg(F.min_by("context", "context_id").alias("reference"))
    masked = rows.where("context_type <> 'no'").groupBy("dataset", "entry_id", "context_type", "mask_ratio").agg(F.min_by("context", "context_id").alias("context"), F.min("context_id").alias("context_id"))
    return masked.join(reference, ["dataset", "entry_id"])


def reduced_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _reference_pairs(spark, sf).select("context_id", "dataset", "context_type", "mask_ratio", _six(M.reduced_ratio(F.col("reference"), F.col("context"))).alias("reduced"))


def reduced_ratio_means(spark: SparkSession, sf: str) -> DataFrame:
    return R.mean_by(reduced_ratio(spark, sf), ["dataset", "context_type", "mask_ratio"], ["reduced"]).withColumn("reduced", _mean("reduced"))


def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the experiment that the stored contexts call for: small literal lists, crossed."""
    lists = {"task": ["summarisation", "qa", "reconstruction"], "model": ["gpt-a", "llama-x-7b"], "ratio": list(RATIOS)}
    cells = table(spark, sf, "contexts").where("dataset_type is not null").select(F.lower(F.trim("dataset_type")).alias("dataset")).distinct()
    for name, values in lists.items():
        cells = cells.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return cells


def article_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of the articles' first sections: unmasked, and masked by score at sentence level."""
    texts = X.first_sections(table(spark, sf, "articles").select("row_id", "sections").repartition("row_id"))
    rows = U.token_rows(X.within_length(texts), "row_id", F.col("body"))
    model = U.unigram_model(rows).withColumn("self_info", _six("self_info"))
    made = X.generate_context(texts, "row_id", "no").unionByName(X.generate_context(texts, "row_id", "self-info", "sent", 0.35, model=model))
    return made.select("row_id", "context_type", "context", "context_masked", F.coalesce(F.size("masked_units"), F.lit(-1)).cast("bigint").alias("n_masked"))


def unit_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The units that the printed figure shows: the first fifty and the sixty-one from 361 on."""
    shown = F.concat(F.slice("text", 1, 50), F.slice("text", 361, 61))
    return table(spark, sf, "lexical_units").where("text is not null").select("unit_id", F.array_join(shown, "|").alias("shown"))


# --- conversations ------------------------------------------------------------------------------


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return C.turns_once(table(spark, sf, "conv_turns"))


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", *_big("turn"), T.utterance_line(F.col("role"), F.col("text")).alias("line"))


def conversation_articles(spark: SparkSession, sf: str) -> DataFrame:
    return C.articles(_turns(spark, sf)).select("conv_id", *_big("num_rounds"), "text")


def conversation_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return C.articles(_turns(spark, sf)).select("conv_id", "prompt")


def conversation_last_response(spark: SparkSession, sf: str) -> DataFrame:
    return C.articles(_turns(spark, sf)).select("conv_id", "response")


def conversation_roles(spark: SparkSession, sf: str) -> DataFrame:
    return C.role_units(_turns(spark, sf)).select("conv_id", *_big("turn"), "text", "self_info")


def _conversation_units(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of all turns but the last, headed by role units; utterances keep their white space."""
    turns = _turns(spark, sf)
    last = Window.partitionBy("conv_id")
    kept = turns.withColumn("__last", F.max("turn").over(last)).where("turn < __last").drop("__last")
    said = kept.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text")).withColumn("self_info", _six(F.ln(F.length("text") + 1.0)))
    return said.unionByName(C.role_units(kept).withColumn("pos", F.lit(-1)))


def conversation_units(spark: SparkSession, sf: str) -> DataFrame:
    return _conversation_units(spark, sf).select("conv_id", *_big("turn", "pos"), "text", "self_info")


def conversation_mask(spark: SparkSession, sf: str) -> DataFrame:
    docs = U.unit_arrays(_conversation_units(spark, sf), "conv_id", ["turn", "pos"])
    return docs.select("conv_id", M.masked_text(F.col("units"), 0.5, "sent").alias("context"))


# --- tasks --------------------------------------------------------------------------------------


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contexts").where("context is not null").select("context_id", "context", F.element_at(F.array(*map(F.lit, K.FAMILIES)), (F.col("context_id") % 4 + 1).cast("int")).alias("family"))


def prompts_summarise(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf).select("context_id", "family", K.summarise_prompt(F.col("family"), F.col("context")).alias("prompt"))


def prompts_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf).select("context_id", "family", K.reconstruct_prompt(F.col("family"), F.col("context")).alias("prompt"))


def prompts_continue(spark: SparkSession, sf: str) -> DataFrame:
    return C.articles(_turns(spark, sf)).select("conv_id", K.continue_prompt(F.col("prompt")).alias("prompt"))


def prompts_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry's own questions, numbered in order of their text, under each of its contexts."""
    asked = table(spark, sf, "qa_answers").where("question is not null and entry_id is not null").select("entry_id", "question").distinct()
    lists = asked.groupBy("entry_id").agg(K.numbered(F.array_sort(F.collect_list("question"))).alias("questions"))
    contexts = table(spark, sf, "contexts").where("context is not null").select("context_id", "entry_id", "context")
    kind = F.lit("flan")
    return contexts.join(lists, "entry_id").select("context_id", K.answer_prompt(kind, F.col("context"), F.col("questions")).alias("prompt"))


def postprocess_answers(spark: SparkSession, sf: str) -> DataFrame:
    kind = K.family(F.col("model_type"))
    return table(spark, sf, "qa_answers").where("answer is not null").select("answer_id", kind.alias("family"), K.clean_answer(kind, F.col("task_name"), F.col("answer")).alias("answer"))


def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """Entries, context types and ratios of the contexts for which no answer is stored."""
    keys = ["entry_id", "context_type", "mask_ratio"]
    work = table(spark, sf, "contexts").select(*keys).where("entry_id is not null").distinct()
    return K.pending(work, table(spark, sf, "qa_answers").where("answer is not null"), keys)


def generated_reconstructions(spark: SparkSession, sf: str) -> DataFrame:
    """Reconstructions by the default generator, which gives its prompt back."""
    return K.generated(prompts_reconstruct(spark, sf), "prompt").select("context_id", "answer")


# --- metrics and reports --------------------------------------------------------------------------


def _answer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers given under masked contexts with the answer of the same model under the unmasked one.

    Rows sent twice count once, pairs with a null on either side drop out.
    """
    rows = table(spark, sf, "qa_answers").where("answer is not null and question is not null and dataset_type is not null").select("answer_id", F.lower(F.trim("dataset_type")).alias("dataset"), "entry_id", "context_type", "mask_ratio", "task_name", "model_type", "question", "answer")
    cell = ["dataset", "entry_id", "task_name", "model_type", "question"]
    reference = rows.where("context_type = 'no'").groupBy(*cell).agg(F.min_by("answer", "answer_id").alias("reference"))
    other = rows.where("context_type <> 'no'").groupBy(*cell, "context_type", "mask_ratio").agg(F.min_by("answer", "answer_id").alias("answer"), F.min("answer_id").alias("answer_id"))
    return other.join(reference, cell)


def answer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _answer_pairs(spark, sf).select("answer_id", "dataset", "task_name", "context_type", "mask_ratio", "answer", "reference")


def _rouge(n: int, spark: SparkSession, sf: str) -> DataFrame:
    scored = E.rouge_n(_reference_pairs(spark, sf), "context_id", "context", "reference", n)
    return scored.select("context_id", *[_six(c).alias(c) for c in ("precision", "recall", "f1")])


def bleu(spark: SparkSession, sf: str) -> DataFrame:
    scored = E.corpus_bleu(_reference_pairs(spark, sf), "context_id", "context", "reference", ["context_type"])
    return scored.select("context_type", *[_six(c).alias(c) for c in ("p1", "p2", "p3", "p4", "brevity", "bleu")])


def ordered_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = E.ordered_metrics(_reference_pairs(spark, sf), "context_id", "context", "reference")
    return scored.select("context_id", _six("rougeL").alias("rougeL"), _six("meteor").alias("meteor"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of every masked context, with its cell."""
    pairs = _reference_pairs(spark, sf).withColumnsRenamed({"context_type": "method", "mask_ratio": "ratio"})
    return E.rouge_f1(pairs, "context_id", "context", "reference", (1, 2), ("dataset", "method", "ratio"))


def by_ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    means = R.mean_by(_cells(spark, sf), ["method", "ratio"], ["rouge1", "rouge2"])
    return means.select("method", "ratio", _six("rouge1").alias("rouge1"), _six("rouge2").alias("rouge2"))


def _method_means(spark: SparkSession, sf: str) -> DataFrame:
    return R.mean_by(_cells(spark, sf), ["method", "dataset"], ["rouge1", "rouge2"])


def method_task_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Means per method and dataset, and each method's unweighted mean over datasets."""
    rows = R.with_average_row(_method_means(spark, sf), "method", "dataset", ["rouge1", "rouge2"])
    return rows.select("method", "dataset", _six("rouge1").alias("rouge1"), _six("rouge2").alias("rouge2"))


def gap_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.gaps(_method_means(spark, sf), "method", "dataset", "no2", ["rouge1", "rouge2"])
    return rows.select("method", "dataset", *[_six(c).alias(c) for c in ("rouge1", "rouge2", "gap_rouge1", "gap_rouge2")])


def gap_table_fmt(spark: SparkSession, sf: str) -> DataFrame:
    rows = gap_table(spark, sf)
    return rows.select("method", "dataset", R.formatted(F.col("rouge1"), F.col("gap_rouge1")).alias("rouge1"))


def transpose_metrics(spark: SparkSession, sf: str) -> DataFrame:
    means = R.mean_by(_cells(spark, sf), ["method"], ["rouge1", "rouge2"])
    rows = R.transposed(means, "method", ["rouge1", "rouge2"], ["self-info", "Random", "no2"])
    return rows.select("metric", *[_six(c).alias(n) for c, n in (("self-info", "self_info"), ("Random", "random"), ("no2", "no2"))])


def _answer_cells(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-1 of every answer under a masked context against the answer under the unmasked one."""
    pairs = _answer_pairs(spark, sf).withColumnsRenamed({"task_name": "task", "context_type": "method", "mask_ratio": "ratio"})
    return E.rouge_f1(pairs, "answer_id", "answer", "reference", (1,), ("dataset", "task", "method", "ratio"))


def task_ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.mean_by(_answer_cells(spark, sf), ["method", "task", "ratio"], ["rouge1"]).withColumn("rouge1", _six("rouge1"))


def source_ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.mean_by(_answer_cells(spark, sf), ["method", "dataset", "ratio"], ["rouge1"]).withColumn("rouge1", _six("rouge1"))


def random_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Random contexts replaced by the context of the other ratio where the entry has one, else kept."""
    rows = _reference_pairs(spark, sf).where("context_type = 'Random'").select("context_id", "dataset", "entry_id", "mask_ratio", "context")
    other = rows.where("mask_ratio = 0.5").groupBy("dataset", "entry_id").agg(F.min_by("context", "context_id").alias("other"))
    return rows.join(other, ["dataset", "entry_id"], "left").select("context_id", F.coalesce("other", "context").alias("context"))


def _lexical_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf).where("unit_type = 'sent'").select("unit_id", F.posexplode("units").alias("pos", "u")).select("unit_id", "pos", "u.text", F.when(~F.isnan("u.self_info"), F.col("u.self_info")).alias("self_info")).where("self_info is not null")


def unit_score_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lexical_rows(spark, sf).groupBy("unit_id").agg(F.min("self_info").alias("low"), F.max("self_info").alias("high"), F.percentile("self_info", F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    return rows.select("unit_id", *[_six(c).alias(c) for c in ("low", "high", "median")], "n")


def heat_units(spark: SparkSession, sf: str) -> DataFrame:
    return R.heat(_lexical_rows(spark, sf), "unit_id", ["pos"]).select("unit_id", *_big("pos"), F.round("heat", 3).alias("heat"), "high")


def heatmap_latex(spark: SparkSession, sf: str) -> DataFrame:
    return R.heat_map(R.heat(_lexical_rows(spark, sf), "unit_id", ["pos"]), "unit_id", ["pos"])


def low_score_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of neighbouring sentences under the document's median."""
    rows = _lexical_rows(spark, sf).withColumn("limit", F.percentile("self_info", F.lit(0.5)).over(Window.partitionBy("unit_id")))
    return R.low_runs(rows, "unit_id", "pos", "limit").select("unit_id", *_big("first", "last", "n"))


def resume_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Articles that the stored units do not cover yet: what a resumed run still has to score."""
    return K.pending(table(spark, sf, "articles").select("row_id", "entry_id"), table(spark, sf, "lexical_units").where("unit_type = 'sent'"), ["entry_id"])


def conversation_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of the conversations of at most 1,800 tokens: last response and prompt."""
    return X.conversation_contexts(C.articles(_turns(spark, sf)))


def prompts_question(spark: SparkSession, sf: str) -> DataFrame:
    """What asks for questions about the unmasked contexts."""
    return table(spark, sf, "contexts").where("context is not null and context_type = 'no'").select("context_id", K.question_prompt(F.col("context")).alias("prompt"))


def question_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Questions read back from generated tables: here one table of each task's stored questions, with a broken line."""
    rows = table(spark, sf, "question_bank").groupBy("task_name").agg(F.array_sort(F.collect_list(F.struct("question_id", "question"))).alias("q"))
    text = F.concat(F.lit("Question\tAnswer\nbroken line\n"), F.array_join(F.transform("q", lambda x: F.concat(x["question"], F.lit("\t"), x["question_id"].cast("string"))), "\n"))
    parsed = rows.select("task_name", F.posexplode(K.parsed_questions(text)).alias("place", "r"))
    return parsed.select("task_name", *_big("place"), "r.question", "r.answer")


def _at_ratio(spark: SparkSession, sf: str, ratio: float = 0.35) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of the answers under contexts of one ratio."""
    pairs = _answer_pairs(spark, sf).where(F.col("mask_ratio") == ratio).withColumnsRenamed({"task_name": "task", "context_type": "method"})
    return E.rouge_f1(pairs, "answer_id", "answer", "reference", (1, 2), ("task", "method"))


def pooled_table(spark: SparkSession, sf: str) -> DataFrame:
    """Means over all tasks at ratio 0.35."""
    return R.mean_by(_at_ratio(spark, sf), ["method"], ["rouge1", "rouge2"]).select("method", _mean("rouge1").alias("rouge1"), _mean("rouge2").alias("rouge2"))


def task_table(spark: SparkSession, sf: str) -> DataFrame:
    """Means per task at ratio 0.35; the unmasked comparison has no reconstruction."""
    rows = _at_ratio(spark, sf).where(~((F.col("method") == "no2") & (F.col("task") == "reconstruction")))
    return R.mean_by(rows, ["method", "task"], ["rouge1", "rouge2"]).select("method", "task", _mean("rouge1").alias("rouge1"), _mean("rouge2").alias("rouge2"))


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of the masked contexts against the unmasked ones, by method."""
    found = E.evaluate(_reference_pairs(spark, sf), "context_id", "context", "reference", by=["context_type"])
    return found.select("context_type", *[_six(c).alias(c) for c in found.columns[1:]])


def causal_self_info(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the articles' titles scored one after the other by a causal count model of their sentences."""
    from terseforge.operators import causal

    titles = table(spark, sf, "articles").where("title is not null").select("row_id", F.col("title").alias("body")).repartition("row_id")
    sents = U.sentence_rows(titles, "row_id", F.col("body"))
    causal.register(sents, "counts")
    return S.model_tokens(sents, "row_id", "counts").select("row_id", *_big("sent_idx", "pos"), "token", _six("self_info").alias("self_info"))


# --- files: what is written must come back ---------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def metrics_file(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics written as CSV and read back."""
    path = _folder(spark, "metrics")
    W.write_metrics(reduced_ratio_means(spark, sf), path)
    return S_.result_table(spark, path, "dataset")


def conversation_file(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as JSON lines and read back, those of four or more rounds."""
    path = _folder(spark, "conversations")
    W.write_conversations(_turns(spark, sf), path)
    return S_.conversation_lines(spark, path).select(F.col("id").cast("bigint").alias("conv_id"), *_big("num_rounds", "turn"), "role", "text")


def news_file(spark: SparkSession, sf: str) -> DataFrame:
    """News written as JSON lines and read back."""
    path = _folder(spark, "news")
    W.write_news(table(spark, sf, "news"), path)
    return S_.news_file(spark, path)


def token_file(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus model's tokens written with tabs and read back."""
    path = _folder(spark, "tokens")
    W.write_tokens(unigram_self_info(spark, sf), path)
    return S_.token_file(spark, path)


def article_file(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written as JSON lines and read back."""
    path = _folder(spark, "articles")
    W.write_articles(table(spark, sf, "articles").select("entry_id", "published", "title", "authors", "primary_category", "categories", "text"), path)
    lists = [F.array_join(c, "|").alias(c) for c in ("authors", "categories")]
    return S_.article_files(spark, path, lines=True).select("entry_id", "published", "title", "primary_category", "text", *lists)


def question_file(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written as one tab-separated file for each task and read back in order."""
    path = _folder(spark, "questions")
    W.write_questions(table(spark, sf, "question_bank").withColumn("answer", F.col("question_id").cast("string")), path, "task_name", "question_id")
    found = S_.question_files(spark, f"{path}/*")
    return found.select(F.regexp_extract("file", "task_name=([^/]+)", 1).alias("task_name"), F.array_join("questions", "|").alias("questions"), F.array_join("answers", "|").alias("answers"))


def compress_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The public entry: every document without its least informative tokens, under a frozen model."""
    made = compress(table(spark, sf, "documents"), "doc_id", "text", 0.35, "token", model=_model(spark, sf))
    return made.select("doc_id", "context", F.size("masked_units").cast("bigint").alias("n_masked"), _six("reduced").alias("reduced"))


def chat_table(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in the published form, each pair of role and text as one line."""
    chats = W.chat_table(_turns(spark, sf), "conv_id")
    return chats.select("conv_id", F.array_join(F.transform("chat", lambda x: F.array_join(x, "|")), "\n").alias("chat"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    from terseforge.sources.html import plain_text

    raw = _turns(spark, sf)
    return raw.select("conv_id", *_big("turn"), F.when(F.col("role") == "human", F.col("text")).otherwise(plain_text("text")).alias("text"))


def stream_compress(spark: SparkSession, sf: str) -> DataFrame:
    """The documents read as a stream, compressed by in-row expressions and written batch by batch."""
    from terseforge.streaming.compress import compress_stream_once

    return compress_stream_once(spark, f"{sf}/documents.parquet", "doc_id", "text", 0.35)


def queries() -> dict[str, Query]:
    named = (
        beautify, strip_citations, latex_comment_strip, section_split, doc_id_tail, published_range, sentence_split, sentence_counts, tokenize, token_offsets, length_filter, limit_after_filter,
        unigram_self_info, bigram_self_info, token_units, sent_units, phrase_units, align_tokens, dataset_stats, masked_units, mask_sent_lead3, mask_random, threshold_by_ratio, context_grid, reduced_ratio, reduced_ratio_means, experiment_grid, article_contexts, unit_slice,
        conversation_lines, conversation_articles, conversation_prompt, conversation_last_response, conversation_roles, conversation_units, conversation_mask,
        prompts_summarise, prompts_reconstruct, prompts_continue, prompts_qa, postprocess_answers, pending_work, generated_reconstructions, answer_pairs, bleu, ordered_metrics, by_ratio_table, method_task_avg, gap_table, gap_table_fmt, transpose_metrics, task_ratio_table, source_ratio_table, random_repair,
        unit_score_stats, heat_units, heatmap_latex, low_score_runs, resume_scoring, html_text, stream_compress,
        conversation_contexts, prompts_question, question_tables, pooled_table, task_table, evaluation, causal_self_info, metrics_file, conversation_file, news_file, token_file, chat_table, article_file, question_file, compress_tokens,
    )
    out: dict[str, Query] = {f.__name__: f for f in named}
    out |= {f"mask_{level}": partial(_masked, level) for level in ("sent", "phrase", "token")}
    out |= {f"rouge{n}": partial(_rouge, n) for n in (1, 2)}
    return out


def oracle_sql() -> dict[str, str]:
    from terseforge.plans.oracle import statements

    return statements()
