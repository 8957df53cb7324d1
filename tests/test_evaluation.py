"""Evaluation in one call, line-wise ROUGE, templates, generated questions, the causal model and the experiment."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terseforge.api import compress
from terseforge.operators import causal, scorers
from terseforge.operators import metrics as E
from terseforge.operators import units as U
from terseforge.plans import contexts as X
from terseforge.plans import tasks as K
from terseforge import experiment


def _brute_lcs(a, b):
    return max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if n == 0 or _within(c, b))


def _within(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_lcs_members_are_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(80):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        places = sorted(E.lcs_members(a, b))
        assert len(places) == _brute_lcs(a, b) == E.lcs_length(a, b) and _within([a[k] for k in places], b)


def test_line_wise_rouge():
    # The published example of union subsequences: two lines of the prediction cover four of five words.
    reference, prediction = [list("abcde")], [list("abfgh"), list("acikl")]
    assert math.isclose(E.rouge_l_sum(prediction, reference), 2 * (3 / 10) * (3 / 5) / (3 / 10 + 3 / 5))
    assert E.rouge_l_sum([["a", "b"]], [["a", "b"]]) == 1.0 and E.rouge_l_sum([[]], [["a"]]) == 0.0


def test_evaluate_is_the_sum_of_its_parts(spark):
    rows = [(1, "g", "the cat sat on the mat", "the cat sat on a mat"), (2, "g", "a dog\nran home", "the dog\nran far"), (3, "h", None, "x"), (4, "h", "x y", "x y")]
    df = spark.createDataFrame(rows, "i int, m string, p string, r string")
    got = {r["m"]: r.asDict() for r in E.evaluate(df, "i", "p", "r", by=["m"]).collect()}
    assert set(got["g"]) == {"m", "bleu", "meteor", "rouge1", "rouge2", "rougeL", "rougeLsum"}
    one = [r["f1"] for r in E.rouge_n(df.where("m = 'g'"), "i", "p", "r", 1).collect()]
    assert math.isclose(got["g"]["rouge1"], sum(one) / 2) and got["h"]["rougeL"] == 0.5
    whole = E.evaluate(df, "i", "p", "r").collect()
    assert len(whole) == 1 and math.isclose(whole[0]["rouge1"], (got["g"]["rouge1"] + got["h"]["rouge1"]) / 2)
    assert E.evaluate(df.limit(0), "i", "p", "r", by=["m"]).count() == 0
    with pytest.raises(ValueError):
        E.evaluate(df, "i", "p", "r", ("bertscore",))


def test_templates_are_data(spark):
    df = spark.createDataFrame([("a", "ctx"), ("b", "ctx")], "k string, c string")
    own = {("summarisation", "a"): "<{context}>", ("summarisation", ""): "{context}{context}"}
    assert [r[0] for r in df.select(K.summarise_prompt(F.col("k"), F.col("c"), own)).collect()] == ["<ctx>", "ctxctx"]
    with pytest.raises(ValueError):
        K.prompt("nothing", F.col("k"), context=F.col("c"))


def test_generated_questions(spark):
    rows = ["Question\tAnswer\nWhy?\tSo.\nbroken\nWho?\tShe.\r\nx\ty\tz", "no table", None, "Question\tAnswer", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(K.parsed_questions(F.col("t"))).collect()]
    assert [tuple(q) for q in got[0]] == [("Why?", "So."), ("Who?", "She.")] and got[1] is None and got[2] is None and got[3] == [] and got[4] is None


def test_causal_probabilities_sum_to_one_and_read_the_history():
    model = causal.CausalCounts(["the cat sat", "the cat ran", "a dog ran"])
    vocabulary = {t for c in model.after.values() for t in c}
    for history in ((causal.START, causal.START), (causal.START, "the"), ("the", " cat"), ("x", "y")):
        total = sum(model.probability(history, t) for t in vocabulary) + model.probability(history, "unknown")
        assert math.isclose(total, 1.0)
    assert model.probability(("the", " cat"), " sat") > model.probability(("a", " dog"), " sat")
    for s in ("the cat sat.", "  odd\tblanks ", ""):
        assert "".join(t for t, _ in model.score([s])[0]) == s


def test_causal_scorer_in_compress(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat. A dog ran. The cat ran home."), (2, None)], "doc_id long, text string")
    causal.register(U.sentence_rows(df, "doc_id", F.col("text")), "counts-test")
    row = compress(df, ratio=0.4, level="sent", scorer="counts-test").collect()
    assert len(row) == 1 and len(row[0]["masked_units"]) >= 1
    assert "counts-test" in scorers.MODELS


@pytest.mark.parametrize(("lang", "text", "want"), [("de", "Der Hund von Anna", 4), ("zh", "abc def", 2), ("en", "the old dog of Anna", 4)])
def test_phrases_by_language(spark, lang, text, want):
    rows = U.token_rows(spark.createDataFrame([(1, text)], "k long, t string"), "k", F.col("t")).withColumn("self_info", F.lit(1.0))
    assert U.phrase_units(rows, "k", lang=lang).count() == want
    with pytest.raises(ValueError):
        U.phrase_units(rows, "k", lang="xx")


def test_phrases_cut_in_the_row_equal_those_of_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    sents = U.sentence_rows(docs, "doc_id", F.col("text"))
    tokens = U.token_rows(docs, "doc_id", F.col("text"))
    model = U.unigram_model(tokens)
    cut = U.unit_scores(U.phrases_cut(sents, "doc_id"), ["doc_id", "sent_idx", "phrase_idx"], model, True)
    windows = U.phrase_units(U.scored(tokens, model, complete=True), "doc_id")
    one, two = ({(r["doc_id"], r["sent_idx"], r["phrase_idx"]): (r["text"], round(r["self_info"], 9)) for r in d.collect()} for d in (cut, windows))
    assert one == two and one


def test_experiment(spark):
    rows = [(k, "The cat sat on the mat near the door. " * 2 + f"Dog {k} ran home in the rain.") for k in range(3)]
    texts = spark.createDataFrame(rows, "row_id long, body string")
    found = experiment.run(texts, ratios=(0.2, 0.5), methods=("self-info",), tasks=("reconstruction",)).orderBy("ratio").collect()
    assert [r["ratio"] for r in found] == [0.2, 0.5] and found[0]["rouge1"] >= found[1]["rouge1"] > 0
    from terseforge.sources.writers import performance_lines

    lines = performance_lines(spark.createDataFrame([("qa", 0.2, 0.5)], "task string, ratio double, bleu double"), ["task", "ratio"])
    assert lines == ["task=qa ratio=0.2: bleu 0.5000"]


def test_conversations_over_the_length_drop_out(spark):
    df = spark.createDataFrame([(1, "a b c.", "p", "r"), (2, "a " * 50, "p", "r")], "conv_id long, text string, prompt string, response string")
    assert {(r["conv_id"], r["context_type"], r["context"]) for r in X.conversation_contexts(df, 10).collect()} == {(1, "no", "r"), (1, "no2", "p")}
