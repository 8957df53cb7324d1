"""Readers, writers, LaTeX, the scorer interface, streaming and the public entry."""

import json

import pytest
from pyspark.sql import functions as F

from terseforge.api import TextCompressor, compress
from terseforge.operators import scorers
from terseforge.sources import readers, tex, writers
from terseforge.streaming.compress import compressed


def test_article_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"entry_id": f"http://x/{k}", "title": "t", "text": f"§ A {k}", "published": "20230301120000", "authors": ["a"]}, indent=1))
    assert [r["text"] for r in readers.article_files(spark, str(tmp_path), 2).orderBy("file").collect()] == ["§ A 0", "§ A 1"]
    assert readers.submitted(readers.article_files(spark, str(tmp_path)), "2023-03-01", "2023-03-02", 2).count() == 2


def test_conversation_limit_lets_one_more_through(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text("\n".join(json.dumps({"id": str(k), "conversations": [{"from": "human", "value": "x"}] * (3 + k % 3)}) for k in range(12)))
    rows = readers.conversation_lines(spark, str(path), limit=3)
    assert rows.select("id").distinct().count() == 4 and rows.where("num_rounds < 4").count() == 0


def test_question_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Question\tAnswer\nq1\ta1\nq2\ta2\n")
    (tmp_path / "b.tsv").write_text("Question\tAnswer\n")
    got = {r["file"].rsplit("/", 1)[1]: r["questions"] for r in readers.question_files(spark, str(tmp_path)).collect()}
    assert got == {"a.tsv": ["q1", "q2"], "b.tsv": None}


def test_result_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.2, 0.5), (0.35, 0.25)], "ratio double, bleu double")
    writers.write_metrics(df, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.result_table(spark, str(tmp_path / "m"), "r").collect())) == [(0.2, 0.5), (0.35, 0.25)]
    assert r"\toprule" in writers.latex_table(df)


def test_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    writers.write_scored(df.where("id = 1"), str(tmp_path / "s"))
    assert [r["id"] for r in writers.unscored(df, str(tmp_path / "s"), "id").collect()] == [2]


def test_answers_share_the_unmasked_partition(spark, tmp_path):
    df = spark.createDataFrame([("d", "m", "qa", 0.2, "no", "x"), ("d", "m", "qa", 0.2, "self-info", "y")], "dataset string, model string, task string, ratio double, context_type string, answer string")
    writers.write_answers(df, str(tmp_path / "a"))
    got = {r["answer"]: r["ratio"] for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert got == {"x": None, "y": 0.2}


def test_tex():
    files = {"main.tex": "\\begin{document}\\section{One} A % note\n\\input{sub/b} 5\\% of~it \\cite{k}.\\end{document}", "sub/b.tex": "B \\input{c}", "sub/c.tex": "\\begin{table}x\\end{table}C \\input{c}"}
    whole = tex.inlined(files, "main.tex")
    assert "note" not in whole and "B" in whole and "C" in whole
    text = tex.tex_to_text(whole)
    assert text.startswith("§ One") and "5% of it <cit.>." in text and "x" not in text
    assert tex.tex_to_text(None) is None


def test_main_tex(spark):
    df = spark.createDataFrame([("a", "x.tex"), ("b", "main.tex"), ("b", "y.tex"), ("c", "p.tex"), ("c", "q.tex"), ("d", "n.txt")], "doc string, name string")
    assert sorted(map(tuple, readers.main_tex(df, "doc", "name").collect())) == [("a", "x.tex"), ("b", "main.tex")]


@pytest.mark.parametrize("scorer", ["unigram", "bigram", "letters"])
def test_compress_levels(spark, scorer):
    scorers.register("letters", lambda: lambda batch: [[(c, float(ord(c) % 7)) for c in s] for s in batch])
    df = spark.createDataFrame([(1, "The cat sat. A dog ran there? The cat ran."), (2, ""), (3, None), (4, "One.")], "doc_id long, text string")
    for level in ("sent", "phrase", "token"):
        rows = {r["doc_id"]: r for r in compress(df, ratio=0.5, level=level, scorer=scorer).collect()}
        assert set(rows) == {1, 4} and rows[4]["context"] == "One." or level != "sent"
        assert compress(df, ratio=0.0, level=level, scorer=scorer).where("size(masked_units) > 0").count() == 0
    few = compress(df, ratio=0.2, level="token", scorer=scorer).where("doc_id = 1").first()["masked_units"]
    many = compress(df, ratio=0.8, level="token", scorer=scorer).where("doc_id = 1").first()["masked_units"]
    assert len(few) <= len(many)


def test_compressor_checks_its_arguments(spark):
    one = TextCompressor(spark)
    context, masked = one("A b c. D e f. G h.", 0.5, "sent")
    assert context and isinstance(masked, list)
    assert one("") == ("", [])
    with pytest.raises(ValueError, match="level"):
        one("x", level="page")
    with pytest.raises(ValueError, match="ratio"):
        one("x", ratio=2)
    with pytest.raises(ValueError, match="scorer"):
        TextCompressor(spark, "absent")("x. y.")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, f"A sentence {k}. Another longer sentence here. Short.") for k in range(20)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    from terseforge.streaming.compress import compress_stream_once

    streamed = compress_stream_once(spark, str(tmp_path / "in"), "doc_id", "text", 0.35, out=str(tmp_path / "out"))
    batch = compressed(df, "doc_id", "text", 0.35)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    again = compress_stream_once(spark, str(tmp_path / "in"), "doc_id", "text", 0.35, out=str(tmp_path / "out"))
    assert again.count() == batch.count()


def test_rest_stands_without_the_llm_folder():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "terseforge"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("terseforge.llm") for n in names), p
    assert F is not None
