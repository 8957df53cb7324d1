"""Prompts of the evaluation tasks, generation behind an interface, and answer clean-up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terseforge.functions import text as T
from terseforge.runtime import small_batches

CHAT = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
FAMILIES = ("flan", "vicuna", "instruct", "base")


def family(model: Column) -> Column:
    """Prompt family of a model's name."""
    m = F.lower(model)
    return F.when(m.contains("flan"), "flan").when(m.contains("vicuna"), "vicuna").when(m.rlike("gpt|alpaca|instruct"), "instruct").otherwise("base")


#: Templates by task and family; {context} and {questions} are filled in. A user's own table may replace them.
TEMPLATES: dict[tuple[str, str], str] = {
    ("summarisation", "flan"): "Summarize: {context}",
    ("summarisation", "vicuna"): CHAT + " USER: Here is the text.\n----\n{context}\n----\nSummarise it in a few sentences. ASSISTANT:",
    ("summarisation", "instruct"): "{context}\n---\nSummarise the text above.",
    ("summarisation", "base"): "{context}\nTl;dr",
    ("questions", ""): "Write questions about the context below, each with its answer, as a table with tabs between the columns Question and Answer and nothing else.\n---\n{context}",
    ("qa", "flan"): "Passage: {context}\nQuestions: {questions}\nAnswers:",
    ("qa", "vicuna"): CHAT + " USER: Passage:\n{context}\nAnswer these questions:\n{questions} ASSISTANT:",
    ("qa", "instruct"): "{context}\nAnswer these questions about the passage:\n{questions}:\n",
    ("qa", "base"): "{context}\nA reader answers these questions about the passage:\n{questions}\nThe answers are:\n",
    ("reconstruction", ""): "Parts of the text were left out. Rebuild the original text.\n---\n{context}",
    ("reconstruction", "vicuna"): CHAT + " USER: Parts of the text were left out. Rebuild the original text.\n{context} ASSISTANT: The original text is:",
    ("reconstruction", "base"): "Noisy paragraph:\n{context}\nThe original paragraph:\n",
    ("continue", ""): CHAT + "\n{context}",
}


def prompt(task: str, kind: Column, templates: dict[tuple[str, str], str] | None = None, **slots: Column) -> Column:
    """The prompt of a task for each row's family; a family without a template takes the task's own ("")."""
    own = {family: t for (name, family), t in (TEMPLATES if templates is None else templates).items() if name == task}
    if not own:
        raise ValueError(f"no template for the task {task!r}")

    def filled(template: str) -> Column:
        parts = [slots[p[1:-1]] if p[:1] == "{" and p[1:-1] in slots else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
        return F.concat(*parts)

    default = own.pop("", None)
    out = F.lit(None).cast("string") if default is None else filled(default)
    for family_, t in own.items():
        out = F.when(kind == family_, filled(t)).otherwise(out)
    return out


def summarise_prompt(kind: Column, context: Column, templates: dict[tuple[str, str], str] | None = None) -> Column:
    """Prompt of the summary task."""
    return prompt("summarisation", kind, templates, context=context)


def question_prompt(context: Column, templates: dict[tuple[str, str], str] | None = None) -> Column:
    """Prompt that asks for questions with their answers; the same for all families."""
    return prompt("questions", F.lit(""), templates, context=context)


def parsed_questions(answer: Column) -> Column:
    """array<struct<question, answer>> of a generated table; lines of another form drop out, a text without the header is null."""
    lines = F.split(F.replace(answer, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    fields = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(x, "\t", -1))
    rows = F.transform(F.filter(fields, lambda x: F.size(x) == 2), lambda x: F.struct(x[0].alias("question"), x[1].alias("answer")))
    return F.when(F.get(lines, F.lit(0)) == "Question\tAnswer", rows)


def numbered(questions: Column) -> Column:
    """Questions of an array, one numbered line each."""
    return F.array_join(F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")


def answer_prompt(kind: Column, context: Column, questions: Column, templates: dict[tuple[str, str], str] | None = None) -> Column:
    """Prompt of the answering task; ``questions`` is the numbered text."""
    return prompt("qa", kind, templates, context=context, questions=questions)


def reconstruct_prompt(kind: Column, context: Column, templates: dict[tuple[str, str], str] | None = None) -> Column:
    """Prompt of the reconstruction task."""
    return prompt("reconstruction", kind, templates, context=context)


def continue_prompt(context: Column, templates: dict[tuple[str, str], str] | None = None) -> Column:
    """Prompt of the conversation task."""
    return prompt("continue", F.lit(""), templates, context=context)


def clean_answer(kind: Column, task: Column, answer: Column) -> Column:
    """What a model's family and task leave of a raw answer.

    Instructed models answer after the first "ASSISTANT:"; base models run on, so their last piece is
    dropped: the last line of a summary (then stripped) or reconstruction, the last paragraph of answers.
    """
    told = F.when(F.instr(answer, "ASSISTANT:") > 0, T.strip(F.substr(answer, F.instr(answer, "ASSISTANT:") + 10))).otherwise(answer)
    base = F.when(task == "summarisation", T.strip(T.last_piece_dropped(answer, "\n"))).when(task == "qa", T.last_piece_dropped(answer, "\n\n")).otherwise(T.last_piece_dropped(answer, "\n"))
    return F.when(kind == "base", base).otherwise(told)


def identity(prompts: pd.Series) -> pd.Series:
    """The default generator: it gives its prompt back."""
    return prompts


GENERATORS: dict[str, Callable[[pd.Series], pd.Series]] = {"identity": identity}


def generated(prompts: DataFrame, prompt: str, model: str = "identity", out: str = "answer") -> DataFrame:
    """Prompts with their answers, in Arrow batches, by a registered generator; other columns stay as they are."""
    make = GENERATORS[model]
    small_batches(prompts.sparkSession)
    at = prompts.columns.index(prompt)
    schema = StructType([*prompts.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array(make(batch.column(at).to_pandas()).tolist(), pa.string(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, said], names=[*batch.schema.names, out])

    return prompts.mapInArrow(run, schema)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose full key has no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
