"""LaTeX sources: comments removed, inputs put in their place, markup read as text."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Environments that hold no prose, and commands whose argument is none.
DROPPED = ("figure", "figure*", "algorithm", "table", "table*", "algorithmic")
SILENT = ("label", "includegraphics", "bibliography", "bibliographystyle", "usepackage", "documentclass", "vspace", "hspace", "input", "href")

_COMMENT = re.compile(r"(?<!\\)%.*")
_INPUT = re.compile(r"\\(?:input|include)\{([^}]*)\}")


def inlined(files: dict[str, str], name: str, seen: tuple[str, ...] = ()) -> str:
    """A file's source with its inputs in their place, relative to the file that asks for them.

    Comments go only where a source asks for inputs. A file that is missing leaves nothing, and one
    that includes itself is read once.
    """
    text = files.get(name, "")
    if "\\input" not in text and "\\include{" not in text:
        return text
    text = _COMMENT.sub("", text)
    here = posixpath.dirname(name)

    def put(m: re.Match) -> str:
        target = posixpath.normpath(posixpath.join(here, m[1].strip()))
        target = target if target in files or target.endswith(".tex") else target + ".tex"
        return "" if target in seen or target == name else inlined(files, target, (*seen, name))

    return _INPUT.sub(put, text)


def tex_to_text(source: str | None) -> str | None:
    """Prose of a LaTeX source: the document body without figures, tables and algorithms.

    Sections become lines with the section mark, citations and references their markers.
    """
    if source is None:
        return None
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", source, re.S)
    t = _COMMENT.sub("", body[1] if body else source)
    for env in DROPPED:
        name = re.escape(env)
        while True:
            inner = re.search(rf"\\begin\{{{name}\}}(?:(?!\\begin\{{{name}\}}).)*?\\end\{{{name}\}}", t, re.S)
            if inner is None:
                break
            t = t[: inner.start()] + t[inner.end() :]
    t = re.sub(r"\\section\*?\{([^{}]*)\}", r"\n§ \1\n", t)
    t = re.sub(r"\\(?:sub)+section\*?\{([^{}]*)\}", r"\n§.§ \1\n", t)
    t = re.sub(r"\\cite\w*(?:\[[^\]]*\])*\{[^{}]*\}", "<cit.>", t)
    t = re.sub(r"\\(?:eq|c|page|auto)?ref\{[^{}]*\}", "<ref>", t)
    t = re.sub(rf"\\(?:{'|'.join(SILENT)})\*?(?:\[[^\]]*\])*(?:\{{[^{{}}]*\}})+", "", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "", t)
    for _ in range(4):  # nested arguments
        t = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\([%&_#${}])", r"\1", t)
    t = re.sub(r"\\[a-zA-Z]+\*?|[{}]", "", t).replace("~", " ").replace("\\\\", "\n")
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def plain_text(c: str | Column) -> Column:
    """The prose of a column of LaTeX sources, in Arrow batches; null stays null."""
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(tex_to_text, na_action="ignore").astype(object)

    return run(c)


def inlined_documents(files: DataFrame, doc: str, name: str, text: str, root: DataFrame) -> DataFrame:
    """doc, text of each document's root file (doc, name) with its inputs in their place.

    The files of one document, a bounded number, are gathered; documents are independent.
    """
    packed = files.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.coalesce(text, F.lit(""))))).alias("files"))

    @F.pandas_udf("string")
    def run(maps: pd.Series, roots: pd.Series) -> pd.Series:
        return pd.Series([inlined(dict(m), r) for m, r in zip(maps, roots, strict=True)], dtype=object)

    return packed.join(root.select(doc, F.col(name).alias("__root")), doc).select(doc, run("files", "__root").alias(text))
