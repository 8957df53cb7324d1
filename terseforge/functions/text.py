"""Text cleaning and cutting as column expressions; everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str sees it, in the JVM's dialect.
WS = r"(?U)[\s\x1c-\x1f]"
#: A sentence ends after "." or "?" before white space, unless an abbreviation such as "e.g." or "Dr." stands there.
SENTENCE_BREAK = r"(?Ud)(?<![\p{L}\p{N}_]\.[\p{L}\p{N}_].)(?<![A-Z][a-z]\.)(?<=\.|\?)[\s\x1c-\x1f]"
#: Words and runs of signs, each with the blank before it; they tile a stripped and collapsed sentence.
TOKEN = r" ?[\p{L}\p{N}_]+| ?[^\s\p{L}\p{N}_]+|\s+"


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank; the ends are not trimmed."""
    return F.regexp_replace(c, f"{WS}+", " ")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def without_citations(c: Column) -> Column:
    """Citation and reference markers removed, white space collapsed."""
    return collapse(F.replace(F.replace(c, F.lit("<cit.>"), F.lit("")), F.lit("<ref>"), F.lit("")))


def sections(c: Column) -> Column:
    """Sections of an article: what stands before the first mark is dropped, subsections stay inside."""
    body = F.regexp_replace(c, r"(?s)\A.*?§", "§")
    parts = F.split(body, r"(?U)(?<!§\.)§[\s\x1c-\x1f]", -1)
    return F.transform(F.filter(parts, lambda x: strip(x) != ""), without_citations)


def sentences(c: Column) -> Column:
    """Stripped, non-blank sentences of a text."""
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK, -1), strip), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Tokens that concatenate to the sentence."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def id_tail(c: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(c, "/"), -1)


def utterance_line(role: Column, text: Column) -> Column:
    """A role and what it says, closed with a full stop if no end mark closes it."""
    line = F.concat(role, F.lit(": "), text)
    return F.when(F.right(line, F.lit(1)).isin(".", "!", "?"), line).otherwise(F.concat(line, F.lit(".")))


def leading_words(c: Column, n: int = 3) -> Column:
    """The first ``n`` word tokens, each followed by a blank."""
    first = F.slice(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"), F.lit(0)), 1, n)
    return F.concat(F.array_join(first, " "), F.lit(" "))


def latex_comments_removed(c: Column) -> Column:
    """A percent sign that is not escaped and the rest of its line removed."""
    return F.regexp_replace(c, r"(?d)(?<!\\)%.*", "")


def ngrams(toks: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by blanks."""
    count = F.size(toks) - n + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts: the first eight digits of their MD5."""
    key = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def last_piece_dropped(c: Column, mark: str) -> Column:
    """A text without what follows the last ``mark``, ``mark`` included; whole if it has none."""
    at = F.length(c) - F.instr(F.reverse(c), F.reverse(F.lit(mark))) - len(mark) + 1
    return F.when(F.instr(c, mark) > 0, F.substr(c, F.lit(1), at)).otherwise(c)
