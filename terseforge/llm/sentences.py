"""Sentence units in any script, by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, one for what stands before a position and one for what
follows. At each candidate position (after a run of end marks, its closing quotes and citation
markers) the tables are asked in order: the table of the block's language, the tables of scripts
with marks of their own, abbreviations that all languages share, and the common table. The first
rule that matches decides, and nothing decides before the tables. Patterns look behind as far as
they need to; no context is cut off.

A block is what stands between blank lines (or line ends, in transcripts). Its language is the one
whose function words it uses most, and where none leads, all language tables are asked. Speech
inside a pair of quotation marks of one block, however long, blank lines and heading lines with a
section mark hold no candidate.

Nulls and blank texts give no unit. A text without end marks is one unit per block between blank
lines. Offsets count code points; a unit has no white space at its ends.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.runtime import small_batches


class Rule(NamedTuple):
    breaks: bool
    before: str
    after: str


# Abbreviations, ordinals and month names by language. "name" abbreviations stand
# before a name or a noun, "number" abbreviations before a number.
ABBREVIATIONS: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "name": ("Dr", "Prof", "Mr", "Mrs", "Ms", "St", "Mt", "Gen", "Col", "Capt", "Lt", "Sgt", "Rev", "Hon", "Gov", "Sen", "Rep", "Messrs", "vs", "approx", "resp", "cf", "Cf", "e.g", "i.e", "viz", "al"),
        "number": ("No", "Nos", "no", "nos", "Fig", "Figs", "fig", "Eq", "Eqs", "eq", "Sec", "sec", "Sect", "Ch", "ch", "Tab", "tab", "Ref", "Refs", "Vol", "vol", "p", "pp", "art", "Art", "ca", "al", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"),
    },
    "de": {
        "name": ("Hr", "Fr", "Dipl", "Ing", "Mio", "Mrd", "Tsd", "bzw", "ca", "z.B", "d.h", "u.a", "B", "h", "a", "vgl", "Vgl", "evtl", "ggf", "sog", "inkl", "usf", "St", "Str"),
        "number": ("Nr", "Abb", "Tab", "Kap", "Bd", "Abs", "Art", "S", "bzw", "ca", "etwa"),
    },
    "fr": {
        "name": ("M", "MM", "Me", "Mgr", "St", "Ste", "env", "av", "apr", "cf", "Cf", "c.-à-d", "p. ex"),
        "number": ("env", "p", "pp", "fig", "Fig", "art", "chap", "n", "vol", "éd", "tabl", "av", "apr"),
    },
    "es": {
        "name": ("Sr", "Sra", "Srta", "Dr", "Dra", "D", "Dª", "Ud", "Uds", "Lic", "Ing", "Prof", "Profa", "aprox", "p. ej", "EE", "UU"),
        "number": ("pág", "págs", "art", "arts", "núm", "fig", "cap", "vol", "aprox", "tel", "Tel"),
    },
    "pt": {
        "name": ("Sr", "Sra", "Srs", "Dr", "Dra", "Exmo", "Exma", "Eng", "Prof", "Profa", "aprox", "p. ex"),
        "number": ("pág", "págs", "art", "arts", "núm", "n", "fig", "cap", "vol", "aprox", "tel"),
    },
    "ru": {
        "name": ("г", "гг", "им", "т", "е", "д", "др", "проф", "акад", "ул", "пр", "стр", "т.е", "т.д", "т.п", "т. е", "см", "См", "ср", "Ср", "н", "э", "тыс", "млн", "млрд", "руб"),
        "number": ("рис", "табл", "стр", "с", "гл", "см", "См", "п", "ст", "т", "ок", "см. рис"),
    },
}
# Month names that follow a day written with a point.
MONTHS: dict[str, tuple[str, ...]] = {
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember", "Jahrhundert"),
}

# Abbreviations that texts of every language use.
SHARED: dict[str, tuple[str, ...]] = {
    "name": ("Dr", "Prof", "Mr", "Mrs", "Ms", "St", "vs", "approx", "resp", "cf", "Cf", "e.g", "i.e", "viz", "al", "Sr", "Sra"),
    "number": ("No", "Nos", "Nr", "Fig", "Figs", "fig", "Eq", "Eqs", "eq", "Sec", "sec", "Sect", "Ref", "Refs", "Vol", "vol", "p", "pp", "ca", "al", "Tab", "tab"),
}
# Function words by which a block's language is known.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the and of to is was are were that which with for from this it we they he she not by at an be has have had as on in or if but than then there".split()),
    "de": frozenset("der die das und ist nicht ein eine einen dem den des mit von zu auf für sich war sind wird im am er sie es wir aus bei nach wie auch etwa dass aber als oder hat vor über".split()),
    "fr": frozenset("le la les des est et une un dans du pour que qui ne pas au aux sur par il elle nous sont avec ce cette mais ou été plus se d' l'".split()),
    "es": frozenset("el la los las del y en que un una por con para se es no su al lo más como pero fue son está desde sin sobre entre".split()),
    "pt": frozenset("o os as da do das dos e em um uma que não para com por se é ao na no nas nos mais como mas foi são pela pelo desde sem sobre".split()),
    "ru": frozenset("и в не на что с по к из у от за как это для его но он она они был была было были то же так а о об при до".split()),
}
# Words that open a sentence and are no surname, so that a letter before them ends one.
OPENERS = ("The", "Then", "This", "That", "These", "Those", "There", "We", "He", "She", "It", "They", "You", "In", "On", "At", "But", "And", "If", "When", "After", "Before", "However", "Der", "Die", "Das", "Dann", "Wir", "Er", "Sie", "Es", "Le", "La", "Les", "Il", "Elle", "Nous", "Puis", "El", "Los", "Las", "Entonces", "Os", "Ele", "Ela", "Depois", "Он", "Она", "Они", "Мы", "Это", "Затем")

_UP = r"[A-ZÀ-ÖØ-ÞĀ-ŽΑ-ΩА-ЯЁ]"
_WS = r"[\s]"
_CJK = r"[぀-ヿ㐀-鿿豈-﫿]"
_CLOSED = r"[”」』’\"）)»\]]"
# End marks of further scripts (Devanagari, Arabic, Urdu, Ethiopic, Khmer, Burmese, Armenian, Tibetan).
_FOREIGN = "।॥؟۔።፧។៕။։།"
# Thai writes no end mark; these words close a statement before a blank.
_THAI = "ครับ|ค่ะ|คะ|จ้ะ|นะ|แล้ว"


def _edge(words: tuple[str, ...]) -> str:
    return r"(?:^|[\s(\[«“„\"'])(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + r")\."


def _abbreviations(kinds: dict[str, tuple[str, ...]]) -> list[Rule]:
    return [Rule(False, _edge(kinds["name"]), rf"{_WS}+[^\s]"), Rule(False, _edge(kinds["number"]), rf"{_WS}*[\d(\[№IVXLC]")]


def rule_tables() -> dict[str, list[Rule]]:
    """The cascade: a table for every language, then those that all blocks share, in order."""
    tables: dict[str, list[Rule]] = {lang: _abbreviations(kinds) for lang, kinds in ABBREVIATIONS.items()}
    for lang, months in MONTHS.items():
        tables[lang].insert(0, Rule(False, r"(?:^|[\s(])\d{1,2}\.", rf"{_WS}+(?:{'|'.join(months)})\b"))
    # "no" before a number is short for number, unless it answers.
    tables["en"].insert(0, Rule(True, r"\b(?:is|was|be|say|says|said|answer|answers|answered|reply|replied|with|a)[\s,:]+no\.", rf"{_WS}+[\d]"))
    tables["cjk"] = [
        Rule(False, rf"[。！？｡]{_CLOSED}+", _CJK),  # a report of speech goes on
        Rule(False, r"モーニング娘。", r"\S"),
        Rule(False, r"[。！？｡]+", r"[\p{Ll}\d/_@=&]"),
        Rule(True, r"[。！？｡]", r""),
        Rule(False, r"(?:图|表|第|図)\s?\d+\.", r"\s?\d"),
        Rule(False, rf"{_CJK}\.", r"[\p{L}\d]"),
    ]
    tables["scripts"] = [Rule(True, rf"[{_FOREIGN}]+{_CLOSED}*", r""), Rule(True, rf"(?:{_THAI})", rf"{_WS}")]
    tables["shared"] = _abbreviations(SHARED)
    tables["common"] = [
        # What opens a sentence ends the one before, also after a single letter.
        Rule(True, rf"{_WS}{_UP}\.", rf"{_WS}+(?:{'|'.join(OPENERS)}){_WS}"),
        # Initials before a surname or another initial; "a.m." and the like may end a sentence.
        Rule(False, rf"(?:^|[\s(\[«“„\"'.-]){_UP}\.", rf"{_WS}*(?:{_UP}\.|{_UP}[\w'’-]+)"),
        Rule(False, r"(?:^|[\s(\[«“„])\w\.", rf"{_WS}*\w\."),
        # Numbers, versions, addresses and file names.
        Rule(False, r"[^\s]", r"[^\s　-鿿＀-￯A-ZÀ-ÖØ-ÞА-ЯЁ\"“”«»‹„「『¿¡§(\[]"),
        # A sentence may follow without a blank, unless the mark is inside an address or a version.
        Rule(True, r"(?:^|\s|[(\"“«])[^\s/:@.]*[\w)\]%»”\"][.!?…]+", rf"{_UP}[\w'’-]*[,;:]?(?:{_WS}|$)"),
        Rule(True, r"[.!?…]+[\"”»]", rf"{_UP}[\w'’-]+"),
        Rule(True, r"[。！？｡]+", rf"(?!{_WS})"),
        Rule(False, r"[^\s]", r"\S"),
        # What goes on in lower case, after a dash or with a comma goes on with the sentence.
        Rule(False, r"[^\s]", rf"{_WS}+(?:[-–—]{_WS}*)?[a-zà-öø-ÿāăąćčďđēęěğīłńňōőřśşšťūůűźžа-яё,;:)\]»”]"),
        Rule(False, r"[^\s]", rf"{_WS}+[-–—]{_WS}*{_UP}?"),
        Rule(True, r"[^\s]", rf"{_WS}|$"),
    ]
    return tables


class Cascade:
    """Tables in the order in which they are asked, compiled.

    Where the end marks touch the position, neighbouring rules of one verdict are one expression,
    which is true where any of them is; else each rule is asked by itself.
    """

    def __init__(self, *names: str) -> None:
        tables = rule_tables()
        rules = [r for name in names for r in tables[name]]
        self.single = [(r.breaks, regex.compile(f"(?<={r.before})"), regex.compile(r.after)) for r in rules]
        runs = [(breaks, list(own)) for breaks, own in itertools.groupby(rules, key=lambda r: r.breaks)]
        self.fused = [(breaks, regex.compile("|".join(f"(?<={r.before})(?:{r.after})" for r in own)).match) for breaks, own in runs]

    def breaks(self, text: str, marks_end: int, end: int, hi: int) -> bool:
        """The verdict of the first rule that matches."""
        if marks_end == end:
            for breaks, match in self.fused:
                if match(text, end, hi):
                    return breaks
        else:
            for breaks, before, after in self.single:
                if after.match(text, end, hi) and before.match(text, marks_end):
                    return breaks
        return False


_AFTER_ALL = ("cjk", "scripts", "shared", "common")
#: The cascade by language, and of blocks whose language is not known.
_CASCADES = {lang: Cascade(lang, *_AFTER_ALL) for lang in ABBREVIATIONS} | {"zh": Cascade(*_AFTER_ALL), "ja": Cascade(*_AFTER_ALL), None: Cascade(*ABBREVIATIONS, *_AFTER_ALL)}
_CLOSING = r"(?:[\"”’'»)\]」』）】›]|“(?![\w“])|[ \xa0 ]»)*(?:\s?<(?:cit|ref)\.>)*"
_CANDIDATE = re.compile(rf"[.!?…‽。！？｡{_FOREIGN}]+{_CLOSING}")
_THAI_CANDIDATE = re.compile(rf"(?:[.!?…‽。！？｡{_FOREIGN}]+|(?:{_THAI})(?=\s)){_CLOSING}")
_THAI_LETTER = re.compile("[ก-๛]")
_HEADING = re.compile(r"(?:§\.)*§")
_QUOTE_MARK = re.compile("[\"“„«「『]")
_QUOTE = re.compile(
    r"“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|「[^「」]+」|『[^『』]+』"
    r"|(?:(?<=[\s(\[—])|(?<![\s\S]))\"(?=\S)[^\"]+\"(?=[\s.,;:!?)\]<—]|\Z)"
)


_LANGUAGES_OF = {w: tuple(k for k, own in FUNCTION_WORDS.items() if w in own) for w in frozenset().union(*FUNCTION_WORDS.values())}


def block_language(block: str) -> str | None:
    """The language whose function words lead in a block; None where none leads."""
    words = block.lower().split()
    found = Counter(lang for w in words if w in _LANGUAGES_OF for lang in _LANGUAGES_OF[w])
    best = found.most_common(2)
    return best[0][0] if best and (len(best) == 1 or best[0][1] > best[1][1]) else None


def _marks_end(text: str, start: int, end: int) -> int:
    """Where a candidate's marks and quotes end, before its citation markers."""
    at = text.find("<", start, end)
    at = end if at < 0 else at
    while text[at - 1].isspace():
        at -= 1
    return at


def sentence_spans(text: str | None, lang: str | None = None, lines: bool = False) -> list[tuple[int, int]]:
    """Units of one text as (start, end).

    ``lang`` names the language of the whole text; by default it is found for every block.
    With ``lines`` every line end closes a unit, as in transcripts.
    """
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    candidate = _THAI_CANDIDATE if _THAI_LETTER.search(text) else _CANDIDATE
    for lo, hi, heading in _blocks(text, lines):
        if heading:
            _add(spans, text, lo, hi)
            continue
        opened, closed = [], []
        if _QUOTE_MARK.search(text, lo, hi):
            for m in _QUOTE.finditer(text, lo, hi):
                opened.append(m.start())
                closed.append(m.end())
        begin = lo
        cascade = None
        for m in candidate.finditer(text, lo, hi):
            start, end = m.span()
            if end >= hi:
                break
            if opened:
                k = bisect.bisect_right(opened, start) - 1
                if k >= 0 and end < closed[k]:
                    continue
            if cascade is None:
                cascade = _CASCADES.get(lang or block_language(text[lo:hi]), _CASCADES[None])
            if cascade.breaks(text, _marks_end(text, start, end), end, hi):
                _add(spans, text, begin, end)
                begin = end
        _add(spans, text, begin, hi)
    return spans


def _blocks(text: str, lines: bool) -> Iterator[tuple[int, int, bool]]:
    """Stretches that no unit crosses, as (start, end, is a heading line)."""
    begin = at = 0
    n = len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end + 1
        heading = text.startswith("§", at) and _HEADING.match(text, at)
        if heading or lines or text[at:end].isspace():
            if begin < at:
                yield begin, at, False
            if heading or lines:
                yield at, end, bool(heading)
            begin = end
        at = end
    if begin < n:
        yield begin, n, False


def _add(spans: list[tuple[int, int]], text: str, start: int, end: int) -> None:
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    if start < end:
        spans.append((start, end))


def sentence_units(df: DataFrame, key: str, text: str, lang: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every unit of every row of ``df``: the columns ``keep``, ``key``, start_pos and end_pos.

    One narrow pass over the rows without a shuffle; the text itself is not emitted. Other columns of
    ``df`` are ignored, whatever their names. Null and blank texts give no rows.
    """
    small_batches(df.sparkSession)
    names = [*keep, key]
    source = df.where(F.col(text).isNotNull()).select(*[F.col(n) for n in names], F.col(text).alias("__text"))
    schema = source.select(*names).schema.add("start_pos", "integer").add("end_pos", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, t in enumerate(batch.column(len(names)).to_pylist()):
                for s, e in sentence_spans(t, lang):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(taken) for k in range(len(names))], pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*names, "start_pos", "end_pos"])

    return source.mapInArrow(run, schema)
