"""The field for personal data on hand-written sentences, in any batch, with a worker's model replaced."""

import sys
from pathlib import Path

import numpy as np
import pytest

from terseforge.llm import pii

sys.path.insert(0, str(Path(__file__).resolve().parent))
from ordinary_sentences import parsed  # noqa: E402


@pytest.fixture(scope="module")
def decoder():
    return pii.Decoder(pii.train())


def test_ordinary_sentences(decoder):
    rows = parsed()
    found = decoder.batch([t for t, _ in rows])
    hit = sum(len(g & set(f)) for (_, g), f in zip(rows, found, strict=True))
    assert len(rows) >= 200
    assert hit / sum(len(g) for _, g in rows) >= 0.9 and hit / sum(map(len, found)) >= 0.9


def test_spans_do_not_depend_on_the_batch(decoder, monkeypatch):
    rows = [t for t, _ in parsed()]
    whole = decoder.batch(rows)
    assert [decoder.batch([t])[0] for t in rows] == whole
    monkeypatch.setattr(pii, "TOKENS_AT_ONCE", 50)
    assert decoder.batch(rows) == whole


def test_one_very_long_text_is_decoded_by_itself(decoder):
    text = "The river is wide. " * 20_000 + "My name is Clara Weber and you can write to clara.weber@example.org."
    found = decoder.batch([text, *[t for t, _ in parsed()]])
    assert {text[a:b] for a, b, _ in found[0]} >= {"clara.weber@example.org"}


def test_words_of_a_found_span_speak_for_themselves_elsewhere(decoder):
    text = "Write to ivo.vel@example.org today. ivo.vel@example.org"
    assert [text[a:b] for a, b, k in decoder.batch([text])[0] if k == "email"] == ["ivo.vel@example.org"] * 2


def test_another_field_replaces_the_first_one(decoder):
    pii._decoder(decoder.field)
    field = pii.Field(decoder.field.index, np.zeros_like(decoder.field.weights), np.zeros_like(decoder.field.joint), decoder.field.trans)
    assert pii._decoder(field).field is field and field.digest != decoder.field.digest


@pytest.mark.parametrize(("text", "kind", "want"), [("call +1 (212) 555-0134 now", "phone", "+1 (212) 555-0134"), ("Dr. Ludwig van Beethoven", "name", "Ludwig van Beethoven"), ("Anna Šimek", "name", "Anna Šimek"), ("Maria Anna Lopez", "name", "Maria Anna Lopez")])
def test_the_check_keeps_what_was_decoded(text, kind, want):
    at = text.find(want)
    s, e = pii.fitted(text, at, at + len(want), kind)
    assert text[s:e] == want
