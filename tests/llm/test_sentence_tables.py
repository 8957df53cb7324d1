"""Sentence rules by language, marks of other scripts, and quotations of any length."""

import pytest

from terseforge.llm.sentences import block_language, rule_tables, sentence_spans


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The answer is no. 5 people came.", ["The answer is no.", "5 people came."]),
        ("We saw M. Then we left.", ["We saw M.", "Then we left."]),
        ("Nous avons vu M. Durand dans la rue. Il pleut.", ["Nous avons vu M. Durand dans la rue.", "Il pleut."]),
        ("यह पहला वाक्य है। यह दूसरा है। क्या यह तीसरा है?", ["यह पहला वाक्य है।", "यह दूसरा है।", "क्या यह तीसरा है?"]),
        ("هل أنت بخير؟ نعم أنا بخير.", ["هل أنت بخير؟", "نعم أنا بخير."]),
        ("ይህ ነው። ሌላ ነው።", ["ይህ ነው።", "ሌላ ነው።"]),
        ("ស្ដី។ សួស្ដី។", ["ស្ដី។", "សួស្ដី។"]),
        ("สบายดีครับ ขอบคุณ", ["สบายดีครับ", "ขอบคุณ"]),
        ("见图1.2。他来了。", ["见图1.2。", "他来了。"]),
    ],
)
def test_languages_and_scripts(text, want):
    assert units(text) == want


@pytest.mark.parametrize("n", [1, 5, 20, 400])
@pytest.mark.parametrize("marks", ['""', "“”", "«»"])
def test_quoted_speech_of_any_length(n, marks):
    text = f"He said: {marks[0]}{' '.join(['This is wrong.'] * n)}{marks[1]} and left. Then it rained."
    assert len(units(text)) == 2


def test_an_unclosed_quotation_ends_with_its_block():
    assert units('He said: "This is wrong. He left.\n\nThen it rained. It " stopped.') == ['He said: "This is wrong.', "He left.", "Then it rained.", 'It " stopped.']


def test_context_is_not_cut_off():
    assert len(units("It ended." + " " * 500 + "it went on. Then it stopped.")) == 2
    assert len(units("The " + "x" * 300 + " of Dr. Vem is here. It is.")) == 2


def test_block_language():
    assert block_language("The cat is on the mat.") == "en" and block_language("Der Hund ist nicht da.") == "de" and block_language("xyz") is None
    assert set(rule_tables()) == {"en", "de", "fr", "es", "pt", "ru", "cjk", "scripts", "shared", "common"}
