"""Properties that hold for any text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from terseforge.llm import answers, leaks, neardup, pieces, pii, sentences, tokens

ALPHABET = st.text(st.sampled_from(list("aBc .!?…。“”\"'()[]§\n\t,;:-—1293éßжП漢字かカ@&<>#😀") + ["​", "\xad", "\xa0"]), max_size=120)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_sentences_cover_the_text(t):
    spans = sentences.sentence_spans(t)
    assert "".join(re.sub(r"\s", "", t[a:b]) for a, b in spans) == re.sub(r"\s", "", t)
    assert all(a < b for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.integers(1, 40))
def test_chunks_count_as_the_whole(t, size):
    count = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    chunks = tokens.independent_chunks(t, size)
    assert "".join(chunks) == t
    assert sum(len(count(c)) for c in chunks) == len(count(t))


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_words_are_runs_of_letters_and_digits(t):
    for w in leaks.words(t):
        assert w and all(c.isalnum() or not c.isspace() for c in w) and "_" not in w


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_spans_lie_in_the_text(t):
    decoder = pii.Decoder(pii.train())
    for s, e, kind in decoder.batch([t])[0]:
        assert 0 <= s < e <= len(t) and kind in pii.TYPES and t[s:e].strip() == t[s:e]


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_judgements_do_not_fail(t):
    said = answers.body(t)
    assert answers.is_empty(said) in (True, False)
    if not answers.is_empty(said):
        assert answers.is_truncated(said) in (True, False)
        assert all(f and 0 <= c < 2**63 for f, _, c in answers.forms(said))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n"), min_size=1, max_size=600), st.integers(40, 120), st.integers(1, 300))
def test_packed_stretches_keep_the_reach(t, reach, size):
    packer, cut = pieces.Packer(reach), []
    for chunk in pieces.ranges_of(t, size):
        cut += packer.add(len(chunk), pieces.Boundaries(chunk).places(reach))
    cut = [(end, level) for _, end, level in [*cut, *packer.end(0)]]
    places = [0, *[a for a, _ in cut]]
    assert places[-1] == len(t) and all(0 < b - a <= reach for a, b in zip(places, places[1:], strict=False))
    whole = pieces.Boundaries(t)
    levels = [whole.cuts, whole.inner, [k + 1 for k, c in enumerate(t) if c.isspace()]]
    for (a, _), (b, level) in zip([(0, ""), *cut], cut, strict=False):
        if level != "end":  # the farthest place of the coarsest level that has one
            found = [(max((x for x in own if a < x <= a + reach), default=None), v) for own, v in zip(levels, pieces.LEVELS, strict=True)]
            assert (b, level) == next(((x, v) for x, v in found if x is not None), (a + reach, "none"))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n"), min_size=1, max_size=400), st.integers(1, 200))
def test_summaries_of_ranges_add_up_to_the_whole(t, size):
    one, many = pieces.Summary(), pieces.Summary()
    one.add(pieces.Boundaries(t), 0)
    for chunk in pieces.ranges_of(t, size):
        many.add(pieces.Boundaries(chunk), 0)
    assert (one.own, one.first, one.last) == (many.own, many.first, many.last)
    for k in range(len(pieces.LEVELS)):
        assert one.heads[k] == many.heads[k], pieces.LEVELS[k]
        assert one.longest[k] == many.longest[k], pieces.LEVELS[k]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ab cd ef gh ij kl mn op".split()), max_size=40), st.integers(1, 5))
def test_shingles_are_a_set(words, size):
    got = neardup.shingles(" ".join(words), size)
    want = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    assert len(got) == len(want)
