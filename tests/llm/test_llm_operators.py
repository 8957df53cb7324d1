"""The training-data operators against brute force, round trips and their defined edge cases."""

import base64
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terseforge.llm import answers, langid, leaks, neardup, pieces, pii, sentences, tokens

NAMES = "Ada Bruno Clara Dario Elif Felix Goran Hana Ivo Jonas Karim Lena".split()
WORDS = "market river engine paper window garden letter signal answer bridge cloud theory driver winter summer record member number system worker artist doctor farmer museum".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- sentences ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Vem and A. B. Cole (see Eq. (5), resp. Sec. 2.1) agree. It rose to 3.5 vs. 4.", ["Dr. Vem and A. B. Cole (see Eq. (5), resp. Sec. 2.1) agree.", "It rose to 3.5 vs. 4."]),
        ('He wrote: "This is wrong. Try again." and left. "We tried," she said.', ['He wrote: "This is wrong. Try again." and left.', '"We tried," she said.']),
        ("Am 10. Mai kam er. Etwa 2,5 Mio. Stück, d. h. viele. „Nein. Geh!“, sagte er.", ["Am 10. Mai kam er.", "Etwa 2,5 Mio. Stück, d. h. viele.", "„Nein. Geh!“, sagte er."]),
        ("« C'est faux. Recommencez ! » dit-il. Cf. p. 17 : oui.", ["« C'est faux. Recommencez ! » dit-il.", "Cf. p. 17 : oui."]),
        ("По словам А. Б. Мимова, т. е. так. «Нет. Ещё раз!» — сказал он. См. рис. 3.", ["По словам А. Б. Мимова, т. е. так.", "«Нет. Ещё раз!» — сказал он.", "См. рис. 3."]),
        ("他说：“不对。再试。”然后走了。“好吗？没人知道。”她说。完", ["他说：“不对。再试。”然后走了。", "“好吗？没人知道。”她说。", "完"]),
        ("§ Data and Setup\nOne line\ngoes on. <cit.> Two!\n\nThree.Four goes. Version v1.2.3 at http://a.b/c.d?e=1 stays.", ["§ Data and Setup", "One line\ngoes on. <cit.>", "Two!", "Three.", "Four goes.", "Version v1.2.3 at http://a.b/c.d?e=1 stays."]),
        ("bought by Quib Inc. Residents left at 3 p.m. on Jan. 2 from the U.S. office. No. 4 is it.", ["bought by Quib Inc.", "Residents left at 3 p.m. on Jan. 2 from the U.S. office.", "No. 4 is it."]),
        ("", []), ("  \n ", []), ("no end", ["no end"]), (None, []),
    ],
)
def test_sentence_spans(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_units_are_ordered_and_whole():
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice(["a", "B", ".", "!", " ", "\n", "。", "“", "”", "§ ", '"', "<cit.>"]) for _ in range(60))
        spans = sentences.sentence_spans(t)
        assert all(a < b and t[a:b].strip() == t[a:b] for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        covered = "".join(t[a:b] for a, b in spans)
        assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", t)


def test_sentence_units_ignore_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x", 3), (1, "A b. C d.", "x", 3), (2, None, "y", 4)], "id long, text string, start_pos string, __t int")
    rows = sentences.sentence_units(df, "id", "text").collect()
    assert sorted((r["id"], r["start_pos"], r["end_pos"]) for r in rows) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sentences.sentence_units(df.limit(0), "id", "text").count() == 0


# --- pieces ---------------------------------------------------------------------------------------


def _items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def _long_texts():
    rng = random.Random(2)
    prose = lambda n: " ".join(_text(rng, 9).capitalize() + "." for _ in range(n))
    return ["\n\n".join(prose(12) for _ in range(30)), prose(400), "x" * 15_000, _text(rng, 4000), "word " * 1100 + "y" * 6001, None, "", "short", "x " * 20_000, " " * 7000]


def test_cut_level_against_whole_text(spark):
    texts = _long_texts()
    df = _items(spark, texts)
    for size in (200_000, 7_000, 1):
        got = {r["id"]: r["cut_level"] for r in pieces.cut_levels(pieces.item_summaries(df, ["id"], "text", size=size), ["id"]).collect()}
        for i, t in enumerate(texts):
            if not t or len(t) <= pieces.LIMIT:
                assert i not in got
                continue
            want = "none"
            if max(map(len, re.findall(r"\S+", t)), default=0) <= 6000:
                want = "space"
            if t.strip() and max(b - a for a, b in sentences.sentence_spans(t)) <= 6000:
                want = "sentence"
            if t.strip() and max(len(p.strip()) for p in re.split(r"\n[^\S\n]*\n", t)) <= 6000:
                want = "paragraph"
            assert got[i] == want, (i, size)


@pytest.mark.parametrize("size", [200_000, 7_000, 1])
def test_pieces_cover_overlap_and_keep_the_limit(spark, size):
    texts = _long_texts()
    df = _items(spark, texts)
    offsets = pieces.piece_offsets(pieces.item_places(df, ["id"], "text", size=size), ["id"])
    by: dict[int, list] = {}
    for r in pieces.piece_texts(df, offsets, ["id"], "text").orderBy("id", "piece_no").collect():
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > pieces.LIMIT}
    for i, rows in by.items():
        t = texts[i]
        assert rows[0]["start_pos"] == 0 and rows[-1]["end_pos"] == len(t)
        for r in rows:
            assert 0 < r["end_pos"] - r["start_pos"] <= pieces.LIMIT and r["piece"] == t[r["start_pos"] : r["end_pos"]]
        for a, b in zip(rows, rows[1:], strict=False):
            assert a["end_pos"] - b["start_pos"] == pieces.OVERLAP or b["start_pos"] == 0
    assert {r["cut_level"] for r in by[0]} == {"paragraph", "end"} and {r["cut_level"] for r in by[1]} == {"sentence", "end"}
    assert {r["cut_level"] for r in by[2]} == {"none", "end"} and {r["cut_level"] for r in by[3]} == {"space", "end"}


@pytest.mark.parametrize("end", ["", "\n", "\n\n", "\n\n\n  \n"])
def test_byte_ranges_of_a_file_equal_the_whole_text(spark, tmp_path, end):
    rng = random.Random(3)
    blocks = [f"Absatz {k} über Öl und 漢字。 {'wort ' * rng.choice((3, 40, 400))}. Das war es." + "\n" * rng.randint(0, 2) for k in range(60)]
    text = "\n\n" + ("\n\n" + "x" * 9000 + "\n \n").join(["\n\n".join(blocks), _text(rng, 3000), "§ Teil\nEnde"]) + end
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "big.txt").write_text(text, encoding="utf-8")
    (folder / "small.txt").write_text("Short. Text.", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {}
    try:
        for most in ("7000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            cuts = pieces.piece_offsets(pieces.file_places(spark, str(folder), size=3000), ["path"])
            levels = pieces.cut_levels(pieces.file_summaries(spark, str(folder), size=3000), ["path"])
            got[most] = [tuple(r)[1:] for r in cuts.orderBy("path", "piece_no").collect()], [r["cut_level"] for r in levels.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    df = _items(spark, [text])
    want = [tuple(r)[1:] for r in pieces.piece_offsets(pieces.item_places(df, ["id"], "text"), ["id"]).orderBy("piece_no").collect()]
    assert want[-1][2] == len(text)
    for most in got:
        assert got[most] == (want, [r["cut_level"] for r in pieces.cut_levels(pieces.item_summaries(df, ["id"], "text"), ["id"]).collect()]), most


# --- near duplicates --------------------------------------------------------------------------------


def _jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both) if both else 0.0


def _edited(rng, text):
    w = text.split()
    for _ in range(3):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = [_text(rng, 120) for _ in range(60)]
    texts += [_edited(rng, t) for t in texts[:25]] + [texts[0]] * 40 + ["", None, "one two", "one two", "!!"]
    df = spark.createDataFrame([("t", i, t, "noise", 1) for i, t in enumerate(texts)], "part string, id long, text string, rep string, bands int")
    pairs, members = neardup.near_duplicates(df, ["part", "id"], "text", threshold=0.6, size=3)
    got = {(r["a_id"], r["b_id"]) for r in neardup.record_pairs(pairs, members, ["part", "id"]).collect()}
    sets = [neardup.shingles(t, 3) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _jaccard(sets[i], sets[j]) >= 0.6}
    assert got == want
    grouped = {r["id"]: r["group_id"] for r in neardup.groups(pairs, members, ["part", "id"]).collect()}
    assert all(grouped[i] == grouped[j] for i, j in want) and len(grouped) == sum(bool(len(s)) for s in sets)
    empty_pairs, empty_members = neardup.near_duplicates(df.limit(0), ["part", "id"], "text")
    assert empty_pairs.count() == empty_members.count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    same = (neardup.signature(np.unique(a), 400) == neardup.signature(np.unique(b), 400)).mean()
    assert abs(same - 700 / 1100) < 0.08


# --- leaks ------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    items = [" ".join([_text(rng, 8).capitalize(), f"and {n} counts {rng.randint(10, 99)} kg.", _text(rng, 6), n, "."]) for n in (rng.choice(NAMES) + "or" for _ in range(30))]
    docs = []
    for k in range(120):
        d = _text(rng, 40)
        if k % 3 == 0:
            w = items[k % 30].split()
            part = " ".join(w[: rng.randint(9, len(w))])
            d += " " + (part.upper() if k % 2 else part.replace("a", "ａ")) + " " + _text(rng, 10)
        docs.append(d)
    docs += ["", None, items[0], items[0]]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id long, text string, kind string")
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = leaks.leaks(df, it)
    got = {(r["doc_id"], r["item_id"]) for r in found.where("kind = 'verbatim'").collect()}
    grams = [{tuple(w[k : k + 12]) for k in range(len(w) - 11)} for w in (leaks.words(t) for t in items)]
    want = set()
    for i, d in enumerate(docs):
        w = leaks.words(d)
        mine = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(i, j) for j, g in enumerate(grams) if mine & g}
    assert got == want and len(want) > 20
    rows = sorted(tuple(r) for r in found.dropDuplicates().collect())
    assert sorted(tuple(r) for r in leaks.leaks(df, it, item_chars=0).collect()) == rows
    assert leaks.leaks(df, it.limit(0)).count() == 0 and leaks.leaks(df.limit(0), it).count() == 0


def test_reparameterised_passages_need_consistent_slots(spark):
    item = "Suppose Marlo holds 340 shelves and the quiet river replaces the old bridge of Marlo before noon"
    same = "suppose Tessa holds 912 shelves and the quiet river replaces the old bridge of Tessa before noon"
    broken = "suppose Tessa holds 912 shelves and the quiet river replaces the old bridge of Quinn before noon"
    df = spark.createDataFrame([(1, same), (2, broken), (3, item)], "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in leaks.leaks(df, it, size=16).collect()}
    assert got == {1: "reparameterised", 3: "verbatim"}


# --- tokens and mixtures ------------------------------------------------------------------------------


def test_token_counts_of_cut_documents_are_exact(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "é", "ß", " ", "  ", "\n", "1", "23", "'s", "。", "漢", "，", "!", "<|endoftext|>", "ж"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["", None, "x" * 3000, " " * 500, "word " * 800]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, t string, n_tokens int")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(df, ["id"], "t", size=50).collect()}
    enc = tokens.encoding(tokens.TOKENIZER)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all("".join(tokens.independent_chunks(t, 50)) == t for t in texts if t)
    ranks = {base64.b64decode(x) for x, _ in (line.split() for line in open(tokens.TOKENIZER, "rb"))}
    assert len(ranks) == enc.n_vocab


def test_mixture_shares_and_caps(spark):
    docs = [(i, "some words in a text " * (i % 7 + 1), ("big", "mid ", "TINY", None, "unlisted")[min(i % 10, 4) if i % 10 < 3 else 3 + i % 2]) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("tiny", 0.15, 4), ("lost", 0.05, 9)], "source string, target_share double, max_repeats int")
    copies, shares = tokens.mixture(df, targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert rows["lost"]["rate"] == 0 and rows["lost"]["mixed_tokens"] == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.15)):
        assert rows[s]["rate"] <= rows[s]["max_repeats"] + 1e-9
        assert abs(rows[s]["mixed_share"] - share / 0.95) < 0.03
    most = copies.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] <= rows[r["source"]]["max_repeats"] for r in most)
    again = tokens.mixture(df.repartition(7), targets)[0]
    assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, again.collect()))
    none, empty = tokens.mixture(df.limit(0), targets)
    assert none.count() == 0 and empty.count() == 4


# --- languages ------------------------------------------------------------------------------------------


SAID = {
    "en": "The river was quiet and the people of the town were reading in the garden.", "de": "Der Fluss war ruhig und die Leute der Stadt lasen in dem Garten nicht.", "fr": "Le fleuve était calme et les gens de la ville lisaient dans le jardin.",
    "es": "El río estaba tranquilo y la gente del pueblo leía en el jardín por la tarde.", "pt": "O rio estava calmo e as pessoas da cidade não liam no jardim à noite.", "ru": "Река была тихой, и люди города читали в саду весь вечер.",
    "zh": "这条河很安静，城里的人在花园里读书。", "ja": "川は静かで、町の人たちは庭で本を読んでいた。",
}


def test_forward_sums_all_segmentations():
    index = {p: i for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab"])}
    probs = np.zeros((8, 1))
    probs[:6, 0] = [0.1, 0.2, 0.15, 0.25, 0.2, 0.1]
    want = 0.1 * 0.2 * 0.15 + 0.25 * 0.15 + 0.1 * 0.2 + 0.1
    assert np.isclose(np.exp(langid.forward(["ab"], index, probs)[0, 0]), want)


def test_languages_and_segments(spark):
    rows = [(i, SAID[k] + " " + SAID[k], k) for i, k in enumerate(SAID) for _ in range(1)] * 5
    docs = [(i, t, k) for i, (_, t, k) in enumerate(rows)]
    docs += [(100, f"{SAID['de']} {SAID['de']}\n\n{SAID['fr']} {SAID['fr']}", "de"), (101, SAID["en"] + " " + SAID["en"], None), (102, SAID["es"] + " " + SAID["es"], "PT-br"), (103, "12 34\n---\nab12cd34", "en"), (104, None, "en"), (105, "", None), (106, "§ Theory\n" + SAID["en"] + " <cit.> " + SAID["en"], " EN ")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = langid.document_languages(df, "doc_id", "text", "lang").cache()
    got = {r["doc_id"]: r["lang"] for r in found.collect()}
    assert all(got[i] == k for i, _, k in docs[: len(rows)]) and got[103] is None and got[104] is None and got[105] is None
    faults = [tuple(r) for r in langid.label_faults(found, "doc_id").orderBy("doc_id", "segment_no").collect()]
    assert faults == [(100, 0, "de"), (100, 1, "fr"), (101, 0, "en"), (102, 0, "es")]


# --- personal data ------------------------------------------------------------------------------------------


def test_personal_data_rows(spark):
    rows = [(1, 0, "Please call Ada R. Norberg on 617-555-0140 before noon."), (2, 0, '<p>Is <a href="mailto:ivo.vel@example.org">ivo.vel@example.org</a> still the right address for Hana Kalund?</p>'), (3, 0, None), (4, 0, ""), (5, 0, "Use foo@92.89 as the revision, not an address. The range 7162 - 9743 covers 555 pupils."), (1, 0, "Please call Ada R. Norberg on 617-555-0140 before noon.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, turn int, text string, pii_type string")
    got = sorted((r["record_id"], r["pii_type"], r["start_pos"], r["end_pos"]) for r in pii.personal_data(df, ["record_id", "turn"], "text").collect())
    texts = {r[0]: r[2] for r in rows}
    said = sorted((i, k, texts[i][a:b]) for i, k, a, b in got)
    assert said == sorted([(1, "name", "Ada R. Norberg"), (1, "phone", "617-555-0140")] * 2 + [(2, "email", "ivo.vel@example.org")] * 2 + [(2, "name", "Hana Kalund")])
    clean = {r["record_id"]: r["text"] for r in pii.redacted(df, ["record_id", "turn"], "text").collect()}
    assert clean[1] == "Please call [NAME] on [PHONE] before noon." and clean[3] is None and clean[4] == "" and clean[5] == texts[5]
    assert pii.personal_data(df.limit(0), ["record_id", "turn"], "text").count() == 0


# --- answers --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("It names these points:\n1. the red book\n2. the old door", False), ("It ends here.", False), ("None of the drivers", False), ("It ends here. (see above)", False), ("It ends here. [3]", False), ('"It ends here."', False),
        ("It ends here. But then the", True), ("It ends here. \n1. the book\n2. the\n3.", True), ("It ends here. As shown in Fig.", True), ("It ends, although —", True), ("A first. And then:", True), ("第一句。然后", True), ("第一句。", False), ("62.3 percent", False),
    ],
)
def test_truncation(answer, want):
    assert answers.is_truncated(answer) is want


@pytest.mark.parametrize("answer", ["", " ", "-", "N/A", "nan", "<p></p>", "ASSISTANT: \n", "…", '""', "​", "A:", "[ ]", "null"])
def test_empty(answer):
    assert answers.is_empty(answers.body(answer))


def test_defect_types(spark):
    no = ["I'm sorry, but I cannot help with that request.", "Unfortunately, I am not able to answer this question.", "Es tut mir leid, aber dabei kann ich nicht helfen."]
    rows = [(f"What does the {w} say about the {v}?", no[i % 2]) for i, (w, v) in enumerate(zip(WORDS, WORDS[1:], strict=False))]
    rows += [("What is the main point of the text?", "The authors say they cannot release the corpus, and the town reads it in the garden."), ("Why is the river of the town called quiet?", SAID["de"] + " " + SAID["de"]), ("Translate the summary of the town into German.", SAID["de"]), ("What is it about?", "Q: what is it about"), ("What is it about?", None), (None, "x"), ("What is it about?", "0"), ("What is the name of the town?", SAID["en"] + " And then the")]
    df = spark.createDataFrame([(i, q, a, "x") for i, (q, a) in enumerate(rows)], "answer_id long, question string, answer string, kind string")
    labelled = spark.createDataFrame([(i, SAID[k] + " " + SAID[k], k) for i, k in enumerate(list(SAID) * 4)], "id long, text string, lang string")
    asked = spark.createDataFrame([(i, q, "en") for i, (q, _) in enumerate(rows) if q], "id long, text string, lang string")
    got = {r["answer_id"]: r["defect_type"] for r in answers.defective_pairs(df, [labelled, asked]).collect()}
    n = len(WORDS) - 1
    assert {i: got.get(i) for i in range(n)} == dict.fromkeys(range(n), "refusal")
    assert [got.get(n + k) for k in range(8)] == [None, "other_language", None, "copies_question", "empty", None, None, "truncated"]
