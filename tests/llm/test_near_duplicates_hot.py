"""Bands by threshold, and buckets that are divided."""

import random

import numpy as np
import pytest

from terseforge.llm import neardup

WORDS = [f"w{k}" for k in range(400)]


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.45, 0.5, 0.55, 0.6, 0.65, 0.75, 0.8, 0.9, 1.0])
def test_the_escape_holds_at_every_threshold(threshold):
    bands, rows = neardup.bands_for(threshold)
    assert (1 - threshold**rows) ** bands <= neardup.ESCAPE
    assert bands <= neardup.MOST_BANDS or rows == 1


def _similar(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_divided_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    shared = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(3)]  # boilerplate, under the threshold
    texts = [shared[k % 3] + " " + " ".join(rng.choice(WORDS) for _ in range(60)) for k in range(150)]
    for t in list(texts[:40]):
        w = t.split()
        w[rng.randrange(len(w))] = "x"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [neardup.shingles(t, 3) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _similar(sets[i], sets[j]) >= 0.6}
    for hot in (500, 3):
        monkeypatch.setattr(neardup, "HOT", hot)
        pairs, members = neardup.near_duplicates(df, ["id"], "text", threshold=0.6, size=3)
        assert {(r["a_id"], r["b_id"]) for r in neardup.record_pairs(pairs, members, ["id"]).collect()} == want, hot


def test_one_common_bucket_is_enough_however_full(spark, monkeypatch):
    rng = random.Random(4)
    shared = [rng.choice(WORDS) for _ in range(30)]
    texts = []
    for _ in range(60):
        own = [rng.choice(WORDS) for _ in range(70)]
        texts += [" ".join(shared + own), " ".join(shared + own[:47] + [rng.choice(WORDS) for _ in range(23)])]
    texts += [" ".join(shared)] * 2 + [" ".join(shared + ["x"] * k) for k in range(1, 4)] + ["", "x"]
    monkeypatch.setattr(neardup, "bands_for", lambda _: (4, 1))
    monkeypatch.setattr(neardup, "HOT", 5)
    sets = [neardup.shingles(t, 3) for t in texts]
    bands = [set(neardup.band_hashes(neardup.signature(s, 4), 4, 1).tolist()) if len(s) else set() for s in sets]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if bands[i] & bands[j] and _similar(sets[i], sets[j]) >= 0.6}
    assert any(len(bands[i] & bands[j]) == 1 for i, j in want)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, members = neardup.near_duplicates(df, ["id"], "text", threshold=0.6, size=3)
    assert want <= {(r["a_id"], r["b_id"]) for r in neardup.record_pairs(pairs, members, ["id"]).collect()}


@pytest.mark.parametrize(("threshold", "unit"), [(0.3, "word"), (0.6, "word"), (0.9, "word"), (0.5, "char")])
def test_the_prefix_join_gives_every_similar_pair(spark, threshold, unit):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [rng.choice(WORDS[:40]) for _ in range(rng.randrange(1, 40))]
        texts += [" ".join(base), " ".join(base[: rng.randrange(len(base)) + 1]), " ".join(rng.choice(WORDS) if rng.random() < 0.05 else w for w in base)]
    sets = [neardup.shingles(t, 3, unit) for t in texts]
    df = spark.createDataFrame([(i % 2, i // 2, t, i % 14 < 4) for i, t in enumerate(texts)], "part int, id long, text string, sought boolean")
    for sought in (None, "sought"):
        want = {(i % 2, i // 2, j // 2) for i in range(len(texts)) for j in range(i + 2, len(texts), 2) if _similar(sets[i], sets[j]) >= threshold and (sought is None or i % 14 < 4 or j % 14 < 4)}
        met = neardup.prefix_pairs(df, ["part", "id"], "text", threshold, 3, unit=unit, sought=sought).withColumnRenamed("__p", "p")
        named = {r["p"]: r["part"] for r in df.selectExpr("part", "xxhash64(part) as p").distinct().collect()}
        assert want <= {(named[r["p"]], r["a_rep"], r["b_rep"]) for r in met.collect()}
