"""Alignment, thresholds and masks on small fixtures and against a sequential walk."""

import math
import random

from pyspark.sql import functions as F

from terseforge.operators import masking as M
from terseforge.operators import units as U


def _walk(tokens, units):
    """Token by token: units that end inside share it, else the unit around gets it."""
    ends, got, at, k = [], [[] for _ in units], 0, 0
    total = 0
    for u in units:
        total += len(u)
        ends.append(total)
    for text, info in tokens:
        start, at = at, at + len(text)
        hit = [i for i, e in enumerate(ends) if start < e <= at]
        if hit:
            for i in hit:
                got[i].append(info / len(hit))
        elif text != " ":
            k = next(i for i, e in enumerate(ends) if e > start)
            got[k].append(info)
    return [sum(g) / len(g) if g else None for g in got]


def _cut(rng, text):
    out = []
    while text:
        n = rng.randint(1, 4)
        out.append(text[:n])
        text = text[n:]
    return out


def test_alignment_equals_the_walk(spark):
    rng = random.Random(5)
    cases = [([("ab", 1.0), ("c", 2.0)], ["ab", "c"]), ([("abc", 3.0)], ["a", "b", "c"][:3]), ([("abc", 1.0), ("d", 2.0)], ["ab", "cd"]), ([("a", 1.0), (" ", 9.0), ("b", 3.0)], ["a b"])]
    for _ in range(120):
        text = "".join(rng.choice("ab  c") for _ in range(rng.randint(1, 20)))
        cases.append(([(t, float(rng.randint(1, 9))) for t in _cut(rng, text)], _cut(rng, text)))
    tokens = spark.createDataFrame([(d, i, t, s) for d, (ts, _) in enumerate(cases) for i, (t, s) in enumerate(ts)], "d int, pos int, token string, self_info double")
    units = spark.createDataFrame([(d, i, t) for d, (_, us) in enumerate(cases) for i, t in enumerate(us)], "d int, unit int, text string")
    got = {(r["d"], r["unit"]): r["self_info"] for r in U.aligned(tokens, units, ["d"]).collect()}
    for d, (ts, us) in enumerate(cases):
        for i, want in enumerate(_walk(ts, us)):
            have = got.get((d, i))
            assert (have is None and want is None) or math.isclose(have, want, abs_tol=1e-9), (cases[d], i, have, want)


def _units(spark, scores):
    df = spark.createDataFrame([([(f"u{i}", s) for i, s in enumerate(scores)],)], "units array<struct<text:string,self_info:double>>")
    return lambda c: df.select(c(F.col("units"))).first()[0]


def test_threshold_and_mask(spark):
    on = _units(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert on(lambda u: M.threshold(u, 0.5)) == 3.0
    assert on(lambda u: M.masked_units(u, 0.5)) == ["u0", "u1"]
    assert on(lambda u: M.masked_units(u, 0.0)) == []
    assert on(lambda u: M.masked_units(u, 1.0)) == ["u0", "u1", "u2", "u3"]
    assert on(lambda u: M.masked_text(u, 0.5, "sent")) == "  u2 u3 u4"


def test_equal_scores_keep_all(spark):
    assert _units(spark, [2.0] * 4)(lambda u: M.masked_units(u, 1.0)) == []


def test_nan_and_null_are_kept(spark):
    on = _units(spark, [float("nan"), 1.0, 2.0, 3.0, None])
    assert on(lambda u: M.threshold(u, 0.5)) == 2.0
    assert on(lambda u: M.masked_units(u, 0.5)) == ["u1"]
    none = _units(spark, [float("nan"), None])
    assert none(lambda u: M.threshold(u, 0.5)) is None
    assert none(lambda u: M.masked_text(u, 0.9, "phrase")) == "u0u1"


def test_sentence_replacement_keeps_leading_words(spark):
    df = spark.createDataFrame([("One, two three four",)], "t string")
    assert df.select(M.replacement("sent", F.col("t"), 3, M.SENT_MASK)).first()[0] == "One , two " + M.SENT_MASK


def test_reduced_ratio_never_negative(spark):
    df = spark.createDataFrame([("ab", "abcd"), ("abcd", "a"), ("", "a")], "r string, c string")
    assert [r[0] for r in df.select(M.reduced_ratio(F.col("r"), F.col("c"))).collect()] == [0.0, 0.75, None]


def test_large_model_is_joined_the_same(spark, sf):
    rows = U.token_rows(spark.read.parquet(f"{sf}/documents.parquet").limit(20), "doc_id", F.col("text")).cache()
    model = U.unigram_model(rows)
    a = U.scored(rows, model).agg(F.sum("self_info"), F.count("*")).first()
    b = U.scored(rows, model, broadcast_bytes=0).agg(F.sum("self_info"), F.count("*")).first()
    assert a[1] == b[1] and math.isclose(a[0], b[0], rel_tol=1e-9)
    rows.unpersist()
