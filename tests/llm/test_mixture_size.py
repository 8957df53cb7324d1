"""The size asked of a mixture, and targets without a share or a cap."""

from terseforge.llm import tokens


def _documents(spark):
    rows = [(i, "some words in a text", "rare" if i < 100 else "big") for i in range(1000)]
    rows += [(1000 + i, "some words in a text", s) for i, s in enumerate(("never", "uncapped", "unshared"))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_size_is_honoured_up_to_the_caps(spark):
    df = _documents(spark)
    targets = spark.createDataFrame([("rare", 0.5, 2), ("big", 0.5, 3)], "source string, target_share double, max_repeats int")
    one = {r["source"]: r for r in tokens.mixture(df, targets)[1].collect()}
    each = one["rare"]["n_tokens"] / 100
    two = {r["source"]: r for r in tokens.mixture(df, targets, total_tokens=int(2000 * each))[1].collect()}
    assert two["rare"]["rate"] == 2 and abs(two["big"]["expected_tokens"] - 1000 * each) < 1
    assert abs(two["rare"]["mixed_share"] - 200 / 1200) < 0.02 and two["rare"]["mixed_share"] < one["rare"]["mixed_share"]


def test_null_and_zero_caps_and_shares(spark):
    targets = spark.createDataFrame([("rare", 0.4, 2), ("big", 0.4, 3), ("never", 0.1, 0), ("uncapped", 0.1, None), ("unshared", None, 2)], "source string, target_share double, max_repeats int")
    copies, shares = tokens.mixture(_documents(spark), targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert len(rows) == 5 and all(rows[s]["rate"] == 0 and rows[s]["mixed_tokens"] == 0 for s in ("never", "uncapped", "unshared"))
    assert rows["rare"]["rate"] == 2 and copies.count() > 300
