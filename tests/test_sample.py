"""The bounded sample is that of the least hashes, whatever the partitions and the guess of the size."""

import pytest
from pyspark.sql import functions as F

from terseforge.runtime import hashed_sample


@pytest.mark.parametrize("guess", [5000, 1, 10**9])
@pytest.mark.parametrize("parts", [1, 40])
def test_least_hashes(spark, guess, parts):
    df = spark.range(5000).select("id", F.lit("x").alias("t")).repartition(parts)
    want = [r["id"] for r in df.orderBy(F.xxhash64("id")).limit(70).collect()]
    assert [r["id"] for r in hashed_sample(df, "id", 70, guess)] == want


def test_small_and_empty_tables(spark):
    assert len(hashed_sample(spark.range(9), "id", 70, 9)) == 9 and hashed_sample(spark.range(0), "id", 70, 0) == []
