"""The quality rules are fitted on every labelled row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality


def test_all_labelled_rows_fit(spark):
    labels = spark.range(250_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality._trusted(labels).count() == 250_000


@pytest.mark.parametrize("bitmaps", [0, 1 << 14])
def test_flags_are_membership(spark, monkeypatch, bitmaps):
    monkeypatch.setattr(quality, "BITMAPS", bitmaps)
    rng = random.Random(2)
    ids = [0, 1, -1, 32768, 32769, 65536, -32768, -32769, 2**63 - 1, -(2**63), *(rng.randrange(-100_000, 100_000) for _ in range(300))]
    chosen = set(ids[::2])
    docs = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    got = quality._flagged(docs, spark.createDataFrame([(i,) for i in chosen], "id long")).collect()
    assert sorted((x.id, x.fits) for x in got if x.id is not None) == sorted((i, i in chosen) for i in ids)
    assert [x.fits for x in got if x.id is None] == [False]


@pytest.mark.parametrize("n", [0, 1, 2, 1001, 2500])
def test_the_least_score_is_the_percentile(spark, n):
    rng = random.Random(n)
    values = [rng.gauss(0, 1) for _ in range(n)]
    got = quality._least(spark.createDataFrame([(v,) for v in values], "llr double"))
    assert got is None if not n else abs(got - np.percentile(values, 100 * quality.MISSED)) < 1e-12
