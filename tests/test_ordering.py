"""Global running sums do not depend on the number of buckets."""

import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import ordering


@pytest.mark.parametrize("most", [4096, 32])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_bounded_buckets(spark, monkeypatch, most, descending):
    """Where the bound on splits is reached, buckets are cut again, and the sums stay exact."""
    monkeypatch.setattr(ordering, "MOST_BUCKETS", most)
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.random(), rng.random() ** 9, -1e12, 3.0])) for i in range(3000)]
    rows += [(3000, float("nan")), (3001, float("inf")), (3002, -float("inf"))]
    df = spark.createDataFrame(rows, "id long, v double")
    splits = ordering.score_splits(df, "v")
    assert len(splits) < max(most, ordering.SCORE_BUCKETS) and (most > 32 or len(splits) <= 31)
    bucketed = ordering.with_score_bucket(df, "v", splits)
    order = [F.col("v").desc(), F.col("id")] if descending else [F.col("v"), F.col("id")]
    got = ordering.running_sums(bucketed, {"n": F.lit(1)}, "_bucket", order, descending=descending)
    place = {r["id"]: r["n"] for r in got.collect()}
    nan_last = [(v != v, 0.0 if v != v else v, i) for i, v in rows]
    want = sorted(nan_last, key=lambda k: ((not k[0], -k[1], k[2]) if descending else k))
    assert [i for _, _, i in want] == sorted(place, key=place.get)
    if most == 32:
        assert bucketed.select("_bucket").distinct().count() > 100
