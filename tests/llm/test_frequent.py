import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackloom.llm.frequent import frequent


def rows(seed):
    rnd = random.Random(seed)
    return [(None if rnd.random() < 0.02 else f"v{int(rnd.paretovariate(0.7)) % 3000}", rnd.choice([1, 2, 5, 0, None, -3])) for _ in range(5000)] + [("tie1", 40), ("tie2", 40), ("", 7)]


def totals(data):
    out = Counter()
    for v, w in data:
        if v is not None and w and w > 0:
            out[v] += w
    return out


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_share_and_top_match_full_counts(spark, bits):
    data = rows(bits)
    df = spark.createDataFrame(data, "value string, weight bigint").withColumn("__prefix", F.lit(1))
    want = totals(data)
    total = sum(want.values())
    assert {tuple(r) for r in frequent(df, share=0.01, bits=bits).collect()} == {(v, w) for v, w in want.items() if w >= 0.01 * total}
    top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:25]
    assert [tuple(r) for r in frequent(df, k=25, bits=bits).collect()] == top


def test_fewer_values_than_asked_and_none(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "value string, weight bigint")
    assert {tuple(r) for r in frequent(df, k=10).collect()} == {("a", 2), ("b", 2)}
    assert frequent(df.limit(0), k=3).collect() == [] and frequent(df.filter("weight > 5"), share=0.1).collect() == []
