import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stackloom.llm import percentiles as P


def test_codes_are_monotone_and_close(spark):
    values = sorted({0, 1, 2, 1023, 1024, 2047, 2048, 2049, 4095, 4096, *(2**k + d for k in range(12, 62) for d in (-1, 0, 1)), 2**63 - 1})
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    codes = [r[0] for r in df.orderBy("v").select(P.code(F.col("v"))).collect()]
    assert codes == sorted(codes) and codes[-1] < 1 << P.LEVELS
    upper = P.decode(np.array(codes[:-1]))
    assert all(v <= u <= v * 1.001 + 1 for v, u in zip(values, upper.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << P.LEVELS) - 1), min_size=1, max_size=400), st.integers(1, 60))
def test_compression_keeps_counts_and_its_invariant(codes, k):
    leaves, counts = np.unique(np.array(codes) + (1 << P.LEVELS), return_counts=True)
    limit = np.array([len(codes) // k])
    row, node, count = P.compress(np.zeros(len(leaves), np.int64), leaves, counts.astype(np.int64), limit)
    assert count.sum() == len(codes) and len(set(node.tolist())) == len(node) and (row == 0).all()
    kept = dict(zip(node.tolist(), count.tolist()))
    for v in kept:
        if v > 1:
            assert kept[v] + kept.get(v ^ 1, 0) + kept.get(v >> 1, 0) > limit[0]
        if v < 1 << P.LEVELS:
            assert kept[v] <= limit[0]


@pytest.mark.parametrize("k", [64, 640])
def test_merged_ranks_stay_within_the_bound(spark, k):
    rng = np.random.default_rng(k)
    rows = [(g, int(day), int(v)) for g, n in (("a", 6000), ("b", 50), ("c", 1)) for day, v in zip(rng.integers(0, 9, n), rng.lognormal(8, 2, n))]
    rows += [("a", 1, None), ("b", 2, -5), ("d", 1, None), (None, 1, 7), (None, 2, 9)]
    df = spark.createDataFrame(rows, "g string, day int, v bigint").withColumn("n", F.lit("clash"))
    got = P.quantiles(P.merge(P.digests(df, ["g", "day"], "v", k), ["g"], k), {"p50": 0.5, "p99": 0.99}).collect()
    assert {r["g"] for r in got} == {"a", "b", "c", None}
    for r in got:
        data = np.sort([v for g, _, v in rows if g == r["g"] and v is not None and v >= 0])
        assert r["n"] == len(data) and len(r["digest"]["nodes"]) <= 3 * k
        for name, q in (("p50", 0.5), ("p99", 0.99)):
            rank = np.ceil(q * len(data))
            low, high = np.searchsorted(data, r[name] / 1.002, "left"), np.searchsorted(data, r[name] * 1.002 + 1, "right")
            slack = P.LEVELS * len(data) / k + 1
            assert low - slack <= rank <= high + slack


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v bigint")
    assert P.quantiles(P.merge(P.digests(df, ["g"], "v"), ["g"]), {"p50": 0.5}).collect() == []
