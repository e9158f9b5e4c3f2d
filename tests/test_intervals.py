import random

import pytest

from stackloom.operators.intervals import merge_intervals


def brute(rows):
    groups = {}
    for key, s, e in rows:
        if s is not None and e is not None and e >= s:
            groups.setdefault(key, []).append((s, e))
    out = []
    for key, spans in groups.items():
        periods = []
        for s, e in sorted(spans):
            if periods and s <= periods[-1][1]:
                periods[-1] = (periods[-1][0], max(periods[-1][1], e))
            else:
                periods.append((s, e))
        out += [(key, "period", a, b) for a, b in periods]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in merge_intervals(df, ["k"], "s", "e", **kw).collect()), key=str)


@pytest.mark.parametrize("split", [10**6, 150, 20])
def test_matches_brute_force_whole_and_cut(spark, split):
    rnd = random.Random(split)
    rows = []
    for _ in range(500):
        s = rnd.randint(-500, 3000)
        rows.append((rnd.choice(["a", "a", "a", "b", None]), None if rnd.random() < 0.05 else s, s + rnd.choice([0, 0, 1, 2, 5, 10, -3, 200 if rnd.random() < 0.1 else 3])))
    assert run(spark.createDataFrame(rows, "k string, s bigint, e bigint"), split_rows=split) == brute(rows)


def test_one_interval_spans_every_piece(spark):
    rows = [("a", 0, 10_000)] + [("a", i * 10, i * 10 + 3) for i in range(300)] + [("a", 20_000, 20_001), ("a", 20_001, 20_001)]
    assert run(spark.createDataFrame(rows, "k string, s bigint, e bigint"), split_rows=30) == brute(rows)


def test_touching_zero_length_repeats_and_large_values(spark):
    base = 1_767_936_235_231_032
    rows = [("a", base, base), ("a", base, base + 1), ("a", base + 1, base + 2), ("a", base + 3, base + 3), ("a", base + 3, base + 3)]
    assert run(spark.createDataFrame(rows, "k string, s bigint, e bigint")) == [("a", "gap", base + 2, base + 3), ("a", "period", base, base + 2), ("a", "period", base + 3, base + 3)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, s bigint, e bigint")
    assert run(empty) == []
    more = spark.createDataFrame([("a", 1, 2, "x", 9, "y")], "k string, s bigint, e bigint, kind string, __from bigint, session_window string")
    assert run(more) == [("a", "period", 1, 2)]


def test_a_key_of_over_seventy_pieces_and_one_crowded_start(spark):
    rnd = random.Random(9)
    rows = [("hot", rnd.randint(0, 10**9), 0) for _ in range(2500)] + [("hot", 5_000_000 + rnd.randint(0, 30), 0) for _ in range(900)] + [("hot", 77, 0)] * 200 + [(None, i, 0) for i in range(60)] + [("cold", 5, 0)]
    rows = [(k, s, s + rnd.choice([0, 3, 1000, 400_000])) for k, s, _ in rows]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    from stackloom.operators import intervals as I

    cuts, few = I._cuts(df.selectExpr("k", "s AS __from", "e AS __to"), ["k"], 40)
    bounds = {r["k"]: r["__bounds"] for r in cuts.collect()}
    assert few and len(bounds["hot"]) >= 70 and set(bounds) == {"hot", None}
    starts = sorted(s for k, s, _ in rows if k == "hot")
    edges = [-1, *bounds["hot"], 10**12]
    for a, b in zip(edges, edges[1:]):
        inside = [s for s in starts if a <= s < b]
        assert len(inside) - max(map(inside.count, set(inside)), default=0) <= 80
    assert run(df, split_rows=40) == brute(rows)
    I.BROADCAST_ENTITIES, before = 0, I.BROADCAST_ENTITIES
    try:
        assert run(df, split_rows=40) == brute(rows)
    finally:
        I.BROADCAST_ENTITIES = before
