import random

from pyspark.sql import functions as F

from stackloom.llm import mixing


def setup(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice(["big", "Big ", " BIG", "small-one", "Small_One", "tiny", None]), rnd.choice([0, None, rnd.randint(1, 300)])) for i in range(6000)]
    plans = [("p", "big", 0.2, 1), ("p", "small_one", 0.5, 3), ("p", "tiny", 0.3, 2), ("q", "tiny", 0.9, 2), ("q", "absent", 0.1, 5), ("r", "big", 1.0, None)]
    return sizes, spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint").withColumn("rank", F.lit("clash")), spark.createDataFrame(plans, "plan_id string, source string, target_share double, max_repeats int")


def test_shares_caps_and_reports(spark):
    sizes, docs, plans = setup(spark)
    copies, report = mixing.mix(docs, plans)
    copies, report = copies.collect(), {(r["plan_id"], r["source"]): r for r in report.collect()}
    total = sum(n or 0 for _, _, n in sizes)
    name = lambda s: s.strip().lower().replace("-", "_") if s else None
    have = {s: sum(n or 0 for _, x, n in sizes if name(x) == s) for s in ("big", "small_one", "tiny")}
    limit = {(p, s): (m or 0, t) for p, s, t, m in plans.collect()}
    assert len({(r["plan_id"], r["doc_id"]) for r in copies}) == len(copies)
    for r in copies:
        assert 1 <= r["copies"] <= limit[r["plan_id"], r["source"]][0]
    for key, r in report.items():
        most, share = limit[key]
        mine = [c for c in copies if (c["plan_id"], c["source"]) == key]
        reached = sum(c["copies"] * c["n_tokens"] for c in mine)
        assert r["reached_tokens"] == reached and r["available_tokens"] == have.get(key[1], 0)
        assert r["short"] == (have.get(key[1], 0) * most < share * total)
        aim = min(share * total, have.get(key[1], 0) * most)
        assert abs(reached - aim) <= 300 + 0.02 * aim
        if r["sample_size"] and not r["whole_copies"]:
            assert len(mine) == r["sample_size"]  # no document is certain here
    assert len(report) == 6


def test_drawn_frequencies_follow_the_odds(spark):
    """A source of known sizes drawn for 400 plans: fixed size in each, a document's odds in proportion to its tokens, the largest certain."""
    sizes = [(i, "s", 10 + 7 * (i % 30)) for i in range(120)] + [(120, "s", 40_000), (121, "s", 0), (122, "other", 60_000)]
    docs = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint")
    total = sum(n for _, _, n in sizes)
    small = [n for i, _, n in sizes if i < 120]
    target = 40_000 + 0.2 * sum(small)
    plans = spark.range(400).select(F.col("id").cast("string").alias("plan_id"), F.lit("s").alias("source"), F.lit(target / total).alias("target_share"), F.lit(1).alias("max_repeats"))
    copies, report = mixing.mix(docs, plans)
    drawn = {r["doc_id"]: r["n"] / 400 for r in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    c = 0.2 * sum(small) / sum(n * n for n in small)
    assert drawn[120] == 1.0 and 121 not in drawn and 122 not in drawn
    for n in set(small):
        same = [drawn.get(i, 0.0) for i, _, m in sizes if m == n and i < 120]
        assert abs(sum(same) / len(same) - c * n) < 4 * (c * n * (1 - c * n) / (400 * len(same))) ** 0.5 + 0.01, n
    counts = {r["n"] for r in copies.groupBy("plan_id").agg(F.count("*").alias("n")).collect()}
    expected = c * sum(small)
    assert counts <= {1 + int(expected), 2 + int(expected)}
    rows = report.collect()
    assert all(abs(r["reached_tokens"] - target) <= 230 + 0.1 * 0.2 * sum(small) for r in rows)
    assert abs(sum(r["reached_tokens"] for r in rows) / 400 - target) < 0.01 * target


def test_sampling_is_even_and_repeatable(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("n_tokens"))
    docs = docs.unionByName(spark.range(20_000, 40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit(10).alias("n_tokens")))
    plans = spark.createDataFrame([("p", "s", 0.15, 1)], "plan_id string, source string, target_share double, max_repeats int")
    got = sorted(r["doc_id"] for r in mixing.mix(docs, plans)[0].collect())
    assert abs(len(got) - 6000) <= 1 and got == sorted(r["doc_id"] for r in mixing.mix(docs.repartition(5), plans)[0].collect())
    assert all(abs(sum(a <= x < a + 4000 for x in got) - 1200) < 150 for a in range(0, 20_000, 4000))
    assert sorted(r["doc_id"] for r in mixing.mix(docs, plans, seed=1)[0].collect()) != got


def test_many_strata_take_the_shuffle_join(spark, monkeypatch):
    _, docs, plans = setup(spark)
    want = sorted(map(str, mixing.mix(docs, plans)[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_STRATA", 0)
    assert sorted(map(str, mixing.mix(docs, plans)[0].collect())) == want


def test_empty(spark):
    _, docs, plans = setup(spark)
    copies, report = mixing.mix(docs.limit(0), plans)
    assert copies.collect() == [] and all(r["reached_tokens"] == 0 for r in report.collect())
