import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stackloom.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_best_fit_matches_a_plain_search(sizes, limit):
    bins = packing.BestFit(50, limit)
    room: dict[int, int] = {}  # free space of the open bins
    fill: dict[int, int] = {}
    for s in sizes:
        fits = [f for f in room.values() if f >= s]
        least = min(room.values(), default=0)
        before, full = set(room), len(room) == limit
        n = bins.place(s)
        if n in before:
            assert room[n] == min(fits)
        else:
            assert not fits
            still = {b for stack in bins.free for b in stack}
            closed = before - still
            assert len(closed) == full and all(room[b] == least for b in closed)
            for b in closed:
                del room[b]
            room[n] = 50
        room[n] -= s
        fill[n] = fill.get(n, 0) + s
        if room[n] == 0:
            del room[n]
        assert sorted(room) == sorted(b for stack in bins.free for b in stack) and bins.open == len(room) <= limit
    assert all(v <= 50 for v in fill.values()) and sum(fill.values()) == sum(sizes)


def test_everything_is_packed_once_and_tightly(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice([rnd.randint(1, 400), rnd.randint(1, 90), 0, None, 2048, 2049, 5000])) for i in range(3000)] + [(None, 10), (7, 10)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint").withColumn("container_id", F.lit("clash"))
    got = packing.pack(df, 2048, task_items=1000).collect()
    assert sum(r["size"] for r in got) == sum(n or 0 for _, n in data)
    for r in got:
        assert r["size"] <= 2048 and (r["container_id"] is None) == (r["size"] == 0)
        assert r["first_unit"] == 2048 * r["piece"] and (r["size"] == 2048 or r["piece"] == r["pieces"] - 1)
    assert {r["item_id"] for r in got if r["pieces"] > 1} == {i for i, n in data if n and n > 2048}
    boxes = packing.containers(packing.pack(df, 2048, task_items=1000), 2048).collect()
    assert all(0 <= r["unused"] for r in boxes)
    assert sum(r["unused"] for r in boxes) < 0.05 * sum(r["used"] for r in boxes)
    again = packing.pack(df.repartition(7), 2048, task_items=1000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert packing.pack(df.limit(0), 2048).collect() == []


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world <|endoftext|>"), (2, ""), (3, None), (4, "x" * 200_000), (5, "日本語のテキスト")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(df, "doc_id", "text").collect()}
    coder = tokens.encoding(tokens.TOKENIZER)
    assert got[2] == got[3] == 0 and got[1] == len(coder.encode_ordinary("Hello world <|endoftext|>")) and got[4] > 1000 and got[5] > 0
