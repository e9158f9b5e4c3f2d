"""The subpackage's queries against SQL and against each other, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stackloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(Q.SQL[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))


def test_percentiles_lie_within_the_stated_ranks(spark, duck):
    data: dict = {}
    for q, d in duck.sql("SELECT qualname, duration_us FROM (SELECT DISTINCT call_id, qualname, duration_us FROM call_records WHERE duration_us >= 0) ORDER BY 2").fetchall():
        data.setdefault(q, []).append(d)
    got = {r["qualname"]: r for r in Q.p3_percentiles(spark, DATA).collect()}
    assert set(got) == set(data)
    for q, r in got.items():
        for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            rank = max(1, -(-len(data[q]) * int(p * 100) // 100))
            below = sum(v <= r[name] * 1.001 + 1 for v in data[q])
            under = sum(v < r[name] * 0.999 - 1 for v in data[q])
            assert under - r["rank_error"] <= rank <= below + r["rank_error"]


def test_shares_and_containers(spark):
    report = Q.p8_report(spark, DATA).collect()
    short = {(r["plan_id"], r["source"]) for r in report if r["short"]}
    assert {tuple(r) for r in Q.p8_found(spark, DATA).collect()} == short
    split = {r["doc_id"] for r in Q.p7_found(spark, DATA).collect()}
    placed = Q.p7_placements(spark, DATA).collect()
    assert split == {r["item_id"] for r in placed if r["pieces"] > 1}
    assert all(r["used"] <= Q.CAPACITY for r in Q.p7_containers(spark, DATA).collect())


def test_languages_agree_with_most_labels(spark):
    found = Q.p9_documents(spark, DATA).collect()
    assert all(0 < r["confidence"] <= 1 and Q.langid.MIN_SHARE <= r["share"] <= 1.0001 for r in found)
    docs = {r["doc_id"]: r["label"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", Q.langid.iso_code(Q.F.col("lang")).alias("label")).collect()}
    alone = {}
    for r in found:
        alone.setdefault(r["doc_id"], []).append(r["lang"])
    labelled = [(docs[i], ls) for i, ls in alone.items() if docs[i]]
    assert sum(label in ls for label, ls in labelled) / len(labelled) > 0.85  # the rest are the planted wrong labels
    segments = Q.p9_segments(spark, DATA).collect()
    assert all(s["start"] < s["stop"] for s in segments) and {s["doc_id"] for s in segments} >= {r["doc_id"] for r in found}
