"""Queries of the training-data problems over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stackloom.llm import frequent as freq, langid, mixing, packing, percentiles, tokens
from stackloom.operators import joins
from stackloom.operators.skew import heavy_light_join
from stackloom.session import materialize

#: Tokens of a container.
CAPACITY = 2048
#: A compression beyond any number of calls.
FINE = 1 << 50
#: Names of the top list.
TOP = 100


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each function in each log; a call counts once however often it was delivered."""
    calls = _read(spark, sf_dir, "call_records").filter("duration_us >= 0").select("log_id", "qualname", "call_id", "duration_us").distinct()
    return percentiles.digests(calls, ["qualname", "log_id"], "duration_us")


def _function_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = percentiles.merge(_log_digests(spark, sf_dir), ["qualname"])
    return percentiles.quantiles(whole, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = materialize(_function_quantiles(spark, sf_dir).select("qualname", "p50", "n"), "medians")
    calls = _read(spark, sf_dir, "call_records").filter("duration_us >= 0").select("qualname", "call_id", "duration_us")
    # deliveries of a call are joined one by one and reduced afterwards, when few are left
    if medians.count() <= 100_000:
        joined = calls.join(F.broadcast(medians.drop("n")), "qualname")
    else:
        joined = heavy_light_join(calls, medians, ["qualname"], "n", medians.agg(F.sum("n")).first()[0])
    return joined.filter(F.col("duration_us") > 20 * F.col("p50")).select("call_id").distinct()


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each function, from digests of separate logs, with the ranks they may be off by."""
    got = _function_quantiles(spark, sf_dir)
    return got.select("qualname", "n", "p50", "p90", "p95", "p99", F.floor(percentiles.LEVELS * F.col("n") / percentiles.COMPRESSION).alias("rank_error"))


def p3_percentiles_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with so large a compression that no count moves up the tree: ranks are exact, values are so up to their code."""
    calls = _read(spark, sf_dir, "call_records").filter("duration_us >= 0").select("log_id", "qualname", "call_id", "duration_us").distinct()
    logs = percentiles.digests(calls, ["qualname", "log_id"], "duration_us", k=FINE)
    return percentiles.quantiles(percentiles.merge(logs, ["qualname"], k=FINE), {"p50": 0.5, "p95": 0.95}).select("qualname", "n", "p50", "p95")


#: Of the frames only the names are read.
_NAMES = "array<struct<qualified_name: string>>"
_LINES = f"log_id string, line_no bigint, type string, received_at timestamp, count bigint, frames {_NAMES}, samples array<struct<count: bigint, frames: {_NAMES}>>"


def _frame_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, weight of every named frame; repeated lines count once."""
    lines = spark.read.schema(_LINES).parquet(f"{sf_dir}/raw_events.parquet")
    own = F.when(F.col("type").isin("wall_trace", "cpu_trace"), F.struct("count", F.col("frames.qualified_name").alias("names")))
    inner = F.transform(F.coalesce("samples", F.expr(f"cast(array() as array<struct<count: bigint, frames: {_NAMES}>>)")), lambda s: F.struct(s["count"].alias("count"), s["frames"]["qualified_name"].alias("names")))
    stacks = F.filter(F.concat(F.array(own), inner), lambda s: (s["count"] > 0) & s["names"].isNotNull())
    lines = lines.select("log_id", "line_no", stacks.alias("stacks")).filter("size(stacks) > 0")
    once = joins.last_delivery(lines.withColumn("n", F.size("stacks")), ["log_id", "line_no"], "n")
    once = materialize(once.select("stacks"), "stacks")
    stack = once.select(F.explode("stacks").alias("s"))
    return stack.select(F.explode("s.names").alias("value"), F.col("s.count").alias("weight"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.frequent(_frame_weights(spark, sf_dir), share=0.01).select(F.col("value").alias("qualified_name"))


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.frequent(_frame_weights(spark, sf_dir), k=TOP).select(F.col("value").alias("qualified_name"), "weight")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(tokens.token_sizes(_read(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    return packing.pack(sizes, CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose pieces were put into several containers."""
    return packing.split_items(_packed(spark, sf_dir)).select(F.col("item_id").alias("doc_id"))


def p7_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_packed(spark, sf_dir), CAPACITY)


def p7_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing of texts sized in characters: what went in, and what no container may break."""
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_tokens"))
    packed = materialize(packing.pack(texts, CAPACITY), "packed")
    sums = packed.agg(F.count("*").alias("pieces"), F.countDistinct("item_id").alias("items"), F.sum("size").alias("units"), F.count_if(F.col("container_id").isNull()).alias("unplaced"))
    split = packing.split_items(packed).agg(F.count("*").alias("split_items"))
    held = packing.containers(packed, CAPACITY).agg(
        F.sum("used").alias("held_units"), F.count_if(F.col("used") > CAPACITY).alias("over_full"), (F.sum("unused") > 0.05 * F.sum("used") + CAPACITY).cast("bigint").alias("loose")
    )
    tall = lambda df: df.unpivot([], df.columns, "measure", "value")
    return tall(sums).unionByName(tall(split)).unionByName(tall(held))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(tokens.token_sizes(_read(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), "sizes")
    return mixing.mix(sizes, _read(spark, sf_dir, "mix_plans"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].filter("short").select("plan_id", "source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select("plan_id", "source", "doc_id", "copies")


def p8_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the same draw with texts sized in characters: its columns that do not depend on chance, and whether the reached tokens are near the target."""
    sizes = _read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n_tokens"))
    report = mixing.mix(sizes, _read(spark, sf_dir, "mix_plans"))[1]
    near = F.col("short") | (F.abs(F.col("reached_tokens") - F.col("target_tokens")) <= 0.02 * F.col("target_tokens") + F.col("largest_tokens"))
    return report.select("plan_id", "source", F.round("target_tokens", 3).alias("target_tokens"), "available_tokens", "docs", "whole_copies", "short", near.alias("near"))


def _languages(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    model = langid.train(_read(spark, sf_dir, "lang_samples"), "sample_text", "lang")
    return langid.segments(_read(spark, sf_dir, "documents"), model, keep=keep)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _languages(spark, sf_dir, ["lang"]).select("doc_id", langid.iso_code(F.col("lang")).alias("label"), langid.written_in()["lang"].alias("langs")).filter("size(langs) > 0")
    cases = rows.filter("size(langs) > 1 OR label IS NULL OR NOT array_contains(langs, label)")
    return cases.select("doc_id", F.explode("langs").alias("lang"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(_languages(spark, sf_dir))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language, of all documents."""
    return _languages(spark, sf_dir).select("doc_id", F.posexplode("spans").alias("segment", "s")).select("doc_id", "segment", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_percentiles, p3_percentiles_fine, p4_found, p4_top, p7_found, p7_placements, p7_containers, p7_characters, p8_found, p8_report, p8_copies, p8_characters, p9_found, p9_documents, p9_segments,
    )
}

_CALLS = "WITH c AS (SELECT DISTINCT call_id, qualname, duration_us FROM call_records WHERE duration_us >= 0)"
_WEIGHTS = """
WITH l AS (
  SELECT log_id, line_no, any_value(type) AS type, any_value(count) AS n, any_value(frames) AS f, any_value(samples) AS s FROM raw_events GROUP BY log_id, line_no
), e AS (
  SELECT n, f FROM l WHERE type IN ('wall_trace', 'cpu_trace')
  UNION ALL SELECT x.count, x.frames FROM (SELECT unnest(s) AS x FROM l)
), w AS (
  SELECT unnest(f).qualified_name AS value, n FROM e WHERE n > 0
), t AS (
  SELECT value, sum(n) AS weight FROM w WHERE value IS NOT NULL GROUP BY value
)
"""
_CODE = "((({q} >> {s}) + 1) << {s}) - 1"


def _coded(p: float) -> str:
    """The largest value of the code of an exact quantile."""
    q = f"quantile_disc(duration_us, {p})"
    return _CODE.format(q=q, s=f"CAST(greatest(0, floor(log2(greatest({q}, 1))) - {percentiles.MANTISSA}) AS BIGINT)")


_SAME = "replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '-', '_')"
SQL = {
    "p3_percentiles_fine": _CALLS + f" SELECT qualname, count(*) AS n, {_coded(0.5)} AS p50, {_coded(0.95)} AS p95 FROM c GROUP BY qualname",
    "p7_characters": f"""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)
SELECT 'pieces' AS measure, CAST(sum(greatest(ceil(n / {CAPACITY}), 1)) AS BIGINT) AS value FROM d UNION ALL SELECT 'items', count(DISTINCT doc_id) FROM d UNION ALL SELECT 'units', CAST(sum(n) AS BIGINT) FROM d
UNION ALL SELECT 'unplaced', count_if(n = 0) FROM d UNION ALL SELECT 'split_items', count_if(n > {CAPACITY}) FROM d UNION ALL SELECT 'held_units', CAST(sum(n) AS BIGINT) FROM d UNION ALL SELECT 'over_full', 0 UNION ALL SELECT 'loose', 0""",
    "p8_characters": f"""WITH d AS (SELECT {_SAME} AS source, coalesce(length(text), 0) AS n FROM documents), t AS (SELECT sum(n) AS total FROM d), s AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS available_tokens, count(*) AS docs FROM d WHERE source IS NOT NULL GROUP BY source
), p AS (SELECT plan_id, {_SAME} AS source, target_share, max_repeats, target_share * (SELECT total FROM t) AS target FROM mix_plans)
SELECT plan_id, source, round(target, 3) AS target_tokens, coalesce(available_tokens, 0) AS available_tokens, coalesce(docs, 0) AS docs,
  CAST(least(floor(CASE WHEN coalesce(available_tokens, 0) > 0 THEN target / available_tokens ELSE max_repeats END), max_repeats) AS INT) AS whole_copies, coalesce(available_tokens, 0) * max_repeats < target AS short, true AS near
FROM p LEFT JOIN s USING (source)""",
    "p3_found": _CALLS + """, m AS (SELECT qualname, quantile_disc(duration_us, 0.5) AS p50 FROM c GROUP BY qualname)
SELECT DISTINCT call_id FROM c JOIN m USING (qualname) WHERE duration_us > 20 * p50""",
    "p4_found": _WEIGHTS + "SELECT value AS qualified_name FROM t WHERE weight >= 0.01 * (SELECT sum(weight) FROM t)",
    "p4_top": _WEIGHTS + f"SELECT value AS qualified_name, CAST(weight AS BIGINT) AS weight FROM t ORDER BY weight DESC, value LIMIT {TOP}",
}
