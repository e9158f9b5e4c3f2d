"""Mergeable percentiles with deterministic rank error: q-digests.

Values are quantised to a bounded ordered universe of 2^16 codes (log-linear,
1,024 steps an octave, so a code is wrong by under 0.1 % of the value). A digest
keeps counts on nodes of the dyadic tree over these codes; a node whose count
together with its sibling's and parent's is at most n/k moves into the parent.
Digests merge by adding nodes and compressing again. A quantile read from a
digest of n values with compression k is off by at most 16 n / k ranks, however
the digests were merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Levels of the dyadic tree, and the bits kept of a value.
LEVELS, MANTISSA = 16, 10
#: k of the digest: rank error at most LEVELS / COMPRESSION = 0.25 %; a digest holds at most 3 k nodes.
COMPRESSION = 6400

_NODES = T.StructType([T.StructField("nodes", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def code(value: Column) -> Column:
    """The code of a non-negative integer; monotone in the value."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int") - MANTISSA)
    return (shift * (1 << MANTISSA) + F.call_function("shiftright", value, shift)).cast("int")


def decode(codes: np.ndarray) -> np.ndarray:
    """The largest value of each code."""
    codes = codes.astype(np.int64)
    shift = np.maximum(0, (codes >> MANTISSA) - 1)
    return (((codes - (shift << MANTISSA)) + 1) << shift) - 1


def compress(row: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move small counts up the trees of many digests at once. ``limit[row]`` is floor(n / k); (row, node) are unique."""
    level = np.floor(np.log2(node)).astype(np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cur = (row[:0], node[:0], count[:0])
    for at in range(LEVELS, 0, -1):
        own = level == at
        r, v, c = _add(np.r_[cur[0], row[own]], np.r_[cur[1], node[own]], np.r_[cur[2], count[own]])
        parent = v >> 1
        up = level == at - 1
        pr, pv, pc = row[up], node[up], count[up]
        key, inverse = np.unique(np.r_[(r << 20) | parent, (pr << 20) | pv], return_inverse=True)
        total = np.bincount(inverse, np.r_[c, pc].astype(np.float64), len(key)).astype(np.int64)
        small = total[inverse[: len(r)]] <= limit[r]
        kept.append((r[~small], v[~small], c[~small]))
        cur = (r[small], parent[small], c[small])
    root = level == 0
    kept.append(_add(np.r_[cur[0], row[root]], np.r_[cur[1], node[root]], np.r_[cur[2], count[root]]))
    return tuple(np.concatenate(x) for x in zip(*kept))


def _add(row: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(row):
        return row, node, count
    key, inverse = np.unique((row.astype(np.int64) << 20) | node, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, count)
    return key >> 20, key & ((1 << 20) - 1), total


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)


def _compressor(k: int):
    @F.pandas_udf(_NODES)
    def run(nodes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        row, node = _flat(nodes)
        _, count = _flat(counts)
        n = np.bincount(row, count, len(nodes)).astype(np.int64)
        r, v, c = compress(row, node, count, n // k)
        order = np.lexsort((v, r))
        cuts = np.searchsorted(r[order], np.arange(1, len(nodes)))
        return pd.DataFrame({"nodes": np.split(v[order].astype(np.int32), cuts), "counts": np.split(c[order], cuts)})

    return run


def _fold(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, n, digest from unique (keys, node, count) rows, of which a group has at most 2^17."""
    lists = nodes.groupBy(*keys).agg(F.sum("count").alias("n"), F.collect_list(F.struct("node", "count")).alias("x"))
    return lists.select(*keys, "n", _compressor(k)(F.col("x.node"), F.col("x.count")).alias("digest"))


def digests(df: DataFrame, keys: list[str], value: str, k: int = COMPRESSION) -> DataFrame:
    """One digest a group: keys, n, digest.

    Equal codes of a group are counted before they are shuffled, and a group then
    has at most 65,536 rows, so one with a third of all rows is no larger than
    others. Null and negative values are left out; a group without any other has
    no row; a null key is a key of its own; an empty table gives no rows.
    """
    rows = df.filter(F.col(value) >= 0).select(*keys, (F.lit(1 << LEVELS) + code(F.col(value).cast("bigint"))).alias("node"))
    return _fold(rows.groupBy(*keys, "node").count(), keys, k)


def merge(parts: DataFrame, keys: list[str], k: int = COMPRESSION) -> DataFrame:
    """Digests of coarser groups from those of finer ones, by adding nodes."""
    nodes = parts.select(*keys, F.explode(F.arrays_zip("digest.nodes", "digest.counts")).alias("x"))
    return _fold(nodes.groupBy(*keys, F.col("x.nodes").alias("node")).agg(F.sum("x.counts").alias("count")), keys, k)


def quantiles(parts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The digests with one bigint column for each named probability p: the value of rank ceil(p n), within the error."""
    names = list(probabilities)
    kind = T.StructType([T.StructField(x, T.LongType()) for x in names])

    @F.pandas_udf(kind)
    def read(nodes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = {x: np.zeros(len(nodes), np.int64) for x in names}
        for i, (node, count) in enumerate(zip(nodes, counts)):
            node, count = np.asarray(node, np.int64), np.asarray(count, np.int64)
            below = LEVELS - np.floor(np.log2(node)).astype(np.int64)
            last = ((node + 1) << below) - 1 - (1 << LEVELS)  # largest code under the node
            order = np.lexsort((below, last))
            seen = np.cumsum(count[order])
            for x in names:
                rank = max(1, int(np.ceil(probabilities[x] * seen[-1] - 1e-9)))
                out[x][i] = decode(last[order][[np.searchsorted(seen, rank)]])[0]
        return pd.DataFrame(out)

    return parts.withColumn("__q", read("digest.nodes", "digest.counts")).select("*", "__q.*").drop("__q")
