"""Exact comparison of candidate groups in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.runtime import materialise


def forest(a, b) -> list[tuple]:
    """A spanning forest of the links a[i] - b[i]."""
    up, out = {}, []
    for x, y in zip(a, b, strict=True):
        p, q = x, y
        while up.get(p, p) != p:
            up[p] = up.get(up[p], up[p])
            p = up[p]
        while up.get(q, q) != q:
            up[q] = up.get(up[q], up[q])
            q = up[q]
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def in_blocks(rows: DataFrame, n, name: str) -> DataFrame:
    """Deal rows to pairs (p, q) of ``n`` blocks: block b of n meets every block; small groups are one block."""
    return (
        rows.withColumn("b", F.pmod(F.xxhash64(name), n).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("p", F.least("b", "with"))
        .withColumn("q", F.greatest("b", "with"))
        .drop("with")
    )


def runs(group: pd.DataFrame, by: list[str]):
    """(key, rows) for each combination of ``by``."""
    g = group.sort_values(by, kind="stable")
    keys = g[by].to_numpy()
    for rows in np.split(np.arange(len(g)), np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1):
        if len(rows):
            yield tuple(keys[rows[0]]), g.iloc[rows]


def units(groups: DataFrame, members: DataFrame, block: int, block_entries: int, entries: int) -> DataFrame:
    """(unit, key, codes, p, q, b, no): who is compared with whom exactly.

    ``members`` (no, component, size) are nodes of components of likely pairs, ``groups``
    (group, codes, no) the groups in which candidates were found. Components of one
    block are compared as they are (codes null). A larger one goes block by block, or
    group by group where that moves fewer nodes: nodes that only a chain of likely pairs
    joins share few groups, a crowd of near copies shares most. A block has ``block``
    nodes and ``block_entries`` of their sizes at most on average, a unit of small ones
    ``entries``.
    """
    blocks = lambda m, size: F.greatest(F.ceil(m / block), F.ceil(size / block_entries)).cast("int")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("size").alias("entries")).withColumn("blocks", blocks(F.col("m"), F.col("entries")))
    sizes = materialise(sizes, "sizes")
    whole = lambda rows: rows.select(F.xxhash64("component").alias("key"), F.lit(None).cast("array<int>").alias("codes"), "no", "size", "blocks")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        every = whole(members.join(sizes.select("component", "blocks"), "component"))
    else:
        own = groups.select("group", "codes", "no").join(members.join(large.select("component"), "component").select("no", "component", "size"), "no")
        within = materialise(own.select(F.xxhash64("group", "component").alias("key"), "codes", "no", "component", "size"), "within")
        dealt = within.groupBy("key").agg(F.first("component").alias("component"), F.count("*").alias("k"), F.sum("size").alias("entries")).where("k > 1").withColumn("blocks", blocks(F.col("k"), F.col("entries")))
        moved = dealt.groupBy("component").agg(F.sum(F.col("k") * F.col("blocks")).alias("moved"))
        by_group = materialise(moved.join(large, "component").where(F.col("moved") < F.col("m") * F.col("blocks")).select("component"), "within")
        parts = within.join(by_group, "component", "left_semi").join(dealt.select("key", "blocks"), "key").select("key", "codes", "no", "size", "blocks")
        every = whole(members.join(by_group, "component", "left_anti").join(sizes.select("component", "blocks"), "component")).unionByName(parts)
    small = F.lit(max(1, (every.agg(F.sum("size")).first()[0] or 0) // entries))
    unit = F.when(F.col("blocks") <= 1, F.pmod(F.xxhash64("key"), small)).otherwise(F.xxhash64("key", "p", "q"))
    return in_blocks(every, F.col("blocks"), "no").select(unit.alias("unit"), "key", "codes", "p", "q", "b", "no")
