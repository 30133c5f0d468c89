"""Connected components over an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.runtime import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: Nodes with more rows than this, or than the ``SHARE``-th part of all rows, are hubs: at most 2 * ``SHARE`` of them.
HUB, SHARE = 1_000, 100_000


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the m of their u in ``least`` (u, m, deg).

    Hubs' rows stay where they are and meet a broadcast of the hubs, whose number has a
    proven bound; the others are shuffled.
    """
    limit = max(HUB, total // SHARE)
    hubs = least.where(F.col("deg") > limit).select("u", F.col("m").alias("hub"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    others = marked.where("hub IS NULL").select("u", "v").join(least.where(F.col("deg") <= limit).select("u", "m"), "u")
    return marked.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")).unionByName(others)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node reachable, itself included.

    Alternates large-star and small-star contraction, so a chain of n nodes needs
    O(log^2 n) rounds. Both steps are a ``min`` aggregate (combined before the
    shuffle) and an equi-join on the node; hubs leave that join, so neither gathers a
    hub's rows in one task. Every round is a table in the shared folder.

    Edges with a null end are ignored; a self-loop yields a singleton component.
    Nodes may be of any orderable type.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # u is the greater end: after convergence v is the component's least node.
    cur = materialise(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    state = _state(cur)
    while state[0]:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg"))
        # Large star: greater neighbours of u move to the least of u and its neighbours.
        large = (
            _with_least(both.where("v > u"), lows, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: u and its lesser neighbours move to the least of those neighbours.
        small_low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
        small = (
            _with_least(large, small_low, state[0])
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = materialise(small, "cc")
        after = _state(new)
        discard(cur)
        cur = new
        if after == state:
            break
        state = after
    return nodes.join(cur, nodes.node == cur.u, "left").select("node", F.coalesce("v", "node").alias("component"))
