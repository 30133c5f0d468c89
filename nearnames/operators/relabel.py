"""Reviewed label changes as a window over each pair's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relabel(base: DataFrame, changes: DataFrame, pos: str = "pos", seq: str = "seq", allow_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(final pairs, change log).

    ``base`` has x_1, x_2, label and a row order ``pos``; ``changes`` has action
    (remove, add, or anything else: relabel), x_1, x_2, new_label and an order ``seq``.
    Keys are raw unordered pairs. A change sets its key's state outright, so what it
    finds is its predecessor's result: one lag over the key's events, no loop.

    Repeated base pairs stand at the first one's place with the last one's label and
    spelling. Unless ``allow_missing``, adding a pair that is there, or changing one
    that isn't, raises.
    """
    key = [F.least("x_1", "x_2").alias("lo"), F.greatest("x_1", "x_2").alias("hi")]
    at = F.struct(F.col(pos).cast("long").alias("a"))
    first = base.groupBy(*key).agg(F.min(F.col(pos)).cast("long").alias("place"), F.max_by(F.struct("x_1", "x_2", F.col("label").cast("string").alias("label")), at).alias("r"))
    start = first.select("lo", "hi", F.lit(0).cast("int").alias("turn"), "place", F.lit("base").alias("action"), "r.x_1", "r.x_2", "r.label")
    steps = changes.select(*key, F.lit(1).alias("turn"), F.col(seq).cast("long").alias("place"), "action", "x_1", "x_2", F.col("new_label").cast("string").alias("label"))
    by = Window.partitionBy("lo", "hi").orderBy("turn", "place")
    removed = F.col("action") == "remove"
    events = (
        start.unionByName(steps)
        .withColumn("before", F.lag(F.struct(removed.alias("removed"), F.col("label").alias("label"))).over(by))
        .withColumn("present", F.col("before").isNotNull() & ~F.coalesce(F.col("before.removed"), F.lit(False)))
        .withColumn("removals", F.sum(removed.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last", F.row_number().over(Window.partitionBy("lo", "hi").orderBy(F.desc("turn"), F.desc("place"))) == 1)
    )
    if not allow_missing:
        wrong = events.where("turn = 1").where((F.col("action") == "add") == F.col("present")).limit(1).collect()
        if wrong:
            w = wrong[0]
            raise ValueError(f"{w['action']} of ({w['x_1']}, {w['x_2']}): the pair is {'there already' if w['present'] else 'not there'}")
    outcome = (
        F.when(removed, F.when(F.col("present"), "removed").otherwise("already absent"))
        .when(~F.col("present"), "added")
        .when(F.col("before.label") == F.col("label"), "already correct")
        .otherwise(F.concat(F.lit("relabelled from "), F.col("before.label")))
    )
    log = events.where("turn = 1").select(F.col("place").alias("seq"), "action", "x_1", "x_2", F.col("label").alias("new_label"), outcome.alias("outcome"))
    # Since the last removal: names from the event that brought the pair in, the place of that event, the last label.
    opened = events.where(~removed).groupBy("lo", "hi", "removals").agg(
        F.min(F.struct("turn", "place", "x_1", "x_2")).alias("opened"), F.max_by(F.struct("label", "last"), F.struct("turn", "place")).alias("end")
    )
    final = opened.where("end.last").select("opened.x_1", "opened.x_2", F.col("end.label").alias("label"), F.col("opened.turn").alias("turn"), F.col("opened.place").alias("place"))
    return final, log


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action", "outcome").agg(F.count("*").alias("n"))
