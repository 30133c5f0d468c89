"""Joins of per-document frequencies with one value per distinct key.

The frequent keys, at most a fixed number of them, go to the workers; all other keys are
joined by shuffle. By Zipf's law the first take nearly all occurrences, so little is
shuffled, and what is has no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of an octave in which frequencies are told apart.
STEPS = 8


def frequent_from(table: DataFrame, most: int, n_col: str = "n") -> float:
    """The least frequency from which on at most ``most`` rows of ``table`` lie.

    The driver sees one count per step of frequency: some hundred rows whatever the table.
    """
    steps = table.groupBy(F.floor(F.log2(F.col(n_col).cast("double")) * STEPS).cast("int").alias("step")).agg(F.count("*").alias("k")).collect()
    room, limit = most, float("inf")
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["k"] > room:
            break
        room, limit = room - r["k"], r["step"]
    return limit


def is_frequent(limit: float, n_col: str = "n"):
    """Whether a row is at or above the limit of ``frequent_from``."""
    return F.floor(F.log2(F.col(n_col).cast("double")) * STEPS) >= F.lit(limit)


def with_rare(rows: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` (row, rare array<struct<key, n>>, ...) with ``rest``: the sum of n * value over the row's rare keys.

    ``values`` holds a row for every rare key.
    """
    each = rows.where(F.size("rare") > 0).select("row", F.explode("rare").alias("x")).select("row", F.col(f"x.{key}").alias(key), F.col("x.n").alias("times"))
    sums = each.join(values.select(key, value), key).groupBy("row").agg(F.sum(F.col("times") * F.col(value)).alias("rest"))
    return rows.drop("rare").join(sums, "row", "left")
