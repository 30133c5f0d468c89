"""Edit-distance joins by shared deletion variants instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletion_variants(x, k: int) -> Column:
    """The string and what is left of it after up to k deletions."""
    s = F.col(x) if isinstance(x, str) else x
    out, ring = F.array(s), F.array(s)
    shorter = lambda v: F.when(F.length(v) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
    )
    for _ in range(k):
        ring = F.array_distinct(F.flatten(F.transform(ring, shorter)))
        out = F.array_union(out, ring)
    return out


def near_names(names: DataFrame, k: int, name: str = "name") -> DataFrame:
    """(x_1, x_2, distance): all pairs x_1 < x_2 within k edits.

    Two strings within k edits have a common subsequence that each reaches by at most
    k deletions, so an equi-join on variants misses none; its candidates are then
    measured. Variants travel as 8-byte hashes.
    """
    keys = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().select("name", F.explode(deletion_variants("name", k)).alias("v")).select("name", F.xxhash64("v").alias("v"))
    a, b = keys.withColumnRenamed("name", "x_1"), keys.withColumnRenamed("name", "x_2")
    met = a.join(b, "v").where("x_1 < x_2").where(F.abs(F.length("x_1") - F.length("x_2")) <= k).select("x_1", "x_2").distinct()
    return met.select("x_1", "x_2", F.levenshtein("x_1", "x_2").alias("distance")).where(F.col("distance") <= k)
