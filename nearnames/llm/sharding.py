"""Uniform shuffle into shards of exact size through a communication matrix.

1. Rows are written once with their source partition and two random numbers.
2. Only the partitions' row counts reach the driver. It draws how many rows each
   partition sends to each shard: a multivariate hypergeometric draw against the
   shards' free places, which is the law of these counts under a uniform shuffle.
3. Each partition permutes its rows locally and deals them by its matrix row.
4. After the exchange each shard permutes what it got. That sort is spread over
   ranges of the second random number; range counts give each range's first slot.

DataFrame operations only. No task holds more than one source partition or one
range of a shard.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearnames.runtime import discard, materialise

SHARDS = 8
SEED = 20240607
#: Rows of one range in the second permutation.
RANGE_ROWS = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from good + bad, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(sizes: list[int], places: list[int], seed: int) -> list[list[int]]:
    """Rows: partitions; columns: shards. Row sums are ``sizes``, column sums ``places``."""
    rng, free, out = random.Random(seed), list(places), []
    for n in sizes:
        row, left = [], sum(free)
        for k, room in enumerate(free):
            got = hypergeometric(rng, room, left - room, n) if k < len(free) - 1 else n
            row.append(got)
            n, left = n - got, left - room
        free = [a - b for a, b in zip(free, row, strict=True)]
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null): a row per row.

    Shard counts differ by one at most. Null texts have size 1 and checksum 0.
    Repeated rows, equal texts and null ids are dealt like any other rows (the
    law is about rows, so equal texts may part). An empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text)).cast("long").__add__(1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
            F.rand(seed).alias("r1"),
            F.rand(seed + 1).alias("r2"),
        ),
        "shard",
    )
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    places = [total // shards + (k < total % shards) for k in range(shards)]
    upto = [(p, list(accumulate(row))) for (p, _), row in zip(counts, matrix([n for _, n in counts], places, seed), strict=True)]
    sent = spark.createDataFrame(upto, "part int, upto array<bigint>")
    local = Window.partitionBy("part").orderBy("r1", "r2", "doc_id", "size", "text_crc32")
    ranges = max(1, -(-total // (shards * RANGE_ROWS)))
    dealt = materialise(
        rows.withColumn("rank", F.row_number().over(local).cast("long"))
        .join(sent, "part")
        .select(
            "doc_id", "size", "text_crc32", "r1", "r2",
            F.size(F.filter("upto", lambda x: x < F.col("rank"))).alias("shard"),
            F.floor(F.col("r2") * ranges).cast("long").alias("range"),
        ),
        "shard",
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    again = Window.partitionBy("shard", "range").orderBy("r2", "r1", "doc_id", "size", "text_crc32")
    discard(rows)
    return (
        dealt.withColumn("rank", F.row_number().over(again) - 1)
        .join(first, ["shard", "range"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
