"""Relations of names and unordered pairs: cleaning, dedup, priority union, anti-joins, sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearnames.config import POSITIVE, REJECTED, UNLABELED
from nearnames.functions.text import clean_name, is_variant_pair, normalize, ordered_hash

BAD_NAMES = ("", "none", "nan", "n/a")


def clean_registry(raw: DataFrame, name: str = "drug_name", pos: str | None = None) -> DataFrame:
    """(drug_name, pos): distinct clean names; with ``pos``, each at its first position."""
    rows = raw.select(clean_name(name).alias("drug_name"), (F.col(pos) if pos else F.lit(0)).cast("long").alias("pos")).where(~F.col("drug_name").isin(*BAD_NAMES))
    return rows.groupBy("drug_name").agg(F.min("pos").alias("pos"))


def registry_report(raw: DataFrame, name: str = "drug_name", least: int = 500) -> DataFrame:
    """One row: rows, nulls, duplicates, clean names, dropped, and whether the registry is small."""
    counts = raw.agg(F.count("*").alias("n_raw"), F.count_if(F.col(name).isNull()).alias("n_null"), F.count_distinct(name).alias("n_distinct"))
    clean = clean_registry(raw, name).agg(F.count("*").alias("n_clean"))
    return counts.crossJoin(clean).select(  # one row each
        "n_raw", "n_null", (F.col("n_raw") - F.col("n_null") - F.col("n_distinct")).alias("n_duplicate"), "n_clean",
        (F.col("n_raw") - F.col("n_clean")).alias("n_dropped"), (F.col("n_raw") < least).alias("is_small"),
    )


def _first_of_pair(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Keep the first row of each unordered pair: an aggregate, so hot pairs are combined before the shuffle."""
    rest = [c for c in rows.columns]
    return (
        rows.groupBy(F.least("x_1", "x_2").alias("lo"), F.greatest("x_1", "x_2").alias("hi"))
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select(*[F.col(f"r.{c}").alias(c) for c in rest])
    )


def clean_and_deduplicate(pairs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Clean both names, drop pairs of a name with itself, keep the first row of each unordered pair."""
    rows = pairs.withColumns({"x_1": clean_name("x_1"), "x_2": clean_name("x_2")}).where("x_1 <> x_2")
    return _first_of_pair(rows, order or [F.col("x_1"), F.col("x_2")])


def with_aliases(pairs: DataFrame) -> DataFrame:
    """Accept the older column names of a positives file."""
    return pairs.withColumnsRenamed({k: v for k, v in {"Brand Name": "x_1", "Confusible": "x_2"}.items() if k in pairs.columns})


def priority_union(positives: DataFrame, rejected: DataFrame | None, unlabeled: DataFrame, pos: str | None = None) -> DataFrame:
    """(x_1, x_2, label): labelled sources by unordered clean pair; the strongest claim (1, then -1, then 0) wins."""
    place = (lambda d: F.col(pos).cast("long")) if pos else (lambda d: F.lit(0).cast("long"))
    parts = [(positives, POSITIVE, 0), (rejected, REJECTED, 1), (unlabeled, UNLABELED, 2)]
    rows = None
    for df, label, rank in parts:
        if df is None:
            continue
        part = with_aliases(df)
        part = part.select("x_1", "x_2", F.lit(label).alias("label"), F.lit(rank).alias("rank"), place(part).alias("pos"))
        rows = part if rows is None else rows.unionByName(part)
    return clean_and_deduplicate(rows, [F.col("rank"), F.col("pos"), F.col("x_1"), F.col("x_2")]).select("x_1", "x_2", "label")


def split_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positives, rejected) of a labelled table; ``y`` may stand for ``label``."""
    df = df.withColumnRenamed("y", "label") if "label" not in df.columns and "y" in df.columns else df
    if missing := {"x_1", "x_2", "label"}.difference(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    rows = df.select("x_1", "x_2", F.expr("try_cast(label AS int)").alias("label"))
    if bad := rows.where(f"label IS NULL OR label NOT IN ({POSITIVE}, {REJECTED})").limit(1).count():
        raise ValueError(f"labels other than {POSITIVE} and {REJECTED}: {bad} or more")
    return tuple(rows.where(F.col("label") == v).select("x_1", "x_2") for v in (POSITIVE, REJECTED))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(name): distinct normalised names of both sides."""
    return pairs.select(F.explode(F.array(normalize("x_1"), normalize("x_2"))).alias("name")).where("name IS NOT NULL").distinct()


def normal_pairs(pairs: DataFrame) -> DataFrame:
    """(lo, hi): distinct unordered normalised pairs, those of a name with itself included."""
    a, b = normalize("x_1"), normalize("x_2")
    return pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def outside(registry: DataFrame, pairs: DataFrame, name: str = "drug_name") -> DataFrame:
    """(name): normalised registry names not among the pairs' names (repeats stay)."""
    return registry.select(normalize(name).alias("name")).where("name IS NOT NULL").join(vocabulary(pairs), "name", "left_anti")


def without_pairs(df: DataFrame, *known: DataFrame) -> DataFrame:
    """Rows of df whose unordered normalised pair is in none of ``known``."""
    for k in known:
        keys = normal_pairs(k)
        a, b = normalize("x_1"), normalize("x_2")
        df = df.withColumns({"__lo": F.least(a, b), "__hi": F.greatest(a, b)}).join(keys.withColumnsRenamed({"lo": "__lo", "hi": "__hi"}), ["__lo", "__hi"], "left_anti").drop("__lo", "__hi")
    return df


def without_variants(df: DataFrame) -> DataFrame:
    return df.where(~is_variant_pair("x_1", "x_2"))


def sample(df: DataFrame, n: int, seed: int, *by: str) -> DataFrame:
    """n rows in the reproducible random order of ``by``; only n rows ever meet."""
    return df.orderBy(ordered_hash(seed, *by), *by).limit(n)


def shuffled(df: DataFrame, seed: int, *by: str) -> DataFrame:
    """The table in its reproducible random order (a range-partitioned sort)."""
    return df.orderBy(ordered_hash(seed, *by), *by)


def random_pairs(names: DataFrame, count: int, excluded: list[DataFrame], seed: int, name: str = "name") -> DataFrame:
    """``count`` distinct unordered pairs of distinct normalised names, none of them excluded; tier 3, no similarity.

    Draws hashed index pairs, so only ids are joined; draws more until enough are left,
    and raises if there are fewer such pairs than asked.
    """
    spark = names.sparkSession
    distinct = names.select(normalize(name).alias("name")).where("name IS NOT NULL").distinct()
    ranked = numbered(distinct, seed, "name")
    n = ranked.count()
    possible = n * (n - 1) // 2
    if count > possible:
        raise ValueError(f"only {possible} pairs of {n} names, {count} wanted")
    factor = 2
    while True:
        draws = spark.range(max(64, count * factor)).select(
            "id", F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("a")), F.lit(n)).alias("i"), F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("b")), F.lit(n)).alias("j")
        )
        first = draws.where("i <> j").groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.min("id").alias("id"))
        rows = first.join(ranked.select(F.col("k").alias("lo"), F.col("name").alias("x_1")), "lo").join(ranked.select(F.col("k").alias("hi"), F.col("name").alias("x_2")), "hi")
        rows = without_pairs(rows.select("id", "x_1", "x_2"), *excluded).orderBy("id").limit(count)
        if rows.count() >= count:
            return rows.select("x_1", "x_2", F.lit(None).cast("double").alias("similarity"), F.lit(3).alias("tier"), F.lit(UNLABELED).alias("label"))
        if count * factor > 64 * possible + 4096:
            raise ValueError(f"fewer than {count} pairs are left outside the excluded ones")
        factor *= 4


def numbered(df: DataFrame, seed: int, *by: str, into: str = "k") -> DataFrame:
    """Number all rows from 0 in the md5 order of ``by``, without gathering them.

    The first three digits of the md5 cut the order into at most 4,096 ranges; rows are
    numbered within their range, and the ranges' counts give their offsets.
    """
    rows = df.withColumn("__h", ordered_hash(seed, *by)).withColumn("__range", F.left("__h", F.lit(3)))
    within = Window.partitionBy("__range").orderBy("__h", *by)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = rows.withColumn("__r", F.row_number().over(within) - 1).join(F.broadcast(base), "__range")
    return out.withColumn(into, (F.col("__base") + F.col("__r")).cast("long")).drop("__h", "__range", "__r", "__base")


def slice_of(df: DataFrame, count: int, seed: int, pos: str = "pos") -> DataFrame:
    """Up to ``count`` rows of consecutive positions, from a seeded start, to look at."""
    last = df.agg(F.max(pos)).first()[0] or 0
    start = random.Random(seed).randint(0, max(0, last + 1 - count))
    return df.where(F.col(pos).between(start, start + count - 1))
