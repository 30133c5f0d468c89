"""Stand-in relations made from the test tables: a registry of names, pairs, a run, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearnames.operators.blocking import near_names

LITERALS = ["", "None", "N/A", "Éclair-X", "a/b'c"]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): distinct a-z tokens of 5 letters or more."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name"))
    return words.where("length(name) >= 5").distinct()


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drug_name): names dressed up by their length, and some literals."""
    w, k = F.col("name"), F.length("name") % 6
    dressed = (
        F.when(k == 0, w).when(k == 1, F.upper(w)).when(k == 2, F.concat(w, F.lit(" forte"))).when(k == 3, F.concat(w, F.lit(" 10")))
        .when(k == 4, F.concat(w, F.lit(" hydrochloride"))).otherwise(F.concat(F.lit("neo "), w))
    )
    return names(spark, sf_dir).select(dressed.alias("drug_name")).union(spark.createDataFrame([(x,) for x in LITERALS], "drug_name string"))


def _digit():
    return F.substring(F.md5(F.concat_ws("|", "x_1", "x_2")), 1, 1)


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_names(names(spark, sf_dir), 1).where("distance = 1").select("x_1", "x_2")


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_names(names(spark, sf_dir), 2).where("distance = 2").where(_digit().between("0", "3")).select("x_1", "x_2")


def unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_names(names(spark, sf_dir), 3).where("distance = 3 AND left(x_1, 1) = left(x_2, 1)")
    return near.where(_digit() == "0").select("x_1", "x_2")


def numbered(pairs: DataFrame) -> DataFrame:
    """With ``seq``: the row number in pair order."""
    return pairs.withColumn("seq", F.row_number().over(Window.orderBy("x_1", "x_2")).cast("long"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, action, x_1, x_2, new_label): by row number mod 4 of the positives; some reversed, some absent."""
    p = numbered(positives(spark, sf_dir))
    part = lambda k, at, action, a, b, label: p.where(F.col("seq") % 4 == k).select((F.col("seq") * 10 + at).alias("seq"), F.lit(action).alias("action"), F.col(a).alias("x_1"), F.col(b).alias("x_2"), F.lit(label).alias("new_label"))
    out = part(0, 0, "remove", "x_1", "x_2", "").union(part(1, 0, "relabel", "x_2", "x_1", "-1")).union(part(2, 0, "remove", "x_2", "x_1", "")).union(part(2, 1, "add", "x_1", "x_2", "1"))
    absent = spark.createDataFrame([(1_000_001, "remove", "zzza", "zzzb", ""), (1_000_002, "relabel", "zzza", "zzzc", "-1"), (1_000_003, "add", "zzzd", "zzzc", "1"), (1_000_004, "add", "zzzc", "zzzd", "1")], "seq long, action string, x_1 string, x_2 string, new_label string")
    return out.union(absent)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, x_1, seed_x_2, candidates, x_2): names within 2 edits as candidates, those within 1 as chosen."""
    near = near_names(names(spark, sf_dir), 2)
    both = near.select(F.col("x_1").alias("a"), F.col("x_2").alias("b"), "distance").union(near.select("x_2", "x_1", "distance"))
    met = numbered(positives(spark, sf_dir)).join(both, F.col("x_1") == F.col("a"))
    each = met.groupBy("seq", "x_1", "x_2").agg(F.sort_array(F.collect_list("b")).alias("candidates"), F.sort_array(F.collect_list(F.when(F.col("distance") == 1, F.col("b")))).alias("chosen"))
    return each.select(F.col("seq").alias("run"), "x_1", F.col("x_2").alias("seed_x_2"), "candidates", F.col("chosen").alias("x_2"))
