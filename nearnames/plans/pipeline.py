"""Stages of the dataset build as lazy plans: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.config import Config
from nearnames.functions.text import ordered_hash
from nearnames.operators import noise, pairs, scoring

D = ["x_1", "t_eng_1", "t_fil_1", "x_2", "t_eng_2", "t_fil_2", "label"]


def assemble(positives: DataFrame, unlabeled: DataFrame, rejected: DataFrame | None = None, cfg: Config = Config(), adapters: dict | None = None) -> DataFrame:
    """D: the three sources by priority, with transcriptions, and each row's place in the shuffle."""
    merged = pairs.priority_union(positives, rejected, unlabeled)
    return scoring.transcribe(merged, adapters=adapters).select(*D, ordered_hash(cfg.shuffle_seed, "x_1", "x_2").alias("shuffle_key"))


def in_shuffled_order(d: DataFrame) -> DataFrame:
    return d.orderBy("shuffle_key", "x_1", "x_2").drop("shuffle_key")


def features(d: DataFrame, adapters: dict | None = None, own: list | None = None) -> DataFrame:
    """D_pho."""
    return scoring.all_features(d.drop("shuffle_key"), adapters=adapters, own=own)


def build(positives: DataFrame, registry: DataFrame, rejected: DataFrame | None = None, target: int | None = None, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(U, D, D_pho) from positives and a clean registry."""
    u = noise.noise_to_target(positives, registry, target, rejected, cfg, cfg.random_share, cfg.skip_variants) if target is not None else noise.make_noise(positives, registry, cfg)
    d = assemble(positives, u, rejected, cfg)
    return u, d, features(d)


def hard_negatives(positives: DataFrame, mined: DataFrame, low: float = Config.min_hardness, high: float = Config.max_hardness) -> DataFrame:
    """As many of the mined pairs as there are positives, hardest first within the band; with their hardness."""
    scored = scoring.hardness(scoring.transcribe(mined.select("x_1", "x_2"), ("eng",)))
    return scoring.hard_negatives(scored, positives.count(), low, high).select("x_1", "x_2", F.round("hardness", 9).alias("hardness"))
