"""Unlabelled pairs: clusters of positives, exclusive claims on outside names, stratified sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearnames.config import UNLABELED, Config
from nearnames.functions import distance, phonetics
from nearnames.functions.text import is_qualifier_pair, normalize, ordered_hash
from nearnames.operators.graph import connected_components
from nearnames.operators.meeting import meet, similar
from nearnames.operators.pairs import normal_pairs, numbered, outside, random_pairs, vocabulary, without_pairs, without_variants
from nearnames.runtime import discard, materialise, tune

U = ["x_1", "x_2", "similarity", "tier", "label"]


def clusters(pairs: DataFrame) -> DataFrame:
    """(name, cluster_id): components of normalised pairs, named by their least name; a self-pair is a singleton."""
    keys = normal_pairs(pairs)
    return connected_components(keys, "lo", "hi").select(F.col("node").alias("name"), F.col("component").alias("cluster_id"))


def positives_per_cluster(pairs: DataFrame, members: DataFrame) -> DataFrame:
    return normal_pairs(pairs).join(members.withColumnRenamed("name", "lo"), "lo").groupBy("cluster_id").agg(F.count("*").alias("n"))


def tier_targets(per_cluster: DataFrame, num_positives: int, cfg: Config = Config()) -> DataFrame:
    """(cluster_id, n, target_1, target_2, cap_1, cap_2); halves are rounded to even."""
    total = float(round(num_positives * (1 - cfg.positive_prevalence) / cfg.positive_prevalence))
    share = F.lit(total) * F.col("n") / F.lit(float(num_positives))
    # bround() of a double: halves to even.
    targets = {f"target_{k}": F.bround(share * p).cast("long") for k, p in ((1, cfg.tier_1_proportion), (2, cfg.tier_2_proportion))}
    out = per_cluster.select("cluster_id", "n", *[c.alias(k) for k, c in targets.items()])
    return out.withColumns({f"cap_{k}": F.greatest(F.lit(cfg.min_pool).cast("long"), cfg.oversample_factor * F.col(f"target_{k}")) for k in (1, 2)})


def coded(names: DataFrame, codes: DataFrame) -> DataFrame:
    """``names`` (name, ...) with their sound codes and normalised forms, worked out once per name."""
    return names.join(codes.select("name", "soundex", "metaphone"), "name", "left").fillna("", ["soundex", "metaphone"]).withColumn("key", F.coalesce(normalize("name"), F.lit("")))


def claim(qualifying: DataFrame, caps: str = "cap") -> DataFrame:
    """Rows that each cluster keeps when clusters choose in rank order.

    ``qualifying``: rank (of the cluster), ``caps``, place (row order within the
    cluster), candidate, ... A cluster takes its first ``cap`` rows whose candidate no
    better-ranked cluster took. In rounds: each cluster holds its first ``cap`` rows
    left; every row whose candidate a better rank holds is rejected for good. Holds
    only ever pass to better ranks, so this ends, after at most as many rounds as there
    are clusters, with the sequential result.
    """
    left = materialise(qualifying, "claim")
    first = Window.partitionBy("rank").orderBy("place")
    while True:
        held = left.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= F.col(caps)).drop("__n")
        best = held.groupBy("candidate").agg(F.min("rank").alias("best"))
        lost = held.join(best, "candidate").where("rank > best").limit(1).count()
        if not lost:
            return held
        after = materialise(left.join(best, "candidate", "left").where("best IS NULL OR rank <= best").drop("best"), "claim")
        discard(left)
        left = after


def tier_1(members: DataFrame, ranks: DataFrame, free: DataFrame, positive: DataFrame, codes: DataFrame, cfg: Config) -> DataFrame:
    """(rank, cluster_id, place, x_1, x_2, similarity): claimed pairs of members with outside names."""
    anchors = coded(members.join(ranks, "cluster_id").where("cap_1 > 0").select("name", "cluster_id", "rank", F.col("cap_1").alias("cap")), codes)
    names = coded(free.select("name", F.col("pos").alias("at")), codes)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j, found = similar(a, b, cfg.similarity_threshold)
        left, right = a.iloc[i].reset_index(drop=True), b.iloc[j].reset_index(drop=True)
        return pd.DataFrame({"cluster_id": left["cluster_id"], "rank": left["rank"], "cap": left["cap"], "x_1": left["name"], "x_2": right["name"], "at": right["at"], "similarity": found})

    # Every member meets every outside name once, by contract.
    kinds = dict(anchors.dtypes) | dict(names.dtypes)
    met = meet(anchors, names, compare, f"cluster_id {kinds['cluster_id']}, rank int, cap long, x_1 string, x_2 string, at {kinds['at']}, similarity double")
    rows = without_pairs(met, positive)
    order = Window.partitionBy("rank").orderBy("x_1", "at")
    return claim(rows.withColumn("candidate", F.col("x_2")).withColumn("place", F.row_number().over(order))).drop("candidate", "at")


def tier_2_slices(free: DataFrame, ranks: DataFrame, each: int, seed: int) -> DataFrame:
    """(name, rank): cluster k gets the k-th run of ``each`` free names in shuffled order."""
    rows = numbered(free.select("name"), seed + 1, "name", into="__k").where(F.col("__k") < ranks.count() * each)
    return rows.select("name", F.floor(F.col("__k") / each).cast("int").alias("rank"))


def tier_2(claimed: DataFrame, slices: DataFrame, ranks: DataFrame, positive: DataFrame, codes: DataFrame, cfg: Config) -> DataFrame:
    """(rank, cluster_id, place, x_1, x_2, similarity): pairs within each cluster's pool, first ``cap_2`` in name order."""
    pool = claimed.select("rank", F.col("x_2").alias("name")).union(slices.select("rank", "name")).distinct()
    few = Window.partitionBy("rank").orderBy(ordered_hash(cfg.seed + 2, "rank", "name"), "name")
    pool = pool.withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= cfg.tier_2_max_pool).drop("__n").join(ranks.where("cap_2 > 0").select("rank", "cluster_id", F.col("cap_2").alias("cap")), "rank")

    def compare(pool: pd.DataFrame) -> pd.DataFrame:
        keep = pool["name"].to_numpy()[:, None] < pool["name"].to_numpy()[None, :]
        i, j, found = similar(pool, pool, cfg.similarity_threshold, keep)
        left, right = pool.iloc[i].reset_index(drop=True), pool.iloc[j].reset_index(drop=True)
        return pd.DataFrame({"rank": left["rank"], "cluster_id": left["cluster_id"], "cap": left["cap"], "x_1": left["name"], "x_2": right["name"], "similarity": found})

    # A pool has at most tier_2_max_pool names, so a task's group is bounded.
    tune(pool.sparkSession)
    met = coded(pool, codes).groupBy("rank").applyInPandas(compare, f"rank int, cluster_id {dict(pool.dtypes)['cluster_id']}, cap long, x_1 string, x_2 string, similarity double")
    rows = without_pairs(met, positive)
    order = Window.partitionBy("rank").orderBy("x_1", "x_2")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("cap"))


def sample_tiers(one: DataFrame, two: DataFrame, ranks: DataFrame, seed: int) -> DataFrame:
    """Sample each cluster's tier 1 to its target, and tier 2 to its target plus what tier 1 lacked."""
    draw = lambda d: d.withColumn("__n", F.row_number().over(Window.partitionBy("rank").orderBy(ordered_hash(seed + 3, "x_1", "x_2"), "place")))
    targets = ranks.select("rank", "target_1", "target_2")
    got = one.groupBy("rank").agg(F.count("*").alias("have"))
    need = targets.join(got, "rank", "left").select("rank", "target_1", (F.col("target_2") + F.greatest(F.lit(0), F.col("target_1") - F.coalesce("have", F.lit(0)))).alias("target_2"))
    pick = lambda d, k: draw(d).join(need, "rank").where(F.col("__n") <= F.col(f"target_{k}")).select("rank", "x_1", "x_2", "similarity", F.lit(k).alias("tier"))
    return pick(one, 1).unionByName(pick(two, 2))


def fallback(empty: DataFrame, members: DataFrame, free: DataFrame, owned: DataFrame, positive: DataFrame) -> DataFrame:
    """The best scoring free or own name for each cluster without rows, clusters in rank order (capacity one)."""
    names = free.select(F.col("name").alias("x_2"), F.col("pos").alias("at")).join(owned.withColumnsRenamed({"name": "x_2", "rank": "owner"}), "x_2", "left")
    anchors = members.join(empty, "cluster_id").select("cluster_id", "rank", F.col("name").alias("x_1"))
    met = anchors.join(names, F.col("owner").isNull() | (F.col("owner") == F.col("rank"))).where(~is_qualifier_pair("x_1", "x_2"))
    scored = without_pairs(met, positive).withColumn("similarity", distance.wratio_column("x_1", "x_2"))
    order = Window.partitionBy("rank").orderBy(F.desc("similarity"), "x_1", "at")
    rows = scored.withColumn("place", F.row_number().over(order)).withColumn("candidate", F.col("x_2")).withColumn("cap", F.lit(1))
    return claim(rows).select("rank", "x_1", "x_2", "similarity", F.lit(1).alias("tier"))


def prepared(pairs: DataFrame, registry: DataFrame, cfg: Config = Config(), name: str = "drug_name") -> tuple[DataFrame, ...]:
    """(positive pairs, members of clusters, ranks of clusters with targets and caps, outside names, sound codes)."""
    positive = pairs.select("x_1", "x_2")
    members = materialise(clusters(positive), "clusters")
    num = normal_pairs(positive).count()
    if not num:
        raise ValueError("no positive pairs")
    per = tier_targets(positives_per_cluster(positive, members), num, cfg)
    ranks = materialise(numbered(per, cfg.seed, "cluster_id", into="rank").withColumn("rank", F.col("rank").cast("int")), "ranks")
    free = outside(registry, positive, name).withColumn("pos", ordered_hash(cfg.seed, "name"))
    free = materialise(free, "outside")
    codes = materialise(phonetics.sound_codes(members.select("name").union(free.select("name"))), "codes")
    return positive, members, ranks, free, codes


def make_noise(pairs: DataFrame, registry: DataFrame, cfg: Config = Config(), name: str = "drug_name") -> DataFrame:
    """U: x_1, x_2, similarity, tier (1 or 2), label 0.

    Random orders are md5 orders by seed, so a run is reproducible; members of samples
    differ from those of a generator-based shuffle, counts and rules do not.
    """
    cfg.check()
    positive, members, ranks, free, codes = prepared(pairs, registry, cfg, name)
    one = materialise(tier_1(members, ranks, free, positive, codes, cfg), "tier1")
    each = max(1, cfg.tier_2_sample_size // max(1, ranks.count()))
    taken = one.select(F.col("x_2").alias("name"), "rank").distinct()
    slices = materialise(tier_2_slices(free.select("name").distinct().join(taken, "name", "left_anti"), ranks, each, cfg.seed), "slices")
    two = materialise(tier_2(one, slices, ranks, positive, codes, cfg), "tier2")
    drawn = materialise(sample_tiers(one, two, ranks, cfg.seed), "drawn")
    empty = ranks.select("cluster_id", "rank").join(drawn.select("rank").distinct(), "rank", "left_anti")
    owned = taken.unionByName(slices)
    out = drawn.unionByName(fallback(empty, members, free, owned, positive)) if not empty.isEmpty() else drawn
    out = out.select("x_1", "x_2", "similarity", "tier", F.lit(UNLABELED).alias("label"))
    if out.isEmpty():
        raise ValueError("no unlabelled pairs: the similarity threshold may be too strict")
    return out


def noise_to_target(
    pairs: DataFrame, registry: DataFrame, target: int, rejected: DataFrame | None = None, cfg: Config = Config(), random_share: float = 0.0, skip_variants: bool = False, name: str = "drug_name"
) -> DataFrame:
    """Exactly ``target`` pairs, none of them labelled, a share of them random (tier 3); raises if short.

    Pairs are mined at ``noise_oversample`` times the target. A random pair that is also
    a similar one leaves too few, and raises.
    """
    n = pairs.count()
    mined = make_noise(pairs, registry, Config(**(cfg.__dict__ | {"positive_prevalence": n / (n + cfg.noise_oversample * target)})), name)
    known = [pairs] + ([rejected] if rejected is not None else [])
    mined = without_pairs(mined, *known)
    if skip_variants:
        mined = without_variants(mined)
    n_random = round(target * random_share)
    similar = mined.orderBy(ordered_hash(cfg.seed + 4, "x_1", "x_2"), "x_1", "x_2").limit(target - n_random)
    similar = materialise(similar, "similar")
    if (found := similar.count()) < target - n_random:
        raise ValueError(f"only {found} of {target - n_random} similar pairs")
    if not n_random:
        return similar
    extra = random_pairs(registry.select(F.col(name).alias("name")), n_random, known, cfg.seed)
    both = similar.unionByName(extra).withColumns({"lo": F.least("x_1", "x_2"), "hi": F.greatest("x_1", "x_2")})
    out = materialise(both.groupBy("lo", "hi").agg(F.min_by(F.struct(*U), "tier").alias("r")).select(*[f"r.{c}" for c in U]), "noise")
    if (found := out.count()) != target:
        raise ValueError(f"expected {target} pairs, got {found}")
    return out


def noise_report(noise: DataFrame, pairs: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row of figures, the most used names)."""
    known = vocabulary(pairs)
    a, b = normalize("x_1"), normalize("x_2")
    ids = noise.select(F.monotonically_increasing_id().alias("i"), a.alias("a"), b.alias("b"))
    first = known.select(F.col("name").alias("a"), F.lit(1).alias("ka"))
    second = known.select(F.col("name").alias("b"), F.lit(1).alias("kb"))
    flagged = ids.join(first, "a", "left").join(second, "b", "left")
    used = noise.select(F.explode(F.array(a, b)).alias("name")).where("name IS NOT NULL")
    usage = used.groupBy("name").agg(F.count("*").alias("n"))
    figures = flagged.agg(
        F.count("*").alias("n_pairs"),
        F.coalesce(F.avg((F.left("a", F.lit(1)) == F.left("b", F.lit(1))).cast("int")), F.lit(0.0)).alias("same_first_letter"),
        F.coalesce(F.avg(F.coalesce("ka", "kb", F.lit(0))), F.lit(0.0)).alias("with_known_name"),
    )
    figures = figures.crossJoin(usage.agg(F.count("*").alias("n_names"))).crossJoin(known.join(usage, "name", "left_anti").agg(F.count("*").alias("n_unused"))).crossJoin(known.agg(F.count("*").alias("n_known")))  # one row each
    return figures, usage.orderBy(F.desc("n"), "name").limit(top)


def report_text(noise: DataFrame, pairs: DataFrame) -> str:
    figures, names = noise_report(noise, pairs)
    r = figures.first()
    lines = [
        f"pairs: {r['n_pairs']:,}", f"same first letter: {r['same_first_letter']:.1%}", f"pairs with a known name: {r['with_known_name']:.1%}",
        f"different names used: {r['n_names']:,}", f"known names in no pair: {r['n_unused']:,} of {r['n_known']:,}", "most used names:",
    ]
    return "\n".join([*lines, *(f"{x['name']} {x['n']}" for x in names.collect())])
