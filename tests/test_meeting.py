"""Blockwise meetings of names against plain loops; components with hubs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearnames.config import Config
from nearnames.functions import distance as D
from nearnames.functions import phonetics, text
from nearnames.operators import graph, meeting, noise, proposer


def names(n, seed, several=0.2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9)))
    out = [" ".join(word() for _ in range(rng.choice([1, 2, 3]) if rng.random() < several else 1)) for _ in range(n)]
    return list(dict.fromkeys([*out, *(x + " forte" for x in out[:5]), *(x[1:] for x in out[:20] if len(x) > 3)]))


def test_bounds_hold():
    a, b = pd.Series(names(60, 1, 0.5)), pd.Series(names(60, 2, 0.5))
    for least in (50.0, 65.0, 80.0):
        w, r = meeting.may_reach_wratio(a, b, least), meeting.may_reach_ratio(a, b, least)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                assert w[i, j] or D.wratio(x, y) < least
                assert r[i, j] or D.ratio(x, y) <= least
    assert not meeting.may_reach_wratio(a, b, 80.0).all()


def test_code_similarity_equals_columns(spark):
    rng = random.Random(4)
    codes = ["", *("".join([rng.choice("ABM"), *(rng.choice("0123") for _ in range(3))]) for _ in range(25))]
    got = meeting.code_similarity(pd.Series(codes), pd.Series(codes[::-1]))
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(codes) for j, b in enumerate(codes[::-1])], "i int, j int, a string, b string")
    for r in df.withColumn("s", D.soundex_similarity("a", "b")).collect():
        assert got[r["i"], r["j"]] == r["s"]


@pytest.mark.parametrize("rows", [4096, 17])
def test_tier_1_pairs_equal_plain_loop(spark, monkeypatch, rows):
    """Before claims: all pairs of a member and an outside name that look or sound alike, but qualified and positive ones."""
    monkeypatch.setattr(meeting, "MOST_ROWS", rows)
    monkeypatch.setattr(meeting, "LEAST_ROWS", rows // 2)
    monkeypatch.setattr(noise, "claim", lambda d: d)
    inside, out = names(40, 5), [x for x in names(70, 6) if x not in names(40, 5)]
    members = spark.createDataFrame([(x, "c") for x in inside], "name string, cluster_id string")
    ranks = spark.createDataFrame([("c", 0, 10**6)], "cluster_id string, rank int, cap_1 long")
    free = spark.createDataFrame([(x, str(i)) for i, x in enumerate(out)], "name string, pos string")
    positive = spark.createDataFrame([(inside[0], out[0])], "x_1 string, x_2 string")
    codes = phonetics.sound_codes(members.select("name").union(free.select("name"))).cache()
    got = {(r["x_1"], r["x_2"]): r["similarity"] for r in noise.tier_1(members, ranks, free, positive, codes, Config()).collect()}
    code = {r["name"]: r for r in codes.collect()}
    want = {}
    for x in inside:
        for y in out:
            alike = any(code[x][k] and code[x][k] == code[y][k] for k in ("soundex", "metaphone"))
            if (alike or D.wratio(x, y) >= 65) and not (x + " ").startswith(y + " ") and not (y + " ").startswith(x + " ") and {x, y} != {inside[0], out[0]}:
                want[x, y] = D.wratio(x, y)
    assert got == pytest.approx(want)


def test_candidates_equal_plain_loop(spark):
    known = names(25, 8)
    registry = names(80, 9) + known
    seeds = [(i, x, known[(i * 7 + 3) % len(known)]) for i, x in enumerate(known)] + [(100, known[0], registry[0]), (101, known[0], known[1])]
    s = spark.createDataFrame([x for x in seeds if x[1] != x[2]], "run long, x_1 string, x_2 string")
    r = spark.createDataFrame([(x, i) for i, x in enumerate(registry)], "drug_name string, pos long")
    got = {}
    for x in proposer.candidates(s, r).collect():
        got.setdefault(x["run"], []).append((x["rank"], x["candidate"]))
    cfg = Config()
    codes = {x["name"]: x for x in phonetics.sound_codes(r.select(F.col("drug_name").alias("name"))).collect()}
    pairs = [(x, y) for x in known for y in registry if x != y]
    df = spark.createDataFrame(pairs, "a string, b string").distinct()
    flags = {(x["a"], x["b"]): x for x in df.select("a", "b", F.levenshtein("a", "b").alias("d"), text.is_strength_variant("a", "b").alias("v"), text.is_fragment(F.col("a"), F.col("b"), cfg.min_length_ratio).alias("f"), D.spelling_similarity("a", "b").alias("s")).collect()}
    for run, x, known_name in seeds:
        if x == known_name:
            continue
        rows = []
        for pos, y in enumerate(registry):
            if y in (x, known_name):
                continue
            p, q, k = codes[x], codes[y], flags[x, y]
            sounds = p["soundex"] and q["soundex"] and sum(a == b for a, b in zip(p["soundex"], q["soundex"], strict=True)) >= 3
            ratio = D.ratio(x, y)
            if (ratio > cfg.ratio_threshold or sounds) and k["d"] >= cfg.min_edit and not k["v"] and not k["f"]:
                jw = float(D.jaro_winkler_batch(pd.Series([p["native_metaphone"]]), pd.Series([q["native_metaphone"]]))[0])
                rows.append((-(0.5 * k["s"] + 0.5 * jw), -ratio, pos, y))
        assert [y for _, y in sorted(got.get(run, []))] == [y for *_, y in sorted(rows)[: cfg.candidate_limit]]


@pytest.mark.parametrize("hub", [1000, 3])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 1200)] + [(9000, i) for i in range(5000, 6200)] + [(i, i + 1) for i in range(10000, 10060)] + [(rng.randrange(20000, 20400), rng.randrange(20000, 20400)) for _ in range(250)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert np.unique(list(got.values())).size < len(got)
