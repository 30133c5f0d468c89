import random

import pytest
from pyspark.sql import functions as F

from nearnames.config import Config
from nearnames.operators import noise, pairs, proposer, relabel, scoring
from nearnames.operators.graph import connected_components


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (600, 700), (700, 600)]
    got = connected_components(frame(spark, edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == components(edges)


def test_components_of_nothing(spark):
    assert connected_components(frame(spark, [], "src long, dst long")).count() == 0


def test_priority_and_dedup(spark):
    p = frame(spark, [("A-b", "c"), ("x", "X")], "x_1 string, x_2 string")
    n = frame(spark, [("c", "a b"), ("d", "e")], "x_1 string, x_2 string")
    u = frame(spark, [("E", "d"), ("f", "g"), ("", "h")], "x_1 string, x_2 string")
    got = {(r["x_1"], r["x_2"], r["label"]) for r in pairs.priority_union(p, n, u).collect()}
    assert got == {("a b", "c", 1), ("d", "e", -1), ("f", "g", 0), ("", "h", 0)}


def test_labels_are_checked(spark):
    with pytest.raises(ValueError, match="labels other"):
        pairs.split_labelled(frame(spark, [("a", "b", "2")], "x_1 string, x_2 string, label string"))
    with pytest.raises(ValueError, match="missing"):
        pairs.split_labelled(frame(spark, [("a", "b")], "x_1 string, x_2 string"))


def test_registry(spark):
    raw = frame(spark, [("Foo", 3), ("FOO ", 1), (None, 0), ("nan", 5), ("n/a", 6)], "drug_name string, pos long")
    assert {tuple(r) for r in pairs.clean_registry(raw, pos="pos").collect()} == {("foo", 1), ("n a", 6)}


def test_random_pairs_exhaust(spark):
    names = frame(spark, [("a",), ("b",), ("c",), ("d",)], "name string")
    known = frame(spark, [("b", "a")], "x_1 string, x_2 string")
    got = {frozenset((r["x_1"], r["x_2"])) for r in pairs.random_pairs(names, 5, [known], 1).collect()}
    assert len(got) == 5 and frozenset("ab") not in got
    with pytest.raises(ValueError):
        pairs.random_pairs(names, 6, [known], 1)


def greedy(rows, cap):
    owner, out = {}, []
    for rank in sorted({r[0] for r in rows}):
        n = 0
        for r in sorted(x for x in rows if x[0] == rank):
            if n < cap and owner.setdefault(r[2], rank) == rank:
                out.append(r)
                n += 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_claim_equals_sequential_greedy(spark, seed):
    # setdefault() above would claim past the cap, so the cap is tested first, as the operator does.
    rng = random.Random(seed)
    rows = [(r, p, f"n{rng.randrange(9)}") for r in range(6) for p in range(rng.randrange(1, 8))]
    got = noise.claim(frame(spark, [(*r, 2) for r in rows], "rank int, place int, candidate string, cap int"))
    assert sorted((r["rank"], r["place"], r["candidate"]) for r in got.collect()) == greedy(rows, 2)


def test_noise_rules(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abdeiklmnorst") for _ in range(7)) for _ in range(60)]
    p = [(w, w[:-1] + "x") for w in base[:6]]
    names = base + [w[:2] + "y" + w[3:] for w in base]
    cfg = Config(positive_prevalence=0.2, min_pool=3, tier_2_sample_size=60)
    positive, registry = frame(spark, p, "x_1 string, x_2 string"), frame(spark, [(n,) for n in names], "drug_name string")
    rows = noise.make_noise(positive, registry, cfg).collect()
    vocab = {x for pair in p for x in pair}
    assert rows and all(r["label"] == 0 and r["tier"] in (1, 2) for r in rows)
    assert not {frozenset((r["x_1"], r["x_2"])) for r in rows} & {frozenset(x) for x in p}
    cluster = {}
    members = {r["name"]: r["cluster_id"] for r in noise.clusters(positive).collect()}
    for r in rows:
        if r["tier"] == 1:
            assert r["x_1"] in vocab and r["x_2"] not in vocab
            assert cluster.setdefault(r["x_2"], members[r["x_1"]]) == members[r["x_1"]]
    exact = noise.noise_to_target(positive, registry, 8, cfg=cfg, random_share=0.25, skip_variants=True)
    assert exact.count() == 8 and exact.where("tier = 3 AND similarity IS NULL").count() == 2


def sequential(base, changes):
    """(final rows, outcomes) one change after another."""
    state, place, out = {}, {}, []
    for i, (a, b, label) in enumerate(base):
        k = frozenset((a, b))
        place.setdefault(k, (0, i))
        state[k] = (a, b, label)
    for i, (action, a, b, label) in enumerate(changes):
        k = frozenset((a, b))
        if action == "remove":
            out.append("removed" if k in state else "already absent")
            state.pop(k, None), place.pop(k, None)
        elif k not in state:
            state[k], place[k] = (a, b, label), (1, i)
            out.append("added")
        else:
            out.append("already correct" if state[k][2] == label else f"relabelled from {state[k][2]}")
            state[k] = (*state[k][:2], label)
    return [state[k] for k in sorted(state, key=place.get)], out


@pytest.mark.parametrize("seed", range(5))
def test_relabel_equals_sequential(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("abcd")
    base = [(name(), name(), rng.choice(["1", "-1"])) for _ in range(8)]
    changes = [(rng.choice(["remove", "add", "relabel"]), name(), name(), rng.choice(["1", "0", "-1"])) for _ in range(25)]
    final, log = relabel.relabel(
        frame(spark, [(*r, i) for i, r in enumerate(base)], "x_1 string, x_2 string, label string, pos long"),
        frame(spark, [(*c, i) for i, c in enumerate(changes)], "action string, x_1 string, x_2 string, new_label string, seq long"),
    )
    rows, outcomes = sequential(base, changes)
    assert [(r["x_1"], r["x_2"], r["label"]) for r in final.orderBy("turn", "place").collect()] == rows
    assert [r["outcome"] for r in log.orderBy("seq").collect()] == outcomes


def test_relabel_strict(spark):
    base = frame(spark, [("a", "b", "1", 0)], "x_1 string, x_2 string, label string, pos long")
    for action, pair in (("add", ("b", "a")), ("remove", ("a", "c"))):
        ch = frame(spark, [(action, *pair, "1", 0)], "action string, x_1 string, x_2 string, new_label string, seq long")
        with pytest.raises(ValueError):
            relabel.relabel(base, ch, allow_missing=False)


def test_proposal_is_within_candidates(spark):
    seeds = frame(spark, [(1, "aprinol", "aprinal"), (2, "zzz", "yyy")], "run long, x_1 string, x_2 string")
    registry = frame(spark, [("aprinol", 0), ("aprinal", 1), ("aprinel", 2), ("aprinol 10", 3), ("dugorov", 4)], "drug_name string, pos long")
    run = proposer.propose(seeds, registry)
    rows = {r["run"]: r for r in run.collect()}
    assert set(rows[1]["x_2"]) <= set(rows[1]["candidates"]) and "aprinel" in rows[1]["candidates"]
    assert "aprinol" not in rows[1]["candidates"] and "aprinal" not in rows[1]["candidates"]
    assert rows[2]["candidates"] == [] and rows[2]["x_2"] == []
    got = {tuple(r) for r in proposer.proposed_pairs(run).collect()}
    assert ("aprinol", "aprinal") in got and ("zzz", "yyy") in got


def test_features_keep_columns_and_rows(spark):
    df = frame(spark, [("tsokolate", "chocolate", 1, 9), (None, "x", 0, 9)], "x_1 string, x_2 string, label int, len_diff int")
    out = scoring.engineered(df)
    assert [r["len_diff"] for r in out.collect()] == [9, 9]
    whole = scoring.featurize(df)
    assert whole.columns[:3] == ["x_1", "x_2", "label"] and whole.count() == 2
    assert "aline_var:cangu_g2p:fil" in whole.columns and "aline_var:cangu_g2p:eng" not in whole.columns and "core_bisim" in whole.columns
    r = whole.where("x_1 IS NULL").first()
    assert r["len_diff"] == 2 and r["t_eng_1"] == ""  # 'nan' against 'x'


def test_hard_negatives_raise(spark):
    df = frame(spark, [("a", "b", 0.5), ("a", "c", 0.9)], "x_1 string, x_2 string, hardness double")
    assert [r["x_2"] for r in scoring.hard_negatives(df, 1, 0.4, 0.8).collect()] == ["b"]
    with pytest.raises(ValueError, match="only 1"):
        scoring.hard_negatives(df, 2, 0.4, 0.8)


def test_anti_join_ignores_order_and_accents(spark):
    rows = frame(spark, [("é", "b"), ("c", "d")], "x_1 string, x_2 string")
    known = frame(spark, [("B", "e")], "x_1 string, x_2 string")
    assert [tuple(r) for r in pairs.without_pairs(rows, known).select(F.col("x_1"), F.col("x_2")).collect()] == [("c", "d")]
