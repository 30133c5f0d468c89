import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearnames.functions import distance as D
from nearnames.functions import features, phonetics
from nearnames.operators.blocking import near_names


def words(n, k=8, letters="abcde"):
    rng = random.Random(n)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, k))) for _ in range(n)]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_jaro_winkler_equals_sql():
    a, b = words(400), words(401)[:400]
    got = D.jaro_winkler_batch(pd.Series(a), pd.Series(b))
    con = duckdb.connect()
    for x, y, g in zip(a, b, got, strict=True):
        if x or y:
            want = con.execute("SELECT jaro_winkler_similarity(?, ?)", [x, y]).fetchall()[0][0]
            assert abs(want - g) < 1e-9, (x, y)
    assert D.jaro_winkler_batch(pd.Series([""]), pd.Series([""]))[0] == 1


def test_ratio_twins():
    a, b = words(200), words(201)[:200]
    same, total = D.lcs_batch(pd.Series(a), pd.Series(b))
    for x, y, s, r in zip(a, b, same, D.ratio_batch(pd.Series(a), pd.Series(b)), strict=True):
        assert s == lcs(x, y) == D._lcs(x, y)
        assert r == pytest.approx(D.ratio(x, y))


@pytest.mark.parametrize(("a", "b", "score"), [("", "x", 0), ("abc", "abc", 100), ("new york mets", "new york mets vs atlanta braves", 90), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95)])
def test_wratio(a, b, score):
    assert D.wratio(a, b) == pytest.approx(score)


def single(batch):
    return lambda a, b: float(batch(pd.Series([a]), pd.Series([b]))[0])


def plain_alignment(a, b, gap, cost):
    t = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                t[i, j] = min(
                    t[i - 1, j] + gap(a[max(i - 2, 0)], a[i - 1]) if i else 1e9, t[i, j - 1] + gap(b[max(j - 2, 0)], b[j - 1]) if j else 1e9, t[i - 1, j - 1] + cost(a[i - 1], b[j - 1]) if i and j else 1e9
                )
    return t[len(a), len(b)]


def test_batches_equal_plain_alignments():
    a, b = words(150, 9, "abhklmwñ"), words(151, 9, "abhklmwñ")[:150]
    alike = lambda groups, w, far: lambda c, d: 0 if c == d else w if any(c in g and d in g for g in groups) else far
    sound, look = alike(D.EDITEX_GROUPS, 1, 2), alike(D.VISUAL_GROUPS, D.VISUAL_COST, 1)
    for x, y, e, v in zip(a, b, D.editex_batch(pd.Series(a), pd.Series(b)), D.visual_batch(pd.Series(a), pd.Series(b)), strict=True):
        most = max(len(x), len(y))
        if most:
            assert e == pytest.approx(max(0, 1 - plain_alignment(x, y, lambda p, c: 1 if c in "hw" else max(1, sound(p, c)), sound) / (2 * most)))
            assert v == pytest.approx(1 - plain_alignment(x, y, lambda p, c: 1, look) / most)


def test_bisim_by_hand():
    assert single(D.bisim_batch)("abc", "abd") == pytest.approx(2.5 / 3)
    assert single(D.bisim_batch)("", "") == 1 and single(D.bisim_batch)("", "a") == 0


@pytest.mark.parametrize("f", [single(D.bisim_batch), single(D.editex_batch), single(D.visual_batch), D.aline, D.aline_stress])
def test_measures_are_symmetric_and_one_on_equal_names(f):
    for a, b in zip(words(60), words(61), strict=False):
        assert f(a, a) == pytest.approx(1)
        assert f(a, b) == pytest.approx(f(b, a))
        assert 0 <= f(a, b) <= 1


def test_native_measures(spark):
    rows = [(a, b) for a, b in zip(words(100), words(101), strict=False)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", D.levenshtein_similarity("a", "b").alias("l"), D.prefix_similarity("a", "b").alias("p"), D.suffix_similarity("a", "b").alias("s"), D.substring_similarity("a", "b").alias("m")).collect()
    for r in got:
        a, b, most = r["a"], r["b"], max(len(r["a"]), len(r["b"]))
        if not most:
            assert r["l"] == r["p"] == r["s"] == r["m"] == 1
            continue
        pre = next((i for i, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))
        run = max((k for k in range(len(a) + 1) for i in range(len(a) - k + 1) if a[i : i + k] in b), default=0)
        assert r["l"] == pytest.approx(1 - lev(a, b) / most)
        assert r["p"] == pytest.approx(pre / most)
        assert r["m"] == pytest.approx(run / most)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_near_names_finds_all(spark, k):
    names = sorted({w for w in words(120, 6, "abc") if w})
    want = {(a, b) for a in names for b in names if a < b and lev(a, b) <= k}
    got = near_names(spark.createDataFrame([(n,) for n in names], "name string"), k)
    assert {(r["x_1"], r["x_2"]) for r in got.collect()} == want


def test_soundex_vectors(spark):
    want = {"tymczak": "T522", "pfister": "P236", "ashcraft": "A261", "honeyman": "H555", "1abc": "A120", "": ""}
    df = spark.createDataFrame([(k,) for k in want], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", phonetics.soundex("n").alias("s")).collect()} == want


@pytest.mark.parametrize(("name", "code"), [("knight", "NT"), ("wright", "RT"), ("phone", "FN"), ("xenon", "SNN"), ("school", "SKL"), ("action", "AKXN"), ("", "")])
def test_metaphone(name, code):
    assert phonetics.metaphone(name).replace("0", "T") == code


def test_adaptation_example():
    assert phonetics.adapt("chocolate")[:4] == ("tsokoleyt", "tso-ko-leyt", "tsokOleyt", "tso-kO-leyt")
    assert phonetics.adapt("12") == ("", "", "", "", None)


def test_transcription_chunks_and_stress():
    assert phonetics.filipino_g2p("tored 10") == phonetics.filipino_g2p("tored") + "10"
    for w in words(50, letters="abdeiokst"):
        assert phonetics.filipino_stressed(w).replace("ˈ", "") == phonetics.filipino_g2p(w)


def test_engineered_counts(spark):
    df = spark.createDataFrame([("bana", "bonana"), ("", "x"), ("añb", "ab")], "a string, b string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in features.spelling_features("a", "b").items()]).collect()]
    assert got == [(2, 1, 3, 1, 1, 1), (1, 0, 0, 0, 0, 1), (1, 1, 1, 0, 0, 1)]


def test_batch_of_nulls():
    assert np.array_equal(D.ratio_batch(pd.Series([None, "a"]), pd.Series(["a", "a"])), [0, 100])


def test_wrong_number_of_results_raises(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(Exception, match="results for"):
        phonetics.once_per_name(names, "name", "x string", lambda xs: [("1",)] * 3, ["x"]).collect()


@pytest.mark.parametrize("stress", [False, True])
def test_aline_batch_equals_pairs(stress):
    rng = random.Random(2)
    spoken = ["".join(rng.choice([*D.SOUNDS, "ˈ", "?"]) for _ in range(rng.randint(0, 11))) for _ in range(120)]
    a, b = [rng.choice(spoken) for _ in range(900)] + ["", ""], [rng.choice(spoken) for _ in range(900)] + ["", "a"]
    got = D.aline_batch(pd.Series(a), pd.Series(b), stress)
    assert got.tolist() == [D.aline(x, y, stress) for x, y in zip(a, b, strict=True)]


def test_spelling_takes_leading_words(spark):
    a = pd.Series(["foo bar baz", "foo", "aspirin", "neo aspirin forte", "", "  a  b"])
    b = pd.Series(["foo bar", "foo qux", "aspirine", "neo aspirin", "", "a"])
    lead = lambda x, y: " ".join(x.split()[: len(y.split())])
    one = lambda x, y: float(D.jaro_winkler_batch(pd.Series([x]), pd.Series([y]))[0])
    want = [max(one(x, y), one(x, lead(y, x)), one(lead(x, y), y)) for x, y in zip(a, b, strict=True)]
    assert D.spelling_batch(a, b) == pytest.approx(want)
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(D.spelling_similarity("a", "b")).collect()] == pytest.approx(want)


def test_wratio_batch_equals_pairs():
    a, b = words(300, 12, "ab c") + ["", "x"], words(301, 12, "ab c")[:300] + ["x", ""]
    got = D.wratio_batch(pd.Series(a), pd.Series(b))
    assert all(g == pytest.approx(D.wratio(x, y)) for g, x, y in zip(got, a, b, strict=True))
    some = D.wratio_batch(pd.Series(a), pd.Series(b), 65)
    assert all(abs(g - s) < 1e-9 if not np.isnan(s) else g < 65 for g, s in zip(got, some, strict=True)) and np.isnan(some).any()


def test_wratio_column_gives_null_below(spark):
    df = spark.createDataFrame([("abcdefghij", "xyz"), ("abc", "abd")], "a string, b string")
    assert [r[0] for r in df.select(D.wratio_column("a", "b", 65.0)).collect()] == [None, pytest.approx(200 / 3)]
