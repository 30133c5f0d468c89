"""Sharding, secrets, language, quality, pipeline: laws, brute force, held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearnames.llm import langid, quality, queries, secrets, sharding

# ---------------------------------------------------------------- sharding


def check_shards(rows, docs, n=8):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert all(0 <= k < n and sorted(v) == list(range(len(v))) for k, v in by.items())
    sizes = [len(by[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_whole_table(spark, sf, documents, awkward, empty, monkeypatch):
    check_shards(queries.op3_sharding(spark, sf).collect(), [d[:2] for d in documents])
    check_shards(sharding.shuffle_into_shards(awkward.repartition(3)).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert sharding.shuffle_into_shards(empty).count() == 0
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    check_shards(sharding.shuffle_into_shards(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).collect(), [d[:2] for d in documents])


def test_sharding_runs_no_python(spark, sf):
    plan = queries.op3_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_matrix_sums():
    rng = random.Random(1)
    sizes = [rng.randrange(0, 400) for _ in range(30)]
    total = sum(sizes)
    places = [total // 8 + (k < total % 8) for k in range(8)]
    m = sharding.matrix(sizes, places, 7)
    assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m, strict=True)] == places
    assert all(x >= 0 for r in m for x in r)


def test_hypergeometric_law():
    rng = random.Random(2)
    good, bad, draws, n = 7, 9, 6, 20000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    big = [sharding.hypergeometric(rng, 10**9, 7 * 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 125000) < 5 * 331 / math.sqrt(50)


def test_shuffle_is_uniform(spark):
    """Where a given row goes, over many seeds."""
    df = spark.range(0, 16, 1, 4).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    seen = Counter()
    for seed in range(24):
        for r in sharding.shuffle_into_shards(df, shards=2, seed=seed).where("doc_id < 4").collect():
            seen[r["shard"]] += 1
    assert abs(seen[0] - 48) < 5 * math.sqrt(96) / 2


# ---------------------------------------------------------------- secrets


def plain_scan(text):
    """The definition, word by word: all matches of the base patterns, then the short ones dropped."""
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ("assign", "access", "hex")
    return [f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1])))]


def test_secrets_whole_table(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op5_secrets(spark, sf).collect()}
    owners, repos, texts, values = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for i, text, _, source in documents:
        values[i] = [(s, text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in plain_scan(text)]
        for _, k, _, v in secrets.scan(text):
            owners[v].add(source), repos[v].add((source, i)), texts[v].add(text)
    for i, text, _, _ in documents:
        spans = plain_scan(text)
        assert got[i]["spans"] == ",".join(spans) and got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in secrets.KINDS] == [sum(s.startswith(k) for s in spans) for k in secrets.KINDS]
        live = [len(owners[v]) < 8 or len(repos[v]) < 8 or len(texts[v]) < 8 for _, _, _, v in secrets.scan(text)]
        assert (got[i]["n_live"], got[i]["n_example"]) == (sum(live), len(live) - sum(live))
        assert got[i]["live_spans"] == ",".join(s for s, yes in zip(spans, live, strict=True) if yes)
        if live:
            found = [v for *_, v in secrets.scan(text)]
            assert (got[i]["min_owners"], got[i]["max_repos"]) == (min(len(owners[v]) for v in found), max(len(repos[v]) for v in found))
    assert any(values.values())


@pytest.mark.parametrize("text", ["secret=token=abcdefghijklmn", "password: token: abcdefghijklmnop", "ſecret=abcdefghijklmn", "toKen='abcdefghijkl'", "AKIAXAKIA" + "A" * 20, "0123456789abcdef" * 3 + "g", "api-key=abcdefghijklmnop", 'API_KEY" : "A/b+c=d-e_f.g1"'])
def test_scan_equals_definition(text):
    got = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in secrets.scan(text)]
    assert got == plain_scan(text)


def test_examples_and_live(spark, awkward, empty):
    key, mine = "AKIA" + "Q" * 16, "AKIA" + "Z" * 16
    rows = [(1, f"x {key}", "a"), (2, f"{key} y", "b"), (3, f"🙂 {mine} {mine}", "a"), (3, f"🙂 {mine} {mine}", "a"), (4, None, None), (None, f"token = {'k' * 12}", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    two = {"example_owners": 2, "example_repos": 2, "example_texts": 2}
    got = sorted(((r["doc_id"], r["n_live"], r["n_example"], r["min_owners"], r["max_repos"]) for r in secrets.scan_secrets(df, **two).collect()), key=str)
    assert got == sorted([(1, 0, 1, 2, 2), (2, 0, 1, 2, 2), (3, 2, 0, 1, 1), (3, 2, 0, 1, 1), (4, 0, 0, None, None), (None, 1, 0, 1, 1)], key=str)
    masked = sorted(((r["doc_id"], r["text"]) for r in secrets.mask_live(df, **two).collect()), key=str)
    assert masked == sorted([(1, f"x {key}"), (2, f"{key} y"), (3, "🙂 [SECRET] [SECRET]"), (3, "🙂 [SECRET] [SECRET]"), (4, None), (None, "token = [SECRET]")], key=str)
    assert {r["n_example"] for r in secrets.scan_secrets(df, repo_col="source", **two).collect()} == {0, 1}
    assert secrets.scan_secrets(awkward).count() == awkward.count()
    out = secrets.mask_live(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert secrets.scan_secrets(empty).count() == 0 and secrets.mask_live(empty).count() == 0


# ---------------------------------------------------------------- language


def test_language_held_out(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, sf).collect()}
    assert len(got) == len(documents)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in documents if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i, *_ in documents)
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_text_vector_is_the_bundle():
    first, middle, last = langid.letter_vectors()
    table = langid.symbol_table()
    text = "Ab é-c"
    s = [0, *(int(table[ord(c)]) for c in text.lower()), 0]
    s = [x for k, x in enumerate(s) if x or k == 0 or s[k - 1]]
    want = sum(np.roll(last[s[k - 1]], 2).astype(int) * np.roll(last[s[k]], 1) * last[s[k + 1]] for k in range(1, len(s) - 1) if s[k])
    got, letters = langid.bundles(["zz", text, ""])
    assert np.array_equal(got[1], want) and letters.tolist() == [2, 4, 0]
    assert np.array_equal(first[5], np.roll(last[5], 2)) and np.array_equal(middle[5], np.roll(last[5], 1))


def test_language_inputs_are_only_texts(spark, awkward, empty):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("der die das und nicht", "de"), ("the of and that is", "en")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {(r["lang_pred"]) for r in langid.identify(df).where("doc_id % 2 = 0").collect()}
    assert found == {"de"}
    swapped = langid.predict(df.select((F.col("doc_id") + 7).alias("doc_id"), "text"), langid.train(df))
    assert {r["lang_pred"] for r in swapped.where("doc_id % 2 = 1").collect()} == {"de"}
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(awkward).collect()]
    assert len(got) == awkward.count() and (1, "und", 0.0) in got and (7, "und", 0.0) in got and (2, "und", 0.0) in got
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_texts_of_no_language_go(spark, sf):
    """Random letters, base64 and foreign texts go; clean labelled documents stay."""
    import corpus_pipeline as C

    rng = random.Random(6)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(rng.choice([60, 300, 1000]))) for _ in range(60)]
    coded = [base64.b64encode(rng.randbytes(300)).decode() for _ in range(30)]
    foreign = ["Mieleni minun tekevi aivoni ajattelevi lahteani laulamahan saaani sanelemahan", "Litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie", "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(letters + coded + foreign)], docs.schema)
    left = {r["doc_id"] for r in C.language_id(spark, docs.union(junk), sf).collect()}
    assert not [i for i in left if i >= 10**6]
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert len(clean - left) <= 0.02 * len(clean)


# ---------------------------------------------------------------- quality


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over folded symbols with dictionaries; a function of a 4-tuple."""
    fold = quality.folding()
    counts = Counter()
    for t in texts:
        s = [1, 1, 1, *(int(fold[ord(c)]) for c in t)]
        counts.update(tuple(s[k : k + 4]) for k in range(len(s) - 3))
    tables = {4: counts}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    d = {n: quality.discounts(Counter(t.values())) for n, t in tables.items()}
    cut = lambda n, c: d[n][min(c, 3) - 1]
    followers = {n: defaultdict(list) for n in tables}
    for n, t in tables.items():
        for g, c in t.items():
            followers[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        n, rest = len(g), p(g[1:])
        cs = followers[n].get(g[:-1])
        if not cs:
            return rest
        c = tables[n].get(g, 0)
        return (c - cut(n, c) if c else 0) / sum(cs) + sum(cut(n, x) for x in cs) / sum(cs) * rest

    return p


def test_model_equals_plain_kneser_ney(spark, documents):
    texts = [d[1] for d in documents[:40]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    p = plain_kneser_ney(texts)
    rng = random.Random(1)
    code, _ = quality.grams(texts)
    codes = {int(c) for c in rng.sample(code.tolist(), 150)} | {rng.randrange(48**4) for _ in range(150)} | {48 * c + x for c in (5, 48**2 + 7, 9 * 48**2) for x in range(48)}
    seen = spark.createDataFrame([(c,) for c in codes], "code int")
    got = {r["code"]: math.exp(r["logp"]) for r in quality.log_probabilities(seen, quality.count_grams(df)).collect()}
    assert set(got) == codes
    for c in codes:
        assert got[c] == pytest.approx(p(tuple(c // 48**k % 48 for k in (3, 2, 1, 0))), rel=1e-6)
    for c in (5, 48**2 + 7, 9 * 48**2):
        assert sum(got[48 * c + x] for x in range(48)) == pytest.approx(1)


@pytest.mark.parametrize("hot", [0, 500, 10**6])
def test_quality_equals_plain_form(spark, documents, hot):
    """Every perplexity, threshold and verdict of ``classify``, by dictionaries; however few 4-grams the workers hold."""
    rng = random.Random(7)
    docs = [(i, t[:400] if t else t, lang, "x") for i, t, lang, _ in documents[:260]] + [(9000, "", "en", "x"), (9001, None, "en", "x"), (9002, "zzqx", None, "x"), (3, "again with another text", "de", "x")]
    labels = [(i, int(rng.random() < 0.8), int(rng.random() < 0.1)) for i in range(260)] + [(7, 0, 0), (None, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, rare string").repartition(3)
    got = sorted(((r["doc_id"], r["lang"], r["log_perplexity"], r["threshold"], r["kept"]) for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), hot=hot).collect()), key=str)
    bad = {i for i, q, t in labels if q != 1 or t == 1}
    trusted = {i for i, q, t in labels if i is not None} - bad
    held = lambda i: zlib.crc32(str(i).encode()) % quality.FOLDS == 0
    p = plain_kneser_ney([t or "" for i, t, _, _ in docs if i in trusted and not held(i)])
    fold, memo = quality.folding(), {}

    def perplexity(text):
        s = [1, 1, 1, *(int(fold[ord(c)]) for c in text or "")]
        grams = [tuple(s[k : k + 4]) for k in range(len(s) - 3)]
        for g in grams:
            if g not in memo:
                memo[g] = math.log(p(g))
        return -sum(memo[g] for g in grams) / len(grams) if grams else None

    all_scores = [(i, lang, perplexity(t)) for i, t, lang, _ in docs]
    steps = defaultdict(list)
    for i, lang, x in all_scores:
        if i in trusted and held(i) and x is not None:
            steps[lang].append(math.floor(x / quality.STEP)), steps["every"].append(math.floor(x / quality.STEP))
    at = lambda v: (sorted(v)[math.ceil(len(v) * quality.QUANTILE) - 1] + 1) * quality.STEP
    threshold = {lang: at(v) if len(v) >= quality.LEAST and lang is not None else at(steps["every"]) for lang, v in steps.items()}
    want = sorted(((i, lang, x, t, x is not None and x <= t) for i, lang, x in all_scores for t in [threshold.get(lang, threshold["every"])]), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[:2]), r[2] or 0)), sorted(want, key=lambda r: (str(r[:2]), r[2] or 0)), strict=True):
        assert a[:2] == b[:2] and (a[2] is b[2] is None or a[2] == pytest.approx(b[2], rel=1e-6)) and a[3] == pytest.approx(b[3]) and a[4] == b[4]


def plain_character_model(texts):
    """Interpolated modified Kneser-Ney over characters as they are; a function of a string of 4."""
    tables = {4: Counter(g for t in texts for g in four_grams(t))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    d = {n: quality.discounts(Counter(t.values())) for n, t in tables.items()}
    followers = {n: defaultdict(list) for n in tables}
    for n, t in tables.items():
        for g, c in t.items():
            followers[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 0x110000
        n, rest = len(g), p(g[1:])
        cs, c = followers[n].get(g[:-1]), tables[n].get(g, 0)
        return rest if not cs else ((c - d[n][min(c, 3) - 1] if c else 0) + sum(d[n][min(x, 3) - 1] for x in cs) * rest) / sum(cs)

    return p


def four_grams(text):
    return [("\n\n\n" + text)[k : k + 4] for k in range(len(text))]


def test_quality_query_tells_all_characters_apart(spark, documents, tmp_path):
    """Perplexities of the query are those of the texts' own characters: case, digits, accents, scripts and marks count."""
    odd = ["THE ABC of 12", "QRS XYZ of 98", "Ωμέγα και", "Ωμάγα και", "привет мир", "приват мир", "漢字かな交じり", "a\x00b\x00", "\x00\x00", "😀 ok", "", None]
    docs = [(i, t[:300] if t else t, lang) for i, t, lang, _ in documents[:120]] + [(9000 + i, t, "en") for i, t in enumerate(odd)]
    labels = [(i, int(i % 7 > 0), 0) for i, _, _ in docs if i % 3 and i < 9000] + [(9002, 1, 0), (9004, 1, 0), (9006, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["log_perplexity"] for r in queries.op7_quality(spark, str(tmp_path)).collect()}
    trusted = {i for i, q, _ in labels if q}
    p = plain_character_model([t or "" for i, t, _ in docs if i in trusted and zlib.crc32(str(i).encode()) % quality.FOLDS])
    assert len(got) == len(docs)
    for i, t, _ in docs:
        want = -sum(math.log(p(g)) for g in four_grams(t)) / len(t) if t else None
        assert got[i] == (want if want is None else pytest.approx(want, rel=1e-6)), t
    assert got[9000] != pytest.approx(got[9001], rel=1e-6) and got[9002] != pytest.approx(got[9003], rel=1e-6)


@pytest.mark.parametrize("hot", [0, 300])
def test_character_model_with_few_grams_in_the_workers(spark, documents, hot):
    texts = [(t or "")[:200] for _, t, _, _ in documents[:60]] + ["", "É\x00漢"]
    p = plain_character_model(texts[::2])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    counts = quality.count_grams(df.where("i % 2 = 0"), folded=False).localCheckpoint()
    for r in quality.log_perplexities(df, counts, hot=hot).collect():
        t = texts[r["i"]]
        want = -sum(math.log(p(g)) for g in four_grams(t)) / len(t) if t else None
        assert r["log_perplexity"] == (want if want is None else pytest.approx(want, rel=1e-6))


def test_character_grams_of_any_alphabet():
    """Also where a slice has more characters than numbers of four of them fit in 64 bits."""
    wide = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)[:70_000]
    for texts in (["abca", "", "\x00\x00", "zß漢\U0010ffff"], [wide, "ab", wide[::-1][:500]], [""], []):
        code, index, n = quality.character_grams(texts)
        code = ["".join(chr(int.from_bytes(c[k : k + 3], "big")) for k in (0, 3, 6, 9)) for c in code.to_pylist()]
        assert len(set(code)) == len(code) and n.tolist() == [len(t) for t in texts]
        assert [code[i] for i in index] == [g for t in texts for g in four_grams(t)]


def test_the_driver_plans_one_order_at_a_time(spark, documents):
    df = spark.createDataFrame([(d[1],) for d in documents[:10]], "text string")
    counts = quality.count_grams(df, folded=False).localCheckpoint()
    plan = quality.log_probabilities(counts, counts)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Join ") <= 4


def test_quality_separates(spark, sf):
    out = queries.op7_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "i")
    r = out.join(labels, F.col("doc_id") == F.col("i")).groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {(x["quality"], x["toxic"]): x["k"] for x in r}
    assert share[1, 0] > 0.98 and share[0, 0] < 0.3
    assert out.count() == 1000


def test_thresholds_are_quantiles(spark):
    rng = random.Random(4)
    steps = Counter(rng.randrange(50) for _ in range(777))
    df = spark.createDataFrame([("a", s, n) for s, n in steps.items()], "lang string, step long, n long")
    flat = sorted(steps.elements())
    at = lambda q: (flat[math.ceil(len(flat) * q) - 1] + 1) * quality.STEP
    got = quality._thresholds(df, ["lang"], 0.9).first()
    assert got["total"] == 777 and got["threshold"] == pytest.approx(at(0.9))


def test_thresholds_are_those_of_trusted_held_out_texts(spark, sf):
    """By default a language's threshold is the quantile of its trusted held-out texts."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    en = [r for r in rows if r["lang"] == "en"]
    held = sorted(math.floor(r["log_perplexity"] / quality.STEP) for r in en if r["trusted"] and zlib.crc32(str(r["doc_id"]).encode()) % quality.FOLDS == 0)
    assert len(held) >= quality.LEAST
    assert en[0]["threshold"] == pytest.approx((held[math.ceil(len(held) * quality.QUANTILE) - 1] + 1) * quality.STEP)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = [(r["doc_id"], r["kept"]) for r in quality.classify(awkward, labels).collect()]
    assert len(got) == awkward.count() and (1, False) in got and (5, True) in got  # without trusted text all texts stay
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(awkward, labels.limit(0)).count() == awkward.count()


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
            before, after = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (docs, out))
            assert set(after) <= set(before)
            gone = set(before) - set(after)
            clean = [i for i in before if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
            if name in ("language_id", "quality_classifier"):
                assert len([i for i in clean if i in gone]) <= 0.02 * len(clean)
            if name == "ngram_jaccard":
                from test_brute import components, jaccard_links

                comp = components(jaccard_links(list(before.items())), before)
                assert set(after) == set(comp.values())
            if name == "secret_scan":
                assert not gone and any(before[i] != after[i] for i in after)
            kept[name] = len(after)
            out.write.mode("overwrite").parquet(f"/tmp/nearnames-test/{name}")
            docs = spark.read.parquet(f"/tmp/nearnames-test/{name}")
        else:
            assert {r["doc_id"] for r in out.collect()} == set(after)
    assert kept["quality_classifier"] < kept["language_id"]
    assert C.run(spark, sf).select("doc_id").distinct().count() == kept["secret_scan"]


#: Names that stages use inside, or once did.
CLASHING = ["gone", "again", "__id", "__live", "wanted", "gone_id", "GONE_KEY", "again_id", "again_key", "live_id", "live_key", "live_spans", "text_key", "kept", "stays", "row", "node", "sig", "rank", "salt", "label", "labelled", "trusted", "known", "rare", "score", "spans"]


def odd_documents(spark, awkward):
    long = "la casa es grande y el perro corre por la calle " * 25_000
    rows = [tuple(r)[:4] for r in awkward.collect()] + [(20, long, "es", "a"), (21, long + "x", "es", "b"), (22, " " * 2_000_000, "en", "a"), (23, "one text", "en", "a"), (23, "quite another text under the same id", "en", "a"), (24, f"token = {'k' * 20}", "en", "q"), (24, f"token = {'j' * 20}", "en", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(k) if k % 2 else F.lit(f"c{k}"))
    return docs


@pytest.mark.parametrize("name", ["language_id", "quality_classifier", "ngram_jaccard", "secret_scan", "packing"])
def test_stages_on_odd_rows(spark, sf, awkward, name):
    """Null, empty, repeated and very long rows, clashing names, an empty table: each stage on its own."""
    import corpus_pipeline as C

    stage, docs = dict(C.STAGES)[name], odd_documents(spark, awkward)
    out = stage(spark, docs, sf)
    before, after = ([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], None)
    if name == "packing":
        got = Counter(r["doc_id"] for r in out.where("start = 0").collect())
        assert got == Counter(i for i, _ in before)
        assert stage(spark, docs.limit(0), sf).count() == 0
        return
    rows = out.collect()
    after = [(r["doc_id"], r["text"]) for r in rows]
    assert out.columns == docs.columns and all(r[c] == (k if k % 2 else f"c{k}") for r in rows for k, c in enumerate(CLASHING))
    if name != "secret_scan":
        assert not Counter(after) - Counter(before)
    if name in ("language_id", "quality_classifier"):
        assert not [t for _, t in after if not t]
    if name == "language_id":
        assert not [t for _, t in after if not any(c.isalpha() for c in t)]
    if name == "ngram_jaccard":
        # The white-space texts are one group, the repeated rows one row, the long texts one group; texts under one id are judged apart.
        want = [1, 3, 4, 6, 7, 20, 23, 23, 24, 24, None]
        assert sorted((i for i, _ in after), key=str) == sorted(want, key=str)
    if name == "secret_scan":
        want = [(i, "token = [SECRET]" if i == 24 else t) for i, t in before]
        assert Counter(after) == Counter(want)
        assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows)
    assert stage(spark, docs.limit(0), sf).count() == 0
