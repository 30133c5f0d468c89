"""Registered queries run the whole job with the production settings."""

import unicodedata

from pyspark.sql import functions as F

from nearnames.config import Config
from nearnames.operators import noise
from nearnames.plans import catalog
from nearnames.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_noise_queries_use_the_defaults(spark, monkeypatch):
    seen, tier_1 = [], noise.tier_1
    monkeypatch.setattr(noise, "tier_1", lambda members, ranks, free, positive, codes, cfg: seen.append((cfg, ranks)) or tier_1(members, ranks, free, positive, codes, cfg))
    claimed = catalog.QUERIES["tier1_claim"](spark, SF)
    mined = catalog.QUERIES["noise_full"](spark, SF)
    assert len(seen) == 2 and all(cfg == Config() for cfg, _ in seen)
    want = {r["cluster_id"]: (r["target_1"], r["cap_1"]) for r in catalog.QUERIES["tier_targets"](spark, SF).collect()}
    assert {r["cluster_id"]: (r["target_1"], r["cap_1"]) for r in seen[0][1].collect()} == want
    assert claimed.groupBy("rank").count().agg(F.max("count")).first()[0] > 3
    assert mined.count() > 3 * fx.positives(spark, SF).count()
    hard = catalog.QUERIES["hard_negatives_full"](spark, SF).agg(F.count("*"), F.min("hardness"), F.max("hardness")).first()
    assert hard[0] == fx.positives(spark, SF).count() and hard[1] >= 0.4 and hard[2] <= 0.8


def test_lexicon_is_queries_by_all_names(spark):
    queries, names = catalog.QUERIES["positive_vocabulary"](spark, SF), fx.names(spark, SF)
    pool = catalog.QUERIES["lexicon_full"](spark, SF)
    assert pool.select("x_1", "x_2").distinct().count() == queries.count() * (names.count() - 1)


def test_features_cover_all_sources(spark):
    count = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    got = count(catalog.QUERIES["featurize_full"](spark, SF))
    assert got == count(catalog.QUERIES["assemble_full"](spark, SF)) and set(got) == {1, 0, -1}


def test_diacritics_go_from_whole_texts(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["strip_diacritics"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = "".join(c for c in unicodedata.normalize("NFD", d["text"]) if unicodedata.category(c) != "Mn")
        assert got[d["doc_id"]]["bare"] == unicodedata.normalize("NFC", want)
        words = "".join(c for c in want.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
        assert got[d["doc_id"]]["clean"].replace(" ", "") == words
