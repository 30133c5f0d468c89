import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearnames.functions import text


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()[0]


@pytest.mark.parametrize(("name", "core"), [
    ("sevelamer hydrochloride", "sevelamer"), ("tored 10", "tored"), ("neo penotran", "neo penotran"), ("sodium valproate", "sodium valproate"),
    ("sodium chloride", "sodium chloride"), ("10 20", "10"), ("", ""), ("neo 10 forte", "neo"), ("a bc", "bc"), ("neo", "neo"), ("plus 5", "plus"),
])
def test_core_name(spark, name, core):
    assert one(spark, text.core_name, name) == core


@pytest.mark.parametrize(("a", "b", "yes"), [("Zantac", "Zantac 360", True), ("Zantac", "Zantac", False), ("zan", "zantac", False), ("zantac 360", "ZANTAC", True)])
def test_qualifier(spark, a, b, yes):
    assert one(spark, text.is_qualifier_pair, a, b) is yes


@pytest.mark.parametrize(("x", "y"), [("a\tb", "ab"), ("A-B/c'd", "a b c d"), ("É", "e"), (None, ""), ("  x   y ", "x y"), ("n/a", "n a"), ("a\u00a0b", "ab"), ("Ñandú 5%", "nandu 5")])
def test_clean_name(spark, x, y):
    assert one(spark, text.clean_name, x) == y


def test_normalize_keeps_punctuation(spark):
    assert one(spark, text.normalize, " É-x'Y ") == "e-x'y"


def test_stripped_and_variants(spark):
    assert one(spark, text.stripped_name, "foo forte 10 b") == "foo b"
    assert one(spark, text.stripped_name, "forte 10") == "forte 10"
    assert one(spark, text.is_variant_pair, "foo forte", "foo 20") is True


def test_fragment_and_strength(spark):
    assert one(spark, text.is_fragment, "ab", "cdefgh") is True
    assert one(spark, text.is_fragment, "ab", "ab cdefgh") is False
    assert one(spark, text.is_fragment, "abcd", "efghij") is False
    assert one(spark, text.is_strength_variant, "tor 10", "tor 5") is True
    assert one(spark, text.is_strength_variant, "tor 10", "tor mg") is False


def test_answer_filter_keeps_candidates_only(spark):
    df = spark.createDataFrame([("A\nfoo\na", ["a", "b"])], "t string, c array<string>")
    assert df.select(text.answer_filter("t", "c")).first()[0] == ["a"]


def test_chunks(spark):
    assert one(spark, text.chunks, "tored 10") == ["tored", "10"]


def twin_clean(x):
    s = "".join(c for c in unicodedata.normalize("NFD", x.lower().strip()) if unicodedata.category(c) != "Mn")
    s = "".join(" " if c in "-/'" else c for c in s)
    return " ".join("".join(c for c in s if c in "abcdefghijklmnopqrstuvwxyz0123456789 ").split())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aB9 -/'éÑçŽ\t\nß.", max_size=12), min_size=20, max_size=20))
def test_clean_name_twin(spark, names):
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.clean_name("n").alias("c")).collect()
    assert all(r["c"] == twin_clean(r["n"]) for r in got)
