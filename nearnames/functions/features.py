"""Engineered columns of a pair of names, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearnames.config import ENGINEERED

_NONE = "aeiou"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def len_diff(a, b) -> Column:
    return F.abs(F.length(_col(a)) - F.length(_col(b)))


#: Prefix lengths that are told apart by plain comparisons, which stop at the first that fails.
_UNROLLED = 24


def common_prefix_len(a, b) -> Column:
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    at = F.array_position(parts, True)
    out = F.when(a == b, n)
    for k in range(1, _UNROLLED + 1):
        out = out.when(F.left(a, F.lit(k)) != F.left(b, F.lit(k)), k - 1)
    return out.otherwise(F.when(at == 0, n).otherwise(at - 1)).cast("int")


def common_suffix_len(a, b) -> Column:
    return common_prefix_len(F.reverse(_col(a)), F.reverse(_col(b)))


def syllables(x) -> Column:
    return F.size(F.regexp_extract_all(F.lower(_col(x)), F.lit("([aeiou]+)"), F.lit(0)))


def vowels(x) -> Column:
    return F.length(F.regexp_replace(F.lower(_col(x)), "[^aeiou]", ""))


def consonants(x) -> Column:
    return F.length(F.regexp_replace(F.lower(_col(x)), r"[^\p{L}]|[aeiou]", ""))


def _diff(f):
    return lambda a, b: F.abs(f(a) - f(b))


syllable_diff, vowel_count_diff, consonant_count_diff = _diff(syllables), _diff(vowels), _diff(consonants)


def vowel_skeleton(stressed) -> Column:
    """Lower-case vowels, e as i and o as u; a capital (stressed) vowel is not among them."""
    return F.translate(F.regexp_replace(_col(stressed), "[^aeiou]", ""), "eo", "iu")


def _penult(s: Column) -> Column:
    v = vowel_skeleton(s)
    return F.when(F.length(v) >= 2, F.substring(v, -2, 1)).otherwise(v)


def _int(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def hyphen_syllables(x) -> Column:
    x = F.coalesce(_col(x), F.lit(""))
    return F.when(x == "", 0).otherwise(F.size(F.split(x, "-")))


def engineered(a: str, b: str, fil_a: Column, fil_b: Column) -> dict[str, Column]:
    """The 14 columns by name; ``fil_a`` and ``fil_b`` are adaptation structs. A null name counts as 'nan'."""
    x, y = F.coalesce(_col(a), F.lit("nan")), F.coalesce(_col(b), F.lit("nan"))
    s, t = (F.coalesce(f["stressed"], F.lit("")) for f in (fil_a, fil_b))
    both = (s != "") & (t != "")
    marked = lambda v: F.length(F.regexp_replace(v, r"[^\p{Lu}]", ""))
    values = (
        len_diff(x, y), common_prefix_len(x, y), common_suffix_len(x, y),
        _int(both & (F.left(s, F.lit(1)) == F.left(t, F.lit(1)))), _int(both & (F.right(s, F.lit(1)) == F.right(t, F.lit(1)))),
        _int(vowel_skeleton(s) == vowel_skeleton(t)), _int((_penult(s) != "") & (_penult(s) == _penult(t))), _int(s == t),
        marked(s) + marked(t), _int(fil_a["english_stress_on_penult"] == fil_b["english_stress_on_penult"]),
        F.abs(hyphen_syllables(fil_a["syllabified"]) - hyphen_syllables(fil_b["syllabified"])),
        syllable_diff(x, y), vowel_count_diff(x, y), consonant_count_diff(x, y),
    )
    return dict(zip(ENGINEERED, values, strict=True))


def spelling_features(a: str, b: str) -> dict[str, Column]:
    """Those of the 14 that need no pronunciation."""
    return {
        "len_diff": len_diff(a, b), "common_prefix_len": common_prefix_len(a, b), "common_suffix_len": common_suffix_len(a, b),
        "syllable_diff": syllable_diff(a, b), "vowel_count_diff": vowel_count_diff(a, b), "consonant_count_diff": consonant_count_diff(a, b),
    }


def name_counts(x) -> Column:
    """What the spelling features need to know of one name, to be made once per name."""
    x = _col(x)
    return F.struct(F.length(x).alias("n"), F.reverse(x).alias("back"), syllables(x).alias("syllables"), vowels(x).alias("vowels"), consonants(x).alias("consonants"))


def spelling_from_counts(a: str, b: str, p: Column, q: Column) -> dict[str, Column]:
    """``spelling_features`` of two names whose ``name_counts`` are p and q."""
    gap = lambda k: F.abs(p[k] - q[k])
    return {
        "len_diff": gap("n"), "common_prefix_len": common_prefix_len(a, b), "common_suffix_len": common_prefix_len(p["back"], q["back"]),
        "syllable_diff": gap("syllables"), "vowel_count_diff": gap("vowels"), "consonant_count_diff": gap("consonants"),
    }


def add_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns in order; one that is there already stays as it is."""
    return df.select("*", *[c.alias(k) for k, c in columns.items() if k not in df.columns])
