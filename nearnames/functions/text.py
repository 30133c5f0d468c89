"""Name cleaning, keys and core words as native column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearnames.config import LEADING_EXCLUDED, LEADING_WORDS, STOPWORDS

_SPACE = r"(?U)^\s+|\s+$"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@functools.cache
def _accents() -> tuple[str, str]:
    """Precomposed letters and their base letters (one to one), from the Unicode tables."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(x) -> Column:
    return F.regexp_replace(F.translate(_col(x), *_accents()), r"\p{Mn}", "")


def strip_space(x) -> Column:
    """Like trim(), but of all white space."""
    return F.regexp_replace(_col(x), _SPACE, "")


def clean_name(x) -> Column:
    """Lower case a-z, 0-9 and single spaces; null gives ''. Hyphen, slash and apostrophe part words; tabs vanish."""
    s = strip_diacritics(strip_space(F.lower(F.coalesce(_col(x), F.lit("")))))
    s = F.regexp_replace(F.regexp_replace(s, "[-/']", " "), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(s, " +", " "))


def normalize(x) -> Column:
    """Lower case without accents and outer white space; punctuation stays."""
    return strip_diacritics(F.lower(strip_space(_col(x))))


def words(x) -> Column:
    return F.filter(F.split(_col(x), r"(?U)\s+"), lambda w: w != "")


def _in(w: Column, names: list[str]) -> Column:
    return w.isin(names)


def _no_digit(w: Column) -> Column:
    return ~w.rlike(r"\d")


def core_name(x) -> Column:
    w = words(x)
    first, second = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(2))
    completes = second.isNotNull() & ~_in(second, LEADING_EXCLUDED) & _no_digit(second) & (F.length(second) > 1)
    plain = F.try_element_at(F.filter(w, lambda v: ~_in(v, STOPWORDS) & _no_digit(v) & (F.length(v) > 1)), F.lit(1))
    led = F.when(completes, F.concat_ws(" ", first, second)).otherwise(first)
    return F.when(_in(first, LEADING_WORDS), led).otherwise(F.coalesce(plain, first, F.lit("")))


def stripped_name(x) -> Column:
    w = words(x)
    kept = F.filter(w, lambda v: ~_in(v, STOPWORDS) & _no_digit(v))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(w), " ")


def is_variant_pair(a, b) -> Column:
    return stripped_name(a) == stripped_name(b)


def is_qualifier_pair(a, b) -> Column:
    x, y = normalize(a), normalize(b)
    return y.startswith(F.concat(x, F.lit(" "))) | x.startswith(F.concat(y, F.lit(" ")))


def is_fragment(a, b, ratio: float = 0.5) -> Column:
    """The shorter name has under ``ratio`` of the longer's length and isn't its leading words."""
    a, b = _col(a), _col(b)
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.size(words(short))
    lead = F.when(n > 0, F.slice(words(long), F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return (F.length(short) < F.length(long) * ratio) & (words(short) != lead)


def is_strength_variant(a, b) -> Column:
    bare = lambda x: words(F.regexp_replace(_col(x), r"\d+", ""))
    return bare(a) == bare(b)


def pair_key(a, b) -> Column:
    return F.struct(F.least(_col(a), _col(b)).alias("lo"), F.greatest(_col(a), _col(b)).alias("hi"))


def sanitize(x) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-zñ]", "")


def fix_english_ipa(x) -> Column:
    return F.translate(_col(x), "ɡᵻ̩", "gɪ")


def fix_filipino_ipa(x) -> Column:
    s = F.replace(F.replace(_col(x), F.lit("d͡ʒ"), F.lit("ʤ")), F.lit("t͡ʃ"), F.lit("ʧ"))
    return F.regexp_replace(F.translate(s, "ɡ", "g"), r"[˥-˩\s]", "")


def chunks(x) -> Column:
    """Runs of a-z, and what stands between them without white space."""
    parts = F.regexp_extract_all(_col(x), F.lit("([a-z]+|[^a-z]+)"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)\s+", "")), lambda p: p != "")


def answer_filter(text, candidates) -> Column:
    """Answer lines, trimmed and lowered, that are candidates; distinct, in order."""
    low = F.transform(_col(candidates), lambda c: F.lower(c))
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\n"), lambda t: F.lower(strip_space(t)))
    return F.array_distinct(F.filter(lines, lambda t: F.array_contains(low, t)))


def ordered_hash(seed: int, *columns) -> Column:
    """A reproducible random order: md5 of the seed and the columns, parted by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c) for c in columns]))
