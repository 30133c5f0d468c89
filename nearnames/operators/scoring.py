"""Score columns of pairs: sound and spelling distances, engineered features, core words, lexicon pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearnames.config import CORE_SCORES
from nearnames.functions import distance, features, phonetics, scorers
from nearnames.functions.text import core_name
from nearnames.runtime import materialise

LANGS = ("eng", "fil")
#: Names up to this many are broadcast when looked up or crossed; more are joined by shuffle.
FEW_NAMES = 1_000_000


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x_1", "x_2")).alias("name")).where("name IS NOT NULL").distinct()


def lookup(pairs: DataFrame, table: DataFrame, columns: list[str], key: str = "name") -> DataFrame:
    """Add each of ``columns`` of ``table`` for both names, as column_1 and column_2 (null where absent)."""
    for side in ("1", "2"):
        part = table.select(F.col(key).alias(f"__k{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(part, F.col(f"x_{side}") == F.col(f"__k{side}"), "left").drop(f"__k{side}")
    return pairs


def transcribe(pairs: DataFrame, langs: tuple[str, ...] = LANGS, adapters: dict | None = None, skip_existing: bool = False) -> DataFrame:
    """Add t_<lang>_1 and t_<lang>_2; a missing name has an empty transcription.

    With ``skip_existing`` a language is left alone if both its columns hold something.
    """
    todo = []
    for lang in langs:
        have = [f"t_{lang}_{s}" for s in "12"]
        if skip_existing and set(have) <= set(pairs.columns):
            filled = pairs.agg(*[F.max(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias(c) for c in have]).first()
            if all(filled):
                continue
        todo.append(lang)
    if not todo:
        return pairs
    pairs = pairs.drop(*[f"t_{lang}_{s}" for lang in todo for s in "12"])
    # Written once, as both sides look names up.
    table = materialise(phonetics.transcriptions(_both(pairs), todo, adapters=adapters), "spoken")
    out = lookup(pairs, table, [f"t_{x}" for x in todo])
    return out.withColumns({f"t_{x}_{s}": F.coalesce(F.col(f"t_{x}_{s}"), F.lit("")) for x in todo for s in "12"})


def empty_transcriptions(pairs: DataFrame, langs: tuple[str, ...] = LANGS) -> DataFrame:
    return pairs.agg(*[F.count_if(F.col(f"t_{x}_{s}") == "").alias(f"empty_{x}_{s}") for x in langs for s in "12"])


def sound_scores(pairs: DataFrame, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """Spelling scores, then sound scores by stem and language; columns of those names are replaced.

    ``fil`` is compared with stress marks, taken from __fil_1 and __fil_2 if they are there. Spelling scores do not depend on language
    and are computed once.
    """
    phonetic = {distance.phonetic_name(stem, x): (f, x) for stem, (f, on) in sorted(distance.PHONETIC.items()) for x in on if x in langs}
    names = [*sorted(distance.ORTHOGRAPHIC), *phonetic]
    pairs = pairs.drop(*names)
    if "fil" in langs and "__fil_1" not in pairs.columns:
        stressed = phonetics.transcriptions(_both(pairs), ["fil"]).select("name", F.col("t_fil_stressed").alias("__fil"))
        pairs = lookup(pairs, stressed, ["__fil"])
    of = lambda x, s: F.coalesce(F.col(f"__fil_{s}" if x == "fil" else f"t_{x}_{s}"), F.lit(""))
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in ("x_1", "x_2"))
    columns = {k: distance.ORTHOGRAPHIC[k](a, b) for k in sorted(distance.ORTHOGRAPHIC)} | {k: f(of(x, 1), of(x, 2)) for k, (f, x) in phonetic.items()}
    return pairs.select("*", *[c.alias(k) for k, c in columns.items()]).drop("__fil_1", "__fil_2")


def engineered(pairs: DataFrame) -> DataFrame:
    """The 14 engineered columns in order; one that is there already stays.

    Names are adapted once each, or adaptations taken from __ad_1 and __ad_2 if they are there.
    """
    if "__ad_1" in pairs.columns:
        return features.add_missing(pairs, features.engineered("x_1", "x_2", F.col("__ad_1"), F.col("__ad_2"))).drop("__ad_1", "__ad_2")
    table = phonetics.adaptations(_both(pairs.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) for c in ("x_1", "x_2")])))
    out = pairs.withColumns({f"__x_{s}": F.coalesce(F.col(f"x_{s}"), F.lit("nan")) for s in "12"})
    for s in "12":
        out = out.join(table.select(F.col("name").alias(f"__x_{s}"), F.col("fil").alias(f"__fil_{s}")), f"__x_{s}", "left")
    return features.add_missing(out, features.engineered("x_1", "x_2", F.col("__fil_1"), F.col("__fil_2"))).drop("__x_1", "__x_2", "__fil_1", "__fil_2")


def cores(names: DataFrame, stressed: bool, adapters: dict | None = None) -> DataFrame:
    """(name, c, t): each distinct name's core word, and that word's stressed transcription if asked for."""
    table = names.select("name").distinct().withColumn("c", core_name("name"))
    if not stressed:
        return table.withColumn("t", F.lit(""))
    spoken = phonetics.transcriptions(table.select(F.col("c").alias("name")), ["fil"], adapters=adapters).select(F.col("name").alias("c"), F.col("t_fil_stressed").alias("t"))
    return table.join(spoken, "c", "left").select("name", "c", F.coalesce("t", F.lit("")).alias("t"))


def core_scores(pairs: DataFrame, stems: tuple[str, ...] = CORE_SCORES) -> DataFrame:
    """core_<stem> of the core words of both names (from __c_1, __t_1, ... if there); columns of those names are replaced."""
    pairs = pairs.drop(*[f"core_{k}" for k in stems])
    if "__c_1" not in pairs.columns:
        plain = pairs.withColumns({f"__x_{s}": F.coalesce(F.col(f"x_{s}"), F.lit("")) for s in "12"})
        table = cores(plain.select(F.explode(F.array("__x_1", "__x_2")).alias("name")), any(k in distance.PHONETIC for k in stems))
        for s in "12":
            plain = plain.join(table.select(F.col("name").alias(f"__x_{s}"), F.col("c").alias(f"__c_{s}"), F.col("t").alias(f"__t_{s}")), f"__x_{s}", "left")
        pairs = plain.drop("__x_1", "__x_2")
    score = lambda k: distance.PHONETIC[k][0]("__t_1", "__t_2") if k in distance.PHONETIC else distance.ORTHOGRAPHIC[k]("__c_1", "__c_2")
    return pairs.select("*", *[score(k).alias(f"core_{k}") for k in stems]).drop("__c_1", "__c_2", "__t_1", "__t_2")


def per_name(names: DataFrame, langs: tuple[str, ...] = LANGS, adapters: dict | None = None) -> DataFrame:
    """(name, __fil, __ad, __c, __t) of each distinct name: stressed transcription, adaptation, core word and its transcription; written once."""
    names = materialise(names.select("name").where("name IS NOT NULL").distinct(), "names")
    spoken = phonetics.transcriptions(names, ["fil"], adapters=adapters).select("name", F.col("t_fil_stressed").alias("__fil")) if "fil" in langs else names.withColumn("__fil", F.lit(""))
    core = cores(names, any(k in distance.PHONETIC for k in CORE_SCORES), adapters).select("name", F.col("c").alias("__c"), F.col("t").alias("__t"))
    return materialise(spoken.join(phonetics.adaptations(names, adapter=(adapters or {}).get("adapt")).select("name", F.col("fil").alias("__ad")), "name").join(core, "name"), "names")


def all_features(pairs: DataFrame, langs: tuple[str, ...] = LANGS, adapters: dict | None = None, own: list[scorers.Scorer] | None = None) -> DataFrame:
    """D to D_pho: sound and spelling scores (or those of ``own`` scorers), engineered columns, core-word scores.

    All that belongs to a name is made once per distinct name. A missing name is spoken
    as nothing, adapted as the word nan, and has no core word.
    """
    missing = pairs.sparkSession.createDataFrame([("nan",)], "name string")
    table = per_name(_both(pairs).union(missing), langs, adapters)
    nan = table.where("name = 'nan'").select("__ad").first()[0]
    nan = F.struct(*[F.lit(v).alias(k) for k, v in nan.asDict().items()])
    looked = lookup(pairs, table, ["__fil", "__ad", "__c", "__t"])
    looked = looked.withColumns({f"__ad_{s}": F.coalesce(f"__ad_{s}", nan) for s in "12"} | {f"{c}_{s}": F.coalesce(f"{c}_{s}", F.lit("")) for c in ("__c", "__t") for s in "12"})
    scored = sound_scores(looked, langs) if own is None else scorers.score(looked, own, langs).drop("__fil_1", "__fil_2")
    return core_scores(engineered(scored))


def featurize(pairs: DataFrame, adapters: dict | None = None, own: list[scorers.Scorer] | None = None, pos: str | None = None) -> DataFrame:
    """x_1, x_2 and label (if there) of any table of pairs, with transcriptions and all features; with ``pos``, that column too."""
    if missing := {"x_1", "x_2"}.difference(pairs.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    rows = pairs.select(*[c for c in ("x_1", "x_2", "label") if c in pairs.columns], *([pos] if pos else []))
    return all_features(transcribe(rows, adapters=adapters), adapters=adapters, own=own)


def latest_transcripts(pairs: DataFrame, langs: tuple[str, ...] = LANGS, pos: str = "pos") -> DataFrame:
    """(name, t_<lang>, ...): for a repeated name the last row wins, and x_2 over x_1."""
    sides = [pairs.select(F.col(f"x_{s}").alias("name"), F.lit(int(s)).alias("side"), F.col(pos).alias("at"), *[F.col(f"t_{x}_{s}").alias(f"t_{x}") for x in langs]) for s in "12"]
    both = sides[0].unionByName(sides[1]).where("name IS NOT NULL")
    best = both.groupBy("name").agg(F.max_by(F.struct(*[f"t_{x}" for x in langs]), F.struct("side", "at")).alias("r"))
    return best.select("name", *[F.col(f"r.t_{x}").alias(f"t_{x}") for x in langs])


def lexicon_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(x_1, x_2): every query with every other name; all pairs are the result here.

    The query set is blocked by hash and meets the names block by block; if the names
    are few they are broadcast, so nothing is shuffled.
    """
    q, n = queries.select(F.col("name").alias("x_1")), names.select(F.col("name").alias("x_2"))
    return q.join(F.broadcast(n) if n.count() <= FEW_NAMES else n, F.col("x_1") != F.col("x_2"))


def lexicon_spelling(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Spelling features of every query with every other name; counts are made per name, before the join."""
    q = queries.select(F.col("name").alias("x_1"), features.name_counts("name").alias("__1"))
    n = names.select(F.col("name").alias("x_2"), features.name_counts("name").alias("__2"))
    met = q.join(F.broadcast(n) if names.count() <= FEW_NAMES else n, F.col("x_1") != F.col("x_2"))
    return features.add_missing(met, features.spelling_from_counts("x_1", "x_2", F.col("__1"), F.col("__2"))).drop("__1", "__2")


def lexicon_scores(queries: DataFrame, names: DataFrame, transcripts: DataFrame, langs: tuple[str, ...] = LANGS, adapters: dict | None = None, own: list[scorers.Scorer] | None = None) -> DataFrame:
    """Scored pool of every query with every name; features are floats, no engineered columns. ``own`` scorers take the place of the usual ones."""
    # All that belongs to a name is made once per name, before the names meet.
    every = queries.select("name").union(names.select("name")).distinct()
    table = every.join(transcripts.select("name", *[f"t_{x}" for x in langs if x != "fil" or own is not None]), "name", "left")
    if "fil" in langs:
        table = table.join(phonetics.transcriptions(every, ["fil"], adapters=adapters).select("name", F.col("t_fil_stressed").alias("__fil")), "name", "left")
    table = materialise(table.join(cores(every, any(k in distance.PHONETIC for k in CORE_SCORES), adapters).select("name", F.col("c").alias("__c"), F.col("t").alias("__t")), "name"), "lexicon")
    side = lambda d, s: d.join(table, "name").select(*[F.col(c).alias(f"x_{s}" if c == "name" else f"{c}_{s}") for c in table.columns])
    right = side(names.select("name"), 2)
    pool = side(queries.select("name"), 1).join(F.broadcast(right) if names.count() <= FEW_NAMES else right, F.col("x_1") != F.col("x_2"))
    heard = sound_scores(pool, langs) if own is None else scorers.score(pool, own, langs).drop("__fil_1", "__fil_2")
    scored = core_scores(heard).drop(*[f"t_{x}_{s}" for x in langs for s in "12"])
    return scored.select("x_1", "x_2", *[F.col(f"`{c}`").cast("float").alias(c) for c in scored.columns if c not in ("x_1", "x_2")])


def hard_negatives(scored: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """The n rows of greatest hardness within [low, high]; raises if there are fewer."""
    band = scored.where(F.col("hardness").between(low, high))
    out = band.orderBy(F.desc("hardness"), "x_1", "x_2").limit(n)
    if (found := out.count()) < n:
        raise ValueError(f"only {found} pairs lie in the band, {n} are needed: widen it or mine more")
    return out


def hardness(pairs: DataFrame) -> DataFrame:
    """Mean of spelling similarity and English sound similarity, as ``hardness``."""
    a, b = (F.coalesce(F.col(f"t_eng_{s}"), F.lit("")) for s in "12")
    return pairs.withColumn("hardness", (distance.levenshtein_similarity("x_1", "x_2") + distance.PHONETIC["aline_kondrak"][0](a, b)) / 2)


def ranked(df: DataFrame, by: list, n: int, *partition: str) -> DataFrame:
    """First n rows of each partition."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*by))).where(F.col("rank") <= n)
