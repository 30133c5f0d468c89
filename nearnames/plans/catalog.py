"""Queries by name, and the SQL that checks them.

Each query reads whole tables. SQL given here runs on the same tables; queries
without any run functions that SQL lacks, and are held against plain Python twins
in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearnames.config import REJECTED, STOPWORDS, UNLABELED, LEADING_EXCLUDED, LEADING_WORDS, Config
from nearnames.functions import distance, features, phonetics, text
from nearnames.operators import noise, pairs, proposer, relabel, scoring
from nearnames.operators.blocking import near_names
from nearnames.plans import fixtures as fx
from nearnames.plans import pipeline
from nearnames.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL for the stand-in relations

_WORDS = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
_CTE = {
    "names": r"SELECT DISTINCT w AS name FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 5",
    "raw": r"""SELECT CASE length(name) % 6 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN name || ' forte' WHEN 3 THEN name || ' 10'
        WHEN 4 THEN name || ' hydrochloride' ELSE 'neo ' || name END AS drug_name FROM names
        UNION ALL SELECT * FROM (VALUES (''), ('None'), ('N/A'), ('Éclair-X'), ('a/b''c'))""",
    "cleaned": r"""SELECT drug_name, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(lower(drug_name), '^\s+|\s+$', '', 'g')), '[-/'']', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS clean FROM raw""",
    "registry": r"SELECT DISTINCT clean AS drug_name FROM cleaned WHERE clean NOT IN ('', 'none', 'nan', 'n/a')",
    "near": r"SELECT a.name AS x_1, b.name AS x_2, levenshtein(a.name, b.name) AS d FROM names a JOIN names b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 3",
    "p": r"SELECT x_1, x_2 FROM near WHERE d = 1",
    "n": r"SELECT x_1, x_2 FROM near WHERE d = 2 AND substr(md5(x_1 || '|' || x_2), 1, 1) BETWEEN '0' AND '3'",
    "u": r"SELECT x_1, x_2 FROM near WHERE d = 3 AND x_1[1] = x_2[1] AND substr(md5(x_1 || '|' || x_2), 1, 1) = '0'",
    "vocab": r"SELECT DISTINCT name FROM (SELECT x_1 AS name FROM p UNION ALL SELECT x_2 FROM p)",
    "outside": r"SELECT name FROM names WHERE name NOT IN (SELECT name FROM vocab)",
    "lex": r"SELECT q.name AS x_1, n.name AS x_2 FROM vocab q JOIN names n ON q.name <> n.name",
    "pseq": r"SELECT x_1, x_2, row_number() OVER (ORDER BY x_1, x_2) AS seq FROM p",
    "both": r"SELECT x_1 AS a, x_2 AS b, d FROM near WHERE d <= 2 UNION ALL SELECT x_2, x_1, d FROM near WHERE d <= 2",
    "run": r"""SELECT seq AS run, x_1, x_2 AS seed_x_2, list_sort(list(b)) AS candidates, list_sort(list(b) FILTER (d = 1)) AS x_2
        FROM pseq JOIN both_ ON x_1 = a GROUP BY seq, x_1, x_2""",
    "ch": r"""SELECT seq * 10 AS seq, 'remove' AS action, x_1, x_2, '' AS new_label FROM pseq WHERE seq % 4 = 0
        UNION ALL SELECT seq * 10, 'relabel', x_2, x_1, '-1' FROM pseq WHERE seq % 4 = 1
        UNION ALL SELECT seq * 10, 'remove', x_2, x_1, '' FROM pseq WHERE seq % 4 = 2
        UNION ALL SELECT seq * 10 + 1, 'add', x_1, x_2, '1' FROM pseq WHERE seq % 4 = 2
        UNION ALL SELECT * FROM (VALUES (1000001, 'remove', 'zzza', 'zzzb', ''), (1000002, 'relabel', 'zzza', 'zzzc', '-1'), (1000003, 'add', 'zzzd', 'zzzc', '1'), (1000004, 'add', 'zzzc', 'zzzd', '1'))""",
    "comp": r"""SELECT node AS name, min(root) AS cluster_id FROM (
        WITH RECURSIVE e AS (SELECT x_1 AS a, x_2 AS b FROM p UNION ALL SELECT x_2, x_1 FROM p), reach(node, root) AS (SELECT name, name FROM vocab UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node)
        SELECT node, root FROM reach) GROUP BY node""",
    "per": r"SELECT cluster_id, count(*) AS n FROM p JOIN comp ON p.x_1 = comp.name GROUP BY cluster_id",
}
_NEEDS = {
    "raw": ["names"], "cleaned": ["raw"], "registry": ["cleaned"], "near": ["names"], "p": ["near"], "n": ["near"], "u": ["near"], "vocab": ["p"], "outside": ["names", "vocab"],
    "lex": ["vocab", "names"], "pseq": ["p"], "both": ["near"], "run": ["pseq", "both"], "ch": ["pseq"], "comp": ["p", "vocab"], "per": ["p", "comp"],
}


def _with(body: str, *needs: str, **extra: str) -> str:
    order: list[str] = []

    def add(k: str) -> None:
        for x in _NEEDS.get(k, []):
            add(x)
        if k not in order:
            order.append(k)

    for k in needs:
        add(k)
    ctes = [f"{'both_' if k == 'both' else k} AS ({_CTE[k]})" for k in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- registry and names

_PREFIX = "CAST(coalesce(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] <> {b}[i]), true) - 1, least(length({a}), length({b}))) AS INTEGER)"
_SQL_PREFIX = lambda a, b: _PREFIX.format(a=a, b=b)
_SYLL = lambda x: f"len(regexp_extract_all(lower({x}), '[aeiou]+'))"
_VOW = lambda x: f"length(regexp_replace(lower({x}), '[^aeiou]', '', 'g'))"
_CONS = lambda x: f"length(regexp_replace(lower({x}), '[^a-z]|[aeiou]', '', 'g'))"
_SPELL = f"""x_1, x_2, CAST(abs(length(x_1) - length(x_2)) AS INTEGER) AS len_diff, {_SQL_PREFIX('x_1', 'x_2')} AS common_prefix_len, {_SQL_PREFIX('reverse(x_1)', 'reverse(x_2)')} AS common_suffix_len,
    CAST(abs({_SYLL('x_1')} - {_SYLL('x_2')}) AS INTEGER) AS syllable_diff, CAST(abs({_VOW('x_1')} - {_VOW('x_2')}) AS INTEGER) AS vowel_count_diff, CAST(abs({_CONS('x_1')} - {_CONS('x_2')}) AS INTEGER) AS consonant_count_diff"""


@query(_with(f"SELECT {_SPELL} FROM (SELECT a.drug_name AS x_1, b.drug_name AS x_2 FROM registry a JOIN registry b ON a.drug_name < b.drug_name AND levenshtein(a.drug_name, b.drug_name) <= 1)", "registry"))
def near_name_features(spark, sf):
    registry = pairs.clean_registry(fx.raw_registry(spark, sf))
    near = near_names(registry, 1, "drug_name").select("x_1", "x_2")
    return features.add_missing(near, features.spelling_features("x_1", "x_2"))


@query(_with("SELECT drug_name FROM registry", "registry"))
def registry_clean(spark, sf):
    return pairs.clean_registry(fx.raw_registry(spark, sf)).select("drug_name")


@query(_with("SELECT count(*) AS n_raw, count(*) FILTER (drug_name IS NULL) AS n_null, count(drug_name) - count(DISTINCT drug_name) AS n_duplicate, (SELECT count(*) FROM registry) AS n_clean, count(*) - (SELECT count(*) FROM registry) AS n_dropped, count(*) < 500 AS is_small FROM raw", "registry"))
def registry_quality_report(spark, sf):
    return pairs.registry_report(fx.raw_registry(spark, sf))


@query(r"SELECT doc_id, strip_accents(text) AS bare, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')), '[-/'']', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS clean FROM documents")
def strip_diacritics(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", text.strip_diacritics("text").alias("bare"), text.clean_name("text").alias("clean"))


_CORE = f"""CASE WHEN w[1] IN {_WORDS(LEADING_WORDS)} THEN CASE WHEN w[2] IS NOT NULL AND w[2] NOT IN {_WORDS(LEADING_EXCLUDED)} AND NOT regexp_matches(w[2], '[0-9]') AND length(w[2]) > 1 THEN w[1] || ' ' || w[2] ELSE w[1] END
    ELSE coalesce(list_filter(w, lambda v: v NOT IN {_WORDS(STOPWORDS)} AND NOT regexp_matches(v, '[0-9]') AND length(v) > 1)[1], w[1], '') END"""
_STRIP = f"array_to_string(CASE WHEN len(list_filter(w, lambda v: v NOT IN {_WORDS(STOPWORDS)} AND NOT regexp_matches(v, '[0-9]'))) > 0 THEN list_filter(w, lambda v: v NOT IN {_WORDS(STOPWORDS)} AND NOT regexp_matches(v, '[0-9]')) ELSE w END, ' ')"
_SPLIT = "SELECT drug_name, string_split(drug_name, ' ') AS w FROM registry"


@query(_with(f"SELECT drug_name, {_CORE} AS core FROM ws", "registry", ws=_SPLIT))
def core_name(spark, sf):
    return pairs.clean_registry(fx.raw_registry(spark, sf)).select("drug_name", text.core_name("drug_name").alias("core"))


@query(_with(f"SELECT drug_name, {_STRIP} AS stripped FROM ws", "registry", ws=_SPLIT))
def stripped_name(spark, sf):
    return pairs.clean_registry(fx.raw_registry(spark, sf)).select("drug_name", text.stripped_name("drug_name").alias("stripped"))


def _forms(spark, sf) -> DataFrame:
    """(drug_name): clean names, plain and as they are dressed, so that variants and qualifiers occur."""
    plain = fx.names(spark, sf).select(F.col("name").alias("drug_name"))
    return pairs.clean_registry(fx.raw_registry(spark, sf)).select("drug_name").union(plain).distinct()


_FORMS = "SELECT drug_name FROM registry UNION SELECT name FROM names"


@query(_with(f"SELECT a.drug_name AS x_1, b.drug_name AS x_2 FROM ws a JOIN ws b ON a.drug_name < b.drug_name AND a.s = b.s", "registry", f=_FORMS, w0="SELECT drug_name, string_split(drug_name, ' ') AS w FROM f", ws=f"SELECT drug_name, {_STRIP} AS s FROM w0"))
def variant_pairs(spark, sf):
    keyed = _forms(spark, sf).withColumn("s", text.stripped_name("drug_name"))
    a, b = keyed.withColumnRenamed("drug_name", "x_1"), keyed.withColumnRenamed("drug_name", "x_2")
    return a.join(b, "s").where("x_1 < x_2").select("x_1", "x_2")


@query(_with("SELECT a.drug_name AS x_1, b.drug_name AS x_2 FROM f a JOIN f b ON starts_with(b.drug_name, a.drug_name || ' ')", "registry", f=_FORMS))
def qualifier_pairs(spark, sf):
    # Every proper run of leading words of the longer name is a key, so this is an equi-join.
    forms = _forms(spark, sf)
    w = F.split("drug_name", " ")
    leads = forms.where(F.size(w) > 1).select(F.col("drug_name").alias("x_2"), F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, F.lit(1), i), " "))).alias("x_1"))
    return leads.join(forms.select(F.col("drug_name").alias("x_1")), "x_1").where(text.is_qualifier_pair("x_1", "x_2")).select("x_1", "x_2")


@query(_with("""SELECT x_1, x_2 FROM (SELECT p.x_1, 'zz ' || p.x_2 || ' ' || q AS x_2 FROM p, (SELECT unnest(['', 'extended release', p_x]) AS q FROM (SELECT 'supercalifragilistic' AS p_x)))
    WHERE least(length(x_1), length(x_2)) < 0.5 * greatest(length(x_1), length(x_2))
    AND (CASE WHEN length(x_1) <= length(x_2) THEN string_split(x_1, ' ') ELSE string_split(x_2, ' ') END) <> (CASE WHEN length(x_1) <= length(x_2) THEN string_split(x_2, ' ')[1:len(string_split(x_1, ' '))] ELSE string_split(x_1, ' ')[1:len(string_split(x_2, ' '))] END)""", "p"))
def fragment_pairs(spark, sf):
    tails = F.explode(F.array(F.lit(""), F.lit("extended release"), F.lit("supercalifragilistic")))
    met = fx.positives(spark, sf).select("x_1", "x_2", tails.alias("q")).select("x_1", F.concat(F.lit("zz "), "x_2", F.lit(" "), "q").alias("x_2"))
    return met.where(text.is_fragment("x_1", "x_2"))


@query(_with("SELECT a.name || ' 10' AS x_1, b.name || ' ' || c AS x_2 FROM names a JOIN (SELECT name, unnest(['5', 'mg']) AS c FROM names) b ON a.name = b.name WHERE c = '5'", "names"))
def strength_variant_pairs(spark, sf):
    tails = F.explode(F.array(F.lit("5"), F.lit("mg")))
    met = fx.names(spark, sf).select("name", tails.alias("tail")).select(F.concat("name", F.lit(" 10")).alias("x_1"), F.concat("name", F.lit(" "), "tail").alias("x_2"))
    return met.where(text.is_strength_variant("x_1", "x_2"))


# ---------------------------------------------------------------- pairs

_ALL3 = "SELECT x_1, x_2, 1 AS label, 0 AS r FROM p UNION ALL SELECT x_2, x_1, -1, 1 FROM n UNION ALL SELECT x_1, x_2, -1, 1 FROM p WHERE x_1 < 'm' UNION ALL SELECT x_2, x_1, 0, 2 FROM u UNION ALL SELECT x_1, x_2, 0, 2 FROM n"


def _three(spark, sf):
    p, n, u = (f(spark, sf) for f in (fx.positives, fx.rejected, fx.unlabeled))
    back = lambda d: d.select(F.col("x_2").alias("x_1"), F.col("x_1").alias("x_2"))
    return p, back(n).unionByName(p.where("x_1 < 'm'")), back(u).unionByName(n)


@query(_with("SELECT x_1, x_2 FROM (SELECT x_1, x_2, row_number() OVER (PARTITION BY least(x_1, x_2), greatest(x_1, x_2) ORDER BY x_1, x_2) AS k FROM t) WHERE k = 1", "p", "n", "u", t=_ALL3))
def pair_dedup_unordered(spark, sf):
    return pairs.clean_and_deduplicate(io.union_all(list(_three(spark, sf))))


@query(_with("SELECT x_1, x_2, label FROM (SELECT *, row_number() OVER (PARTITION BY least(x_1, x_2), greatest(x_1, x_2) ORDER BY r, x_1, x_2) AS k FROM t) WHERE k = 1", "p", "n", "u", t=_ALL3))
def label_priority_union(spark, sf):
    return pairs.priority_union(*_three(spark, sf))


@query(_with("SELECT label, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY least(x_1, x_2), greatest(x_1, x_2) ORDER BY r, x_1, x_2) AS k FROM t) WHERE k = 1 GROUP BY label", "p", "n", "u", t=_ALL3))
def label_counts(spark, sf):
    return pairs.label_counts(label_priority_union(spark, sf))


@query(_with("SELECT x_1, x_2, CAST(1 AS INTEGER) AS label FROM p UNION ALL SELECT x_1, x_2, -1 FROM n", "p", "n"))
def labelled_split(spark, sf):
    both = fx.positives(spark, sf).withColumn("y", F.lit("1")).unionByName(fx.rejected(spark, sf).withColumn("y", F.lit("-1")))
    good, bad = pairs.split_labelled(both)
    return good.withColumn("label", F.lit(1)).unionByName(bad.withColumn("label", F.lit(-1)))


@query(_with("SELECT DISTINCT x_1, x_2 FROM (SELECT x_1, x_2 FROM n UNION ALL SELECT x_1, c AS x_2 FROM (SELECT x_1, seed_x_2, x_2 AS chosen, unnest(candidates) AS c FROM run) WHERE NOT list_contains(list_append(list_transform(chosen, lambda v: lower(v)), lower(seed_x_2)), lower(c)))", "n", "run"))
def rejection_union(spark, sf):
    return fx.rejected(spark, sf).unionByName(proposer.unselected_pairs(fx.run(spark, sf), REJECTED).select("x_1", "x_2")).dropDuplicates()


@query(_with("SELECT name FROM vocab", "vocab"))
def positive_vocabulary(spark, sf):
    return pairs.vocabulary(fx.positives(spark, sf))


@query(_with("SELECT name FROM outside", "outside"))
def outside_vocabulary(spark, sf):
    return pairs.outside(fx.names(spark, sf), fx.positives(spark, sf), "name")


@query(_with("SELECT x_1, x_2 FROM u WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.x_1 = u.x_1 AND near.x_2 = u.x_2 AND d <= 2) UNION ALL SELECT x_1, x_2 FROM near WHERE d = 2 AND (x_1, x_2) NOT IN (SELECT x_1, x_2 FROM n)", "u", "n"))
def exclude_labelled_anti(spark, sf):
    near = near_names(fx.names(spark, sf), 2).where("distance = 2").select("x_1", "x_2")
    rows = fx.unlabeled(spark, sf).unionByName(near)
    return pairs.without_pairs(rows, fx.positives(spark, sf), fx.rejected(spark, sf).select(F.col("x_2").alias("x_1"), F.col("x_1").alias("x_2")))


@query(_with("SELECT name, cluster_id FROM comp", "comp"))
def connected_components(spark, sf):
    return noise.clusters(fx.positives(spark, sf))


@query(_with("SELECT cluster_id, n FROM per", "per"))
def positives_per_cluster(spark, sf):
    p = fx.positives(spark, sf)
    return noise.positives_per_cluster(p, noise.clusters(p))


_SHARE = "CAST((SELECT count(*) FROM p) * 450 AS DOUBLE) * n / CAST((SELECT count(*) FROM p) AS DOUBLE)"
_TARGETS = f"SELECT cluster_id, n, CAST(round_even({_SHARE} * 0.65::DOUBLE, 0) AS BIGINT) AS target_1, CAST(round_even({_SHARE} * 0.35::DOUBLE, 0) AS BIGINT) AS target_2 FROM per"


@query(_with("SELECT *, greatest(50, 4 * target_1) AS cap_1, greatest(50, 4 * target_2) AS cap_2 FROM t", "per", t=_TARGETS))
def tier_targets(spark, sf):
    p = fx.positives(spark, sf)
    return noise.tier_targets(noise.positives_per_cluster(p, noise.clusters(p)), pairs.normal_pairs(p).count())


@query(_with("SELECT name, CAST(floor((k - 1) / 5) AS INTEGER) AS rank FROM (SELECT name, row_number() OVER (ORDER BY md5('43|' || name), name) AS k FROM outside) WHERE k <= 5 * (SELECT count(DISTINCT cluster_id) FROM comp)", "outside", "comp"))
def tier2_slices(spark, sf):
    p = fx.positives(spark, sf)
    ranks = noise.clusters(p).select("cluster_id").distinct()
    return noise.tier_2_slices(pairs.outside(fx.names(spark, sf), p, "name"), ranks, 5, 42)


@query(_with("SELECT c.cluster_id, a.name AS x_1, b.name AS x_2 FROM comp a JOIN comp b ON a.cluster_id = b.cluster_id AND a.name < b.name JOIN (SELECT DISTINCT cluster_id FROM comp) c ON c.cluster_id = a.cluster_id WHERE levenshtein(a.name, b.name) <= 2", "comp"))
def tier2_self_join_lev(spark, sf):
    m = noise.clusters(fx.positives(spark, sf))
    a, b = m.withColumnRenamed("name", "x_1"), m.withColumnRenamed("name", "x_2")
    return a.join(b, "cluster_id").where(F.col("x_1") < F.col("x_2")).where(F.levenshtein("x_1", "x_2") <= 2)


@query(_with("SELECT x_1, x_2 FROM u ORDER BY md5('42|' || x_1 || '|' || x_2), x_1, x_2 LIMIT 50", "u"))
def noise_sample_md5(spark, sf):
    return pairs.sample(fx.unlabeled(spark, sf), 50, 42, "x_1", "x_2")


@query(_with("""SELECT count(*) AS n_pairs, avg(CASE WHEN x_1[1] = x_2[1] THEN 1.0 ELSE 0.0 END) AS same_first_letter,
    avg(CASE WHEN x_1 IN (SELECT name FROM vocab) OR x_2 IN (SELECT name FROM vocab) THEN 1.0 ELSE 0.0 END) AS with_known_name,
    (SELECT count(*) FROM used) AS n_names, (SELECT count(*) FROM vocab WHERE name NOT IN (SELECT name FROM used)) AS n_unused, (SELECT count(*) FROM vocab) AS n_known FROM u""", "u", "vocab", used="SELECT x_1 AS name FROM u UNION SELECT x_2 FROM u"))
def noise_report(spark, sf):
    return noise.noise_report(fx.unlabeled(spark, sf), fx.positives(spark, sf))[0]


@query(_with("SELECT name, count(*) AS n FROM (SELECT x_1 AS name FROM u UNION ALL SELECT x_2 FROM u) GROUP BY name ORDER BY n DESC, name LIMIT 20", "u"))
def name_usage_top(spark, sf):
    return noise.noise_report(fx.unlabeled(spark, sf), fx.positives(spark, sf))[1]


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS n_distinct, CAST(0 AS BIGINT) AS n_known, CAST(0 AS BIGINT) AS n_self")
def random_registry_pairs(spark, sf):
    p = fx.positives(spark, sf)
    out = pairs.random_pairs(fx.names(spark, sf), 100, [p], 42)
    known = p.select(F.col("x_1").alias("lo"), F.col("x_2").alias("hi"), F.lit(1).alias("known"))
    keyed = out.select(F.least("x_1", "x_2").alias("lo"), F.greatest("x_1", "x_2").alias("hi")).join(known, ["lo", "hi"], "left")
    return keyed.agg(F.count("*").alias("n"), F.count_distinct("lo", "hi").alias("n_distinct"), F.count("known").alias("n_known"), F.count_if(F.col("lo") == F.col("hi")).alias("n_self"))


# ---------------------------------------------------------------- joins on similarity


@query(_with("SELECT x_1, x_2, CAST(d AS INTEGER) AS distance FROM near WHERE d <= 2", "near"))
def near_name_join_lev(spark, sf):
    return near_names(fx.names(spark, sf), 2)


@query(_with("""SELECT x_1, name, rank FROM (SELECT q.name AS x_1, n.name, CAST(row_number() OVER (PARTITION BY q.name ORDER BY round(jaro_winkler_similarity(q.name, n.name), 9) DESC, n.name) AS INTEGER) AS rank
    FROM vocab q JOIN names n ON q.name <> n.name) WHERE rank <= 20""", "vocab", "names"))
def jaro_winkler_topk(spark, sf):
    lex = scoring.lexicon_pairs(pairs.vocabulary(fx.positives(spark, sf)), fx.names(spark, sf))
    scored = lex.withColumn("score", F.round(distance.jaro_winkler("x_1", "x_2"), 9))
    return scoring.ranked(scored, [F.desc("score"), "x_2"], 20, "x_1").select("x_1", F.col("x_2").alias("name"), "rank")


@query(_with("SELECT x_1 || ' forte' AS x_1, x_2, round(greatest(jaro_winkler_similarity(x_1 || ' forte', x_2), jaro_winkler_similarity(x_1, x_2)), 9) AS score FROM p", "p"))
def leading_word_jw(spark, sf):
    rows = fx.positives(spark, sf).select(F.concat("x_1", F.lit(" forte")).alias("x_1"), "x_2")
    return rows.withColumn("score", F.round(distance.spelling_similarity("x_1", "x_2"), 9))


@query(_with(f"SELECT {_SPELL} FROM lex", "lex"))
def engineered_orthographic(spark, sf):
    return scoring.lexicon_spelling(pairs.vocabulary(fx.positives(spark, sf)), fx.names(spark, sf))


def _scores(spark, sf, f):
    rows = io.union_all(list(_three(spark, sf))).distinct()
    return rows.select("x_1", "x_2", F.round(f("x_1", "x_2"), 9).alias("score"))


_SOME = "SELECT DISTINCT x_1, x_2 FROM (SELECT x_1, x_2 FROM p UNION ALL SELECT x_2, x_1 FROM n UNION ALL SELECT x_2, x_1 FROM u UNION ALL SELECT x_1, x_2 FROM n)"
_SCORE = lambda e: _with(f"SELECT x_1, x_2, round({e}, 9) AS score FROM t", "p", "n", "u", t=_SOME)
_LEV = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"
_BARE = "regexp_replace({}, '[aeiou]', '', 'g')"


@query(_SCORE(_LEV.format(a="x_1", b="x_2")))
def lev_similarity(spark, sf):
    return _scores(spark, sf, distance.levenshtein_similarity)


@query(_SCORE(f"CASE WHEN greatest(length({_BARE.format('x_1')}), length({_BARE.format('x_2')})) = 0 THEN 1 ELSE {_LEV.format(a=_BARE.format('x_1'), b=_BARE.format('x_2'))} END"))
def lev_consonant(spark, sf):
    return _scores(spark, sf, distance.levenshtein_consonant)


@query(_SCORE(f"{_SQL_PREFIX('x_1', 'x_2')}::DOUBLE / greatest(length(x_1), length(x_2))"))
def prefix_sim(spark, sf):
    return _scores(spark, sf, distance.prefix_similarity)


@query(_SCORE(f"{_SQL_PREFIX('reverse(x_1)', 'reverse(x_2)')}::DOUBLE / greatest(length(x_1), length(x_2))"))
def lcsuf_sim(spark, sf):
    return _scores(spark, sf, distance.suffix_similarity)


@query(_SCORE("coalesce(list_max(list_transform(range(1, length(x_1) + 1), lambda i: list_max(list_transform(range(0, length(x_1) - i + 2), lambda k: CASE WHEN k > 0 AND contains(x_2, x_1[i:i + k - 1]) THEN k ELSE 0 END)))), 0)::DOUBLE / greatest(length(x_1), length(x_2))"))
def lcsubstring_sim(spark, sf):
    return _scores(spark, sf, distance.substring_similarity)


@query(_with(f"SELECT x_1, x_2, round({_LEV.format(a='c1', b='c2')}, 9) AS core_levenshtein, round({_SQL_PREFIX('c1', 'c2')}::DOUBLE / greatest(length(c1), length(c2)), 9) AS core_prefix FROM t", "registry", ws=_SPLIT, cores=f"SELECT drug_name, {_CORE} AS c FROM ws", t="SELECT a.drug_name AS x_1, b.drug_name AS x_2, a.c AS c1, b.c AS c2 FROM cores a JOIN cores b ON a.drug_name < b.drug_name AND levenshtein(a.drug_name, b.drug_name) <= 2"))
def core_features_native(spark, sf):
    near = near_names(pairs.clean_registry(fx.raw_registry(spark, sf)), 2, "drug_name").select("x_1", "x_2")
    scored = scoring.core_scores(near, ("levenshtein", "prefix"))
    return scored.select("x_1", "x_2", *[F.round(c, 9).alias(c) for c in ("core_levenshtein", "core_prefix")])


@query(_with(f"SELECT x_1, x_2, round({_LEV.format(a='x_1', b='x_2')}, 9) AS levenshtein FROM lex", "lex"))
def lexicon_pool_lev(spark, sf):
    lex = scoring.lexicon_pairs(pairs.vocabulary(fx.positives(spark, sf)), fx.names(spark, sf))
    return lex.select("x_1", "x_2", F.round(distance.levenshtein_similarity("x_1", "x_2"), 9).alias("levenshtein"))


@query(_with("SELECT x_1, x_2 FROM (SELECT *, row_number() OVER (ORDER BY s DESC, x_1, x_2) AS k FROM t WHERE s BETWEEN 0.4 AND 0.8) WHERE k <= (SELECT count(*) FROM p)", "p", "n", "u", t=f"SELECT x_1, x_2, round({_LEV.format(a='x_1', b='x_2')}, 9) AS s FROM ({_SOME})"))
def hard_negative_band(spark, sf):
    scored = lev_similarity(spark, sf).withColumnRenamed("score", "hardness")
    return scoring.hard_negatives(scored, fx.positives(spark, sf).count(), 0.4, 0.8).select("x_1", "x_2")


# ---------------------------------------------------------------- proposer


@query(_with("SELECT DISTINCT x_1, x_2 FROM (SELECT x_1, seed_x_2 AS x_2 FROM run UNION ALL SELECT x_1, unnest(x_2) FROM run)", "run"))
def proposer_explode(spark, sf):
    return proposer.proposed_pairs(fx.run(spark, sf))


@query(_with("SELECT x_1, c AS x_2, CAST(-1 AS INTEGER) AS label FROM (SELECT x_1, seed_x_2, x_2 AS chosen, unnest(candidates) AS c FROM run) WHERE NOT list_contains(list_append(list_transform(chosen, lambda v: lower(v)), lower(seed_x_2)), lower(c))", "run"))
def unselected_candidates(spark, sf):
    return proposer.unselected_pairs(fx.run(spark, sf), REJECTED)


@query(_with("SELECT count(*) AS n_all, count(*) FILTER (k = 1 AND p = 0) AS n_new FROM (SELECT row_number() OVER (PARTITION BY least(x_1, c), greatest(x_1, c)) AS k, CASE WHEN (least(x_1, c), greatest(x_1, c)) IN (SELECT x_1, x_2 FROM p) THEN 1 ELSE 0 END AS p FROM (SELECT x_1, seed_x_2, x_2 AS chosen, unnest(candidates) AS c FROM run) WHERE NOT list_contains(list_append(list_transform(chosen, lambda v: lower(v)), lower(seed_x_2)), lower(c)))", "run", "p"))
def extend_with_unselected(spark, sf):
    base, run = fx.positives(spark, sf).withColumn("label", F.lit(1)), fx.run(spark, sf)
    out = io.extend_with_unselected(base, run, UNLABELED).groupBy().agg(F.count_if(F.col("label") == UNLABELED).alias("n_new"))
    return proposer.unselected_pairs(run, UNLABELED).agg(F.count("*").alias("n_all")).crossJoin(out)


@query(_with("SELECT run, candidates[1:3] AS picked FROM run", "run"))
def llm_answer_filter(spark, sf):
    c = F.col("candidates")
    answer = F.concat(F.lit("Sure:\n"), F.array_join(F.transform(F.slice(c, 1, 3), lambda x: F.concat(F.lit("  "), F.upper(x), F.lit("\t"))), "\n"), F.lit("\nnot a name\n"), F.lower(F.element_at(c, 1)))
    return fx.run(spark, sf).select("run", text.answer_filter(answer, "candidates").alias("picked"))


@query(_with("SELECT run, 'Target Drug:' || chr(10) || x_1 || chr(10) || chr(10) || 'Candidate Drugs:' || chr(10) || array_to_string(candidates, chr(10)) || chr(10) || chr(10) AS head FROM run", "run"))
def proposer_prompt(spark, sf):
    whole = proposer.prompt("x_1", "candidates")
    return fx.run(spark, sf).select("run", F.substring_index(whole, "Task:\n", 1).alias("head"))


# ---------------------------------------------------------------- relabel, lexicon, combine

_EVENTS = """SELECT least(x_1, x_2) AS lo, greatest(x_1, x_2) AS hi, 0 AS turn, seq, 'base' AS action, x_1, x_2, '1' AS label FROM pseq
    UNION ALL SELECT least(x_1, x_2), greatest(x_1, x_2), 1, seq, action, x_1, x_2, new_label FROM ch"""
_STATE = "SELECT *, lag(action) OVER w AS la, lag(label) OVER w AS ll, row_number() OVER (PARTITION BY lo, hi ORDER BY turn DESC, seq DESC) AS back FROM ev WINDOW w AS (PARTITION BY lo, hi ORDER BY turn, seq)"


def _relabel(spark, sf):
    base = fx.numbered(fx.positives(spark, sf)).withColumn("label", F.lit("1"))
    return relabel.relabel(base, fx.changes(spark, sf), "seq", "seq")


@query(_with("SELECT lo, hi, label FROM st WHERE back = 1 AND action <> 'remove'", "ch", ev=_EVENTS, st=_STATE))
def relabel_final(spark, sf):
    return _relabel(spark, sf)[0].select(F.least("x_1", "x_2").alias("lo"), F.greatest("x_1", "x_2").alias("hi"), "label")


@query(_with("""SELECT action, outcome, count(*) AS n FROM (SELECT action, CASE WHEN action = 'remove' THEN CASE WHEN la IS NULL OR la = 'remove' THEN 'already absent' ELSE 'removed' END
    WHEN la IS NULL OR la = 'remove' THEN 'added' WHEN ll = label THEN 'already correct' ELSE 'relabelled from ' || ll END AS outcome FROM st WHERE turn = 1) GROUP BY ALL""", "ch", ev=_EVENTS, st=_STATE))
def relabel_outcomes(spark, sf):
    return relabel.outcome_counts(_relabel(spark, sf)[1])


@query(_with("SELECT name, arg_max(t, side * 1000000 + seq) AS t_eng FROM (SELECT x_1 AS name, 1 AS side, seq, 'a' || seq AS t FROM pseq UNION ALL SELECT x_2, 2, seq, 'b' || seq FROM pseq) GROUP BY name", "pseq"))
def transcript_last_wins(spark, sf):
    rows = fx.numbered(fx.positives(spark, sf)).withColumns({"t_eng_1": F.concat(F.lit("a"), F.col("seq").cast("string")), "t_eng_2": F.concat(F.lit("b"), F.col("seq").cast("string"))})
    return scoring.latest_transcripts(rows, ("eng",), "seq")


def _parts(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return [labels.where("doc_id % 3 = 0").select("doc_id", "quality"), labels.where("doc_id % 3 = 1").select("doc_id", "toxic"), labels.where("doc_id % 3 = 2").select("doc_id", "quality", "toxic")]


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE quality END AS quality, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic END AS toxic FROM labels")
def combine_union(spark, sf):
    return io.union_all(_parts(spark, sf))


@query("SELECT CASE WHEN doc_id % 3 = 1 THEN NULL ELSE quality END AS quality, count(*) AS n FROM labels GROUP BY 1")
def class_partition_counts(spark, sf):
    return io.union_all(_parts(spark, sf)).groupBy("quality").agg(F.count("*").alias("n"))


@query(_with("SELECT sum(CASE WHEN x_1 = '' THEN 1 ELSE 0 END)::BIGINT AS empty_eng_1, CAST(0 AS BIGINT) AS empty_eng_2 FROM p", "p"))
def empty_transcription_counts(spark, sf):
    return scoring.empty_transcriptions(scoring.transcribe(fx.positives(spark, sf), ("eng",)), ("eng",)).select("empty_eng_1", "empty_eng_2")


# Length of the longest common subsequence: rows of the usual table, each folded from the one before.
_LCS = """list_reduce(list_prepend(list_prepend(0::BIGINT, list_transform(range(1, length({b}) + 1), lambda j: 0::BIGINT)), list_transform(range(1, length({a}) + 1), lambda i: [i])),
    lambda last, i: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])),
        lambda row, j: list_append(row, CASE WHEN {a}[i[1]] = {b}[j[1]] THEN last[j[1]] + 1 ELSE greatest(last[j[1] + 1], row[-1]) END)))[-1]"""
_RATIO = lambda a, b: f"(200.0::DOUBLE * {_LCS.format(a=a, b=b)} / (length({a}) + length({b})))"


@query(_SCORE(_RATIO("x_1", "x_2")))
def ratio_pairs(spark, sf):
    return _scores(spark, sf, distance.ratio_column)


# These names are single words, for which the weighted ratio is the ratio, or with unlike lengths that of the best window too.
@query(_with(f"SELECT x_1, x_2, round(CASE WHEN n >= 1.5 * m THEN greatest(r, 0.9::DOUBLE * p) ELSE r END, 9) AS score FROM r JOIN (SELECT x_1, x_2, max({_RATIO('s', 'w')}) AS p FROM w GROUP BY ALL) USING (x_1, x_2)",
    "p", "n", "u", t=_SOME,
    r=f"SELECT x_1, x_2, {_RATIO('x_1', 'x_2')} AS r, greatest(length(x_1), length(x_2)) AS n, least(length(x_1), length(x_2)) AS m, CASE WHEN length(x_1) <= length(x_2) THEN x_1 ELSE x_2 END AS s, CASE WHEN length(x_1) <= length(x_2) THEN x_2 ELSE x_1 END AS l FROM t",
    w="SELECT DISTINCT x_1, x_2, s, unnest(list_concat(list_transform(range(1, n - m + 2), lambda i: l[i:i + m - 1]), list_concat(list_transform(range(1, m), lambda i: l[1:i]), list_transform(range(1, m), lambda i: l[-i:])))) AS w FROM r"))
def wratio_pairs(spark, sf):
    return _scores(spark, sf, distance.wratio_column)


# ---------------------------------------------------------------- beyond SQL: held against Python twins in the tests


@query()
def sound_codes(spark, sf):
    return phonetics.sound_codes(fx.names(spark, sf))


@query()
def editex_bisim_visual(spark, sf):
    rows = io.union_all(list(_three(spark, sf))).distinct()
    return rows.select("x_1", "x_2", *[distance.ORTHOGRAPHIC[k]("x_1", "x_2").alias(k) for k in ("bisim", "editex", "visual_weighted")])


@query()
def aline(spark, sf):
    return scoring.sound_scores(assemble_full(spark, sf).drop("shuffle_key"))


@query()
def fil_features(spark, sf):
    return scoring.engineered(pairs.priority_union(fx.positives(spark, sf), fx.rejected(spark, sf), fx.unlabeled(spark, sf)))


@query()
def fil_adaptation(spark, sf):
    return phonetics.adaptations(fx.names(spark, sf)).select("name", "fil.*")


@query()
def proposer_candidates(spark, sf):
    seeds = fx.numbered(fx.positives(spark, sf)).withColumnRenamed("seq", "run")
    return proposer.candidates(seeds, _registry(spark, sf))


@query()
def proposer_run(spark, sf):
    seeds = fx.numbered(fx.positives(spark, sf)).withColumnRenamed("seq", "run")
    return proposer.propose(seeds, _registry(spark, sf))


def _registry(spark, sf) -> DataFrame:
    return fx.names(spark, sf).select(F.col("name").alias("drug_name")).withColumn("pos", F.xxhash64("drug_name"))


@query()
def tier1_claim(spark, sf):
    positive, members, ranks, free, codes = noise.prepared(fx.positives(spark, sf), _registry(spark, sf))
    return noise.tier_1(members, ranks, free, positive, codes, Config()).select("rank", "place", "x_1", "x_2")


@query()
def noise_full(spark, sf):
    return noise.make_noise(fx.positives(spark, sf), _registry(spark, sf))


@query()
def assemble_full(spark, sf):
    return pipeline.assemble(fx.positives(spark, sf), fx.unlabeled(spark, sf), fx.rejected(spark, sf))


@query()
def featurize_full(spark, sf):
    return pipeline.features(assemble_full(spark, sf))


@query()
def lexicon_full(spark, sf):
    names = fx.names(spark, sf)
    return scoring.lexicon_scores(pairs.vocabulary(fx.positives(spark, sf)), names, phonetics.transcriptions(names, ["eng", "fil"]))


@query()
def hard_negatives_full(spark, sf):
    return pipeline.hard_negatives(fx.positives(spark, sf), noise_full(spark, sf))
