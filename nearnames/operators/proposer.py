"""Candidate proposal: anchors against the registry, ranked by spelling and sound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearnames.config import Config
from nearnames.functions import distance, phonetics, text
from nearnames.operators.meeting import code_similarity, may_reach_ratio, meet
from nearnames.runtime import materialise, tune

RUN = "run long, x_1 string, seed_x_2 string, candidates array<string>, x_2 array<string>, reasoning string"


def seed_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct whole pairs; an error if there are none."""
    out = pairs.select("x_1", "x_2").dropna().dropDuplicates()
    if out.isEmpty():
        raise ValueError("no seed pairs")
    return out


def candidates(seeds: DataFrame, registry: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(run, x_1, known, candidate, rank): the best ``candidate_limit`` names for each seed.

    ``seeds``: run, x_1, x_2; ``registry``: drug_name, pos. Codes are made once per name,
    and each distinct anchor meets the registry once, whatever the number of its
    runs: a run leaves out its known name only, so the anchor's best names, and one
    more for each time a name stands in the registry, hold those of all its runs.
    """
    names = registry.select(F.col("drug_name").alias("name"), "pos").where("name IS NOT NULL")
    anchors = seeds.select(F.col("x_1").alias("name")).where("name IS NOT NULL").distinct()
    codes = materialise(phonetics.sound_codes(names.select("name").union(anchors)), "codes")
    spare = names.groupBy("name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sounds = code_similarity(a["soundex"], b["soundex"]) >= cfg.soundex_threshold
        i, j = np.nonzero((sounds | may_reach_ratio(a["name"], b["name"], cfg.ratio_threshold)) & (a["name"].to_numpy()[:, None] != b["name"].to_numpy()[None, :]))
        p, q, ratio = a["name"].to_numpy()[i], b["name"].to_numpy()[j], np.zeros(len(i))
        for begin in range(0, len(i), 65_536):
            part = slice(begin, begin + 65_536)
            ratio[part] = distance.ratio_batch(pd.Series(p[part]), pd.Series(q[part]))
        ok = sounds[i, j] | (ratio > cfg.ratio_threshold)
        i, j = i[ok], j[ok]
        out = {"x_1": p[ok], "candidate": q[ok], "pos": b["pos"].to_numpy()[j], "ratio": ratio[ok], "ma": a["native_metaphone"].to_numpy()[i], "mb": b["native_metaphone"].to_numpy()[j]}
        return pd.DataFrame(out)

    with_codes = lambda d: d.join(codes.select("name", "soundex", "native_metaphone"), "name")
    schema = f"x_1 string, candidate string, pos {dict(names.dtypes)['pos']}, ratio double, ma string, mb string"
    a, b = F.col("x_1"), F.col("candidate")
    met = meet(with_codes(anchors), with_codes(names), compare, schema)
    met = met.where((F.levenshtein(a, b) >= cfg.min_edit) & ~text.is_strength_variant(a, b) & ~text.is_fragment(a, b, cfg.min_length_ratio))
    scored = met.withColumn("score", 0.5 * distance.spelling_similarity(a, b) + 0.5 * distance.jaro_winkler("ma", "mb"))
    order = [F.desc("score"), F.desc("ratio"), "pos"]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("x_1").orderBy(*order))).where(F.col("rank") <= cfg.candidate_limit + spare).drop("rank")
    each = seeds.select("run", "x_1", F.col("x_2").alias("known")).join(best, "x_1").where(F.col("candidate") != F.col("known"))
    return (
        each.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(*order))).where(F.col("rank") <= cfg.candidate_limit)
        .select("run", "x_1", "known", "candidate", "rank")
    )


# Fixed text of the request.
TASK = (
    "Task:\nSelect every candidate drug above that is genuinely likely to be confused with the target drug. There is no fixed number to return -- "
    "select as many or as few as are actually warranted, including none at all if nothing on the list is a real risk.\n\n"
    "Output:\nOne selected drug name per line, written exactly as it appears in the candidate list above. No explanations, headers, numbering, or extra text in this section.\n"
)


def prompt(name, names) -> Column:
    """The request for one target and its candidates (an array)."""
    return F.concat(F.lit("Target Drug:\n"), F.col(name), F.lit("\n\nCandidate Drugs:\n"), F.array_join(names, "\n"), F.lit("\n\n" + TASK))


def threshold_proposer(least: float = 0.9) -> Callable[[str, list[str]], tuple[str, str]]:
    """An offline stand-in for a language model: (answer lines, reasoning)."""

    def answer(name: str, names: list[str]) -> tuple[str, str]:
        scores = distance.jaro_winkler_batch(pd.Series([name] * len(names)), pd.Series(names))
        return "\n".join(n for n, s in zip(names, scores, strict=True) if s >= least), ""

    return answer


def propose(seeds: DataFrame, registry: DataFrame, model: Callable[[str, list[str]], tuple[str, str]] | None = None, cfg: Config = Config()) -> DataFrame:
    """The proposer's run: one row per seed with candidates and the model's choice among them.

    The model is called once per seed that has candidates, on the executors; it cannot
    bring in names that are not candidates.
    """
    tune(seeds.sparkSession)
    found = candidates(seeds, registry, cfg).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda c: c["candidate"]).alias("candidates"))
    rows = seeds.join(found, "run", "left").select("run", "x_1", F.col("x_2").alias("seed_x_2"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    ask = model or threshold_proposer()

    def run(batches):
        for pdf in batches:
            got = [ask(n, list(c)) if len(c) else ("", "") for n, c in zip(pdf["x_1"], pdf["candidates"], strict=True)]
            yield pdf.assign(answer=[g[0] for g in got], reasoning=[g[1] or None for g in got])

    schema = "run long, x_1 string, seed_x_2 string, candidates array<string>, answer string, reasoning string"
    answered = rows.select(F.col("run").cast("long").alias("run"), "x_1", "seed_x_2", "candidates").mapInPandas(run, schema)
    return answered.select("run", "x_1", "seed_x_2", "candidates", text.answer_filter("answer", "candidates").alias("x_2"), "reasoning")


def proposed_pairs(run: DataFrame) -> DataFrame:
    """(x_1, x_2): the seed (if any) and the chosen names of each row, exactly distinct."""
    seed = F.when(F.coalesce(F.col("seed_x_2"), F.lit("")) != "", F.array("seed_x_2")).otherwise(F.array().cast("array<string>"))
    chosen = F.coalesce(F.col("x_2"), F.array().cast("array<string>"))
    return run.select("x_1", F.explode(F.array_compact(F.concat(seed, chosen))).alias("x_2")).distinct()


def unselected_pairs(run: DataFrame, label: int) -> DataFrame:
    """(x_1, x_2, label): candidates that were neither chosen nor the seed, letter case aside."""
    taken = F.transform(F.array_compact(F.concat(F.coalesce(F.col("x_2"), F.array().cast("array<string>")), F.array("seed_x_2"))), lambda c: F.lower(c))
    rest = F.filter(F.coalesce(F.col("candidates"), F.array().cast("array<string>")), lambda c: ~F.array_contains(taken, F.lower(c)))
    return run.where(F.coalesce(F.col("x_1"), F.lit("")) != "").select("x_1", F.explode(rest).alias("x_2"), F.lit(label).alias("label"))
