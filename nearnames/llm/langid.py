"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is bound by permuting
(rolling) the first two letters' vectors by two and one places and multiplying all
three; a text's vector is the bundle (sum) of its trigrams', and a language's
prototype the bundle of its training texts'. Prototypes and texts are centred on the
mean direction of all languages before they are compared by cosine.

Training sums trigram counts per task, so a task sends one vector per language,
however much text it has read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearnames.runtime import materialise, slices, tune, worker_state

DIM = 1024
SEED = 11
#: Symbols: 0 is all that is no letter, 1 to 26 are a to z, other letters share the rest by code point.
SYMBOLS = 64
UNKNOWN = "und"
CHUNK = 64
#: Distinct trigrams whose vectors are built at a time (6 kB each).
STEP_TRIGRAMS = 2048
#: Languages whose prototypes (8 kB each) the driver and workers may hold; with more, training raises an error.
MOST_LANGUAGES = 10_000
#: A text is recognised unless its score is below this quantile of its language's held-out texts.
QUANTILE = 0.005
#: Steps of score in which quantiles are counted.
STEP = 0.0005
#: Held-out texts that a language needs for a threshold of its own.
LEAST = 20
_TRIGRAMS = SYMBOLS**3


def symbol_table() -> np.ndarray:
    return worker_state("language", _tables)[0]


def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters' vectors as first, middle and last letter of a trigram."""
    return worker_state("language", _tables)[1]


def _tables() -> tuple:
    return _symbol_table(), _letter_vectors()


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = np.flatnonzero(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    table[letters] = 27 + (letters * 2654435761 % 2**32 >> 16) % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIM))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def bound(trigrams: np.ndarray) -> np.ndarray:
    """A row per trigram code."""
    first, middle, last = letter_vectors()
    return first[trigrams >> 12] * middle[trigrams >> 6 & 63] * last[trigrams & 63]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, text's number) of the trigram around every letter; runs of non-letters are one symbol."""
    lowered = [t.lower() for t in texts]
    a = symbol_table()[np.frombuffer("\n".join([*lowered, "", ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    text = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 1 for t in lowered), 1])
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] > 0) | (a[:-1] > 0)
    a, text = a[keep].astype(np.int32), text[keep]
    left = np.concatenate([[0], a[:-1]])
    right = np.concatenate([a[1:], [0]])
    at = np.flatnonzero(a)
    return (left[at] << 12 | a[at] << 6 | right[at]), text[at]


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIM vectors, letters in each text)."""
    code, text = trigrams(texts)
    letters = np.bincount(text, minlength=len(texts))
    there = np.flatnonzero(np.bincount(code, minlength=_TRIGRAMS))
    place = np.zeros(_TRIGRAMS, dtype=np.int64)
    place[there] = np.arange(len(there))
    out, at = np.zeros((len(texts), DIM), dtype=np.float32), place[code]
    for begin in range(0, len(there), STEP_TRIGRAMS):
        some = there[begin : begin + STEP_TRIGRAMS]
        now = (at >= begin) & (at < begin + len(some))
        counts = np.bincount(text[now] * len(some) + at[now] - begin, minlength=len(texts) * len(some)).reshape(len(texts), len(some))
        out += counts.astype(np.float32) @ bound(some).astype(np.float32)
    return out, letters


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype per language; rows with a null text or language are left out."""
    tune(docs.sparkSession)
    kept = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            every, at = batch.column(1).to_pylist(), 0
            for texts in slices(batch.column(0).to_pylist()):
                langs = np.array(every[at : at + len(texts)], dtype=object)
                at += len(texts)
                code, text = trigrams(texts)
                for lang in set(langs):
                    n = np.bincount(code[(langs == lang)[text]] if len(code) else code, minlength=_TRIGRAMS)
                    counts[lang] = counts.get(lang, 0) + n
        for lang, n in counts.items():
            total = np.zeros(DIM)
            there = np.flatnonzero(n)
            for i in range(0, len(there), 1024):
                total += n[there[i : i + 1024]] @ bound(there[i : i + 1024]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total.astype(np.int64))], ["lang", "place", "value"])

    sums = kept.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", F.col("v.value").alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their prototypes would not fit the driver")
    return {r["lang"]: np.array(r["v"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["lang"]) if any(r["v"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, with_key: bool = False) -> DataFrame:
    """doc_id, lang_pred, score: a row per row of ``docs``; with ``lang_col`` its label too, as lang; with ``with_key`` text_key, the text's xxhash64.

    ``score`` is (1 + cosine) / 2 of the best language, ties to the first in the
    alphabet. ``und`` with score 0 for null texts, texts without a letter, and where
    nothing was learned. Whole texts of any length count. Repeated rows and null ids
    give a row each; an empty table gives none; other columns are ignored, whatever their
    names.
    """
    tune(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(lang_col).cast("string").alias("lang")] if lang_col else []), *([F.xxhash64(text_col).alias("text_key")] if with_key else []))
    own = kept.columns[2:]
    kind = kept.schema["doc_id"].dataType.simpleString()
    names = [*prototypes, UNKNOWN]
    unit = np.array([p / np.linalg.norm(p) for p in prototypes.values()]).reshape(len(prototypes), DIM)
    mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(DIM)
    centred = unit - mean
    sizes = np.linalg.norm(centred, axis=1, keepdims=True)
    centred = (centred / np.where(sizes > 0, sizes, 1)).astype(np.float32)

    def run(batches):
        for batch in batches:
            texts, best, score = batch.column(1).to_pylist(), [], []
            for some in (part[i : i + CHUNK] for part in slices(texts) for i in range(0, len(part), CHUNK)):
                v, letters = bundles(some)
                if not len(centred):
                    best += [names[-1]] * len(v)
                    score += [0.0] * len(v)
                    continue
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                v -= mean.astype(np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                cos = v @ centred.T
                top = cos.argmax(axis=1)
                best += [names[k] if n else names[-1] for k, n in zip(top.tolist(), letters.tolist(), strict=True)]
                score += np.where(letters > 0, np.clip((1 + cos.max(axis=1)) / 2, 0, 1), 0.0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *own])

    return kept.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + "".join(", lang string" if c == "lang" else ", text_key long" for c in own))


def fold(id_col: str = "doc_id", folds: int = 5):
    """True for held-out rows; a null id is neither held out nor trained on."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: prototypes of the rows not held out, applied to all rows."""
    prototypes = train(docs.where(~fold(id_col)), text_col, lang_col)
    out = predict(docs, prototypes, id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, with_key: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, threshold, kept: as ``identify``, and whether a text is of the language it is nearest to.

    The best of centred cosines is hardly ever negative, so a text is held against the
    texts that were not trained on: ``threshold`` is the ``quantile`` of the scores of
    all held-out rows that bear the language and are found to be of it. Languages with
    fewer than ``LEAST`` of them take that of all languages together; without any,
    every text with a letter is kept.
    """
    found = materialise(predict(docs, train(docs.where(~fold(id_col)), text_col, lang_col), id_col, text_col, lang_col, with_key), "language")
    right = found.where(fold("doc_id") & (F.col("lang") == F.col("lang_pred")) & (F.col("score") > 0))
    steps = right.groupBy("lang", F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    own = _thresholds(steps, ["lang"], quantile).where(F.col("total") >= LEAST).select(F.col("lang").alias("__lang"), F.col("threshold").alias("own"))
    every = _thresholds(steps.groupBy("step").agg(F.sum("n").alias("n")), [], quantile).collect()
    threshold = F.coalesce("own", F.lit(every[0]["threshold"] if every else 0.0))
    judged = found.join(F.broadcast(own), F.col("lang_pred") == F.col("__lang"), "left")  # a row per language
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= threshold)
    return judged.select("doc_id", "lang_pred", "score", threshold.alias("threshold"), kept.alias("kept"), *["text_key"] * with_key)


def _thresholds(steps: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """The lower end of the step in which each quantile lies, from (step, n)."""
    upto, whole = Window.partitionBy(*by, F.lit(0)).orderBy("step"), Window.partitionBy(*by, F.lit(0))
    run = steps.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    at = F.min(F.when(F.col("upto") >= F.col("total") * quantile, F.col("step"))) * STEP
    return run.groupBy(*by).agg(F.first("total").alias("total"), at.alias("threshold")).where("threshold IS NOT NULL")
