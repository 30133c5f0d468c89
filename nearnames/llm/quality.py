"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, order 4: every code point is a symbol of its own, so texts
of any script keep all that they say. ``classify`` can also take folded characters
(``SYMBOLS`` of them, letters without their case and other scripts in a few buckets).

1. Tasks count the 4-grams of trusted texts; shards of counts are summed.
2. One more scan lists the distinct 4-grams of all documents with their frequencies.
   Their probabilities come from the counts by joins, order by order: each n-gram meets
   its own count, its context's totals, and the probability of its suffix.
3. A last scan takes each document's 4-gram frequencies. The most frequent 4-grams, at
   most ``HOT``, meet their probabilities in the worker; the others are joined by
   shuffle. The sums are the documents' log perplexities.
4. Texts above their language's quantile of perplexity, as trusted texts outside the
   training folds have it, are rejected.

The driver sees counts of counts, and the ``HOT`` most frequent rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from nearnames.llm.frequency import frequent_from, is_frequent, with_rare
from nearnames.runtime import discard, materialise, slices, tune, worker_state

ORDER = 4
#: 4-grams whose probabilities every worker holds.
HOT = 65_536
#: Folded characters: 0 space, 1 newline, 2-27 a to z, 28 capital, 29 digit, 30-34 . , ' - :, 35-42 other letters by code point, 43-47 other marks by code point.
SYMBOLS = 48
#: Code points, the symbols of unfolded texts.
CHARACTERS = 0x110000
#: Distinct n-grams that a task holds before it sums them up.
HELD = 500_000
QUANTILE = 0.995
#: Steps of log perplexity in which quantiles are counted.
STEP = 0.001
#: Trusted held-out texts that a language needs for a threshold of its own.
LEAST = 20
FOLDS = 5
#: Trusted ids up to this many are broadcast (8 bytes each); more are joined by shuffle.
FEW_IDS = 2_000_000


def folding() -> np.ndarray:
    """The symbol of every code point."""
    return worker_state("folding", _folding)


def _folding() -> np.ndarray:
    code = np.arange(0x110000, dtype=np.int64)
    table = 43 + (code * 2654435761 % 2**32 >> 16) % 5
    letter, upper, digit, space = (np.fromiter((f(chr(c)) for c in range(0x110000)), bool, 0x110000) for f in (str.isalpha, str.isupper, str.isdigit, str.isspace))
    table[letter] = 35 + (code[letter] * 2654435761 % 2**32 >> 16) % 8
    table[upper], table[digit], table[space] = 28, 29, 0
    table[10] = 1
    table[97:123] = np.arange(2, 28)
    for i, c in enumerate(".,'-:"):
        table[ord(c)] = 30 + i
    return table.astype(np.uint8)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram codes, number of symbols of each text); a text starts after three newlines."""
    whole = np.frombuffer("".join(["\n\n\n" + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    a, n = folding()[whole].astype(np.int32), np.array([len(t) for t in texts], dtype=np.int64)
    if not len(a):
        return np.zeros(0, np.int32), n
    code = np.zeros(len(a), dtype=np.int32)
    for back in range(ORDER):
        code[back:] += a[: len(a) - back] * SYMBOLS**back
    own = np.ones(len(a), bool)
    starts = np.concatenate([[0], np.cumsum(n + 3)[:-1]]).astype(np.int64)
    for k in range(3):
        own[starts + k] = False
    return code[own], n


def _pairs(a: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(the number of each pair of neighbours, what the numbers stand for if it is not first * base + second, how many numbers there are)."""
    pair = a[:-1] * base + a[1:]
    if base**ORDER < 2**63:
        return pair, None, base**2
    found = pa.array(pair).dictionary_encode()  # so many characters that numbers of four would overflow
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(), len(found.dictionary)


def character_grams(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct 4-grams of characters, which of them each character ends, number of characters of each text).

    A 4-gram is 12 bytes, 3 for each code point. A text starts after three newlines.
    """
    whole = np.frombuffer("".join(["\n\n\n" + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = np.array([len(t) for t in texts], dtype=np.int64)
    if not n.sum():
        return pa.array([], pa.binary()), np.zeros(0, np.int64), n
    letters = np.flatnonzero(np.bincount(whole, minlength=CHARACTERS))
    number = np.zeros(CHARACTERS, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    pair, names, size = _pairs(number[whole], len(letters))
    own = np.ones(len(whole), bool)
    starts = np.concatenate([[0], np.cumsum(n + 3)[:-1]]).astype(np.int64)
    for k in range(3):
        own[starts + k] = False
    found = pa.array((pair[:-2] * size + pair[2:])[own[3:]]).dictionary_encode()
    both = found.dictionary.to_numpy()
    halves = [x if names is None else names[x] for x in (both // size, both % size)]
    four = np.stack([letters[x] for half in halves for x in (half // len(letters), half % len(letters))], axis=1)
    raw = np.ascontiguousarray(four.astype(">u4").view(np.uint8).reshape(-1, ORDER, 4)[:, :, 1:])
    offsets = np.arange(len(four) + 1, dtype=np.int32) * 3 * ORDER
    return pa.Array.from_buffers(pa.binary(), len(four), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), found.indices.to_numpy().astype(np.int64), n


def folded_grams(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``character_grams`` of folded characters: a 4-gram is its code."""
    code, n = grams(texts)
    found = pa.array(code, pa.int32()).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), n


def is_folded(table: DataFrame) -> bool:
    """Whether the n-grams of a table are of folded characters."""
    return not isinstance(table.schema["code"].dataType, BinaryType)


def _last(code: Column, n: int, folded: bool) -> Column:
    """The last ``n`` symbols of an n-gram."""
    return (code % SYMBOLS**n).cast("int") if folded else F.substring(code, -3 * n, 3 * n)


def _but_last(code: Column, n: int, folded: bool) -> Column:
    """An n-gram of ``n`` symbols without the last."""
    return (code / SYMBOLS).cast("int") if folded else F.substring(code, 1, 3 * (n - 1))


def count_grams(docs: DataFrame, text_col: str = "text", folded: bool = True) -> DataFrame:
    """(code, n) over all texts; null texts count as empty."""
    tune(docs.sparkSession)
    scan = folded_grams if folded else character_grams

    def run(batches):
        held, rows = [], 0

        def summed():
            t = pa.concat_tables(held).group_by("code", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"code": t["code"], "n": t["n_sum"]})

        for batch in batches:
            for texts in slices(batch.column(0).to_pylist()):
                code, index, _ = scan(texts)
                held.append(pa.table({"code": code, "n": np.bincount(index, minlength=len(code)).astype(np.int64)}))
                rows += len(code)
                if rows > HELD:
                    held = [summed()]
                    # A table that sums don't make much smaller goes on.
                    if len(held[0]) > HELD // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held = []
                    rows = sum(map(len, held))
        if held:
            yield from summed().to_batches(max_chunksize=50_000)

    kind = "int" if folded else "binary"
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"code {kind}, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    n = [counts.get(k, 0) for k in (1, 2, 3, 4)]
    if not all(n):
        return 0.5, 0.75, 0.9  # too little text to estimate them
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def _order(table: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(code, p) and (context, left): an order's discounted probabilities and what its contexts leave to the next lower one."""
    few = {r["c"]: r["k"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()}
    d = discounts(few)
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    each = table.withColumn("context", _but_last(F.col("code"), n, is_folded(table))).withColumn("cut", cut)
    # Whole numbers, so that the order of addition doesn't matter.
    totals = each.groupBy("context").agg(F.sum("c").alias("total"), F.sum(F.round(F.col("cut") * 1e9).cast("long")).alias("off"))
    own = each.join(totals, "context").select("code", ((F.col("c") - F.col("cut")) / F.col("total")).alias("p"))
    return own, totals.select("context", (F.col("off") / 1e9 / F.col("total")).alias("left"))


def log_probabilities(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """``seen`` (code, ...) with logp, the natural log probability of the last symbol of the 4-gram.

    ``counts`` (code, n) are those of trusted text. Joins go from the lowest order up:
    p = own + left of the context * p of the suffix.
    """
    table, tables, folded = counts.select("code", F.col("n").alias("c")), {}, is_folded(counts)
    code = F.col("code")
    for n in range(ORDER, 0, -1):
        tables[n] = table = materialise(table, "quality") if n < ORDER else table
        # A lower order counts the distinct symbols that stand before.
        table = table.groupBy(_last(code, n - 1, folded).alias("code")).agg(F.count("*").alias("c"))
    lower = None
    for n in range(1, ORDER + 1):
        own, left = _order(tables[n], n)
        wanted = seen.select(_last(code, n, folded).alias("code")).distinct() if n < ORDER else seen
        here = wanted.withColumn("context", _but_last(code, n, folded)).withColumn("suffix", _last(code, n - 1, folded))
        here = here.join(own, "code", "left").join(left, "context", "left")
        here = here.withColumn("below", F.lit(1.0 / (SYMBOLS if folded else CHARACTERS))) if lower is None else here.join(lower, "suffix")
        p = F.coalesce("p", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("below")
        if n < ORDER:
            # Each order is a plan of its own: the driver never holds that of all four.
            lower = materialise(here.select(code.alias("suffix"), p.alias("below")), "quality")
        else:
            return here.select(*seen.columns, F.log(F.greatest(p, F.lit(1e-12))).alias("logp"))


def log_perplexities(flagged: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """The columns of ``flagged`` but its text, with log_perplexity: the mean negative log probability per symbol; null for empty texts."""
    spark = flagged.sparkSession
    folded = is_folded(counts)
    scan = folded_grams if folded else character_grams
    seen = materialise(count_grams(flagged, folded=folded), "quality")  # every order reads it
    scores = materialise(log_probabilities(seen, counts), "quality")
    least = frequent_from(scores, hot)
    discard(seen)
    top = scores.where(is_frequent(least)).select("code", "logp").toArrow()
    frequent = spark.sparkContext.broadcast((top["code"].combine_chunks(), top["logp"].to_numpy()))
    gram, sql = (pa.int32(), "int") if folded else (pa.binary(), "binary")
    others = [c for c in flagged.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {k}" for c, k in flagged.drop("text").dtypes)

    def run(batches):
        hot_codes, hot_logs = frequent.value
        hot_logs = np.append(hot_logs, np.nan)
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("code", gram), ("n", pa.int64())]))
        for batch in batches:
            sums, size, rare = [], [], [pa.array([], kind)]
            for texts in slices(batch.column(batch.schema.names.index("text")).to_pylist()):
                code, index, n = scan(texts)
                at = pc.fill_null(pc.index_in(code, value_set=hot_codes), len(hot_codes)).to_numpy()
                logs = hot_logs[at][index]
                cold = np.isnan(logs)
                text = np.repeat(np.arange(len(n)), n)
                sums += np.bincount(text[~cold], weights=logs[~cold], minlength=len(n)).tolist()
                size += n.tolist()
                most = max(len(code), 1)
                pair, k = np.unique(text[cold] * most + index[cold], return_counts=True)
                ends = np.searchsorted(pair // most, np.arange(len(n) + 1)).astype(np.int32)
                each = pa.StructArray.from_arrays([code.take(pa.array(pair % most)), pa.array(k, pa.int64())], ["code", "n"])
                rare.append(pa.ListArray.from_arrays(pa.array(ends), each).cast(kind))
            ids = pa.array(range(row, row + len(size)), pa.int64())
            row += len(size)
            cols = [ids, *(batch.column(batch.schema.names.index(c)) for c in others), pa.array(sums, pa.float64()), pa.array(size, pa.int64()), pa.concat_arrays(rare)]
            yield pa.RecordBatch.from_arrays(cols, ["row", *others, "known", "size", "rare"])

    rows = materialise(flagged.mapInArrow(run, f"row long, {kinds}, known double, size long, rare array<struct<code:{sql},n:long>>"), "quality")
    out = with_rare(rows, scores.where(~is_frequent(least)), "code", "logp")
    return out.select(*others, (-(F.col("known") + F.coalesce("rest", F.lit(0.0))) / F.when(F.col("size") > 0, F.col("size"))).alias("log_perplexity"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    with_key: bool = False,
    hot: int = HOT,
    folded: bool = True,
) -> DataFrame:
    """doc_id, lang, trusted, log_perplexity, threshold, kept: a row per row of ``docs``.

    Trusted: some row of ``labels`` says quality 1, and none says quality 0 or toxic 1. Languages with fewer than ``LEAST``
    trusted texts to judge by, and null languages, take the threshold of all languages
    together; without any trusted text all texts are kept. Null and empty texts have
    no perplexity and are rejected. Texts of any length are scored whole. Repeated
    rows and null ids give a row each; an empty table gives none; other columns are
    ignored, whatever their names. ``with_key`` adds text_key, the text's xxhash64.
    With ``folded=False`` the model is over the characters themselves.
    """
    spark = docs.sparkSession
    tune(spark)
    good = (
        labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0").select("labelled")
    )
    good = materialise(good, "quality")
    few = good.count() <= FEW_IDS
    extra = ["text_key"] * with_key
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), *([F.xxhash64(text_col).alias("text_key")] if with_key else []))
    flagged = base.join(F.broadcast(good) if few else good, base.doc_id == good.labelled, "left").select("doc_id", "text", "lang", *extra, F.col("labelled").isNotNull().alias("trusted"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    counts = materialise(count_grams(flagged.where(F.col("trusted") & ~held), folded=folded), "quality")
    scored = materialise(log_perplexities(flagged, counts, hot), "quality")
    discard(counts)
    steps = scored.where(F.col("trusted") & held & F.col("log_perplexity").isNotNull()).groupBy("lang", F.floor(F.col("log_perplexity") / STEP).alias("step")).agg(F.count("*").alias("n"))
    own = _thresholds(steps.where("lang IS NOT NULL"), ["lang"], quantile).where(F.col("total") >= LEAST).select("lang", F.col("threshold").alias("own"))
    every = _thresholds(steps.groupBy("step").agg(F.sum("n").alias("n")), [], quantile).collect()
    shared = F.lit(every[0]["threshold"] if every else None).cast("double")
    threshold = F.coalesce("own", shared, F.lit(float("inf")))
    own = F.broadcast(own)  # a row per language with trusted texts
    kept = F.coalesce(F.col("log_perplexity") <= threshold, F.lit(False))
    return scored.join(own, "lang", "left").select("doc_id", "lang", "trusted", "log_perplexity", threshold.alias("threshold"), kept.alias("kept"), *extra)


def _thresholds(steps: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """Exact quantiles at the resolution of a step, from (step, n)."""
    upto = Window.partitionBy(*by, F.lit(0)).orderBy("step")
    whole = Window.partitionBy(*by, F.lit(0))
    run = steps.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    at = (F.min(F.when(F.col("upto") >= F.col("total") * quantile, F.col("step"))) + 1) * STEP
    return run.groupBy(*by).agg(F.first("total").alias("total"), at.alias("threshold")).where("threshold IS NOT NULL")
