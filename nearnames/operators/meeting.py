"""Loose similarity joins: a stated set of names against all others, block by block.

The similarities asked for here are so loose that no key holds all their pairs, so
every name of one side has to meet every name of the other. It does so inside a task
that holds one block of each: codes are compared as whole columns, counts of common
letters bound every ratio, and only pairs that can qualify are measured. Only
qualifying rows leave the task; no crossed row is ever built.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.functions import distance
from nearnames.runtime import tune

#: Rows of a block: of the stated side between these bounds, by its size, and of the other side.
LEAST_ROWS, MOST_ROWS = 128, 4096
#: Counts of a name's characters: a to z, space, and the rest by code.
BINS = 32


def meet(left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``compare`` gives for every pair of a block of ``left`` and a block of ``right``."""
    tune(left.sparkSession)
    n, m = left.count(), right.count()
    rows = min(MOST_ROWS, max(LEAST_ROWS, n // 64))
    p, q = max(1, -(-n // rows)), max(1, -(-m // MOST_ROWS))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Columns get names of their own, as both sides may come from one table; repeated rows part, too.
    left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))
    a = left.withColumn("__p", F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), F.lit(p)).cast("int")).withColumn("__q", numbers(q))
    b = right.withColumn("__q", F.pmod(F.xxhash64(*right.columns, F.monotonically_increasing_id()), F.lit(q)).cast("int")).withColumn("__p", numbers(p))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return compare(x.drop(columns=["__p", "__q"]).reset_index(drop=True), y.drop(columns=["__p", "__q"]).reset_index(drop=True))

    return a.groupBy("__p", "__q").cogroup(b.groupBy("__p", "__q")).applyInPandas(run, schema)


def _bags(names: pd.Series) -> np.ndarray:
    """Character counts; characters that share a count can only raise what names have in common."""
    out = np.zeros((len(names), BINS), dtype=np.uint8)
    for i, name in enumerate(names):
        codes = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        place = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 6)
        out[i] = np.minimum(np.bincount(place, minlength=BINS), 255)
    return out


def common_letters(a: pd.Series, b: pd.Series) -> np.ndarray:
    """At least the length of the longest common subsequence of each pair (rows x columns); no bound for names over 255."""
    x, y = _bags(a), _bags(b)
    out = np.zeros((len(x), len(y)), dtype=np.int32)
    step = max(1, (4 << 20) // max(1, len(y) * BINS))
    for i in range(0, len(x), step):
        out[i : i + step] = np.minimum(x[i : i + step, None, :], y[None, :, :]).sum(axis=2, dtype=np.int32)
    long_x, long_y = (s.str.len().to_numpy() > 255 for s in (a, b))
    out[long_x] = 1 << 20
    out[:, long_y] = 1 << 20
    return out


def equal_codes(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Whether codes are equal and not empty (rows x columns)."""
    both = pd.Categorical(pd.concat([a, b]).replace("", None))
    x, y = both.codes[: len(a)], both.codes[len(a) :]
    return (x[:, None] == y[None, :]) & (x >= 0)[:, None]


def _share_word(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Pairs, one of them of several words, that have a word in common."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    x, y = ([s.split() for s in names] for names in (a, b))
    where: dict[str, list[int]] = defaultdict(list)
    for j, words in enumerate(y):
        for w in set(words):
            where[w].append(j)
    for i, words in enumerate(x):
        for w in set(words) & where.keys():
            out[i, where[w]] = True
    several = lambda names: np.array([len(s) > 1 for s in names], dtype=bool)
    return out & (several(x)[:, None] | several(y)[None, :])


def may_reach_wratio(a: pd.Series, b: pd.Series, least: float) -> np.ndarray:
    """Pairs (rows x columns) whose weighted ratio can be ``least`` or more."""
    n, m = (s.str.len().to_numpy().astype(np.float64) for s in (a, b))
    common = np.minimum(common_letters(a, b), np.minimum(n[:, None], m[None, :]))
    whole = 200.0 * common / np.maximum(n[:, None] + m[None, :], 1)
    part = 0.9 * 200.0 * common / np.maximum(np.minimum(n[:, None], m[None, :]) + common, 1)
    low, high = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
    # A hair lower, as the ratios themselves are rounded.
    return (whole >= least - 1e-6) | ((high >= 1.5 * low) & (part >= least - 1e-6)) | _share_word(a, b)


def may_reach_ratio(a: pd.Series, b: pd.Series, least: float) -> np.ndarray:
    """Pairs (rows x columns) whose ratio can be over ``least``."""
    n, m = (s.str.len().to_numpy().astype(np.float64) for s in (a, b))
    common = np.minimum(common_letters(a, b), np.minimum(n[:, None], m[None, :]))
    return 200.0 * common / np.maximum(n[:, None] + m[None, :], 1) > least - 1e-6


def code_similarity(a: pd.Series, b: pd.Series) -> np.ndarray:
    """1 - edit distance / 4 of sound codes (rows x columns), 0 where one is empty; distinct codes are few, so each pair of them is measured once."""
    x, y = pd.Categorical(a), pd.Categorical(b)
    p, q = (np.array([list(c.ljust(4, "\0"))[:4] for c in s.categories]).reshape(-1, 4) for s in (x, y))
    n, m = (np.array([len(c) for c in s.categories], dtype=np.int64) for s in (x, y))
    row = np.broadcast_to(np.arange(5), (len(p), len(q), 5)).copy()
    out = row[:, np.arange(len(q)), m].copy()
    for i in range(4):
        last, row[:, :, 0] = row[:, :, 0].copy(), i + 1
        for j in range(4):
            here = np.minimum(np.minimum(row[:, :, j + 1], row[:, :, j]) + 1, last + (p[:, i][:, None] != q[:, j][None, :]))
            last, row[:, :, j + 1] = row[:, :, j + 1].copy(), here
        out = np.where(n[:, None] == i + 1, row[:, np.arange(len(q)), m], out)
    out = np.where((n > 0)[:, None] & (m > 0)[None, :], np.maximum(0.0, 1 - out / 4), 0.0)
    return out[x.codes][:, y.codes]


def similar(a: pd.DataFrame, b: pd.DataFrame, threshold: float, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, weighted ratios) of the pairs that look or sound alike; both have name, soundex and metaphone."""
    alike = equal_codes(a["soundex"], b["soundex"]) | equal_codes(a["metaphone"], b["metaphone"])
    wanted = alike | may_reach_wratio(a["name"], b["name"], threshold)
    # Names that one another qualifies are no candidates.
    x, y = a["name"], b["name"]
    i, j = np.nonzero(wanted if keep is None else wanted & keep)
    p, q = x.to_numpy()[i], y.to_numpy()[j]
    plain = np.array([not (t.startswith(s + " ") or s.startswith(t + " ")) for s, t in zip(a["key"].to_numpy()[i], b["key"].to_numpy()[j], strict=True)], dtype=bool)
    i, j, p, q = i[plain], j[plain], p[plain], q[plain]
    found = np.zeros(len(i))
    for begin in range(0, len(i), 65_536):
        part = slice(begin, begin + 65_536)
        found[part] = distance.wratio_batch(pd.Series(p[part]), pd.Series(q[part]), threshold)
    sound = alike[i, j]
    for k in np.flatnonzero(sound & np.isnan(found)):
        found[k] = distance.wratio(p[k], q[k])
    ok = sound | (found >= threshold)
    return i[ok], j[ok], found[ok]
