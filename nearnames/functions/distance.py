"""Similarity of names: native columns where Spark can say it, Arrow UDFs elsewhere.

All similarities lie in [0, 1] (``ratio`` and ``wratio`` in [0, 100]); equal names
have the greatest value. Jaro-Winkler and the LCS ratio are computed for a whole
Arrow batch at a time; the others walk pairs of short strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearnames.functions.features import common_prefix_len, common_suffix_len

# ---------------------------------------------------------------- native


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _share(n: Column, a, b) -> Column:
    most = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(most == 0, 1.0).otherwise(n.cast("double") / most)


def levenshtein_similarity(a, b) -> Column:
    most = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(_col(a), _col(b)).cast("double") / most)


def levenshtein_consonant(a, b) -> Column:
    bare = lambda x: F.regexp_replace(F.lower(_col(x)), "[aeiou]", "")
    return levenshtein_similarity(bare(a), bare(b))


def prefix_similarity(a, b) -> Column:
    return _share(common_prefix_len(a, b), a, b)


def suffix_similarity(a, b) -> Column:
    return _share(common_suffix_len(a, b), a, b)


def substring_similarity(a, b) -> Column:
    """Longest common substring over the longer length: a scan of lengths, longest first."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    starts = lambda k: F.sequence(F.lit(1), F.length(a) - k + 1)
    lengths = F.sequence(F.greatest(n, F.lit(1)), F.lit(1), F.lit(-1))
    holds = lambda k: F.exists(starts(k), lambda i: F.position(F.substring(a, i, k), b) > 0)
    best = F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(F.filter(lengths, holds), F.lit(1)), F.lit(0)))
    return _share(best, a, b)


# ---------------------------------------------------------------- batches of pairs


def _codes(s: pd.Series, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest matrix of code points, lengths)."""
    s = s.fillna("").astype(str)
    n = s.str.len().to_numpy(dtype=np.int64)
    width = int(n.max()) if len(n) else 0
    out = np.full((len(s), max(width, 1)), pad, dtype=np.int32)
    flat = np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out, n


def jaro_winkler_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    """p = 0.1 on up to 4 leading characters, where Jaro is above 0.7; two empty names are equal."""
    x, n = _codes(a, -1)
    y, m = _codes(b, -2)
    rows = np.arange(len(x))
    window = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    used_x, used_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(x.shape[1]):
        free = i < n
        for j in range(y.shape[1]):
            hit = free & (np.abs(i - j) <= window) & ~used_y[:, j] & (x[:, i] == y[:, j])
            used_x[hit, i] = used_y[hit, j] = True
            free &= ~hit
            if not free.any():
                break
    common = used_x.sum(axis=1)
    # Matched characters of each side in order, side by side.
    order_x, order_y = np.argsort(~used_x, axis=1, kind="stable"), np.argsort(~used_y, axis=1, kind="stable")
    w = min(x.shape[1], y.shape[1])
    p, q = x[rows[:, None], order_x[:, :w]], y[rows[:, None], order_y[:, :w]]
    swapped = ((p != q) & (np.arange(w)[None, :] < common[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / n + common / m + (common - swapped) / common) / 3, 0.0)
    jaro[(n == 0) & (m == 0)] = 1.0
    k = min(4, w)
    prefix = np.cumprod(x[:, :k] == y[:, :k], axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


def lcs_batch(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(length of the longest common subsequence, sum of lengths)."""
    x, n = _codes(a, -1)
    y, m = _codes(b, -2)
    row = np.zeros((y.shape[1] + 1, len(x)), dtype=np.int32)
    for i in range(x.shape[1]):
        last = row[0].copy()
        for j in range(y.shape[1]):
            here = np.where(x[:, i] == y[:, j], last + 1, np.maximum(row[j + 1], row[j]))
            last, row[j + 1] = row[j + 1].copy(), here
    return row[-1], n + m


def ratio_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    same, total = lcs_batch(a, b)
    return np.where(total > 0, 200.0 * same / np.maximum(total, 1), 100.0)


# ---------------------------------------------------------------- single pairs


def _lcs(a: str, b: str) -> int:
    """Bit-parallel length of the longest common subsequence."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * _lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter with any window of the longer, cut windows at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0

    def best(s: str, t: str) -> float:
        k = len(s)
        spans = [t[i : i + k] for i in range(len(t) - k + 1)] + [t[:i] for i in range(1, k)] + [t[-i:] for i in range(1, k)]
        return max(ratio(s, w) for w in dict.fromkeys(spans))

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def _sets(a: str, b: str) -> tuple[str, str, str]:
    """Common tokens, and those of each alone; sorted and joined."""
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_ratio(a: str, b: str) -> float:
    """The greater of the ratio of sorted tokens and the token set ratio."""
    sort = ratio(_sorted(a), _sorted(b))
    both, x, y = _sets(a, b)
    if not a.split() or not b.split():
        return sort
    if both and (not x or not y):
        return 100.0
    gap = bool(both)
    n, m = len(both) + gap + len(x), len(both) + gap + len(y)
    apart = len(x) + len(y) - 2 * _lcs(x, y)
    found = [sort, 100 - 100 * apart / (n + m) if n + m else 100.0]
    if both:
        found += [100 - 100 * (gap + len(z)) / (len(both) + len(both) + gap + len(z)) for z in (x, y)]
    return max(found)


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(x, y))


def wratio(a: str, b: str) -> float:
    """Weighted ratio: whole names if their lengths are close, else partial ones at a discount; empty gives 0."""
    if not a or not b:
        return 0.0
    by = max(len(a), len(b)) / min(len(a), len(b))
    if by < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if by <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def _before(codes: np.ndarray) -> np.ndarray:
    """Each position's preceding code (the first is its own)."""
    return np.concatenate([codes[:, :1], codes[:, :-1]], axis=1)


def bisim_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Bigram similarity: an alignment of bigrams (first letters doubled), half a point per equal letter."""
    x, n = _codes(a, -1)
    y, m = _codes(b, -2)
    px, py = _before(x), _before(y)
    row = np.zeros((y.shape[1] + 1, len(x)))
    for i in range(x.shape[1]):
        last = row[0].copy()
        for j in range(y.shape[1]):
            s = last + ((px[:, i] == py[:, j]).astype(float) + (x[:, i] == y[:, j])) / 2 * ((i < n) & (j < m))
            last, row[j + 1] = row[j + 1].copy(), np.maximum(np.maximum(row[j + 1], row[j]), s)
    most = np.maximum(n, m)
    return np.where(np.minimum(n, m) > 0, row[-1] / np.maximum(most, 1), (n == m).astype(float))


def _groups_cost(groups: tuple[str, ...], within: float, apart: float) -> np.ndarray:
    """Cost of a pair of ASCII letters: 0 if equal, ``within`` if some group holds both, else ``apart``."""
    cost = np.full((128, 128), apart)
    for g in groups:
        at = [ord(c) for c in g]
        cost[np.ix_(at, at)] = within
    np.fill_diagonal(cost, 0.0)
    return cost


def _letters_cost(cost: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    ascii_ = (p >= 0) & (p < 128) & (q >= 0) & (q < 128)
    return np.where(ascii_, cost[np.where(ascii_, p, 0), np.where(ascii_, q, 0)], np.where(p == q, 0.0, cost.max()))


def _aligned_batch(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, gap_x: np.ndarray, gap_y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least cost of an alignment of each row's names; gaps are given per position."""
    rows = np.arange(len(x))
    row = np.concatenate([np.zeros((1, len(x))), np.cumsum(gap_y, axis=1).T])
    out = row[m, rows].copy()
    for i in range(x.shape[1]):
        last = row[0].copy()
        row[0] += gap_x[:, i]
        for j in range(y.shape[1]):
            here = np.minimum(np.minimum(row[j + 1] + gap_x[:, i], row[j] + gap_y[:, j]), last + _letters_cost(cost, x[:, i], y[:, j]))
            last, row[j + 1] = row[j + 1].copy(), here
        out = np.where(n == i + 1, row[m, rows], out)
    return out


# Letters that editex takes to sound alike, and letters it takes as silent.
EDITEX_GROUPS = ("aeiouy", "bp", "ckq", "dt", "lr", "mn", "gj", "fpv", "sxz", "csz")
EDITEX_SILENT = "hw"

# Letters that look alike in print or handwriting; a swap within a group costs this much.
VISUAL_GROUPS = ("ilj1t", "oc0eaq", "mn", "uvyw", "bdh6", "pqg9", "sz5", "rn", "kx", "ft")
VISUAL_COST = 0.4

_EDITEX, _VISUAL = _groups_cost(EDITEX_GROUPS, 1.0, 2.0), _groups_cost(VISUAL_GROUPS, VISUAL_COST, 1.0)


def editex_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    """1 - editex over its greatest value; a gap costs as much as a swap with the letter before, at least 1, and 1 for silent letters."""
    (x, n), (y, m) = _codes(a, -1), _codes(b, -2)
    silent = [ord(c) for c in EDITEX_SILENT]
    gap = lambda c: np.where(np.isin(c, silent), 1.0, np.maximum(1.0, _letters_cost(_EDITEX, _before(c), c)))
    most = 2 * np.maximum(n, m)
    return np.where(most > 0, np.maximum(0.0, 1 - _aligned_batch(x, n, y, m, gap(x), gap(y), _EDITEX) / np.maximum(most, 1)), 1.0)


def visual_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    (x, n), (y, m) = _codes(a, -1), _codes(b, -2)
    most = np.maximum(n, m)
    return np.where(most > 0, 1 - _aligned_batch(x, n, y, m, np.ones(x.shape), np.ones(y.shape), _VISUAL) / np.maximum(most, 1), 1.0)


def wratio_batch(a: pd.Series, b: pd.Series, least: float = 0.0) -> np.ndarray:
    """``wratio`` of pairs; NaN where it is surely under ``least``.

    For two single words of like length it is their ratio, which a batch gives at once.
    For unlike lengths no window can share more than the whole names do, which bounds
    the partial ratio; only pairs whose bound reaches ``least`` are looked at alone.
    """
    a, b = a.fillna(""), b.fillna("")
    n, m = a.str.len().to_numpy(), b.str.len().to_numpy()
    same, total = lcs_batch(a, b)
    out = np.where(total > 0, 200.0 * same / np.maximum(total, 1), 100.0)
    low, high = np.minimum(n, m), np.maximum(n, m)
    single = (low > 0) & ~(a.str.contains(r"\s", regex=True) | b.str.contains(r"\s", regex=True)).to_numpy()
    like = high < 1.5 * low
    bound = np.maximum(out, 0.9 * 200.0 * same / np.maximum(low + same, 1))
    hopeless = single & ~like & (bound < least)
    for i in np.flatnonzero(~(single & like) & ~hopeless):
        out[i] = wratio(a.iat[i], b.iat[i])
    out[hopeless] = np.nan
    return out


# Articulation of sounds on ALINE's scales. Consonants: place, manner, voiced, nasal, lateral, retroflex.
_PLACE = {"bilabial": 1.0, "labiodental": 0.95, "dental": 0.9, "alveolar": 0.85, "retroflex": 0.8, "postalveolar": 0.75, "palatal": 0.7, "velar": 0.6, "uvular": 0.5, "glottal": 0.1}
_MANNER = {"stop": 1.0, "affricate": 0.9, "fricative": 0.85, "approximant": 0.6, "high": 0.4, "mid": 0.2, "low": 0.0}
_CONSONANTS = """
p bilabial stop 0; b bilabial stop 1; t alveolar stop 0; d alveolar stop 1; k velar stop 0; g velar stop 1; ʔ glottal stop 0;
m bilabial stop 1 nasal; n alveolar stop 1 nasal; ŋ velar stop 1 nasal; ɲ palatal stop 1 nasal; f labiodental fricative 0;
v labiodental fricative 1; θ dental fricative 0; ð dental fricative 1; s alveolar fricative 0; z alveolar fricative 1;
ʃ postalveolar fricative 0; ʒ postalveolar fricative 1; h glottal fricative 0; x velar fricative 0; ʧ postalveolar affricate 0;
ʤ postalveolar affricate 1; l alveolar approximant 1 lateral; r alveolar approximant 1 retroflex; ɹ alveolar approximant 1 retroflex;
ɾ alveolar approximant 1; j palatal approximant 1; w velar approximant 1
"""
# Vowels: height, backness (front 1, central 0.5, back 0), rounded.
_VOWELS = """
i high 1 0; ɪ high 1 0; e mid 1 0; ɛ mid 1 0; æ low 1 0; a low 0.5 0; ə mid 0.5 0; ɐ low 0.5 0; ʌ mid 0 0; ɑ low 0 0; ɔ mid 0 1; o mid 0 1;
ʊ high 0 1; u high 0 1; ɜ mid 0.5 0; ɚ mid 0.5 0
"""


def _sounds() -> dict[str, tuple]:
    out = {}
    for row in _CONSONANTS.split(";"):
        s, place, manner, voiced, *marks = row.split()
        out[s] = (False, _PLACE[place], _MANNER[manner], float(voiced), float("nasal" in marks), float("lateral" in marks), float("retroflex" in marks))
    for row in _VOWELS.split(";"):
        s, height, back, rounded = row.split()
        out[s] = (True, _MANNER[height], float(back), float(rounded), 1.0)
    return out


SOUNDS = _sounds()

# ALINE's published constants and saliences.
ALINE_KONDRAK = {"skip": -10, "substitute": 35, "expand": 45, "vowel": 10, "place": 40, "manner": 50, "voice": 10, "nasal": 10, "lateral": 10, "retroflex": 10, "height": 5, "back": 5, "round": 5, "stress": 0}
#: A variant that knows stress. The learned weights are not public, so these are settings, not a claim of equal values.
ALINE_STRESS = ALINE_KONDRAK | {"stress": 10, "vowel": 5}


@lru_cache(maxsize=65536)
def _segments(ipa: str) -> tuple[tuple[str, bool], ...]:
    out, stressed = [], False
    for c in ipa:
        if c == "ˈ":
            stressed = True
        elif c in SOUNDS:
            out.append((c, stressed and SOUNDS[c][0]))
            stressed = stressed and not SOUNDS[c][0]
    return tuple(out)


def _apart(p: str, q: str, w: dict) -> float:
    x, y = SOUNDS[p], SOUNDS[q]
    if x[0] and y[0]:
        return w["height"] * abs(x[1] - y[1]) * 2.5 + w["back"] * abs(x[2] - y[2]) + w["round"] * abs(x[3] - y[3])
    if x[0] or y[0]:
        v, c = (x, y) if x[0] else (y, x)
        return w["manner"] * abs(v[1] - c[2]) + w["place"] * abs((0.7 if v[2] > 0.5 else 0.6) - c[1]) + w["voice"] * abs(1 - c[3])
    return sum(w[k] * abs(x[i] - y[i]) for i, k in ((1, "place"), (2, "manner"), (3, "voice"), (4, "nasal"), (5, "lateral"), (6, "retroflex")))


@lru_cache(maxsize=65536)
def _swap(s: tuple[str, bool], t: tuple[str, bool], stress: bool) -> float:
    """Score of one sound against one."""
    w = ALINE_STRESS if stress else ALINE_KONDRAK
    vowels = SOUNDS[s[0]][0] + SOUNDS[t[0]][0]
    return w["substitute"] - _apart(s[0], t[0], w) - w["vowel"] * vowels - w["stress"] * (s[1] != t[1])


@lru_cache(maxsize=262144)
def _spread(s: tuple[str, bool], t: tuple[str, bool], u: tuple[str, bool], stress: bool) -> float:
    """Score of one sound against two."""
    w = ALINE_STRESS if stress else ALINE_KONDRAK
    vowels = SOUNDS[s[0]][0] + max(SOUNDS[t[0]][0], SOUNDS[u[0]][0])
    return w["expand"] - _apart(s[0], t[0], w) - _apart(s[0], u[0], w) - w["vowel"] * vowels


def aline_score(a: str, b: str, stress: bool) -> float:
    """Best global alignment with skips, substitutions, and one sound against two."""
    x, y, skip = _segments(a), _segments(b), (ALINE_STRESS if stress else ALINE_KONDRAK)["skip"]
    older, old = None, [skip * j for j in range(len(y) + 1)]
    if len(x) == 0:
        return float(old[-1])
    for i, s in enumerate(x):
        row = [old[0] + skip]
        for j, t in enumerate(y):
            best = max(old[j + 1] + skip, row[j] + skip, old[j] + _swap(s, t, stress))
            if j:
                best = max(best, old[j - 1] + _spread(s, y[j - 1], t, stress))
            if older:
                best = max(best, older[j] + _spread(t, x[i - 1], s, stress))
            row.append(best)
        older, old = old, row
    return float(old[-1])


@lru_cache(maxsize=65536)
def _aline_self(a: str, stress: bool) -> float:
    return aline_score(a, a, stress)


def aline(a: str, b: str, stress: bool = False) -> float:
    """Normalised by the scores of each transcription with itself; two empty ones are equal."""
    if not _segments(a) or not _segments(b):
        return float(not _segments(a) and not _segments(b))
    whole = _aline_self(a, stress) + _aline_self(b, stress)
    return min(1.0, max(0.0, 2 * aline_score(a, b, stress) / whole))


def aline_stress(a: str, b: str) -> float:
    return aline(a, b, True)


@lru_cache(maxsize=2)
def _aline_tables(stress: bool) -> tuple[dict, np.ndarray, np.ndarray]:
    """(number of each sound with and without stress, scores of one sound against one, and against two)."""
    w = ALINE_STRESS if stress else ALINE_KONDRAK
    symbols = [(s, marked) for s in SOUNDS for marked in (False, True)]
    apart = np.array([[_apart(s, t, w) for t, _ in symbols] for s, _ in symbols])
    vowel = np.array([int(SOUNDS[s][0]) for s, _ in symbols])
    marks = np.array([m for _, m in symbols])
    swap = w["substitute"] - apart - w["vowel"] * (vowel[:, None] + vowel[None, :]) - w["stress"] * (marks[:, None] != marks[None, :])
    spread = w["expand"] - apart[:, :, None] - apart[:, None, :] - w["vowel"] * (vowel[:, None, None] + np.maximum(vowel[:, None], vowel[None, :])[None])
    return {s: i for i, s in enumerate(symbols)}, swap, spread


def _sound_numbers(names: pd.Series, number: dict) -> tuple[np.ndarray, np.ndarray]:
    rows = [[number[s] for s in _segments(x)] for x in names]
    n = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), max(1, int(n.max()) if len(n) else 0)), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, n


def _aline_scores(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, stress: bool) -> np.ndarray:
    """``aline_score`` of each row's pair, all rows at a time."""
    _, swap, spread = _aline_tables(stress)
    skip, rows = float((ALINE_STRESS if stress else ALINE_KONDRAK)["skip"]), np.arange(len(x))
    old = np.repeat(skip * np.arange(y.shape[1] + 1)[:, None], len(x), axis=1)
    older, out = None, old[m, rows].copy()
    for i in range(x.shape[1]):
        new = np.empty_like(old)
        new[0] = old[0] + skip
        for j in range(y.shape[1]):
            best = np.maximum(np.maximum(old[j + 1], new[j]) + skip, old[j] + swap[x[:, i], y[:, j]])
            if j:
                best = np.maximum(best, old[j - 1] + spread[x[:, i], y[:, j - 1], y[:, j]])
            if older is not None:
                best = np.maximum(best, older[j] + spread[y[:, j], x[:, i - 1], x[:, i]])
            new[j + 1] = best
        older, old = old, new
        out = np.where(n == i + 1, new[m, rows], out)
    return out


def aline_batch(a: pd.Series, b: pd.Series, stress: bool = False) -> np.ndarray:
    """``aline`` of pairs; a transcription's score with itself is worked out once."""
    a, b = a.fillna("").reset_index(drop=True), b.fillna("").reset_index(drop=True)
    number = _aline_tables(stress)[0]
    own = pd.Series(pd.concat([a, b]).unique())
    z, k = _sound_numbers(own, number)
    place = pd.Series(np.arange(len(own)), index=own)
    i, j = place.loc[a].to_numpy(), place.loc[b].to_numpy()
    alone = _aline_scores(z, k, z, k, stress)
    whole = alone[i] + alone[j]
    score = _aline_scores(z[i], k[i], z[j], k[j], stress)
    both = (k[i] > 0) & (k[j] > 0)
    return np.where(both, np.clip(2 * score / np.where(both, whole, 1.0), 0.0, 1.0), ((k[i] == 0) & (k[j] == 0)).astype(float))


def aline_stress_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    return aline_batch(a, b, True)


# ---------------------------------------------------------------- columns


def pair_udf(f: Callable[[str, str], float]) -> Callable[..., Column]:
    """An Arrow UDF of two strings (null: '')."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)

    return run


def batch_udf(f: Callable[[pd.Series, pd.Series], np.ndarray]) -> Callable[..., Column]:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(a, b), dtype=float)

    return run


def jaro_winkler(a, b) -> Column:
    return batch_udf(jaro_winkler_batch)(_col(a), _col(b))


def ratio_column(a, b) -> Column:
    return batch_udf(ratio_batch)(_col(a), _col(b))


def wratio_column(a, b, least: float = 0.0) -> Column:
    """``wratio``; null where it is surely under ``least``."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(wratio_batch(x, y, least), dtype=float)  # NaN arrives as null

    return run(_col(a), _col(b))


def spelling_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler of the names, or of one with as many leading words of the other as it has, whichever is greatest."""
    a, b = a.fillna("").reset_index(drop=True), b.fillna("").reset_index(drop=True)
    out = jaro_winkler_batch(a, b)
    # For two single words the leading words are the names themselves.
    single = a.str.fullmatch(r"\S+") & b.str.fullmatch(r"\S+")
    at = np.flatnonzero(~single.to_numpy())
    if len(at):
        x, y = [s.split() for s in a.iloc[at]], [s.split() for s in b.iloc[at]]
        lead = lambda of, like: pd.Series([" ".join(p[: len(q)]) for p, q in zip(of, like, strict=True)], dtype=object)
        rows = lambda s: s.iloc[at].reset_index(drop=True)
        out[at] = np.maximum(out[at], np.maximum(jaro_winkler_batch(rows(a), lead(y, x)), jaro_winkler_batch(lead(x, y), rows(b))))
    return out


def spelling_similarity(a, b) -> Column:
    """``spelling_batch`` of two columns."""
    return batch_udf(spelling_batch)(_col(a), _col(b))


def soundex_similarity(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / 4))


#: Spelling scores by stem; more can be registered.
ORTHOGRAPHIC: dict[str, Callable[..., Column]] = {
    "bisim": lambda a, b: batch_udf(bisim_batch)(_col(a), _col(b)),
    "editex": lambda a, b: batch_udf(editex_batch)(_col(a), _col(b)),
    "lcsubstring": substring_similarity,
    "lcsuf": suffix_similarity,
    "levenshtein": levenshtein_similarity,
    "levenshtein_consonant": levenshtein_consonant,
    "prefix": prefix_similarity,
    "visual_weighted": lambda a, b: batch_udf(visual_batch)(_col(a), _col(b)),
}

#: Sound scores by stem, and the languages whose transcriptions they compare.
PHONETIC: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "aline_cangu": (lambda a, b: batch_udf(aline_stress_batch)(_col(a), _col(b)), ("fil",)),
    "aline_kondrak": (lambda a, b: batch_udf(aline_batch)(_col(a), _col(b)), ("eng", "fil")),
}


def phonetic_name(stem: str, lang: str) -> str:
    """aline_<variant> over a language: ``aline_var:<variant>_g2p:<lang>``."""
    return f"aline_var:{stem.removeprefix('aline_')}_g2p:{lang}" if stem.startswith("aline_") else f"{stem}_g2p:{lang}"
