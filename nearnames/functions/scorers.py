"""Scorers described by TOML files: a stem per file, an algorithm, and whether it reports its parts.

    algorithm = "levenshtein"
    separate = true

``aline`` compares transcriptions, over all languages unless ``langs`` names some; every
other algorithm compares spellings. A scorer with ``separate`` has three columns
instead of one: substitutions, insertions and deletions together, and by how much those
two differ.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearnames.functions import distance

# Endings of a separate scorer's columns.
PARTS = ("_substitutions", "_indels", "_indel_diff")
BY_SOUND = ("aline",)


@dataclass(frozen=True)
class Scorer:
    stem: str
    algorithm: str
    separate: bool = False
    stress: bool = False
    langs: tuple[str, ...] = ()

    @property
    def by_sound(self) -> bool:
        return self.algorithm in BY_SOUND

    def columns(self, langs: Iterable[str] = ()) -> list[tuple[str, str | None]]:
        """(column, language) in output order; the language is None for spellings."""
        stems = [self.stem + p for p in PARTS] if self.separate else [self.stem]
        if not self.by_sound:
            return [(s, None) for s in stems]
        return [(distance.phonetic_name(s, x), x) for s in stems for x in langs if not self.langs or x in self.langs]


def load(folder: str | Path) -> list[Scorer]:
    """Spelling scorers first, then those by sound, each by stem; an error if there are none."""
    found = []
    for p in sorted(Path(folder).glob("*.toml")):
        spec = tomllib.loads(p.read_text())
        found.append(Scorer(p.stem, str(spec.get("algorithm", "")).lower(), bool(spec.get("separate", False)), bool(spec.get("stress", False)), tuple(spec.get("langs", ()))))
    if not found:
        raise FileNotFoundError(f"no scorers (*.toml) in {folder}")
    return sorted(found, key=lambda s: (s.by_sound, s.stem))


def edit_parts(a: str, b: str) -> tuple[int, int, int]:
    """(substitutions, insertions, deletions) of a least edit script; substitutions are preferred."""
    row = [(j, 0, j, 0) for j in range(len(b) + 1)]  # (cost, substitutions, insertions, deletions)
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], (i, 0, 0, i)
        for j, d in enumerate(b, 1):
            swap = (last[0] + (c != d), last[1] + (c != d), *last[2:])
            up, left = row[j], row[j - 1]
            best = min((swap[0], 0, swap), (up[0] + 1, 1, (up[0] + 1, up[1], up[2], up[3] + 1)), (left[0] + 1, 2, (left[0] + 1, left[1], left[2] + 1, left[3])))[2]
            last, row[j] = row[j], best
    return row[-1][1:]


def _parts(a: Column, b: Column) -> list[Column]:
    @F.pandas_udf("substitutions double, indels double, indel_diff double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = [edit_parts(p, q) for p, q in zip(x.fillna(""), y.fillna(""), strict=True)]
        return pd.DataFrame([(s, i + d, abs(i - d)) for s, i, d in got], columns=["substitutions", "indels", "indel_diff"], dtype=float)

    parts = run(a, b)
    return [parts[k] for k in ("substitutions", "indels", "indel_diff")]


def score(pairs: DataFrame, scorers: list[Scorer], langs: Iterable[str] = ()) -> DataFrame:
    """Append the scorers' columns; those by sound read t_<lang>_1 and t_<lang>_2."""
    langs, out = list(langs), {}
    for s in scorers:
        names = s.columns(langs)
        for x in dict.fromkeys(lang for _, lang in names):
            a, b = (F.coalesce(F.col(f"t_{x}_{k}" if x else f"x_{k}"), F.lit("")) for k in "12")
            mine = [c for c, lang in names if lang == x]
            if s.separate:
                out |= dict(zip(mine, _parts(a, b), strict=True))
            elif s.by_sound:
                out[mine[0]] = distance.PHONETIC["aline_cangu" if s.stress else "aline_kondrak"][0](a, b)
            else:
                out[mine[0]] = distance.ORTHOGRAPHIC[s.algorithm or s.stem](a, b)
    return pairs.drop(*out).select("*", *[c.alias(k) for k, c in out.items()])
