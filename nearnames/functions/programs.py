"""Outside pronunciation programs as adapters: lists of names in, one result each out.

A program runs on the workers, once per batch of distinct names; it must be installed
there. What it says is put into the notation of the built-in rules.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Callable

from nearnames.functions import phonetics

# Spellings of sounds that programs use for those of the scorers.
ENGLISH_FIXES = {"ɡ": "g", "ᵻ": "ɪ", "̩": ""}
FILIPINO_FIXES = {"d͡ʒ": "ʤ", "t͡ʃ": "ʧ", "ɡ": "g"}
TONES = re.compile(r"[˥-˩\s]")


def _fixed(ipa: str, fixes: dict[str, str]) -> str:
    for a, b in fixes.items():
        ipa = ipa.replace(a, b)
    return ipa


def line_adapter(command: list[str], fixes: dict[str, str] = ENGLISH_FIXES) -> Callable[[list[str]], list[str]]:
    """A program that reads a name a line and prints its transcription on one line, as eSpeak does with --ipa -q."""

    def run(names: list[str]) -> list[str]:
        plain = [" ".join((x or "").split()) for x in names]
        asked = [x for x in plain if x]
        if not asked:
            return [""] * len(names)
        said = subprocess.run(command, input="\n".join(asked) + "\n", capture_output=True, text=True, encoding="utf-8", check=True).stdout.splitlines()
        if len(said) != len(asked):
            raise RuntimeError(f"{command[0]}: {len(said)} lines for {len(asked)} names")
        got = iter(said)
        return [_fixed(next(got).strip().replace("ˈ", "").replace("ˌ", ""), fixes) if x else "" for x in plain]

    return run


def nbest_adapter(command: list[str], fixes: dict[str, str] = FILIPINO_FIXES) -> Callable[[list[str]], list[str]]:
    """A program that takes --wordlist=FILE and prints word, weight and sounds, parted by tabs, best first.

    Runs of letters are decoded, each distinct one once per batch; digits and signs stay
    as they are. A run without an answer is an error.
    """

    def run(names: list[str]) -> list[str]:
        parts = [phonetics.name_chunks(x) for x in names]
        words = sorted({p for row in parts for p in row if re.fullmatch("[a-z]+", p)})
        said: dict[str, str] = {}
        if words:
            with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as f:  # for the program beside this worker
                f.write("\n".join(words) + "\n")
                f.flush()
                lines = subprocess.run([*command, f"--wordlist={f.name}", "--nbest=1"], capture_output=True, text=True, encoding="utf-8", check=True).stdout.splitlines()
            for row in (x.split("\t") for x in lines):
                if len(row) == 3 and row[2].strip():
                    said.setdefault(row[0], TONES.sub("", _fixed("".join(row[2].split()), fixes)))
        if lacking := [w for w in words if w not in said]:
            raise RuntimeError(f"{command[0]}: no transcription for {lacking[:5]}")
        return ["".join(said.get(p, p) for p in row) for row in parts]

    return run
