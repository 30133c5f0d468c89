"""Proposers that ask a language model: a chat endpoint, or a program beside the worker; one request for each anchor that has candidates."""

from __future__ import annotations

import json
import os
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from nearnames.operators.proposer import TASK

SYSTEM = (
    "You judge which drug names could be mistaken for one another when they are read, heard or written. Compare main names, not strengths or "
    "dosage words, and choose from the candidates only."
)


def request(name: str, names: list[str]) -> str:
    return f"Target Drug:\n{name}\n\nCandidate Drugs:\n" + "\n".join(names) + f"\n\n{TASK}"


def process_proposer(command: list[str], system: str = SYSTEM) -> Callable[[str, list[str]], tuple[str, str]]:
    """(answer, reasoning) of a local model: a program that answers each JSON line {system, prompt} with one {content, reasoning}.

    The program is started once per Python worker and keeps its model loaded.
    """
    state: dict = {}

    def ask(name: str, names: list[str]) -> tuple[str, str]:
        worker = state.get("process")
        if worker is None or worker.poll() is not None:
            worker = state["process"] = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        worker.stdin.write(json.dumps({"system": system, "prompt": request(name, names)}) + "\n")
        worker.stdin.flush()
        line = worker.stdout.readline()
        if not line:
            raise RuntimeError(f"{command[0]} ended without an answer for {name!r}")
        said = json.loads(line)
        return said.get("content") or "", said.get("reasoning") or ""

    return ask


def chat_proposer(url: str, model: str, key_variable: str = "", system: str = SYSTEM, tries: int = 3, timeout: float = 120) -> Callable[[str, list[str]], tuple[str, str]]:
    """(answer, reasoning) by a request in the common chat format at temperature 0.

    The key is read from the environment of the worker that asks, so it is in no plan.
    """

    def ask(name: str, names: list[str]) -> tuple[str, str]:
        body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": request(name, names)}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key_variable]}"} if key_variable else {})
        for attempt in range(tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
                    said = json.load(r)["choices"][0]["message"]
                return said.get("content") or "", said.get("reasoning_content") or ""
            except (urllib.error.URLError, TimeoutError):
                if attempt == tries - 1:
                    raise
                time.sleep(2**attempt)
        raise AssertionError("unreachable")

    return ask
