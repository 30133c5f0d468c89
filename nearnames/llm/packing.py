"""Packing of token streams into fixed windows by minimum bin slack.

Every document becomes its ids plus one end id. Full windows are cut off first;
what remains, and every short document, is an item of 1 to ``window`` ids. A
bitset subset-sum dynamic programme over the histogram of item lengths picks, for
the longest remaining length, the multiset that comes closest to the window;
backtracking gives its counts, and the pattern is used as often as those counts
allow. Items are then dealt to (pattern, copy, place) by their rank within their
length, which is arithmetic, so no sequence is ever gathered anywhere.

What the driver sees is one count per length: at most ``window`` rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearnames.runtime import materialise, slices, tune, worker_state

WINDOW = 2048
#: Segments whose ids a worker keeps; the memo is emptied when full. Longer segments are not kept.
MEMO, MEMO_CHARS = 150_000, 64
#: Longer segments go to the library: a long run of white space is more than the merger's pattern matcher can take.
LONG = 4096
_NEXT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
#: Left to the library: characters on which Unicode tables may differ, and special strings.
_HARD = re.compile("[^\\x00-\u024f]|<\\|")


class SegmentEncoder:
    """Ids of whole texts by a byte-level BPE, one call per distinct segment.

    The pre-tokenizer's pattern always starts a new pre-token at a space that a
    non-space follows, so a text may be cut there: its ids are its segments' ids.
    Where the vocabulary's ids are in merge order, segments of Latin letters go
    through a rank-based merger built from the same file, which gives the same ids
    in a third of the time; all others go through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._ranked(json.loads(Path(path).read_text(encoding="utf-8")))
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        if not plain or len(vocab) != 256 + len(merges) or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _raw(self, segments: list[str]) -> list[bytes]:
        found = [b""] * len(segments)
        hard = [i for i, s in enumerate(segments) if self.fast is None or len(s) > LONG or _HARD.search(s)]
        for i in set(range(len(segments))).difference(hard):
            found[i] = array("I", self.fast.encode_ordinary(segments[i])).tobytes()
        for i, x in zip(hard, self.tokenizer.encode_batch_fast([segments[i] for i in hard], add_special_tokens=False), strict=True):
            found[i] = array("I", x.ids).tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [ids for part in slices(texts) for ids in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, cut = self.memo, [(_NEXT.split(t) if _ODD.search(t) else t.split(" ")) for t in texts]
        heads = self._raw([x[0] for x in cut])
        miss = list({w for x in cut for w in x[1:] if w not in memo})
        new = dict(zip(miss, self._raw([" " + w for w in miss]), strict=True))
        memo.update((w, ids) for w, ids in new.items() if len(w) <= MEMO_CHARS)
        long = {w: ids for w, ids in new.items() if len(w) > MEMO_CHARS}
        get = memo.__getitem__ if not long else lambda w: long[w] if w in long else memo[w]
        return [h + b"".join(map(get, x[1:])) for h, x in zip(heads, cut, strict=True)]


def encoder(path: str) -> SegmentEncoder:
    return worker_state(("segments", path), lambda: SegmentEncoder(path))


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset, with the longest length at least once, of the least slack."""
    seed = max(counts)
    used, room, reach, steps = Counter({seed: 1}), window - seed, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == seed), room // length), 1
        while left > 0 and not reach >> room & 1:
            t = min(k, left)
            steps.append((length, t, reach))
            reach |= reach << (length * t) & mask
            left, k = left - t, k * 2
        if reach >> room & 1:
            break
    s = reach.bit_length() - 1
    for length, t, before in reversed(steps):
        if not before >> s & 1:
            used[length] += t
            s -= length * t
    return dict(used)


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) until every item has its place."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        used = fill(counts, window)
        times = min(counts[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece, with its writer's partition as ``salt`` and its rank of its length there."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt int, rank long" + ", ids array<int>" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        enc, seen, salt = encoder(path), np.zeros(window + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows, start, length, crc, total, rank, ids = [], [], [], [], [], [], []
            for i, x in enumerate(enc.encode(batch.column(1).to_pylist())):
                x += end
                n = len(x) // 4
                for s in range(0, n, window):
                    part = x[4 * s : 4 * (s + window)]
                    m = len(part) // 4
                    rows.append(i), start.append(s), length.append(m), total.append(n), crc.append(zlib.crc32(part))
                    rank.append(seen[m])
                    seen[m] += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            long = lambda v: pa.array(v, pa.int64())
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), *map(long, (start, length, crc, total)), pa.array([salt] * len(rows), pa.int32()), long(rank)]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "rank", "ids"]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    return kept.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents: a row per piece with its sequence and offset.

    Null and empty texts hold the end id alone. Repeated rows and repeated or null
    ids are packed like any other row. An empty table gives no rows. Other columns
    of ``docs`` are ignored. ``with_ids`` adds the piece's ids.
    """
    tune(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    table = materialise(pieces(docs, id_col, text_col, path, window, end_id, with_ids), "pack")
    each = table.groupBy("salt", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # For each length its runs of ranks: from rank lo on, u items a sequence, first sequence, offset there.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    at, sequence = Counter(), 0
    for used, times in plan(counts, window):
        offset = 0
        for length in sorted(used, reverse=True):
            runs.setdefault(length, []).append((at[length], used[length], sequence, offset))
            at[length] += used[length] * times
            offset += length * used[length]
        sequence += times
    arrays = {k: np.array(v, dtype=np.int64) for k, v in runs.items()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("salt", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = table.join(base, ["salt", "length"]).select(*names, (F.col("rank") + F.col("base")).alias("rank"))
    kind = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in names) + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                m = int(length[rows[0]])
                run = arrays[m]
                lo, use, first, offset = run[np.searchsorted(run[:, 0], rank[rows], side="right") - 1].T
                copy, place = np.divmod(rank[rows] - lo, use)
                seq[rows], off[rows] = first + copy, offset + place * m
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
