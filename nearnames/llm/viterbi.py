"""SentencePiece encoding by one Viterbi pass over an Aho-Corasick automaton, and decoding.

The automaton holds all normal pieces. One scan of a string reports, at each
position, every piece that ends there (following output links from the longest
match down), and each report relaxes the best score of the position. Ties keep
the longest last piece. A character that is no piece by itself may also be taken
as unknown at the least score minus 10; it is written as its UTF-8 byte pieces.

Texts are cut before runs of spaces and between characters that no piece has side
by side; no piece crosses such a cut, so the best paths of the parts make up the
best path of the whole. Each worker keeps the ids of distinct parts.

The path is the best one by the model file's scores. For a unigram model that is the
library's own encoding. ``piece_bpe_32k.model``, the default, is a BPE model, whose
scores are ranks of merges: the library merges greedily by rank, so its ids differ from
the best path's, and it needs fewer pieces. ``token_counts`` counts the library's pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.llm.token_counts import pre_tokens
from nearnames.runtime import tune, worker_state

#: Words and parts that a worker keeps; the memo is emptied when full. Longer ones are not kept.
MEMO, MEMO_CHARS = 500_000, 64
MARK = "▁"


def pieces_of(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte or other."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
    return [(m.id_to_piece(i), m.get_score(i), kinds(i)) for i in range(m.get_piece_size())]


class Viterbi:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        for i, p, s in normal:
            self.auto.add_word(p, (i, s, len(p)))
        self.auto.make_automaton()
        self.single = {p for _, p, _ in normal if len(p) == 1}
        self.beside = {p[k : k + 2] for _, p, _ in normal for k in range(len(p) - 1)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for _, p, _ in normal):
            raise ValueError("a piece crosses the start of a run of spaces: texts can't be cut there")
        self.unknown = min((s for _, _, s in normal), default=0.0) - 10
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unk_id = next((i for i, (p, _, kind) in enumerate(pieces) if kind == "other"), 0)
        self.out = [bytes([int(p[3:5], 16)]) if kind == "byte" else b" \xe2\x81\x87 " if kind == "other" else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.words: dict[str, tuple[bytes, float]] = {}
        self.parts: dict[str, tuple[bytes, float]] = {}

    def _unknown_ids(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unk_id]

    def path(self, s: str) -> tuple[list[int], float]:
        """Best ids of a string (spaces written as marks) and their score."""
        n = len(s)
        best, back, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(s):  # every position is reached by pieces
            for end, (i, score, length) in self.auto.iter(s):
                start = end + 1 - length
                if (x := best[start] + score) > best[end + 1]:
                    best[end + 1], back[end + 1], ids[end + 1] = x, start, i
        else:
            done = 0
            for end, (i, score, length) in self.auto.iter(s):
                done = self._settle(s, best, back, ids, done, end)
                start = end + 1 - length
                if (x := best[start] + score) > best[end + 1]:
                    best[end + 1], back[end + 1], ids[end + 1] = x, start, i
            self._settle(s, best, back, ids, done, n)
        out, p = [], n
        while p:
            out.append(ids[p : p + 1] if ids[p] >= 0 else self._unknown_ids(s[back[p] : p]))
            p = back[p]
        return [i for x in reversed(out) for i in x], best[n]

    def _settle(self, s: str, best: list, back: list, ids: list, done: int, upto: int) -> int:
        """Let positions done + 1 to upto also be reached by an unknown character."""
        for p in range(done + 1, upto + 1):
            if s[p - 1] not in self.single and best[p - 1] + self.unknown > best[p]:
                best[p], back[p], ids[p] = best[p - 1] + self.unknown, p - 1, -1
        return max(done, upto)

    def _part(self, s: str) -> tuple[bytes, float]:
        found = self.parts.get(s)
        if found is None:
            ids, score = self.path(s)
            found = array("I", ids).tobytes(), score
            if len(s) <= MEMO_CHARS:
                self.parts[s] = found
        return found

    def word(self, w: str) -> tuple[bytes, float]:
        """Ids of a pre-token, through its parts."""
        s, last, got = MARK + w.replace(" ", MARK), 0, []
        for k, pair in enumerate(map(str.__add__, s, s[1:]), 1):
            if pair not in self.beside:
                got.append(self._part(s[last:k]))
                last = k
        got.append(self._part(s[last:]))
        return got[0] if len(got) == 1 else (b"".join([x for x, _ in got]), sum([x for _, x in got]))

    def encode(self, text: str) -> tuple[bytes, float]:
        """Little-endian unsigned 32-bit ids of a whole text, and its score."""
        got = []
        for w in pre_tokens(text):
            found = self.words.get(w)
            if found is None:
                found = self.word(w)
                if len(w) <= MEMO_CHARS:
                    self._keep(w, found)
            got.append(found)
        return b"".join([x for x, _ in got]), float(sum([x for _, x in got]))

    def _keep(self, w: str, found: tuple[bytes, float]) -> None:
        for memo in (self.words, self.parts):
            if len(memo) > MEMO:
                memo.clear()
        self.words[w] = found

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts first is taken off."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def viterbi(path: str) -> Viterbi:
    return worker_state(("viterbi", path), lambda: Viterbi(pieces_of(path)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, score, ids_crc32, decoded_crc32, round_trip and, if asked, ids: a row per row.

    ``score`` is the best path's. ``round_trip``: decoding gives the text back (not so
    for a text that itself holds the space mark). Null and empty texts have no
    pieces and score 0. Texts of any length are encoded whole. Repeated rows and
    null ids give a row each; an empty table gives none; other columns are ignored.
    """
    tune(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, score double, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches):
        v = viterbi(path)
        for batch in batches:
            n, score, crc, back, same, ids = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw, s = v.encode(text)
                got = np.frombuffer(raw, "<u4")
                decoded = v.decode(got.tolist())
                n.append(len(got)), score.append(s), crc.append(zlib.crc32(raw)), back.append(zlib.crc32(decoded.encode())), same.append(decoded == text)
                if with_ids:
                    ids.append(got.astype(np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "score", "ids_crc32", "decoded_crc32", "round_trip", "ids"][: len(cols)])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text: the texts of id arrays (null ids: an empty text)."""
    tune(encoded.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kept = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = viterbi(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(run, f"doc_id {kind}, text string")
