"""Packing, token counts, SentencePiece: against the libraries on whole tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from nearnames.llm import frequency, packing, queries, token_counts, viterbi

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", " the", "The", ".", "!!", "<|endoftext|>", "<s>", "▁", "\x1c", "　", "梦", "😀", "\r\n", "ﬁ", "\xa0", "word", "\0"]


def strange(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_segment_ids_equal_library(library):
    texts = strange(3000)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.SegmentEncoder(P.path("byte_bpe_50k.json")).encode(texts)]
    assert got == ids_of(library, texts)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, "x y " + " " * 5000 + "b" * 9000 + " \n c", "word " * 25_000])
def test_long_runs_equal_library(library, text):
    got = packing.SegmentEncoder(P.path("byte_bpe_50k.json")).encode([text, "after it"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids_of(library, [text, "after it"])


def check_packing(rows, docs, library, window=2048):
    """docs: (doc_id, text). All ids once, checksums, gapless windows within bounds."""
    want = {}
    for (i, _), ids in zip(docs, ids_of(library, [t or "" for _, t in docs]), strict=True):
        want.setdefault(i, []).append([*ids, 1])
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in want[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in want.values() for x in v)
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False))
        assert p[-1][0] + p[-1][1] <= window
    return len(places), sum(r["length"] for r in rows)


def test_packing_whole_table(spark, sf, documents, library):
    rows = queries.op2_packing(spark, sf).collect()
    n, total = check_packing(rows, [d[:2] for d in documents], library)
    assert n * 2048 / total < 1.01  # the last windows alone have room
    starts = {}
    for r in rows:
        starts.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for s in starts.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(s, s[1:], strict=False)) and sum(s[-1][:2]) == s[-1][2]


def test_packing_awkward(spark, awkward, empty, library):
    rows = packing.pack(awkward, window=16, with_ids=True).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()], library, 16)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_best(seed):
    rng = random.Random(seed)
    window, counts = 30, {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
    used = packing.fill(counts, window)
    seed_length = max(counts)
    sums = {seed_length}
    for length, n in counts.items():
        for _ in range(n - (length == seed_length)):
            sums |= {s + length for s in sums if s + length <= window}
    assert sum(k * n for k, n in used.items()) == max(sums)
    assert used[seed_length] >= 1 and all(n <= counts[k] for k, n in used.items())


def test_plan_places_everything():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 500) for n in range(1, 2049, 7)}
    got = {}
    for used, times in packing.plan(counts, 2048):
        assert sum(k * n for k, n in used.items()) <= 2048
        for k, n in used.items():
            got[k] = got.get(k, 0) + n * times
    assert got == counts
    # Only lengths of one residue: few combinations fit. Cutting apart, no packing can be under either bound.
    least = max(-(-sum(k * n for k, n in counts.items()) // 2048), sum(n for k, n in counts.items() if k > 1024))
    assert sum(t for _, t in packing.plan(counts, 2048)) <= least * 1.01


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_token_counts_equal_library(spark, sf, documents, pieces):
    got = {r["doc_id"]: r for r in queries.op4_token_counts(spark, sf).collect()}
    for i, text, _, _ in documents:
        n = len(pieces.encode(text or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 4096)


@pytest.mark.parametrize("hot", [0, 40, 10**6])
def test_token_counts_strange(spark, pieces, hot, monkeypatch):
    """However few pre-tokens the workers hold, the others come through the join."""
    monkeypatch.setattr(token_counts, "MEMO", 100)
    texts = strange(2000, 2) + ["a" * 30_000 + " b", " " * 20_000, "word " * 25_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) for x in pieces.encode(texts)]


def test_each_pre_token_is_counted_once(spark, documents):
    df = spark.createDataFrame([(d[1] or "",) for d in documents[:200]], "text string").repartition(3)
    rows = token_counts._vocabulary(df, P.path("piece_bpe_32k.model")).collect()
    want = Counter(w for d in documents[:200] for w in token_counts.pre_tokens(d[1] or ""))
    assert {r["word"]: r["n"] for r in rows} == want and len(rows) == len(want)
    for most in (0, 10, 300, 10**6):
        least = frequency.frequent_from(spark.createDataFrame(list(want.items()), "word string, n long"), most)
        assert sum(math.floor(math.log2(n) * frequency.STEPS + 1e-9) >= least for n in want.values()) <= most


def test_token_counts_awkward(spark, awkward, empty, pieces):
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(awkward).collect()]
    want = [(r["doc_id"], len(pieces.encode(r["text"] or ""))) for r in awkward.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty).count() == 0


def plain_viterbi(text, pieces):
    """Best score by dynamic programming over a whole text, without cuts, automaton or memo."""
    normal = {p: s for p, s, kind in pieces if kind == "normal"}
    unknown, longest = min(normal.values()) - 10, max(map(len, normal))
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            if s[b:e] in normal:
                best[e] = max(best[e], best[b] + normal[s[b:e]])
        if s[e - 1] not in normal:
            best[e] = max(best[e], best[e - 1] + unknown)
    return best[-1]


def test_viterbi_best_and_round_trip():
    pieces = viterbi.pieces_of(P.path("piece_bpe_32k.model"))
    v = viterbi.Viterbi(pieces)
    scores = {i: s for i, (_, s, kind) in enumerate(pieces) if kind == "normal"}
    for text in strange(400, 3):
        raw, score = v.encode(text)
        ids = np.frombuffer(raw, "<u4").tolist()
        assert score == pytest.approx(plain_viterbi(text.replace("▁", " "), pieces))
        assert v.decode(ids) == text.replace("▁", " ")
        if all(i in scores for i in ids):
            assert sum(scores[i] for i in ids) == pytest.approx(score)


def fields(raw):
    """(number, wire type, value, whole field) of a protocol buffer message."""

    def varint(at):
        x = shift = 0
        while True:
            x |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return x, at

    at = 0
    while at < len(raw):
        begin = at
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + n], at + n
        yield tag >> 3, tag & 7, value, raw[begin:at]


def message(number, body):
    size, out = len(body), b""
    while size > 127:
        size, out = size >> 7, out + bytes([size & 127 | 128])
    return bytes([number << 3 | 2]) + out + bytes([size]) + body


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The pieces of the public model as a unigram model with scores of their own; nothing is trained.

    Field 1 of a model holds its pieces (1 text, 2 score, 3 kind), field 2 the trainer's settings (3: model type, 1 unigram).
    """
    import struct

    rng, out = random.Random(9), b""
    for number, _, value, whole in fields(open(P.path("piece_bpe_32k.model"), "rb").read()):
        if number == 1:
            inner = {n: v for n, _, v, _ in fields(value)}
            if inner.get(3, 1) == 1:
                score = struct.pack("<f", -12 + 0.8 * len(inner[1].decode()) + rng.random())
                value = b"".join(bytes([0x15]) + score if n == 2 else w for n, _, _, w in fields(value))
            whole = message(1, value)
        elif number == 2:
            whole = message(2, b"".join(w for n, _, _, w in fields(value) if n != 3) + bytes([0x18, 1]))
        out += whole
    path = tmp_path_factory.mktemp("unigram") / "unigram.model"
    path.write_bytes(out)
    return str(path)


def test_viterbi_equals_library_on_a_unigram_model(spark, sf, documents, unigram):
    """Whole documents and odd strings have the library's ids where the library takes the best path too.

    The library adds scores in single precision, so paths may differ where two are as good as each other.
    """
    import sentencepiece

    library, pieces = sentencepiece.SentencePieceProcessor(model_file=unigram), viterbi.pieces_of(unigram)
    got = {r["doc_id"]: list(r["ids"]) for r in viterbi.encode(spark.read.parquet(f"{sf}/documents.parquet"), model=unigram).collect()}
    v, equal = viterbi.Viterbi(pieces), 0
    both = [(got[d[0]], d[1]) for d in documents] + [(np.frombuffer(v.encode(t)[0], "<u4").tolist(), t) for t in strange(600, 4)]
    for ids, text in both:
        want = library.encode(text)
        equal += ids == want
        mine, theirs = (sum(pieces[i][1] for i in x) for x in (ids, want))
        assert mine >= theirs - 1e-6 and mine - theirs <= 1e-6 * abs(theirs) + 1e-9
        assert v.decode(ids) == library.decode(want)
    assert equal >= 0.98 * len(both)


def test_viterbi_long_texts(pieces):
    v = viterbi.Viterbi(viterbi.pieces_of(P.path("piece_bpe_32k.model")))
    for text in ("word " * 25_000, "a" * 50_000, " " * 50_000, "\n" * 50_000, "x " + "b" * 9000 + "  c"):
        raw, _ = v.encode(text)
        assert v.decode(np.frombuffer(raw, "<u4").tolist()) == text


def test_viterbi_small_model_ties_take_the_longest_last_piece():
    v = viterbi.Viterbi([("<unk>", 0.0, "other"), ("▁", -1.0, "normal"), ("a", -2.0, "normal"), ("b", -2.0, "normal"), ("▁a", -3.0, "normal"), ("ab", -4.0, "normal")])
    assert v.path("▁ab") == ([1, 5], -5.0)
    assert v.path("▁x")[0] == [1, 0]


def test_viterbi_query(spark, sf, documents, awkward, empty):
    got = {r["doc_id"]: r for r in queries.op6_sentencepiece(spark, sf).collect()}
    v = viterbi.Viterbi(viterbi.pieces_of(P.path("piece_bpe_32k.model")))
    for i, text, _, _ in documents:
        ids, score = (v.path("▁" + text.replace(" ", "▁")) if text else ([], 0.0)) if len(text or "") < 3000 else (None, None)
        assert got[i]["round_trip"] == ("▁" not in text) and got[i]["decoded_crc32"] == zlib.crc32(text.replace("▁", " ").encode())
        if ids is not None:
            assert (got[i]["n_pieces"], got[i]["ids_crc32"], got[i]["score"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), score)
    encoded = viterbi.encode(awkward)
    texts = sorted(((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in awkward.collect()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in viterbi.decode(encoded).collect()), key=str) == texts
    assert viterbi.encode(empty).count() == 0
