"""Near duplicates of vectors and texts, and exact search: against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from test_brute import components, jaccard_links

from nearnames.llm import embedding_dedup, jaccard, queries, topk


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    base[100:160] = base[0] + 0.12 * rng.standard_normal((60, 16))  # a dense crowd
    base[160:170] = base[1]  # exact copies
    base[170:180] = 3 * base[2]  # the same direction
    return [[float(np.float32(c)) for c in v] for v in base]


def brute_links(rows):
    """{id: links} and components over (id, vector) rows, by position."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            x, y = (np.array(rows[ok[k]][1], dtype=float) for k in (a, b))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                pairs.append((ok[a], ok[b]))
    return pairs


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_links(spark, block):
    rows = list(enumerate(vectors(1)))
    df = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "vec_id long, embedding array<float>, node string, key int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    pairs = brute_links(rows)
    n = {i: sum(i in p for p in pairs) for i, _ in rows}
    comp = components(pairs, range(len(rows)))
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == comp[i]) for i, r in got.items())


def test_embedding_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [1e30, 1e25]), (10, [1e-30, 0.0]), (None, [0.0, 1.0]), (11, [1.0]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i) for i in (1, 2, 2, 3, 4, 5, 6, 11)] + [(i, 4, 7) for i in (7, 7, 8, 9, 10)] + [(None, 0, None)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_query_recall(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    assert {r["vec_id"]: r["n_links"] for r in queries.op1_embedding_dedup(spark, sf).collect()} == dict.fromkeys([i for i, _ in rows], 0)


def test_planted_pairs_among_many(spark, tmp_path):
    """Pairs of cosine 0.95 to 0.97 among 100,000 vectors, at the bits and tables of that size: at least 0.99 found, and nothing else."""
    rng = np.random.default_rng(11)
    n, planted, dim = 100_000, 2_000, 64
    x = rng.standard_normal((n, dim))
    a, u = x[:planted] / np.linalg.norm(x[:planted], axis=1, keepdims=True), rng.standard_normal((planted, dim))
    u -= (u * a).sum(axis=1, keepdims=True) * a
    cos = rng.uniform(0.9502, 0.97, planted)[:, None]
    x[planted : 2 * planted] = (cos * a + np.sqrt(1 - cos**2) * u / np.linalg.norm(u, axis=1, keepdims=True)) * rng.uniform(0.5, 2, (planted, 1))
    bits, tables = embedding_dedup.tables_for(n)
    assert bits >= 8 and tables >= 17
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "vectors.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/vectors.parquet").repartition(8)
    got = embedding_dedup.near_duplicates(df).where("n_links > 0 OR NOT kept").toPandas().set_index("vec_id")
    want = {i: i + planted for i in range(planted)} | {i + planted: i for i in range(planted)}
    assert set(got.index) <= set(want) and (got["n_links"] == 1).all()
    assert len(got) >= 0.99 * len(want)
    assert all(c == min(i, want[i]) for i, c in got["component_id"].items())


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(13)
    a, u = rng.standard_normal((2, 20_000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    signs = embedding_dedup.Signs(8, 3)
    (ka, s), (kb, t) = signs.keys_and_sketches(a.tolist()), signs.keys_and_sketches(b.tolist())
    apart = np.bitwise_count(s.view(np.uint64) ^ t.view(np.uint64)).sum(axis=1)
    assert (apart <= embedding_dedup.most_apart()).all()
    assert (ka == signs.keys(a)).all() and abs((ka == kb).mean() - (1 - np.arccos(0.95) / np.pi) ** 8) < 0.02


def test_chains_of_vectors_go_bucket_by_bucket(spark, monkeypatch):
    """Vectors along an arc, each near its neighbours only, are compared bucket by bucket, with the links of brute force."""
    angle = np.arange(0, 6.2, 0.05)
    rows = [(i, [float(np.cos(t)), float(np.sin(t)), 0.0]) for i, t in enumerate(angle)]
    seen, plain = [], embedding_dedup.units

    def units(*args):
        out = plain(*args)
        seen.append({r["whole"] for r in out.selectExpr("codes IS NULL AS whole").distinct().collect()})
        return out

    monkeypatch.setattr(embedding_dedup, "units", units)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=4).collect()}
    pairs = brute_links(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in pairs) for i, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == components(pairs, range(len(rows)))
    assert seen


def test_miss_rate_is_held_at_any_size():
    for n in (10, 10**4, 10**7, 10**10):
        bits, tables = embedding_dedup.tables_for(n)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-4 * 1.001


@pytest.mark.parametrize(("scale", "shard"), [(1, 40), (1e16, 64)])
def test_topk_brute_force(spark, scale, shard):
    rng = np.random.default_rng(4)
    data = np.round(rng.standard_normal((200, 6)) * 2) / 64 * scale  # few values, many ties
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)] + [(200, None), (201, [float("nan")] * 6), (202, []), (None, [1.0] * 6), (40, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, shard_rows=shard, k=7).collect())
    ints = [(i, [int(np.floor(np.float64(64) * c)) for c in v]) for i, v in rows if i is not None and v and all(np.isfinite(v))]
    want = []
    for q, v in ints:
        if q % 20 == 0 and q != 40:
            best = sorted(((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in ints if i != q))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert [r for r in got if r[0] != 40] == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_subtrees_and_shards_are_pruned(spark, monkeypatch):
    """In clustered vectors a query opens few nodes and visits few shards, and still gets what a full scan gives."""
    rng = np.random.default_rng(21)
    centres = rng.integers(-60, 60, (12, 8))
    points = np.repeat(centres, 200, axis=0) * 8.0 + rng.integers(-3, 4, (2400, 8))
    tree = topk.KDTree(points, leaf=50)
    asked = points[::97]
    own = np.full(len(asked), -1)
    q, name, score = tree.search(asked, own, np.arange(len(points)), 5, np.full(len(asked), topk.NEVER))
    full = asked @ points.T
    for i in range(len(asked)):
        want = sorted(((-s, j) for j, s in enumerate(full[i].tolist())))[:5]
        assert sorted(zip((-score[q == i]).tolist(), name[q == i].tolist(), strict=True))[:5] == want
    assert tree.opened.max() < len(tree.children) and tree.opened.mean() < len(tree.children) / 3
    visited, plain = [], topk.materialise

    def materialise(df, tag):
        out = plain(df, tag)
        if "shards" in out.columns:
            visited.append(sum(len(r["shards"]) for r in out.collect()))
        return out

    monkeypatch.setattr(topk, "materialise", materialise)
    df = spark.createDataFrame([(i, [float(c) for c in v / 64]) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, shard_rows=100, k=5).collect())
    want = []
    for i in range(0, 2400, 20):
        best = sorted((-int(s), j) for j, s in enumerate((points[i] @ points.T).tolist()) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert visited[0] == 120 and sum(visited) < 120 * 24 / 3


def test_topk_many_copies(spark):
    """A third of all rows are one vector: regions of many rows are dealt to several shards."""
    rng = np.random.default_rng(22)
    rows = [(i, [0.5] * 4 if i % 3 == 0 else [float(c) for c in np.round(rng.standard_normal(4), 2)]) for i in range(600)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=30, k=6).collect())
    ints = np.array([[int(np.floor(64 * c)) for c in v] for _, v in rows])
    want = []
    for i in range(0, 600, 20):
        best = sorted((-int(s), j) for j, s in enumerate(ints[i] @ ints.T) if j != i)[:6]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_topk_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 1, 8192), (0, 2, 20, -4096), (20, 1, 0, -4096), (20, 2, 1, -8192)]


def near_copies(seed):
    """Texts with edits of many sizes, copies, short ones, and a crowd of near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 20, 60, 200]))]
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        for edits in (1, 1, 2, 4):
            other = base[:]
            for _ in range(edits):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
        texts.append(" ".join(base[: len(base) * 9 // 10]))
    crowd = [word() for _ in range(120)]
    for k in range(90):
        texts.append(" ".join([*crowd, f"tail{k}"]))
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 16)])
def test_jaccard_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LIST", 8)
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, sig string")
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df).collect()}
    pairs = jaccard_links(rows)
    comp = components(pairs, [i for i, _ in rows])
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in pairs) for i, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert sorted(i for i, r in got.items() if r["kept"]) == sorted(set(comp.values()))


def test_jaccard_whole_table(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op10_ngram_jaccard(spark, sf).collect()}
    rows = [d[:2] for d in documents]
    pairs = jaccard_links(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in pairs) for i, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == components(pairs, [i for i, _ in rows])


def test_jaccard_awkward(spark, awkward, empty):
    got = jaccard.near_duplicates(awkward)
    by = {}
    for r in got.collect():
        by.setdefault(r["component_id"], []).append((r["doc_id"], r["n_links"], r["kept"]))
    assert sorted(by[1], key=str) == [(1, 2, True), (2, 2, False), (None, 2, False)]
    assert sorted(by[3]) == [(3, 1, False), (3, 1, True)]
    assert sorted(by[4]) == [(4, 1, True), (5, 1, False)]
    assert jaccard.near_duplicates(empty).count() == 0


def test_short_texts_at_the_threshold(spark):
    """Nine words and the first eight of them share 4 of 5 shingles: all such pairs are links."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(9)] for _ in range(600)]
    rows = [(2 * i + k, " ".join(t[: 9 - k])) for i, t in enumerate(texts) for k in (0, 1)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in got if r["n_links"] != 1] == []
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_prefixes_are_shortened_until_the_recall_holds():
    """Each pair of sizes has its own depth: the deepest that holds the miss rate at the least similarity such a pair can have."""
    assert jaccard.prefix_depth(0.8) == 6
    depths = {}
    for n in range(1, 40):
        for m in range(1, 40):
            can = [c / (n + m - c) for c in range(min(n, m) + 1) if c < max(n, m) and c / (n + m - c) >= 0.8]
            d = depths[n, m] = jaccard.depth_for(n, m)
            assert bool(can) == bool(d) and d == depths.get((m, n), d)
            if can:
                assert (1 - min(can) ** d) ** jaccard.TREES <= jaccard.MISS
                assert d == jaccard.DEPTH or (1 - min(can) ** (d + 1)) ** jaccard.TREES > jaccard.MISS
    assert {depths[5, 4], depths[6, 5], depths[7, 8], depths[20, 20]} == {6, 7, 8}
    listed = jaccard.levels()
    assert not listed[:4].any() and listed[5].nonzero()[0].tolist() == [6, 7] and listed[jaccard.SHORT].nonzero()[0].tolist() == [6]
    for n in range(1, 32):  # no partner of theirs has 40 shingles
        assert set(listed[n].nonzero()[0]) == {depths[n, m] for m in range(1, 40) if depths[n, m]}


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_walk_finds_company_by_sorted_prefixes(cut):
    """However the sorted strings are cut into batches, a text is listed at those of its depths where another shares its prefix."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randrange(2), tuple(rng.randrange(2) for _ in range(jaccard.DEPTH)), rng.choice([5, 6, 7, 12, 99])) for _ in range(120))
    listed = jaccard.levels()
    want = set()
    for i, (tree, text, n) in enumerate(rows):
        for d in listed[min(n, jaccard.SHORT)].nonzero()[0].tolist():
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j][0] == tree and rows[j][1][:d] == text[:d]]
            if near or i in (0, len(rows) - 1):  # a partition's ends count as having company
                want.add((tree, text[:d], d, i))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([np.array(r[1], dtype=">u2").tobytes() for r in part]), pa.array(range(k, k + len(part))), pa.array([r[2] for r in part], pa.int32())], ["tree", "string", "no", "shingles"])
        for k in range(0, len(rows), cut) for part in [rows[k : k + cut]]
    ]
    got = [r for b in jaccard.walk(iter(batches), listed) for r in b.to_pylist()]
    assert {(r["code"] // 16, rows[r["no"]][1][: r["code"] % 16], r["code"] % 16, r["no"]) for r in got} == want and len(got) == len(want)
    names = {}
    for r in got:
        assert names.setdefault((r["code"], rows[r["no"]][1][: r["code"] % 16]), r["key"]) == r["key"]
    assert len(set(names.values())) == len(names)


def test_recall_at_the_threshold_by_length(spark):
    """Planted pairs of least similarity, from 5 words on: at least 0.99 of them are found at each length."""
    rng = random.Random(12)
    rows, pairs = [], []
    for n in (4, 5, 6, 7, 8, 9, 10, 12, 16, 30, 63, 64, 100, 400):  # shingles
        least = min((c / (n + m - c), m) for m in range(1, 2 * n) for c in range(min(n, m) + 1) if c < max(n, m) and c / (n + m - c) >= 0.8 and c == min(n, m))
        for _ in range(150 if n < 100 else 40):
            text = [f"w{rng.randrange(10**9)}" for _ in range(max(n, least[1]) + 4)]
            a, b = " ".join(text[: n + 4]), " ".join(text[: least[1] + 4])
            pairs.append((n, len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for n in {p[0] for p in pairs}:
        here = [got[b] == got[a] == a for k, a, b in pairs if k == n]
        assert sum(here) >= 0.99 * len(here), n


def test_large_chains_go_prefix_by_prefix(spark, monkeypatch):
    """A long chain of near copies is compared by shared prefixes, a crowd as a whole, with the same links."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    chain = [word() for _ in range(100)]
    texts = []
    for _ in range(120):  # each text differs from the one before by a few words at one end
        texts.append(" ".join(chain))
        chain = chain[6:] + [word() for _ in range(6)]
    crowd = [word() for _ in range(80)]
    texts += [" ".join([*crowd, word()]) for _ in range(60)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LIST", 6)
    seen, plain = [], jaccard.units

    def units(*args):
        out = plain(*args)
        seen.append({r["whole"] for r in out.selectExpr("codes IS NULL AS whole").distinct().collect()})
        return out

    monkeypatch.setattr(jaccard, "units", units)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = jaccard_links(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in pairs) for i, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == components(pairs, [i for i, _ in rows])
    assert False in seen[0]
