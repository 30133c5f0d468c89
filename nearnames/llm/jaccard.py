"""Near-duplicate texts: Jaccard join on word n-grams through a MinHash LSH forest.

1. One scan turns each text into its set of 5-word shingles, a digest of that set (the
   text's class: equal sets are one node from here on) and a MinHash signature.
2. The signature is cut into ``TREES`` strings of ``DEPTH`` values. Each tree's strings
   are sorted over the whole table; a string's longest common prefixes with its two
   neighbours tell how deep in the tree's trie it has company.
3. Prefixes are matched at full depth first and shortened value by value until the
   target recall holds. Sets of sizes n and m can only have certain similarities, so
   how far that is depends on the pair: ``depth_for(n, m)`` is the deepest prefix at
   which two sets of these sizes, at the least similarity they can have above the
   threshold, share no tree with a chance of at most ``MISS``. A text is listed under its
   prefixes of the depths that its size asks for (``levels``), where it has company.
4. Texts listed under one prefix are candidates. Signatures and sizes estimate each pair
   (sizes alone where a set is small); a spanning forest of the pairs that may reach
   the threshold goes on, not the pairs.
5. Components of those are compared exactly in blocks of bounded size: an intersection
   count is a product of 0/1 matrices. A component of more than a block is compared
   either as a whole or prefix by prefix (a pair then counts under its first shared
   prefix), whichever moves fewer sets. Link counts are summed, and a spanning forest
   of the true links gives the groups.

Nothing is written per pair, and no task holds more than two blocks of a group.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.llm.blocks import forest, in_blocks, runs, units
from nearnames.operators.graph import connected_components
from nearnames.runtime import SLICE_CHARS, discard, materialise, slices, tune, worker_state

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
#: Greatest chance that a pair matches in no tree.
MISS = 1e-4
BINS = TREES * DEPTH
#: Pairs whose estimate is this many standard deviations below the threshold still go on to the exact comparison.
SIGMAS = 5
#: Texts of fewer shingles fill too few bins for that estimate: any pair with one of them goes on that its sizes allow.
SHORT = 64
#: Nodes of a block and set entries of a block, and nodes of a group that is handled as a list.
BLOCK, BLOCK_ENTRIES, LIST = 512, 2_000_000, 64
#: What a unit of small groups gathers on average: set entries (8 bytes each) in the exact comparison, rows in the estimate.
ENTRIES, UNIT_ROWS = 200_000, 2_000
#: Ids up to this many are broadcast (8 bytes each); more are joined by shuffle.
FEW_IDS = 2_000_000
MEMO = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(5).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_PROBES = np.random.default_rng(6).integers(0, BINS, size=(64, BINS))
#: Each bin's own order of all bins, for those that no probe fills.
_ORDER = np.random.default_rng(7).random((BINS, BINS)).argsort(axis=1).argsort(axis=1).astype(np.uint16)


def prefix_depth(similarity: float, miss: float = MISS) -> int:
    """The longest prefix that holds the miss rate for pairs of this similarity."""
    for depth in range(DEPTH, 1, -1):
        if (1 - similarity**depth) ** TREES <= miss:
            return depth
    return 1


def depth_for(n: int, m: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How deep two different sets of these sizes must be matched; 0 if they can't reach the threshold."""
    for common in range(min(n, m) - (n == m) + 1):
        if common / (n + m - common) >= threshold:
            return prefix_depth(common / (n + m - common), miss)
    return 0


@functools.lru_cache(maxsize=8)
def pair_depths(threshold: float, miss: float) -> np.ndarray:
    """``depth_for`` of all sizes up to ``SHORT``; the last row and column are for SHORT and more.

    From there on, sizes leave similarities so close to the threshold that its own depth holds for all.
    """
    plain = prefix_depth(threshold, miss)
    out = np.full((SHORT + 1, SHORT + 1), plain, dtype=np.int64)
    out[:SHORT, :SHORT] = [[depth_for(n, m, threshold, miss) if n and m else 0 for m in range(SHORT)] for n in range(SHORT)]
    reach = np.arange(SHORT) < SHORT * threshold - 1e-9
    out[:SHORT, SHORT] = out[SHORT, :SHORT] = np.where(reach, 0, plain)
    return out


def levels(threshold: float = THRESHOLD, miss: float = MISS) -> np.ndarray:
    """(SHORT + 1) x (DEPTH + 1): whether a set of n shingles is listed at a depth."""
    depths = pair_depths(threshold, miss)
    out = np.zeros((SHORT + 1, DEPTH + 1), dtype=bool)
    for n in range(1, SHORT + 1):
        out[n, depths[n]] = True
    out[:, 0] = False
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: lower case, words between white space.

    A text of fewer words has one shingle, all of it; a text without words has none.
    """
    known: dict[str, int] = worker_state("shingles", dict)
    if len(known) > MEMO:
        known.clear()
    if sum(map(len, texts)) > SLICE_CHARS and len(texts) > 1:
        return [x for part in slices(texts) for x in shingle_sets(part, words)]
    cut = [t.lower().split() for t in texts]
    for w in set(itertools.chain.from_iterable(cut)).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    n = np.array([len(c) for c in cut])
    flat = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(cut)), dtype=np.uint64, count=int(n.sum()))
    size = max(0, len(flat) - words + 1)
    rolled = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled += flat[k : k + size] * _STEPS[k % 64] + np.uint64(k)
        rolled = _mix(rolled)
        out, at = [], 0
        for m in n.tolist():
            if m >= words:
                out.append(np.unique(rolled[at : at + m - words + 1]))
            elif m:
                out.append(_mix(np.array([(flat[at : at + m] * _STEPS[:m]).sum() + np.uint64(m << 40)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += m
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit one-permutation MinHash values (texts x BINS); empty bins copy a bin that their probes find."""
    least = np.full((len(sets), BINS), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        mixed = _mix(flat * _STEPS[7])
    np.minimum.at(least.reshape(-1), row * BINS + (mixed % np.uint64(BINS)).astype(np.int64), mixed // np.uint64(BINS))
    empty = least == np.iinfo(np.uint64).max
    full, source = ~empty, np.tile(np.arange(BINS), (len(sets), 1))
    for probe in _PROBES:
        r, c = np.nonzero(empty)
        if not len(r):
            break
        hit = full[r, probe[c]]
        source[r[hit], c[hit]] = probe[c[hit]]
        empty[r[hit], c[hit]] = False
    for r in np.flatnonzero(empty.any(axis=1) & full.any(axis=1)):  # few shingles: the first full bin in the own order
        there, c = np.flatnonzero(full[r]), np.flatnonzero(empty[r])
        source[r, c] = there[_ORDER[np.ix_(c, there)].argmin(axis=1)]
    with np.errstate(over="ignore"):
        return (_mix(np.take_along_axis(least, source, axis=1)) >> np.uint64(48)).astype(">u2")


def likely(left: np.ndarray, right: np.ndarray | None, threshold: float, n_left: np.ndarray, n_right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Forest edges (row of left, row of right) of pairs that may reach the threshold, by their numbers of shingles and their signatures."""
    least = (threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / BINS)) * BINS
    other, n_other, i, j = (left, n_left, [], []) if right is None else (right, n_right, [], [])
    for k, (s, n) in enumerate(zip(left, n_left, strict=True)):
        begin = k + 1 if right is None else 0
        m = n_other[begin:]
        # No pair is more alike than the smaller set's share of the larger one.
        fits = np.minimum(m, n) / np.maximum(m, n) >= threshold
        hit = np.flatnonzero(fits & ((m < SHORT) | (n < SHORT) | ((other[begin:] == s).sum(axis=1) >= least)))
        i += [k] * len(hit)
        j += (hit + begin).tolist()
    if right is None:
        return forest(i, j)
    return [(a, b - len(left)) for a, b in forest(i, [x + len(left) for x in j])]


def shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Intersection sizes of all pairs of sets."""
    sets = left + (right or [])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    keep = df[col] > 1
    col, row = number[col[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    m = len(left)
    out = np.zeros((m, len(right) if right is not None else m), dtype=np.float64)
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(col, (begin, begin + 4096))
        x = np.zeros((len(sets), 4096), dtype=np.float32)
        x[row[a:b], col[a:b] - begin] = 1
        out += x[:m] @ (x[m:] if right is not None else x).T
    return out


def _links(weight: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, miss: float, codes=None) -> tuple[np.ndarray, list]:
    """(weight linked to each row, forest edges); with two sides only pairs across them count.

    With ``codes`` only pairs count whose first shared prefix (in tree order, at the
    pair's own depth) is one of them.
    """
    two = side.any()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(sets)),) * 2
    common = shared([sets[i] for i in left], [sets[i] for i in right] if two else None)
    n = np.array([len(s) for s in sets], dtype=np.float64)
    hit = common / (n[left][:, None] + n[right][None, :] - common) >= threshold
    i, j = np.nonzero(hit if two else np.triu(hit, 1))
    i, j = left[i], right[j]
    if codes is not None and len(i):
        sig = signatures(sets).reshape(len(sets), TREES, DEPTH)
        size = np.minimum(n, SHORT).astype(np.int64)
        mine = np.zeros(len(i), dtype=bool)
        for begin in range(0, len(i), 4096):
            x, y = i[begin : begin + 4096], j[begin : begin + 4096]
            depth = pair_depths(threshold, miss)[size[x], size[y]]
            deep = np.cumprod(sig[x] == sig[y], axis=2).sum(axis=2) >= depth[:, None]
            mine[begin : begin + 4096] = deep.any(axis=1) & np.isin(deep.argmax(axis=1) * 16 + depth, list(codes))
        i, j = i[mine], j[mine]
    gained = np.zeros(len(sets), dtype=np.int64)
    np.add.at(gained, i, weight[j])
    np.add.at(gained, j, weight[i])
    return gained, forest(i.tolist(), j.tolist())


def walk(batches, listed: np.ndarray):
    """(key, code, no, shingles) of every prefix under which a text has company.

    ``batches`` of (tree, string, no, shingles) come sorted by tree and string. Adjacent
    strings' common prefixes say how deep a string has company; from there it is
    shortened to the depths that ``listed`` asks for. A partition's ends can't see their
    neighbours and count as having company. ``code`` is tree * 16 + depth.
    """
    held = None
    ahead = itertools.chain(batches, [None])
    for batch in ahead:
        if batch is not None:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(-1, DEPTH)
            now = [batch.column(0).to_numpy(), raw, batch.column(2).to_numpy(), batch.column(3).to_numpy()]
            now = now if held is None else [np.concatenate(x) for x in zip(held[:4], now, strict=True)]
            before = DEPTH if held is None else held[4]
        elif held is None:
            return
        else:
            now, before = held[:4], held[4]
        tree, text, no, size = now
        same = (text[1:] == text[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.concatenate([[before], np.cumprod(same, axis=1).sum(axis=1), [DEPTH]])
        end = len(tree) if batch is None else len(tree) - 1
        held = None if batch is None else [x[-1:] for x in now] + [lcp[-2]]
        company = np.maximum(lcp[:-1], lcp[1:])[:end]
        asked = listed[np.minimum(size[:end], SHORT)]
        at, depth = np.nonzero(asked & (np.arange(DEPTH + 1) <= company[:, None]))
        if len(at):
            mixed = tree.astype(np.uint64) * np.uint64(16) + np.uint64(1)
            keys = np.zeros((len(tree), DEPTH + 1), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for d in range(1, DEPTH + 1):
                    mixed = _mix(mixed * _STEPS[d] + text[:, d - 1].astype(np.uint64) + np.uint64(d))
                    keys[:, d] = mixed
            cols = [keys[at, depth].view(np.int64), (tree[at] * 16 + depth).astype(np.int32), no[at], size[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "code", "no", "shingles"])


def _groups(classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(group, codes, no, m): the texts under each prefix that several texts share.

    Groups of at most ``LIST`` texts that several prefixes repeat are one group that
    answers for all of their codes.
    """
    listed = levels(threshold, miss)
    tree = F.col("tree")
    asked = [n for n in range(1, SHORT) if listed[n].any()]
    leaf = (
        classes.where((F.col("shingles") >= SHORT) | F.col("shingles").isin(asked))
        .select("no", "shingles", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("tree", F.substring("sig", tree * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("string"), "no", "shingles")
    )
    # Ranges of (tree, string, no): however many texts share a string, a task gets its even part.
    in_order = leaf.repartitionByRange("tree", "string", "no").sortWithinPartitions("tree", "string")
    met = materialise(in_order.mapInArrow(lambda batches: walk(batches, listed), "key long, code int, no long, shingles int"), "forest")
    crowd = met.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    placed = met.join(crowd, "key")
    few = (
        placed.where(F.col("m") <= LIST).groupBy("key").agg(F.sort_array(F.collect_list("no")).alias("nos"), F.first("code").alias("code"))
        .groupBy("nos").agg(F.collect_set("code").alias("codes"))
        .select(F.xxhash64("nos").alias("group"), "codes", F.explode("nos").alias("no"), F.size("nos").cast("long").alias("m"))
    )
    many = placed.where(F.col("m") > LIST).select(F.col("key").alias("group"), F.array("code").alias("codes"), "no", "m")
    out = materialise(few.unionByName(many), "forest")
    discard(met)
    return out


def _candidates(groups: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (no, other): a spanning forest of the pairs that deserve an exact comparison."""
    parts = max(1, groups.count() // UNIT_ROWS)
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = in_blocks(groups.drop("codes"), n, "no").withColumn("unit", F.when(F.col("m") <= LIST, F.pmod("group", F.lit(parts))).otherwise(F.xxhash64("group", "p", "q")))
    rows = dealt.join(classes.select("no", "sig", "shingles"), "no").select("unit", "group", "m", "p", "q", "b", "no", "sig", "shingles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, p, q), g in runs(group, ["group", "m", "p", "q"]):
            no = g["no"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), dtype=">u2").reshape(len(no), BINS)
            n = g["shingles"].to_numpy()
            if p == q:
                out += [(no[i], no[j]) for i, j in likely(sig, None, threshold, n)]
            else:
                left, right = np.flatnonzero(g["b"].to_numpy() == p), np.flatnonzero(g["b"].to_numpy() == q)
                out += [(no[left[i]], no[right[j]]) for i, j in likely(sig[left], sig[right], threshold, n[left], n[right])]
        return pd.DataFrame(out, columns=["no", "other"], dtype=np.int64)

    return rows.groupBy("unit").applyInPandas(compare, "no long, other long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS, with_key: bool = False
) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept: a row per row of ``docs``.

    Rows with equal shingle sets are one class, named by its least id. ``n_links``
    counts the other rows linked directly, those of the own class included.
    ``component_id`` is the least id reachable. ``kept`` holds for exactly one row of
    each component: one with the least id; of repeated rows only one is kept. Texts
    without words (null, empty, white space) are one class and link with nothing
    else; texts of fewer than ``words`` words have one shingle. Whole texts of any
    length count. Null ids come after all others. An empty table gives no rows; other
    columns are ignored, whatever their names. ``with_key`` adds text_key, the text's xxhash64.
    """
    spark = docs.sparkSession
    tune(spark)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.xxhash64(text_col).alias("text_key")] if with_key else []))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                sets = shingle_sets(texts, words)
                node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sig = [s.tobytes() for s in signatures(sets)]
                ids = np.arange(row, row + len(sets))
                row += len(sets)
                cols = [pa.array(ids), part.column(0), pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.binary()), *([part.column(2)] if with_key else [])]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "node", "shingles", "sig", "text_key"][: len(cols)])

    rows = materialise(kept.mapInArrow(scan, f"row long, doc_id {kind}, node binary, shingles int, sig binary" + ", text_key long" * with_key), "jaccard")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = rows.groupBy("node").agg(F.min(name).alias("name"), F.count("*").alias("n"), F.first("shingles").alias("shingles"), F.first("sig").alias("sig"))
    # A class's number is fixed once it is written.
    classes = materialise(classes.withColumn("no", F.monotonically_increasing_id()), "jaccard")
    groups = _groups(classes, threshold, miss)
    maybe = materialise(_candidates(groups, classes, threshold), "jaccard")
    parts = materialise(connected_components(maybe, "no", "other"), "jaccard")
    members = materialise(parts.select(F.col("node").alias("no"), "component").join(classes.select("no", "node", "name", "n", "shingles"), "no"), "jaccard")
    # The texts of one row per member, by id: again scanned, as only these need their whole sets.
    wanted = members.select(F.col("name.doc_id").alias("wanted")).distinct()
    few = wanted.count() <= FEW_IDS
    texts = kept.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, kept.doc_id.eqNullSafe(F.col("wanted")), "left_semi")

    def again(batches):
        for batch in batches:
            for part in slices(batch.column(1).to_pylist()):
                sets = shingle_sets(part, words)
                node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    sets = texts.mapInArrow(again, "node binary, set binary").dropDuplicates(["node"]).join(members.select("node", "no", "n"), "node").select("no", "n", "set")
    dealt = units(groups, members.withColumnRenamed("shingles", "size"), BLOCK, BLOCK_ENTRIES, ENTRIES).join(sets, "no")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, p, q), g in runs(group, ["key", "p", "q"]):
            no, b, codes = g["no"].to_numpy(), g["b"].to_numpy(), g["codes"].iat[0]
            side = (b != p).astype(int) if p != q else np.zeros(len(g), int)
            if p != q and (side.all() or not side.any()):
                continue
            gained, edges = _links(g["n"].to_numpy(), [np.frombuffer(s, dtype=np.uint64) for s in g["set"]], side, threshold, miss, codes)
            out += [(no[i], int(gained[i]), None) for i in np.flatnonzero(gained)]
            out += [(no[i], 0, no[j]) for i, j in edges]
        return pd.DataFrame(out, columns=["no", "linked", "other"], dtype=object).astype({"no": np.int64, "linked": np.int64})

    found = materialise(dealt.select("unit", "key", "codes", "p", "q", "b", "no", "n", "set").groupBy("unit").applyInPandas(verify, "no long, linked long, other long"), "jaccard")
    linked = found.where("other IS NULL").groupBy("no").agg(F.sum("linked").alias("linked"))
    ends = materialise(connected_components(found.where("other IS NOT NULL"), "no", "other").select(F.col("node").alias("no"), "component"), "jaccard")
    least = ends.join(classes.select("no", "name"), "no").groupBy("component").agg(F.min("name").alias("first"))
    per_class = (
        classes.select("node", "no", "name", "n")
        .join(linked, "no", "left")
        .join(ends.join(least, "component").select("no", "first"), "no", "left")
        .select("node", F.col("name.doc_id").alias("class_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("first", "name").alias("first"))
    )
    for t in (groups, maybe, parts):
        discard(t)
    extra = ["text_key"] * with_key
    return rows.select("row", "doc_id", "node", *extra).join(per_class, "node").select("doc_id", "class_id", "n_links", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), *extra)
