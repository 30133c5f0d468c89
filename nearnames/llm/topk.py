"""Exact top-k by integer inner product, with a KD-tree per shard.

1. Vectors become integers floor(scale * x). Median splits of a bounded sample say which
   region a row belongs to; a region of many rows is dealt to several shards by chance.
   Every row is in one shard, and shards have about ``SHARD_ROWS`` rows (more only where
   there would be over ``MOST_SHARDS`` of them).
2. In each shard a KD-tree is built once, by median splits on the widest axis, with the
   tight bounding box of every node, and written with the shard.
3. The bound of an inner product over a box is the sum of max(q * low, q * high) over the
   axes. A query ranks the shards by the bounds of their root boxes and visits them in
   rounds: the best one, then the next 4, 16, ..., each time only those whose bound
   reaches its kth score. The kth score found so far goes with it to all of them.
4. In a shard the query descends best-first: it opens the node with the greatest bound,
   puts its children in its place, and stops when no bound reaches the kth score.

Queries travel in blocks: a task holds one shard and one block of queries.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearnames.runtime import discard, materialise, tune

K = 20
SCALE = 64
SHARD_ROWS = 8192
#: Root boxes (16 bytes a dimension) that the driver and all workers hold.
MOST_SHARDS = 16_384
#: Rows that say where regions are split, and the least of them in a region.
SAMPLE, SAMPLE_LEAF = 16_384, 16
LEAF_ROWS = 256
QUERY_ROWS = 4096
#: Shards that a query visits in a round: this many times as many as in the round before.
WIDEN = 4
NEVER = float("-inf")
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


class Regions:
    """Median splits of a sample on the widest axis into about ``count`` regions."""

    def __init__(self, sample: np.ndarray, count: int):
        self.splits, self.count, todo = [], 0, [(sample, count, None, None)]
        while todo:
            points, parts, parent, side = todo.pop()
            width = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
            if parts < 2 or len(points) < 2 * SAMPLE_LEAF or not (width > 0).any():
                name, self.count = -1 - self.count, self.count + 1
            else:
                axis = int(np.argmax(width))
                cut = float(np.median(points[:, axis]))
                low = points[:, axis] < cut
                name = len(self.splits)
                self.splits.append([axis, cut, None, None])
                todo += [(points[~low], parts - parts // 2, name, 3), (points[low], parts // 2, name, 2)]
            if parent is not None:
                self.splits[parent][side] = name

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each point (row)."""
        out, todo = np.zeros(len(points), dtype=np.int32), [(0 if self.splits else -1, np.arange(len(points)))]
        while todo:
            name, rows = todo.pop()
            if name < 0:
                out[rows] = -1 - name
                continue
            axis, cut, left, right = self.splits[name]
            low = points[rows, axis] < cut if axis < points.shape[1] else np.full(len(rows), 0 < cut)
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def upper(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product that each query (row) can have in each box (row)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class KDTree:
    """Median splits on the widest axis down to ``leaf`` rows, with each node's tight box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.points, self.rows, self.children, todo = points, {}, [], [(np.arange(len(points)), None, None)]
        low, high = [], []
        while todo:
            at, parent, side = todo.pop()
            box, node = points[at], len(self.children)
            low.append(box.min(axis=0)), high.append(box.max(axis=0))
            self.children.append([-1, -1])
            if parent is not None:
                self.children[parent][side] = node
            width = high[-1] - low[-1]
            if len(at) <= leaf or not (width > 0).any():
                self.rows[node] = at
                continue
            order = at[np.argsort(box[:, int(np.argmax(width))], kind="stable")]
            todo += [(order[len(order) // 2 :], node, 1), (order[: len(order) // 2], node, 0)]
        self.low, self.high = np.array(low), np.array(high)

    def search(self, queries: np.ndarray, own: np.ndarray, names: np.ndarray, k: int, floor: np.ndarray) -> tuple:
        """Arrays (query's row, name, score) that hold each query's k best at or above its floor.

        All queries descend together, each by its own order: a turn opens every query's best node.
        """
        best = np.full((len(queries), k), NEVER, dtype=queries.dtype)
        kth, found = floor.astype(queries.dtype), ([], [], [])
        # What each query can still open: a node's bound, or NEVER.
        ahead = np.full((len(queries), len(self.children)), NEVER, dtype=queries.dtype)
        ahead[:, 0] = _held(upper(queries, self.low[:1], self.high[:1]))[:, 0]
        live = np.arange(len(queries))
        self.opened = np.zeros(len(queries), dtype=np.int64)
        while len(live):
            node = ahead[live].argmax(axis=1)
            bound = ahead[live, node]
            there = (bound >= kth[live]) & (bound > NEVER)
            live, node = live[there], node[there]
            if not len(live):
                break
            ahead[live, node] = NEVER
            self.opened[live] += 1
            order = np.argsort(node, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                here, asked = int(node[at[0]]), live[at]
                if here not in self.rows:
                    pair = self.children[here]
                    ahead[asked[:, None], pair] = _held(upper(queries[asked], self.low[pair], self.high[pair]))
                    continue
                rows = self.rows[here]
                scores = _held(queries[asked] @ self.points[rows].T)
                scores[names[rows][None, :] == own[asked][:, None]] = NEVER
                q, r = np.nonzero((scores >= kth[asked][:, None]) & (scores > NEVER))
                if not len(q):
                    continue
                for x, y in zip(found, (asked[q], names[rows[r]], scores[q, r]), strict=True):
                    x.append(y)
                new = np.unique(q)
                every = np.concatenate([best[asked[new]], scores[new]], axis=1)
                every.partition(every.shape[1] - k, axis=1)
                best[asked[new]] = every[:, -k:]
                kth[asked[new]] = np.maximum(kth[asked[new]], best[asked[new]].min(axis=1))
        return tuple(np.concatenate(x) if x else np.array([], dtype=np.int64) for x in found)


def _held(scores: np.ndarray) -> np.ndarray:
    """Within a long; only numbers beyond exact doubles can leave it."""
    return np.minimum(np.maximum(scores, _MIN), _MAX) if scores.dtype == object else scores


def _matrix(vectors) -> np.ndarray:
    """Vectors as a matrix of doubles; shorter ones end in zeros."""
    sizes = {len(v) for v in vectors}
    if len(sizes) == 1:
        return np.array(list(vectors), dtype=np.float64)
    out = np.zeros((len(vectors), max(sizes, default=0)), dtype=np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _wide(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows of both can be beyond what doubles hold exactly."""
    top = lambda x: float(np.abs(x).max()) if x.size else 0.0
    return top(a) * top(b) * max(a.shape[1], b.shape[1], 1) >= 2.0**52


def _numbers(x: np.ndarray, wide: bool) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape) if wide else x


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    top = float(np.abs(x).max()) if x.size else 0.0
    return x.astype(next((t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max), np.float64))


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's root box, and its names and tree."""
    points = _matrix(shard["v"])
    tree = KDTree(_narrow(points) if not _wide(points, points) else points)
    kept = {"points": tree.points, "rows": tree.rows, "children": tree.children, "low": tree.low, "high": tree.high, "names": shard["vec_id"].to_numpy()}
    return pd.DataFrame({"shard": [int(shard["shard"].iat[0])], "low": [points.min(axis=0)], "high": [points.max(axis=0)], "tree": [pickle.dumps(kept)]})


def _search(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(shard) or not len(queries):
        return pd.DataFrame({c: np.array([], np.int64) for c in ("q", "vec_id", "score")})
    kept = pickle.loads(shard["tree"].iat[0])
    points, asked = kept["points"].astype(np.float64), _matrix(queries["w"])
    wide, dim = _wide(points, asked), max(points.shape[1], asked.shape[1])
    points, asked = (_numbers(_padded(x, dim), wide) for x in (points, asked))
    tree = KDTree.__new__(KDTree)
    tree.points, tree.rows, tree.children = points, kept["rows"], kept["children"]
    tree.low, tree.high = (_numbers(_padded(kept[c].astype(np.float64), dim), wide) for c in ("low", "high"))
    floor = queries["kth"].fillna(NEVER).to_numpy(dtype=np.float64)
    # pandas has given floors as doubles: a great one may have been rounded up.
    floor = np.where(np.abs(floor) > 2.0**53, np.nextafter(floor, NEVER), floor)
    names, number = kept["names"], queries["q"].to_numpy()
    q, name, score = tree.search(asked, queries["asked"].to_numpy(), names, k, floor)
    order = np.lexsort((name, -score, q))
    q, name, score = q[order], name[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, name, score = (x[place < k] for x in (q, name, score))
    return pd.DataFrame({"q": number[q.astype(np.int64)], "vec_id": name, "score": score.astype(np.int64)}).astype(np.int64)


def _shards(whole: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, shards): all rows with their shard, and a row per shard with its root box and tree."""
    spark = whole.sparkSession
    n = whole.count()
    count = max(1, min(MOST_SHARDS // 2, -(-n // shard_rows)))
    sample = whole.where(F.rand(5) < min(1.0, SAMPLE / max(1, n))).limit(2 * SAMPLE).select("v").toPandas()["v"]
    regions = Regions(_matrix(sample), min(count, SAMPLE // SAMPLE_LEAF))

    def place(frames):
        for f in frames:
            yield f.assign(region=regions.of(_matrix(f["v"])) if len(f) else np.zeros(0, np.int32))

    placed = materialise(whole.withColumn("r", F.rand(6)).mapInPandas(place, "vec_id long, v array<double>, r double, region int"), "topk")
    sizes, first, parts = placed.groupBy("region").agg(F.count("*").alias("n")).collect(), 0, []
    # Regions in shards of an even size: at most one more for each region than there would be without regions.
    for r in sorted(sizes, key=lambda r: r["region"]):
        parts.append((r["region"], first, max(1, round(r["n"] * count / max(1, n)))))
        first += parts[-1][2]
    table = spark.createDataFrame(parts, "region int, first int, parts int")
    rows = placed.join(F.broadcast(table), "region").select("vec_id", "v", (F.col("first") + F.floor(F.col("r") * F.col("parts"))).cast("int").alias("shard"))
    built = rows.groupBy("shard").applyInPandas(_build, "shard int, low array<double>, high array<double>, tree binary")
    return placed.select("vec_id", "v"), materialise(built, "topk")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id ``every`` divides.

    Ties go to the smaller id. Rows with a null id, a null or empty vector, or a null
    or non-finite component take no part. A repeated id is a candidate as often as it
    stands, but never its own query's, and is asked once per distinct vector.
    Vectors of unequal length are compared as if the shorter ended in zeros. Scores
    beyond a long count as the nearest long, in the ranking too. An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        "vec_id IS NOT NULL AND size(x) > 0 AND NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))"
    )
    # A double of 2^52 or more is whole already, and floor() gives a long, which could overflow.
    whole_number = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale)
    rows, shards = _shards(whole.select("vec_id", F.transform("x", whole_number).alias("v")), shard_rows)
    boxes = shards.select("shard", "low", "high").toPandas()
    held = spark.sparkContext.broadcast((boxes["shard"].to_numpy(), _matrix(boxes["low"]), _matrix(boxes["high"])))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    # A query's number is fixed once it is written.
    queries = materialise(asked.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("asked"), F.col("v").alias("w")), "topk")

    def visits(done: int, width: int):
        def run(frames):
            name, low, high = held.value
            for f in frames:
                if not len(f):
                    continue
                w = _matrix(f["w"])
                dim = max(w.shape[1], low.shape[1])
                w, lo, hi = (_padded(x, dim) for x in (w, low, high))
                # Never less than the exact bound, however doubles are rounded.
                bound = upper(w, lo, hi) + 1e-12 * (np.abs(w) @ np.maximum(np.abs(lo), np.abs(hi)).T)
                order = np.argsort(-bound, axis=1, kind="stable")[:, done : done + width]
                kth = f["kth"].fillna(NEVER).to_numpy(dtype=np.float64)
                near = np.minimum(np.take_along_axis(bound, order, axis=1), float(_MAX)) >= kth[:, None]
                yield f.assign(shards=[name[o[x]].tolist() for o, x in zip(order, near, strict=True)])[["q", "asked", "w", "kth", "shards"]]

        return run

    find = lambda a, b: _search(a, b, k)
    best, done, width = None, 0, 1
    while done < len(boxes):
        state = queries.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            kth = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("q", "kth")
            state = queries.join(kth, "q", "left")
        ahead = state.mapInPandas(visits(done, width), "q long, asked long, w array<double>, kth long, shards array<int>").where(F.size("shards") > 0)
        ahead = materialise(ahead, "topk")
        going = ahead.select("q", "asked", "w", "kth", F.explode("shards").alias("shard"))
        crowd = going.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        crowd = F.broadcast(crowd)  # a row per shard
        to = going.join(crowd, "shard").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).select("shard", "block", "q", "asked", "w", "kth")
        at = shards.select("shard", "tree").join(crowd, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tree")
        new = at.groupBy("shard", "block").cogroup(to.groupBy("shard", "block")).applyInPandas(find, "q long, vec_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        every_one = new if best is None else best.unionByName(new)
        after = materialise(every_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "topk")
        for t in (best, ahead):
            discard(t)
        best, done, width = after, done + width, width * WIDEN
    if best is None:
        return queries.select(F.col("asked").alias("query_id"), F.lit(1).alias("rank"), F.col("asked").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
    # A repeated id may have been asked with several vectors.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.join(queries.select("q", F.col("asked").alias("query_id")), "q")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
