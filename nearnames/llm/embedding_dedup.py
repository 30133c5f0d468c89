"""Near-duplicate vectors by random-hyperplane sign hashing.

1. Equal vectors are one class from the start. A class's key in each table is the sign
   pattern against that table's hyperplanes; 128 further signs are its sketch.
2. Buckets gather class numbers and sketches, not vectors. A pair of a bucket goes on
   if its sketches differ in no more signs than a pair at the threshold may
   (``SIGMAS`` standard deviations allowed); a spanning forest of such pairs is kept.
3. Vectors move only for the members of the components of these, block by block, and
   all their pairs are compared by exact cosine in double precision. A component of
   more than a block goes as a whole or bucket by bucket, whichever moves fewer vectors;
   bucket by bucket, a pair counts in the first table whose keys agree.
4. Link counts add up over blocks, each of which hands on a spanning forest of its
   links. Components come from distributed label contraction.

Buckets larger than a block are dealt as pairs of blocks, so no task holds more than
two blocks, however hot a bucket is. Nothing is written per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.llm.blocks import forest, in_blocks, runs, units
from nearnames.operators.graph import connected_components
from nearnames.runtime import materialise, tune

THRESHOLD = 0.95
#: Greatest chance that a pair just at the threshold shares no key.
MISS = 1e-4
#: Expected vectors of a bucket, were they spread evenly.
BUCKET = 256
BLOCK = 2048
SEED = 7
#: Signs of a sketch, and how many standard deviations beyond the mean a pair at the threshold may differ.
SKETCH, SIGMAS = 128, 6
#: Large buckets up to this many are broadcast; more are joined by shuffle.
FEW = 100_000
#: Rows of a unit of small buckets, and vector components of a block and of a unit of small groups.
UNIT_ROWS, BLOCK_ENTRIES, ENTRIES = 20_000, 1 << 21, 1 << 19


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): buckets of a constant expected size, and the miss rate held at any n."""
    bits = min(30, max(6, math.ceil(math.log2(max(2, n) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def most_apart(threshold: float = THRESHOLD) -> int:
    """Signs in which the sketches of a pair at the threshold may differ."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(SKETCH * p + SIGMAS * math.sqrt(SKETCH * p * (1 - p)))


class Signs:
    """Sign patterns: keys of ``tables`` tables of ``bits`` bits, and sketches."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables, self.planes = bits, tables, {}

    def _against(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d not in self.planes:
            self.planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, self.tables * self.bits + SKETCH))
        return x @ self.planes[d] >= 0

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A row per vector, a column per table."""
        return self._split(self._against(x))[0]

    def _split(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keyed = signs[:, : self.tables * self.bits].reshape(len(signs), self.tables, self.bits)
        return keyed @ (1 << np.arange(self.bits)), np.packbits(signs[:, self.tables * self.bits :], axis=1).view(np.int64)

    def keys_and_sketches(self, vectors: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        keys, sketches = np.zeros((len(vectors), self.tables), dtype=np.int64), np.zeros((len(vectors), SKETCH // 64), dtype=np.int64)
        dims = np.array([len(v) for v in vectors])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            keys[at], sketches[at] = self._split(self._against(np.array([vectors[i] for i in at])))
        return keys, sketches


def alike(sketches: np.ndarray, side: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Forest edges of the pairs whose sketches differ in at most ``most`` signs; with two sides of pairs across them."""
    two, s = side.any(), sketches.view(np.uint64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(s)),) * 2
    out = []
    for begin in range(0, len(left), 256):
        rows = left[begin : begin + 256]
        apart = sum(np.bitwise_count(s[rows, None, k] ^ s[None, right, k]).astype(np.int16) for k in range(s.shape[1]))
        i, j = np.nonzero(apart <= most)
        i, j = rows[i], right[j]
        keep = slice(None) if two else i < j
        out += forest(i[keep].tolist(), j[keep].tolist())
    return forest([a for a, _ in out], [b for _, b in out])


def links(weights: np.ndarray, x: np.ndarray, side: np.ndarray, threshold: float, signs: Signs | None = None, tables=()) -> tuple[np.ndarray, list]:
    """(weight linked to each row, forest edges) by exact cosine; with two sides only pairs across them count.

    With ``signs`` only pairs count whose first table with equal keys is one of ``tables``.
    """
    norm = np.sqrt((x * x).sum(axis=1))
    gained, edges, two = np.zeros(len(x), dtype=np.int64), [], side.any()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(x)),) * 2
    keys = None if signs is None else signs.keys(x)
    for begin in range(0, len(left), 512):
        rows = left[begin : begin + 512]
        cos = (x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right][None, :])
        i, j = np.nonzero(cos >= threshold)
        i, j = rows[i], right[j]
        if not two:
            i, j = i[i < j], j[i < j]
        if keys is not None and len(i):
            same = keys[i] == keys[j]
            mine = same.any(axis=1) & np.isin(same.argmax(axis=1), list(tables))
            i, j = i[mine], j[mine]
        np.add.at(gained, i, weights[j])
        np.add.at(gained, j, weights[i])
        edges += forest(i.tolist(), j.tolist())
    return gained, forest([a for a, _ in edges], [b for _, b in edges])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_id: a row per row of ``vectors``.

    ``class_id`` is the least id with an equal vector. Vectors that are null, empty or
    zero, or have null or non-finite components, link with nothing, equal ones
    included; so do vectors of different length with each other. Rows that repeat an
    id count as vectors of their own in ``n_links``. A row with a null id takes part
    in counts, and has no part in naming components unless it is alone. An empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = "size(x) > 0 AND NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity')) AND exists(x, c -> c <> 0)"
    # Scaling by the greatest component keeps squares of any finite vector finite.
    big = F.array_max(F.transform("x", F.abs))
    rows = materialise(
        base.select("vec_id", F.when(F.expr(sound), F.transform("x", lambda c: c / big + F.lit(0.0))).alias("y"), F.when(F.expr(sound), F.transform("x", lambda c: c + F.lit(0.0))).alias("x")).select(
            "vec_id", F.when(big.between(1e-100, 1e100), F.col("x")).otherwise(F.col("y")).alias("x"), F.when(F.col("x").isNotNull(), F.sha2(F.to_json(F.struct("x")), 256)).alias("node")
        ),
        "embed",
    )
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.first("x").alias("x"))
    # A class's number is fixed once it is written.
    classes = materialise(classes.withColumn("no", F.monotonically_increasing_id()), "embed")
    bits, tables = tables_for(classes.count(), threshold, miss)
    most = most_apart(threshold)

    def hashed(batches):
        signs = Signs(bits, tables)
        for batch in batches:
            keys, sketches = signs.keys_and_sketches(batch.column(1).to_pylist())
            cols = [batch.column(0), batch.column(2), pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32())), *(pa.array(c) for c in sketches.T)]
            yield pa.RecordBatch.from_arrays(cols, ["no", "dim", "keys", "s0", "s1"])

    keyed = materialise(classes.select("no", "x", F.size("x").alias("dim")).mapInArrow(hashed, "no long, dim int, keys array<int>, s0 long, s1 long"), "embed")
    placed = keyed.select("no", "dim", "s0", "s1", F.posexplode("keys").alias("table", "key")).select(F.xxhash64("dim", "table", "key").alias("group"), F.col("table").cast("int").alias("table"), "no", "s0", "s1")
    total = keyed.count() * tables
    sizes = placed.groupBy("group").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = materialise(sizes.select("group", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "embed")
    large = F.broadcast(large) if large.count() <= FEW else large
    dealt = in_blocks(placed.drop("table").join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), F.col("blocks"), "no")
    unit = F.when(F.col("blocks") == 1, F.pmod("group", F.lit(max(1, total // UNIT_ROWS)))).otherwise(F.xxhash64("group", "p", "q"))

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, p, q), g in runs(group, ["group", "p", "q"]):
            no, side = g["no"].to_numpy(), (g["b"].to_numpy() != p).astype(int) if p != q else np.zeros(len(g), int)
            if len(no) < 2 or p != q and (side.all() or not side.any()):
                continue
            out += [(no[i], no[j]) for i, j in alike(g[["s0", "s1"]].to_numpy(), side, most)]
        return pd.DataFrame(out, columns=["no", "other"], dtype=np.int64)

    maybe = dealt.select(unit.alias("unit"), "group", "p", "q", "b", "no", "s0", "s1").groupBy("unit").applyInPandas(sift, "no long, other long").distinct()
    parts = connected_components(materialise(maybe, "embed"), "no", "other")
    members = materialise(parts.select(F.col("node").alias("no"), "component").join(classes.select("no", F.size("x").alias("size")), "no"), "embed")
    groups = placed.select("group", F.array("table").alias("codes"), "no")
    todo = units(groups, members, block, BLOCK_ENTRIES, ENTRIES).join(classes.select("no", "n", "x"), "no")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out, signs = [], Signs(bits, tables)
        for (_, p, q), whole in runs(group, ["key", "p", "q"]):
            for _, g in whole.groupby(whole["x"].map(len)):
                no, side = g["no"].to_numpy(), (g["b"].to_numpy() != p).astype(int) if p != q else np.zeros(len(g), int)
                if len(no) < 2 or p != q and (side.all() or not side.any()):
                    continue
                codes = g["codes"].iat[0]
                gained, edges = links(g["n"].to_numpy(), np.array(g["x"].tolist()), side, threshold, *(() if codes is None else (signs, codes)))
                out += [(no[i], int(gained[i]), None) for i in np.flatnonzero(gained)]
                out += [(no[i], 0, no[j]) for i, j in edges]
        return pd.DataFrame(out, columns=["no", "linked", "other"], dtype=object).astype({"no": np.int64, "linked": np.int64})

    found = materialise(todo.groupBy("unit").applyInPandas(verify, "no long, linked long, other long"), "embed")
    linked = found.where("other IS NULL").groupBy("no").agg(F.sum("linked").alias("linked"))
    named = materialise(connected_components(found.where("other IS NOT NULL"), "no", "other").select(F.col("node").alias("no"), "component"), "embed")
    least = named.join(classes.select("no", "class_id"), "no").groupBy("component").agg(F.min("class_id").alias("component_id"))
    per_class = (
        classes.select("node", "no", "class_id", "n")
        .join(linked, "no", "left")
        .join(named.join(least, "component").select("no", "component_id"), "no", "left")
        .select("node", "class_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    )
    return rows.select("vec_id", "node").join(per_class, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
        F.coalesce("class_id", "vec_id").alias("class_id"),
    )
