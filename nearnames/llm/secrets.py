"""Secret scan with corpus-wide ownership frequency.

One scan per text finds candidate spans and hashes their values. Hashes are then
counted over the whole corpus by distinct owners, distinct repositories of those
owners, and distinct texts. A value that many owners hold, in many repositories and
many different texts, is a widely copied example; any other is live-looking. Copies of
one leaking text do not make its secret an example. Where a table names no
repositories, a document is one: a unit that its owner publishes by itself.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.runtime import fresh, materialise, tune, worker_state

KINDS = ("assign", "access", "hex")
#: A value held by as many owners, in as many of their repositories and as many different texts, is an example.
EXAMPLE_OWNERS = EXAMPLE_REPOS = EXAMPLE_TEXTS = 8
#: Parts into which the rows of one hash are split for the join with its counts.
SALT = 16
#: Verdicts of up to so many bytes are broadcast; more are joined by shuffle.
FEW_BYTES = 20 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of each base span, in order.

    Access keys and hex runs are whole runs, so asking for their least length in the
    pattern finds the same as dropping short matches; assignments are filtered after
    the match, as a short one uses up its characters.
    """
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, example_texts: int = EXAMPLE_TEXTS,
) -> DataFrame:
    """A row per row of ``docs`` with its spans and how many of them look live.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example,
    live_spans (those whose value is no example), min_owners, max_repos, text_key (the
    text's xxhash64). A null owner or repository counts as one more owner or repository.
    Null and empty texts have no spans. Texts of any length are scanned whole. Repeated
    rows and null ids give a row each; an empty table gives none; other columns are
    ignored, whatever their names.
    """
    tune(docs.sparkSession)
    kept = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("repo"),
        F.xxhash64(text_col).alias("text_key"),
    )
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, owner string, repo string, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<span:string,hash:binary>>"

    def run(batches):
        worker_state("secrets", dict)  # what other operators kept goes
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, n, sha, spans, found = [], ([], [], []), [], [], []
            for text in batch.column(1).to_pylist():
                got = scan(text)
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in got))
                each = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in got]
                joined = ",".join(each)
                sha.append(hashlib.sha256(joined.encode()).hexdigest()), spans.append(joined)
                found.append([{"span": s, "hash": hashlib.sha256(x[3].encode()).digest()[:16]} for s, x in zip(each, got, strict=True)])
                ids.append(row)
                row += 1
            types = pa.list_(pa.struct([("span", pa.string()), ("hash", pa.binary())]))
            cols = [pa.array(ids, pa.int64()), *(batch.column(k) for k in (0, 2, 3, 4)), *(pa.array(x, pa.int64()) for x in n), pa.array(sha), pa.array(spans), pa.array(found, types)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "owner", "repo", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    table = materialise(kept.mapInArrow(run, schema), "secrets")
    each = table.where(F.size("found") > 0).select("row", "owner", "repo", "text_key", F.posexplode("found").alias("place", "x")).select("row", "owner", "repo", "text_key", "place", F.col("x.span").alias("span"), F.col("x.hash").alias("hash"))

    def by_hash(name: str, *what: str) -> DataFrame:
        # distinct() combines before the shuffle, so a value copied everywhere is one row per task and owner.
        return each.select("hash", *what).distinct().groupBy("hash").agg(F.count("*").alias(name))

    counts = by_hash("owners", "owner").join(by_hash("repos", "owner", "repo"), "hash").join(by_hash("texts", "text_key"), "hash")
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    live = (F.col("owners") < example_owners) | (F.col("repos") < example_repos) | (F.col("texts") < example_texts)
    verdict = (
        each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
        .join(counts, ["hash", "salt"])
        .groupBy("row")
        .agg(
            F.count_if(live).alias("n_live"),
            F.count_if(~live).alias("n_example"),
            F.sort_array(F.collect_list(F.when(live, F.struct("place", "span")))).alias("live"),
            F.min("owners").alias("min_owners"),
            F.max("repos").alias("max_repos"),
        )
    )
    return table.join(verdict, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce(F.array_join("live.span", ","), F.lit("")).alias("live_spans"),
        "min_owners", "max_repos", "text_key",
    )


def mask_live(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, example_texts: int = EXAMPLE_TEXTS, mark: str = "[SECRET]",
) -> DataFrame:
    """``docs``, all rows and columns, with live-looking spans replaced by ``mark``.

    An assignment loses its value only. A value is live-looking in all of its texts or in
    none. Null texts stay null; an empty table stays empty. A row's verdict is that of
    its id and text together.
    """
    found = scan_secrets(docs, id_col, text_col, owner_col, repo_col, example_owners, example_repos, example_texts)
    an_id, key, live = (fresh(c, docs) for c in ("live_id", "live_key", "live_spans"))
    verdicts = materialise(found.where("live_spans <> ''").select(F.col("doc_id").alias(an_id), F.col("text_key").alias(key), F.col("live_spans").alias(live)).dropDuplicates([an_id, key]), "secrets")
    few = verdicts.agg(F.coalesce(F.sum(F.length(live) + 32), F.lit(0))).first()[0] <= FEW_BYTES
    same = docs[id_col].eqNullSafe(F.col(an_id)) & (F.xxhash64(docs[text_col]) == F.col(key))
    joined = docs.join(F.broadcast(verdicts) if few else verdicts, same, "left")

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_mask(t, v, mark) for t, v in zip(text, spans, strict=True)], dtype=object)

    new = F.when(F.col(live).isNotNull(), masked(docs[text_col], F.col(live))).otherwise(docs[text_col])
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])


def _mask(text: str | None, live: str | None, mark: str) -> str | None:
    if text is None or not live:
        return text
    wanted = set(live.split(","))
    cuts, last, out = [], 0, []
    for start, k, end, value in scan(text):
        if f"{KINDS[k]}:{start}:{end}" in wanted:
            cuts.append((end - len(value), end))
    for start, end in sorted(cuts):
        if end > last:
            out += [text[last:start], mark] if start >= last else []
            last = end
    return "".join([*out, text[last:]])
