"""Readers with both rules for missing values, and writers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearnames.config import REJECTED
from nearnames.functions.text import ordered_hash
from nearnames.operators import pairs as P
from nearnames.operators.proposer import RUN, proposed_pairs, unselected_pairs
from nearnames.runtime import discard, fresh, materialise

# Strings that count as missing where missing values are read as such.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CLASS_COLUMNS = ("label", "class", "target", "category")


def read_csv(spark: SparkSession, path: str, missing: bool = True, header: bool = True, own: bool = False, pos: str | None = None) -> DataFrame:
    """All columns as strings. ``missing``: the usual strings are null; else all are kept, and empty ones are ''.

    A quoted field may hold line breaks, which makes each file one task; in tables of
    clean names that this engine wrote itself (``own``) none does, and files are split.
    ``pos`` adds a sortable column of that name with each row's place: its file, and where it is there.
    """
    df = spark.read.csv(path, header=header, escape='"', multiLine=not own, nullValue=None, emptyValue="")
    names = df.columns
    if pos:
        df = df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(pos))
    for c in names:
        q = F.col(f"`{c}`")
        df = df.withColumn(c, F.when(~q.isin(MISSING), q) if missing else F.coalesce(q, F.lit("")))
    return df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str, made_by: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; `{made_by}` makes it")
    return path


def write_text(spark: SparkSession, text: str, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


# ---------------------------------------------------------------- registries


def raw_registry(spark: SparkSession, path: str) -> DataFrame:
    """(drug_name, pos): the first column; a first row that says drug_name is a header."""
    df = read_csv(spark, path, header=False)
    rows = df.select(F.col(df.columns[0]).alias("drug_name")).withColumn("pos", F.monotonically_increasing_id())
    return rows.where(~((F.col("pos") == 0) & (F.lower(F.trim("drug_name")) == "drug_name")) | F.col("drug_name").isNull())


def clean_registry_file(spark: SparkSession, path: str) -> DataFrame:
    """(drug_name, pos) of a cleaned registry: first column without nulls, not cleaned again."""
    df = read_csv(spark, path)
    return df.select(F.col(f"`{df.columns[0]}`").alias("drug_name")).withColumn("pos", F.monotonically_increasing_id()).dropna(subset=["drug_name"])


def registry_file(spark: SparkSession, path: str) -> DataFrame:
    """A registry given for the occasion: header row consumed, then cleaned."""
    return P.clean_registry(clean_registry_file(spark, path), pos="pos")


def registry(spark: SparkSession, raw_path: str, cache_path: str, use_cache: bool = True) -> DataFrame:
    """The cached clean registry if allowed and there, else the raw one cleaned, reported on, and cached."""
    if use_cache and exists(spark, cache_path):
        return clean_registry_file(spark, cache_path)
    raw = raw_registry(spark, raw_path)
    for line in registry_notes(raw):
        print(line)
    out = P.clean_registry(raw, pos="pos")
    write_csv(out.orderBy("pos").select("drug_name"), cache_path)
    return out


def registry_notes(raw: DataFrame) -> list[str]:
    """What is unusual about a raw registry, and what cleaning leaves of it."""
    r = P.registry_report(raw).first()
    notes = [
        (r["is_small"], f"warning: the registry has only {r['n_raw']:,} rows"), (r["n_null"], f"warning: {r['n_null']:,} rows are missing values"),
        (r["n_duplicate"], f"warning: {r['n_duplicate']:,} rows repeat a name"), (True, f"registry: {r['n_raw']:,} rows, {r['n_clean']:,} clean names, {r['n_dropped']:,} dropped"),
    ]
    return [text for there, text in notes if there]


# ---------------------------------------------------------------- pairs


def read_pairs(spark: SparkSession, path: str, missing: bool = True, need: Iterable[str] = ("x_1", "x_2"), pos: str | None = None) -> DataFrame:
    df = P.with_aliases(read_csv(spark, path, missing, pos=pos))
    if gone := set(need).difference(df.columns):
        raise ValueError(f"{path}: columns are missing: {sorted(gone)}")
    return df


def labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return P.split_labelled(read_pairs(spark, path, missing=False))


def unlabelled(spark: SparkSession, path: str) -> DataFrame:
    df = P.with_aliases(read_csv(spark, path, own=True))
    return df.select("x_1", "x_2", F.expr("try_cast(similarity AS double)").alias("similarity"), F.expr("try_cast(tier AS int)").alias("tier"), F.lit(0).alias("label"))


def proposer_run(spark: SparkSession, path: str) -> DataFrame:
    """A run written as one JSON array, or as JSON lines."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.schema(RUN).json(path, multiLine=bool(first and first[0].lstrip().startswith("[")))


def positives(spark: SparkSession, pairs_path: str | None, run_path: str | None) -> DataFrame:
    """From a file of pairs if one is given, else from a proposer's run."""
    return read_pairs(spark, pairs_path).select("x_1", "x_2") if pairs_path else proposed_pairs(proposer_run(spark, run_path))


def rejections(spark: SparkSession, csv_path: str | None, run_path: str | None, named: bool = False) -> DataFrame:
    """Rejected pairs of a file (which may be absent unless it was named) and of a run, exactly distinct."""
    parts = []
    if csv_path and (named or exists(spark, csv_path)):
        parts.append(read_pairs(spark, require(spark, csv_path, "your list of rejected pairs")).select("x_1", "x_2"))
    if run_path and exists(spark, run_path):
        parts.append(unselected_pairs(proposer_run(spark, run_path), REJECTED).select("x_1", "x_2"))
    out = parts[0] if parts else spark.createDataFrame([], "x_1 string, x_2 string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def extend_with_unselected(dataset: DataFrame, run: DataFrame, label: int = 0) -> DataFrame:
    """The dataset and those unselected candidates whose unordered clean pair it lacks."""
    new = P.clean_and_deduplicate(unselected_pairs(run, label))
    known = dataset.select(F.least("x_1", "x_2").alias("lo"), F.greatest("x_1", "x_2").alias("hi")).distinct()
    fresh = new.withColumns({"lo": F.least("x_1", "x_2"), "hi": F.greatest("x_1", "x_2")}).join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")
    return dataset.unionByName(fresh, allowMissingColumns=True)


# ---------------------------------------------------------------- combining


def class_column(df: DataFrame, wanted: str | None = None) -> str:
    found = [c for c in ([wanted] if wanted else CLASS_COLUMNS) if c in df.columns]
    if not found:
        raise ValueError(f"no column {wanted or ' or '.join(CLASS_COLUMNS)} among {df.columns}")
    return found[0]


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def combine_csv(
    spark: SparkSession, folder: str, out: str | None = None, class_col: str | None = None, pattern: str = "*.csv", seed: int = 42, shuffle: bool = True, deduplicate: bool = False, include_d: bool = False
) -> dict[str, str]:
    """Union of a folder's CSV files as D.csv, and a D_<class>.csv per class; an unreadable file is passed over.

    In a file's name, runs of characters other than letters, digits, _, . and - are one _; a missing class is nan.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    names = sorted(s.getPath().toString() for s in found)
    names = [n for n in names if include_d or not re.fullmatch(r"D(_.*)?\.csv", n.rsplit("/", 1)[-1])]
    parts = []
    for n in names:
        try:
            parts.append(read_csv(spark, n))
        except Exception as e:  # noqa: BLE001  whatever makes a file unreadable
            print(f"passed over {n}: {e}")
    if not parts:
        raise FileNotFoundError(f"no CSV files in {folder} match {pattern}")
    whole = union_all(parts)
    if deduplicate:
        whole = whole.dropDuplicates()
    col = class_column(whole, class_col)
    # One read, and one write for all classes: Spark parts them, and their folders get their names.
    whole = materialise(whole, "combine")
    place = ordered_hash(seed, *[f"`{c}`" for c in whole.columns]) if shuffle else F.lit(0)
    part, target = fresh("class_part", whole), out or folder
    ordered = whole.orderBy(place) if shuffle else whole
    made = {"D": f"{target}/D.csv"}
    write_csv(ordered, made["D"])
    value = F.regexp_replace(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan")), r"[^\w.-]+", "_")
    value = F.regexp_replace(value, "^_+|_+$", "")
    staged = f"{target}/.classes-{uuid.uuid4().hex}"
    classed = ordered.withColumn(part, F.when(value == "", "empty").otherwise(value))
    classed.sortWithinPartitions(part, place).write.partitionBy(part).csv(staged, header=True, escape='"')
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(jvm_path(staged)):
        name = status.getPath().getName()
        if name.startswith(f"{part}="):
            k = f"D_{unquote(name.split('=', 1)[1])}"
            made[k] = f"{target}/{k}.csv"
            fs.delete(jvm_path(made[k]), True)
            fs.rename(status.getPath(), jvm_path(made[k]))
    fs.delete(jvm_path(staged), True)
    discard(whole)
    return made


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in set(before.columns)]


