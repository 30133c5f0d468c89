"""Training-data pipeline over ``documents``: identify, judge, deduplicate, scan, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return rows of ``docs`` with its columns, whatever further columns there are and
however they are named; the last returns packed pieces. Every stage works on all rows
that its predecessor kept, on whole texts of any length. A document is an id with a
text: verdicts are about both together, so rows that repeat an id with different texts
are judged apart, and so are rows without an id. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearnames.llm import jaccard, langid, packing, quality, secrets
from nearnames.runtime import fresh, materialise

#: Verdicts up to this many are broadcast (16 bytes each); more are joined by shuffle.
FEW = 1_000_000


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` that no row of ``verdicts`` (doc_id, text_key, kept) rejects; of rows that repeat a document one kept row is enough."""
    an_id, key = fresh("gone_id", docs), fresh("gone_key", docs)
    gone = verdicts.groupBy(F.col("doc_id").alias(an_id), F.col("text_key").alias(key)).agg(F.max("kept").alias("stays")).where("NOT stays").select(an_id, key)
    gone = materialise(gone, "gone")
    few = gone.count() <= FEW
    same = docs["doc_id"].eqNullSafe(F.col(an_id)) & (F.xxhash64(docs["text"]) == F.col(key))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows less like their nearest language than nearly all its held-out texts go, and rows with a null text or without a letter."""
    return _without(docs, langid.recognise(docs, with_key=True).select("doc_id", "text_key", "kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the model of trusted text is beyond their language's quantile go, and rows with a null or empty text.

    Without trusted labels all rows with a text stay.
    """
    found = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_key=True, folded=False)
    return _without(docs, found.select("doc_id", "text_key", "kept"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; null, empty and white-space texts are one group.

    Rows that repeat a document's id and text are one row from here on.
    """
    out = _without(docs, jaccard.near_duplicates(docs, with_key=True).select("doc_id", "text_key", "kept"))
    an_id, key = fresh("again_id", docs), fresh("again_key", docs)
    repeated = docs.groupBy(F.col("doc_id").alias(an_id), F.xxhash64("text").alias(key)).agg(F.count("*").alias("times")).where("times > 1").select(an_id, key)
    repeated = materialise(repeated, "again")
    n = repeated.count()
    if not n:
        return out
    many = F.broadcast(repeated) if n <= FEW else repeated
    same = out["doc_id"].eqNullSafe(F.col(an_id)) & (F.xxhash64(out["text"]) == F.col(key))
    return out.join(many, same, "left_anti").unionByName(out.join(many, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay. Live-looking secrets are masked in place (n_chars follows); copied examples and all other text, null texts too, are left as they are."""
    out = secrets.mask_live(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; a null or empty text is its end id alone, and repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the language model: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
