"""Token counts of whole texts, with a piece count per distinct pre-token.

No piece of the vocabulary holds a space mark after another character, so merges
never cross the start of a run of spaces: a text's pre-tokens are its runs of
spaces with what follows.

1. One scan lists the distinct pre-tokens of the whole table with their frequencies.
2. The pieces of each distinct pre-token are counted once.
3. A second scan takes each document's pre-token frequencies. The most frequent
   pre-tokens, at most ``HOT``, meet their counts in the worker; all others are joined
   by shuffle. Products are summed per document; no document's ids are ever built.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearnames.llm.frequency import frequent_from, is_frequent, with_rare
from nearnames.runtime import materialise, slices, tune, worker_state

LIMIT = 4096
#: Pre-tokens whose counts every worker holds (about 150 bytes each).
HOT = 200_000
#: Pre-tokens that a task counts before it hands them on.
MEMO = 500_000
_RUN = re.compile(r" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space; '' is a lone last space."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _RUN.findall(" " + text)]
    return text.split(" ")


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece crosses the start of a run of spaces: texts can't be cut there")
        # The library adds a space mark of its own to each string.
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def pieces(self, words: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        return [len(x) if w else self.lone for w, x in zip(words, self.model.encode(words, num_threads=1), strict=True)]


def counter(path: str) -> PieceCounter:
    return worker_state(("counts", path), lambda: PieceCounter(path))


def _vocabulary(kept: DataFrame, path: str) -> DataFrame:
    """(word, n, pieces): each distinct pre-token once."""

    def words(batches):
        worker_state("words", dict)  # what other operators kept goes
        seen: Counter = Counter()
        for batch in batches:
            for texts in slices(batch.column(0).to_pylist()):
                for t in texts:
                    seen.update(pre_tokens(t))
                if len(seen) > MEMO:
                    yield from hand_on(seen)
                    seen = Counter()
        yield from hand_on(seen)

    def hand_on(seen):
        items = list(seen.items())
        for i in range(0, len(items), 10_000):
            part = items[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    def pieces(batches):
        c = counter(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [x for part in slices(words) for x in c.pieces(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["word", "n", "pieces"])

    distinct = kept.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(distinct.mapInArrow(pieces, "word string, n long, pieces long"), "words")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row per row of ``docs``.

    Null and empty texts count 0. Texts of any length are counted whole. Repeated
    rows and null ids give a row each; an empty table gives none; other columns are
    ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    vocabulary = _vocabulary(kept, path)
    least = frequent_from(vocabulary, hot)
    frequent = spark.sparkContext.broadcast({r["word"]: r["pieces"] for r in vocabulary.where(is_frequent(least)).select("word", "pieces").collect()})

    def count(batches):
        worker_state("words", dict)
        known, row = frequent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, total, rare = batch.column(1), [], []
            size = pc.binary_length(texts.cast(pa.binary()))
            for t in texts.to_pylist():
                freq, n, others = Counter(pre_tokens(t)), 0, []
                for w, k in freq.items():
                    x = known.get(w)
                    if x is None:
                        others.append({"word": w, "n": k})
                    else:
                        n += k * x
                total.append(n), rare.append(others)
            ids = pa.array(range(row, row + len(total)), pa.int64())
            row += len(total)
            kinds = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), size.cast(pa.int64()), pa.array(total, pa.int64()), pa.array(rare, kinds)], ["row", "doc_id", "n_bytes", "known", "rare"])

    rows = materialise(kept.mapInArrow(count, f"row long, doc_id {kind}, n_bytes long, known long, rare array<struct<word:string,n:long>>"), "counts")
    n_tokens = F.col("known") + F.coalesce("rest", F.lit(0))
    rest = vocabulary.where(~is_frequent(least))
    return with_rare(rows, rest, "word", "pieces").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
