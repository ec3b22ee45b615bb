"""Stages that turn documents into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the
last return the columns of ``docs``, whatever other columns those hold and however they are named. Rows with a
null doc_id can be in no list of ids and stay to the end; null text is an empty document; an empty table gives
no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from tidemark.llm.vocab import vocabulary
from tidemark.session import durable

#: Probability from which a document is rejected as toxic.
TOXIC = 0.7


def _shielded(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with names that no operator uses for its columns besides doc_id and text, and the way back."""
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the bound; the model is learned from labels outside the held-out third.

    Each row is judged by its own text, rows of one doc_id included.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    plain, back = _shielded(docs)
    scored = toxicity.score_toxicity(plain, toxicity.fit(docs, labels, train))
    return scored.filter(F.col("toxicity") < TOXIC).select(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; one that loses all of them stays, empty.

    ``n_chars``, where there is one, follows the text; rows of one doc_id lose the same lines.
    """
    plain, back = _shielded(docs)
    deduped = line_dedup.dedup_lines(plain)
    changed = F.col("n_dropped") > 0
    deduped = deduped.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    out = deduped.select(*back, changed.alias("_changed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_changed"), F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.drop("_changed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones, and all that link with none.

    Rows of one doc_id stay or go together.
    """
    gone = ngram_join.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, each row judged by its own text."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents that are left."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaked),
    ("packing", pack),
]

#: The stages learn a model, link documents and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
