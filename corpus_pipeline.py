"""The training-data pipeline over ``documents``: each stage reads what the one before it wrote.

Every stage takes any rows with the columns of ``documents``, and more columns of any name, which it
carries along (packing returns pieces instead). Null keys, null and empty texts, repeated rows and texts
of any length are rows like any other; what a stage does with them is said at each. An empty table stays
empty through all stages. A text is held whole by one task at a time.
"""

from pyspark.sql import DataFrame, SparkSession

from hoardbook.llm import dedup_exact, dedup_near, mixing, packing, quality
from hoardbook.llm.common import staged
from hoardbook.llm.queries import tokenizer_path

# Learned models, sketches and tokens have no counterpart in SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted texts' model is not out of range. Null and empty texts
    have none and stay; equal texts of a language are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts, that of the largest id; null counts as empty, and one
    empty document stays. Of rows alike in id and text one stays."""
    return dedup_exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id. Texts without words are in
    no class and stay."""
    return dedup_near.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents as often as they are taken. Null is a source, the
    last; documents without words take no part. Ties are in the order of a hash of the id."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences. An empty document is one piece,
    the end sign; one above a window is cut into full windows and a rest."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written and read again before the next."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = staged(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return rows
