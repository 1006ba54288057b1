"""Token counts of whole texts by heap-and-linked-list byte-pair merging, without identifiers."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.bpe import counter
from hoardbook.llm.common import extended


def _counts(tokenizer: str):
    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            numbers = pa.array([count(t or "") for t in batch.column(at).to_pylist()], pa.int64())
            yield batch.set_column(at, "n_tokens", numbers)

    return run


def token_counts(
    docs: DataFrame, tokenizer: str, keys: list[str] | None = None, limit: int = 2048,
    text: str = "text",
) -> DataFrame:
    """``keys``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) per row.

    A null text counts as empty, with no bytes and no tokens. Equal rows count alike; rows stay
    in place (no shuffle), and an empty table stays empty.
    """
    rows = docs.select(
        *(keys or ["doc_id"]),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).alias("_text"),
    )
    schema = extended(rows.drop("_text"), "n_tokens bigint")
    return rows.mapInArrow(_counts(tokenizer), schema).withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
