"""Registered queries of the training-data operators: (spark, folder of the given tables) -> rows."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from hoardbook.llm import (
    dedup_exact, dedup_near, licenses, main_text, mixing, packing, periodic, pii, quality, secrets,
    token_counts, vector_join, whitening,
)
from hoardbook.llm.common import text_digest

TOKENIZER = "word_bpe_49k.json"
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op1_packing(spark, folder):
    docs = _table(spark, folder, "documents")
    return packing.pack(docs, tokenizer_path(), with_ids=False)


@query
def op2_token_counts(spark, folder):
    return token_counts.token_counts(_table(spark, folder, "documents"), tokenizer_path())


@query
def op3_vector_join(spark, folder):
    return vector_join.linked_vectors(_table(spark, folder, "embeddings"))


@query
def op4_exact_dedup(spark, folder):
    docs = _table(spark, folder, "documents")
    return dedup_exact.exact_groups(docs, carry={"text_sha256": text_digest()})


@query
def op5_quality(spark, folder):
    labels = _table(spark, folder, "labels")
    return quality.judged(
        _table(spark, folder, "documents"), labels.where("quality = 1 and toxic = 0").select("doc_id")
    )


@query
def op6_secrets(spark, folder):
    spans = secrets.secret_spans(_table(spark, folder, "documents"))
    kinds = (*secrets.KINDS, "markov")
    return spans.select(
        "doc_id",
        *[secrets.kind_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)],
        F.sha2(secrets.span_text(F.col("base"), kinds), 256).alias("base_sha256"),
        secrets.span_text(F.sort_array(F.concat("base", "extra")), kinds).alias("spans"),
    )


@query
def op7_pii(spark, folder):
    spans = pii.personal_spans(_table(spark, folder, "documents"))
    kinds = (*pii.KINDS, *[f"context_{kind}" for kind in pii.KINDS])
    return spans.select(
        "doc_id",
        *[secrets.kind_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(secrets.span_text(F.col("base"), kinds), 256).alias("base_sha256"),
        secrets.span_text(F.sort_array(F.concat("base", "extra")), kinds).alias("spans"),
    )


@query
def op8_near_dedup(spark, folder):
    return dedup_near.near_groups(_table(spark, folder, "documents"))


@query
def op9_mixing(spark, folder):
    sizes = mixing.sized(_table(spark, folder, "documents"))
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_licenses(spark, folder):
    found = licenses.license_scan(_table(spark, folder, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


@query
def op11_periodic(spark, folder):
    docs = _table(spark, folder, "documents")
    return periodic.digests(periodic.periodic_runs(docs, text=periodic.with_planted_repeats(docs)))


@query
def op12_whitening(spark, folder):
    return whitening.whitened_components(_table(spark, folder, "embeddings"))


@query
def op13_main_text(spark, folder):
    return main_text.extracted(_table(spark, folder, "pages"))
