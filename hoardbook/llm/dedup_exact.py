"""Exact duplicates by recipes: texts become lists of content-defined chunks; chunks are
deduplicated to verified identifiers, and documents compared by their ordered identifiers.

Only chunks of distinct content move, once; a long document travels as its recipe, about a
hundredth of its size.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.common import extended, keep_marked, staged, text_digest, with_group_totals

MASK = np.uint64((1 << 11) - 1)
LEAST, MOST = 256, 16_384
WINDOW = 32
# A fixed pseudo-random number for each byte value.
_X = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
_X = (_X ^ (_X >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
BYTE_HASH = _X ^ (_X >> np.uint64(32))


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``. A chunk ends where a hash of the last 32 bytes has 11 zero
    bits, so equal passages are cut alike wherever they stand; chunks hold 256 to 16,384 bytes,
    the last one may be shorter."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = BYTE_HASH[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # doubles the window: h over 2w bytes from two over w bytes
        shifted = h[:-width] * np.uint64(0x9E3779B97F4A7C15)
        h = h.copy()
        h[width:] ^= (shifted << np.uint64(width % 64)) | (shifted >> np.uint64(64 - width))
        width *= 2
    ends, start = [], 0
    for end in (np.flatnonzero((h >> np.uint64(40)) & MASK == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes):
    start = 0
    for end in cut_points(data):
        yield data[start:end]
        start = end


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _recipes(size):
    def run(batches):
        for batch in batches:
            texts = batch.column("_bytes").to_pylist()
            recipe = [b"".join(_digest(c, size) for c in chunks_of(t or b"")) for t in texts]
            at = batch.schema.get_field_index("_bytes")
            yield batch.set_column(at, "recipe", pa.array(recipe, pa.binary()))

    return run


def _distinct_chunks(size):
    def run(batches):
        for batch in batches:
            seen = {c for t in batch.column("_bytes").to_pylist() for c in chunks_of(t or b"")}
            chunks = list(seen)
            for at in range(0, len(chunks), 4096):
                part = chunks[at:at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(c, size) for c in part], pa.binary()), pa.array(part, pa.binary())],
                    ["digest", "chunk"],
                )

    return run


def verified_size(data: DataFrame, size: int) -> int:
    """The digest length, from ``size`` bytes up, at which every two different chunks of ``_bytes``
    have different digests. Chunks are compared by content."""
    while True:
        chunks = data.mapInArrow(_distinct_chunks(size), "digest binary, chunk binary").distinct()
        clash = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if clash.isEmpty():
            return size
        if size >= 64:
            raise ValueError("two different chunks share a 64-byte digest")
        size = min(64, 2 * size)


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: dict | None = None,
    digest_bytes: int = 16,
) -> DataFrame:
    """One row per row of ``docs``: its key, keep_id, group_size, kept, and ``carry`` columns.

    Texts are equal when identical byte for byte; null counts as empty, and empty texts equal
    each other. Of a group the largest key stays (nulls only if nothing else is there); of rows
    with equal key and text one is marked as kept. ``carry`` maps names to expressions over
    ``docs`` that depend on key and text only.

    Recipes are exact: the identifiers are digests that were verified against the chunks' content;
    were two contents to share a digest, all identifiers get longer until none do.
    """
    carry = carry or {}
    data = docs.select(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_bytes"))
    size = verified_size(data, digest_bytes)
    narrow = docs.select(
        F.col(key).alias("_key"), *[e.alias(n) for n, e in carry.items()],
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_bytes"),
    )
    schema = extended(narrow.drop("_bytes"), "recipe binary")
    recipes = narrow.mapInArrow(_recipes(size), schema)
    rows = staged(
        recipes.groupBy(*schema.names).agg(F.count(F.lit(1)).alias("_copies")), "recipes"
    )
    grouped = with_group_totals(
        rows, ["recipe"], ["_key"],
        {"keep_id": ("max", "_key"), "group_size": ("sum", "_copies")},
    )
    return (
        grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .withColumn("kept", F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1))
        .select(F.col("_key").alias(key), "keep_id", "group_size", "kept", *carry)
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without exact copies; columns as in ``docs``.

    Rows to drop are found by id and the text's digest. Where rows agree in both, one is kept,
    whatever their other columns hold.
    """
    return keep_marked(docs, staged(exact_groups(docs, carry={"_sha": text_digest()}), "marks"))
