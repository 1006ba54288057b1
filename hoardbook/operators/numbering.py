"""Running totals and key numbers without a global or per-group sort in one task."""

from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK = 1_000_000
BUCKET_DIGITS = 4


def running_before(
    rows: DataFrame, position: str, value: str, into: str, group: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the group before this one.

    ``position`` holds distinct whole numbers within the group. They are cut into blocks of
    ``block`` numbers, so a block never holds more rows than that; block totals are summed over
    the few blocks of a group, then each block is summed on its own.
    """
    group = group or []
    blocks = rows.withColumn("_block", F.floor(F.col(position) / block))
    by_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = by_group.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocks.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    within = (
        W.partitionBy(*group, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        blocks.join(starts, [*group, "_block"])
        .withColumn(into, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_block", "_start")
    )


def assign_keys(
    rows: DataFrame, unique: list[str], into: str, existing: DataFrame | None = None,
    digits: int = BUCKET_DIGITS, first: int | None = None,
) -> DataFrame:
    """Add ``into``: consecutive keys from ``first`` on, else after the largest key of ``existing``.

    ``unique`` identifies a row. Rows are numbered in the order of a digest of it: the digest's
    first ``digits`` hex digits form evenly filled buckets, whose sizes (at most 16**digits
    numbers) give each bucket its first key. The same rows get the same keys on every run.
    """
    identity = F.concat_ws("|", *[F.col(c).cast("string") for c in unique])
    hashed = rows.withColumn("_digest", F.md5(identity)).withColumn(
        "_bucket", F.left("_digest", F.lit(digits))
    )
    earlier = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
        )
    )
    before = F.lit(0 if first is None else first - 1)
    if first is None and existing is not None:
        before = existing.agg(F.coalesce(F.max(into), F.lit(0))).scalar()
    within = W.partitionBy("_bucket").orderBy("_digest", *unique)
    if digits <= BUCKET_DIGITS:
        starts = F.broadcast(starts)
    return (
        hashed.withColumn("_rank", F.row_number().over(within))
        .join(starts, "_bucket")
        .withColumn(into, (before + F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_digest", "_bucket", "_rank", "_start")
    )
