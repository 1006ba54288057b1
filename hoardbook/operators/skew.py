"""Joins that stay balanced when one key holds a large part of the rows.

By default Spark's skew rule does the work: it splits the partitions of an inner join, and those of
the kept side of an outer join, by the sizes found at run time, whatever the number of full keys.
What it cannot split, an outer join whose optional side is the uneven one, is an inner join
here, to which the optional side brings an empty row for each key it lacks. So the rows that are
kept move once, and only their keys move once more.

A caller that knows its keys to be uneven beyond what the rule sees gives ``rows_per_task``: keys
with more rows are spread over salts, however many such keys there are. Results never depend on
the salts.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def hot_keys(rows: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows, and over how many salts to spread each. There are
    at most rows / ``rows_per_task`` of them."""
    return (
        rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts"))
    )


def join_one_to_many(
    one: DataFrame, many: DataFrame, keys: list[str], spread_by: list[str],
    how: str = "inner", rows_per_task: int | None = None,
) -> DataFrame:
    """Join ``one`` (unique on ``keys``) to ``many``, whose keys may be very uneven.

    ``how`` is 'inner', 'left' (keep rows of ``one`` without a match) or 'right' (keep rows of
    ``many`` without a match). ``spread_by`` names columns of ``many`` that differ between rows
    of one key; they choose the salt.
    """
    if rows_per_task is None:
        if how != "left":
            return one.join(many, keys, how)
        return _keeping_all(one, many, keys)
    hot = hot_keys(many, keys, rows_per_task)
    spread = F.xxhash64(*spread_by)
    no_key = ~_all_present(keys)
    many_salted = (
        many.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.when(no_key, F.pmod(spread, F.lit(_null_salts(many))))
            .otherwise(F.coalesce(F.pmod(spread, F.col("_salts")), F.lit(0))).cast("int"),
        )
        .drop("_salts")
        .withColumn("_found", F.lit(True))
    )
    one_salted = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    joined = one_salted.join(many_salted, [*keys, "_salt"], how)
    if how == "left":
        # A spread key has matches, though not under each of its salts.
        joined = joined.where(F.col("_found") | F.col("_salts").isNull())
    return joined.drop("_salt", "_salts", "_found")


def _keeping_all(one: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    """A left join as an inner one."""
    known = many.dropna(subset=keys)
    lacking = one.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
    filled = known.unionByName(lacking, allowMissingColumns=True).withColumnsRenamed(
        {key: f"_many_{key}" for key in keys}
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_many_{k}")) for k in keys])
    rest = [c for df in (one, many) for c in df.columns if c not in keys]
    return one.join(filled, same, "inner").select(*keys, *rest)


def _all_present(keys: list[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def _null_salts(rows: DataFrame) -> int:
    """Rows without a key match nothing; they spread over all partitions."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
