"""Keep or drop the rows of a key set."""

from pyspark.sql import DataFrame, functions as F

from hoardbook.operators.skew import join_one_to_many


def rows_with_keys(
    rows: DataFrame, keys: DataFrame, key: str, spread_by: list[str],
    rows_per_task: int | None = None,
) -> DataFrame:
    wanted = keys.select(key).distinct()
    return join_one_to_many(wanted, rows, [key], spread_by, "inner", rows_per_task).select(
        *rows.columns
    )


def replace_rows(
    stored: DataFrame, changed: DataFrame, key: str, spread_by: list[str],
    rows_per_task: int | None = None, among: DataFrame | None = None,
) -> DataFrame:
    """Stored rows, those with a key among the changed rows replaced by these.

    ``among`` names the changed keys where a shorter list of them is at hand.
    """
    keys = changed if among is None else among
    kept = rows_without_keys(stored, keys, key, spread_by, rows_per_task)
    return kept.unionByName(changed.select(*stored.columns))


def rows_without_keys(
    rows: DataFrame, keys: DataFrame, key: str, spread_by: list[str],
    rows_per_task: int | None = None,
) -> DataFrame:
    unwanted = keys.select(key).distinct().withColumn("_unwanted", F.lit(True))
    return (
        join_one_to_many(unwanted, rows, [key], spread_by, "right", rows_per_task)
        .where(F.col("_unwanted").isNull()).select(*rows.columns)
    )
