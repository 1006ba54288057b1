"""Explicit positions in a total order, without sorting everything in one task."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hoardbook.functions import ordering as o
from hoardbook.sources.staging import staged

_PLACE_BITS = 33  # of a row's place in its partition, in Spark's monotonically increasing ids


def positioned(rows: DataFrame, order: list[Column], into: str = "position") -> DataFrame:
    """Add ``into``: 1, 2, 3, ... in the order of ``order``.

    Rows are dealt out by ranges of the order, whose bounds Spark samples, and sorted range by range;
    their places within the ranges are stored with them. Counts per range, one row each, give the rows
    before a range. ``order`` should tell all rows apart: then no range can get too full, and every run
    gives the same positions.
    """
    placed = staged(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()), "positions",
    )
    part = F.shiftright("_place", _PLACE_BITS)
    local = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        into, F.col("_start") + local + 1
    ).drop("_place", "_part", "_start")


def positions_by(
    rows: DataFrame, sorts: dict[str, list[tuple]], keys: list[str]
) -> DataFrame:
    """``keys`` of all rows with their position under every named sort: (sort, position, keys).

    Ties are in the order of the keys, which tell the rows apart; null keys come last.
    """
    needed = {name for order in sorts.values() for _, name in order}
    narrow = staged(rows.select(*keys, *sorted(needed - set(keys))), "sorted-rows")
    found = None
    for name, order in sorts.items():
        columns = list(dict.fromkeys([*keys, *[c for _, c in order]]))
        one = positioned(narrow.select(*columns), [*o.columns(order), *map(o.asc, keys)]).select(
            F.lit(name).alias("sort"), "position", *keys
        )
        found = one if found is None else found.unionByName(one)
    return found
