"""Orderings with the null placement written out: ascending puts nulls last, descending first."""

from pyspark.sql import Column, functions as F


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def desc_nulls_last(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def columns(order: list[tuple]) -> list[Column]:
    """Sort columns of an order written as (direction, column name) pairs."""
    return [direction(name) for direction, name in order]


def pick(sorts: dict[str, list[tuple]], key: str, default: str) -> list[Column]:
    """Named sort order; an unknown name gives the default."""
    return columns(sorts.get(key, sorts[default]))
