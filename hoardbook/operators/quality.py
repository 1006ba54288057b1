"""Row rules and references that the tables must satisfy."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook import schemas as s
from hoardbook.operators.skew import join_one_to_many


def _rules(table: str, columns: list[str]) -> dict[str, Column]:
    """Rule name -> condition that is true when a row breaks it."""
    rules = {}
    for name in s.REQUIRED.get(table, []):
        rules[f"{name} is required"] = F.col(name).isNull()
    for name, values in s.ALLOWED.get(table, {}).items():
        rules[f"{name} is not an allowed value"] = ~F.col(name).isin(values)
    for name in s.NOT_NEGATIVE.get(table, []):
        rules[f"{name} is negative"] = F.col(name) < 0
    for name in s.POSITIVE.get(table, []):
        rules[f"{name} is not positive"] = F.col(name) <= 0
    for name, longest in s.MAX_LENGTH.get(table, {}).items():
        rules[f"{name} is longer than {longest}"] = F.length(name) > longest
    return {rule: cond for rule, cond in rules.items() if rule.split(" is ")[0] in columns}


def violations(df: DataFrame, table: str, keep: list[str] | None = None) -> DataFrame:
    """One row per broken rule: table, key, rule, and the columns in ``keep``."""
    rules = _rules(table, df.columns)
    broken = F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()])
    return df.select(
        F.lit(table).alias("table_name"), F.col(s.PRIMARY_KEY[table]).alias("key"),
        *(keep or []), F.explode(F.array_compact(broken)).alias("rule"),
    )


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [violations(df, name) for name, df in tables.items()]
    )


def orphans(
    tables: dict[str, DataFrame], rows_per_task: int | None = None
) -> DataFrame:
    """Rows whose parent is missing: table, key, and the value that leads nowhere.

    The distinct references are checked, not the rows, so a parent with very many children is
    looked up once.
    """
    found = []
    for child, (column, parent) in s.FOREIGN_KEYS.items():
        if child not in tables or parent not in tables:
            continue
        parents = tables[parent].select(F.col(s.PRIMARY_KEY[parent]).alias("reference"))
        children = tables[child].select(
            F.col(s.PRIMARY_KEY[child]).alias("key"), F.col(column).alias("reference")
        )
        lost = children.select("reference").distinct().join(parents, "reference", "left_anti")
        rows = join_one_to_many(lost, children, ["reference"], ["key"], "inner", rows_per_task)
        found.append(rows.select(F.lit(child).alias("table_name"), "key", "reference"))
    return reduce(DataFrame.unionByName, found)
