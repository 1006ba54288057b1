"""Change events folded into new table snapshots.

An event has event_id, seq, kind ('edit', 'sale', 'grade', 'location'), item_id or
acquisition_id, and a map of the texts entered. Later events (higher seq, then higher event_id) win
column by column.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.functions.numbers import grade_number, money
from hoardbook.operators.keysets import rows_with_keys, rows_without_keys
from hoardbook.operators.numbering import assign_keys
from hoardbook.operators.skew import join_one_to_many
from hoardbook.schemas import CARD_GAMES, CONDITIONS, GRADERS, ITEM, ITEM_STATUSES
from hoardbook.sources.tables import conform, with_generated

# Check-box texts that mean yes.
TICKED = ["on", "true", "1"]
FEES = ["shipping_charged", "marketplace_fee", "processing_fee", "promo_fee", "shipping_paid",
        "supplies_cost"]
GRADING_FEES = ["grading_fee", "grading_ship", "grading_extra"]


ORDER = ["seq", "event_id"]


def _when(write: Column) -> Column:
    return F.struct(*[write[c] for c in ORDER])


@dataclass(frozen=True)
class Snapshot:
    items: DataFrame
    sales: DataFrame
    rejected: DataFrame


def _entered(name: str) -> Column:
    """Text entered for a field; blank and absent are both null."""
    return F.nullif(F.try_element_at("fields", F.lit(name)), F.lit(""))


def _is_given(name: str) -> Column:
    return F.coalesce(F.map_contains_key("fields", name), F.lit(False))


def _date(name: str) -> Column:
    return _entered(name).try_cast("date")


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def event_rejects(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events that would break a table rule, each with its reason, and sales of items that do not
    exist. They change nothing."""
    judged = events.withColumn("reason", _problem())
    sales = judged.where(F.col("reason").isNull() & _is("sale"))
    unknown = rows_without_keys(sales, items, "item_id", ["event_id"])
    return judged.where(F.col("reason").isNotNull()).unionByName(
        unknown.withColumn("reason", F.lit("item_id"))
    )


def _problem() -> Column:
    """Why an event cannot be applied, or null."""

    def outside(name: str, values: list[str]) -> Column:
        return F.coalesce(~_entered(name).isin(values), F.lit(False))

    def unreadable_date(name: str) -> Column:
        return _entered(name).isNotNull() & _date(name).isNull()

    no_status = _is_given("status") & _entered("status").isNull()
    grade_lost = money(_entered("grade")).isNotNull() & grade_number(_entered("grade")).isNull()
    negative = reduce(
        lambda a, b: a | b, [F.coalesce(money(_entered(f)) < 0, F.lit(False)) for f in GRADING_FEES]
    )
    return F.coalesce(
        F.when(_is("edit") & (no_status | outside("status", ITEM_STATUSES)), "status"),
        F.when(_is("edit") & outside("condition", CONDITIONS), "condition"),
        F.when(_is("sale") & _date("sale_date").isNull(), "sale_date"),
        F.when(_is("sale") & (money(_entered("gross_price"), F.lit(0)) < 0), "gross_price"),
        F.when(_is("grade") & outside("grader", GRADERS), "grader"),
        F.when(_is("grade") & outside("status", ITEM_STATUSES), "status"),
        F.when(_is("grade") & grade_lost, "grade"),
        F.when(_is("grade") & unreadable_date("grade_date"), "grade_date"),
        F.when(_is("grade") & negative, "grading fees"),
    )


def _writes() -> dict[str, list[tuple[Column, Column]]]:
    """For each item column: (when an event writes it, what it writes)."""
    edit, sale, grade = _is("edit"), _is("sale"), _is("grade")

    def edited(name: str, value: Column) -> tuple[Column, Column]:
        return edit & _is_given(name), value

    plans = {
        "status": [
            edited("status", _entered("status")), (sale, F.lit("sold")),
            (grade, F.coalesce(_entered("status"), F.lit("inventory"))),
        ],
        "condition": [edited("condition", _entered("condition"))],
        "storage_location": [edited("storage_location", _entered("storage_location"))],
        "market_value": [edited("market_value", money(_entered("market_value")))],
        "graded_value_est": [edited("graded_value_est", money(_entered("graded_value_est")))],
        # The flag of an edit is always written: a box that is not ticked sends nothing.
        "grade_candidate": [
            (edit, F.coalesce(_entered("grade_candidate").isin(TICKED), F.lit(False))),
            (grade, F.lit(False)),
        ],
        "notes": [edited("notes", _entered("notes"))],
        "grader": [(grade, _entered("grader"))],
        "grade": [(grade, grade_number(_entered("grade")))],
        "cert_number": [(grade, _entered("cert_number"))],
        "grade_date": [(grade, _date("grade_date"))],
    }
    for fee in GRADING_FEES:
        plans[fee] = [(grade, money(_entered(fee), F.lit(0)))]
    return plans


def last_writes(events: DataFrame) -> DataFrame:
    """Per item, the last value written to each column and its seq, as ``_w_<column>`` structs.

    A struct stands for a write, so a written null differs from no write at all. One grouped
    pass with map-side combining; an item with very many events moves one row per task.
    """
    columns = []
    for name, plans in _writes().items():
        value = F.lit(None)
        written = F.lit(False)
        for when, what in reversed(plans):
            value = F.when(when, what).otherwise(value)
            written = written | F.coalesce(when, F.lit(False))
        entry = F.when(written, F.struct(
            *ORDER, value.cast(ITEM[name].dataType).alias("value")
        ))
        columns.append(F.max_by(entry, F.when(written, F.struct(*ORDER))).alias(f"_w_{name}"))
    return events.where(F.col("kind").isin("edit", "sale", "grade")).groupBy("item_id").agg(*columns)


def last_locations(events: DataFrame) -> DataFrame:
    """Per purchase, the last place set for all of its items."""
    place = F.struct(*ORDER, _entered("storage_location").alias("value"))
    return (
        events.where(_is("location")).groupBy("acquisition_id")
        .agg(F.max_by(place, F.struct(*ORDER)).alias("_w_box"))
    )


def valid_events(events: DataFrame) -> DataFrame:
    """Events that break no rule of their own."""
    return events.where(_problem().isNull())


def new_sales(
    events: DataFrame, items: DataFrame, sales: DataFrame, first: int | None = None
) -> DataFrame:
    """Sale rows of sale events; fees default to 0. Items that do not exist cannot be sold. Keys run
    from ``first`` on, else from those of ``sales``."""
    sold = events.where(_is("sale"))
    rows = join_one_to_many(items.select("item_id"), sold, ["item_id"], ["event_id"]).select(
        "event_id", "item_id", _date("sale_date").alias("sale_date"),
        _entered("channel").alias("channel"),
        money(_entered("gross_price"), F.lit(0)).alias("gross_price"),
        *[money(_entered(f), F.lit(0)).alias(f) for f in FEES],
        _entered("notes").alias("notes"),
    )
    return conform(assign_keys(rows, ["event_id"], "sale_id", sales, first=first), "sale")


def apply_changes(
    items: DataFrame, sales: DataFrame, events: DataFrame, rows_per_task: int | None = None,
    first_sale: int | None = None,
) -> Snapshot:
    """Items and sales after all events; events that break a rule are set aside. New sales are
    numbered from ``first_sale`` on, if it is given."""
    valid = valid_events(events)
    written = list(_writes())
    # Edits, sales and gradings meet items one to one; box-wide places one to many.
    changed = items.join(last_writes(valid), "item_id", "left")
    changed = join_one_to_many(
        last_locations(valid), changed, ["acquisition_id"], ["item_id"], "right", rows_per_task
    )
    own, box = F.col("_w_storage_location"), F.col("_w_box")
    place = F.when(
        box.isNotNull() & (own.isNull() | (_when(box) > _when(own))), box
    ).otherwise(own)
    changed = changed.withColumn("_w_storage_location", place)
    result = changed.withColumns({
        name: F.when(F.col(f"_w_{name}").isNotNull(), F.col(f"_w_{name}")["value"])
        .otherwise(F.col(name))
        for name in written
    }).select(*items.columns)
    return Snapshot(
        with_generated(result, "item"),
        sales.unionByName(new_sales(valid, items, sales, first_sale), allowMissingColumns=True),
        event_rejects(events, items),
    )


def backfill_game(
    acquisitions: DataFrame, items: DataFrame, rows_per_task: int | None = None
) -> DataFrame:
    """Give items without a game that of their purchase, unless the purchase is mixed."""
    single = acquisitions.where(F.col("game").isin(CARD_GAMES)).select(
        "acquisition_id", F.col("game").alias("_box_game")
    )
    return join_one_to_many(
        single, items, ["acquisition_id"], ["item_id"], "right", rows_per_task
    ).withColumn("game", F.coalesce("game", "_box_game")).select(*items.columns)


def cascade_delete(
    acquisitions: DataFrame, items: DataFrame, sales: DataFrame, removed: DataFrame,
    rows_per_task: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the removed purchases, their items and the sales of those."""
    gone = removed.select("acquisition_id").distinct()
    lost = rows_with_keys(
        items.select("item_id", "acquisition_id"), gone, "acquisition_id", ["item_id"],
        rows_per_task,
    )
    return (
        acquisitions.join(gone, "acquisition_id", "left_anti"),
        rows_without_keys(items, gone, "acquisition_id", ["item_id"], rows_per_task),
        rows_without_keys(sales, lost, "item_id", ["sale_id"], rows_per_task),
    )
