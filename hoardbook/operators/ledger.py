"""Reports over purchases, items and sales."""

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.functions import ordering as o
from hoardbook.functions.numbers import safe_ratio
from hoardbook.functions.text import contains_any, is_filled
from hoardbook.operators.catalog import sample
from hoardbook.operators.keysets import rows_with_keys
from hoardbook.operators.skew import join_one_to_many
from hoardbook.schemas import APPENDABLE_STATUSES, MONEY, OWNED_STATUSES
from hoardbook.sources.staging import staged

POSTERS = 24
SUM = "decimal(22,2)"

COLLECTION_SORTS = {
    "name": [(o.asc, "name")],
    "value_desc": [(o.desc_nulls_last, "market_value")],
    "value_asc": [(o.asc, "market_value")],
    "acquired_desc": [(o.desc_nulls_last, "purchase_date"), (o.asc, "name")],
    "acquired_asc": [(o.asc, "purchase_date"), (o.asc, "name")],
    "basis_desc": [(o.desc_nulls_last, "total_basis")],
    "status": [(o.asc, "status"), (o.asc, "name")],
}
DEFAULT_SORT = "name"

LEDGER_COLUMNS = [
    "item_id", "acquisition_id", "name", "set_code", "status", "condition", "grader", "grade",
    "total_basis", "market_value", "sale_date", "net_proceeds", "realized_profit", "holding_days",
    "purchase_date", "source", "sold_via",
]
BASE_COLUMNS = [
    "item_id", "acquisition_id", "name", "set_code", "status", "condition", "grader", "grade",
    "total_basis", "market_value", "realized_profit", "sale_date", "purchase_date", "variant",
    "collector_number", "image_url", "game", "acquisition_description",
]
DETAIL_COLUMNS = [
    "item_id", "acquisition_id", "name", "set_code", "status", "condition", "grader", "grade",
    "total_basis", "market_value", "sale_date", "net_proceeds", "realized_profit", "holding_days",
    "purchase_date", "source", "sold_via", "variant", "collector_number", "language", "image_url",
    "tcgplayer_product_id", "storage_location", "cost_basis", "grade_candidate",
    "graded_value_est", "cert_number", "grade_date", "grading_fee", "grading_ship",
    "grading_extra", "grading_total", "notes", "acquisition_description", "game", "product_type",
]


def total_basis() -> Column:
    """What an item cost in all; null when its basis is not known."""
    return F.col("cost_basis") + F.col("grading_total")


def ledger_rows(
    acquisitions: DataFrame, items: DataFrame, sales: DataFrame, rows_per_task: int | None = None,
    tiers: DataFrame | None = None,
) -> DataFrame:
    """Every item with its purchase and its sales, once per sale, with basis and profit.

    Carries the columns of the item ledger, of its base and of the card detail in one pass.
    ``tiers`` (item_id, tier), read twice, adds the grading tier of the items.
    """
    boxes = acquisitions.select(
        "acquisition_id", "purchase_date", "source", "product_type",
        F.col("description").alias("acquisition_description"), F.col("game").alias("_box_game"),
    )
    sold = sales.select(
        "sale_id", "item_id", "sale_date", "net_proceeds", F.col("channel").alias("sold_via")
    )
    if tiers is not None:
        # Tiers go with the few columns of the sales, so that items do not move for them.
        alone = tiers.join(sold.select("item_id"), "item_id", "left_anti")
        sold = sold.join(tiers, "item_id", "left").unionByName(alone, allowMissingColumns=True)
    # Sales first: their columns are fewer than those of purchases, and items without any are found without these.
    rows = join_one_to_many(items, sold, ["item_id"], ["sale_id"], "left", rows_per_task)
    rows = join_one_to_many(boxes, rows, ["acquisition_id"], ["item_id"], "inner", rows_per_task)
    is_sold = F.col("sale_id").isNotNull()
    return rows.withColumns({
        "total_basis": total_basis(),
        "realized_profit": F.when(is_sold, F.col("net_proceeds") - total_basis()),
        "holding_days": F.when(is_sold, F.datediff("sale_date", "purchase_date")),
        "game": F.coalesce("game", "_box_game"),
    }).drop("_box_game")


def item_ledger(acquisitions, items, sales, rows_per_task: int | None = None) -> DataFrame:
    return ledger_rows(acquisitions, items, sales, rows_per_task).select(*LEDGER_COLUMNS)


def item_ledger_base(acquisitions, items, sales, rows_per_task: int | None = None) -> DataFrame:
    return ledger_rows(acquisitions, items, sales, rows_per_task).select(*BASE_COLUMNS)


def card_detail(acquisitions, items, sales, keys: DataFrame | None = None) -> DataFrame:
    """Full detail of items, of a key set (column ``item_id``) or of all."""
    if keys is not None:
        items = rows_with_keys(items, keys, "item_id", ["item_id"])
        sales = rows_with_keys(sales, keys, "item_id", ["sale_id"])
    return ledger_rows(acquisitions, items, sales).select(*DETAIL_COLUMNS)


def collection(
    acquisitions, items, sales, name: str = "", game: str = "", status: str = "",
    sort: str | None = DEFAULT_SORT,
) -> DataFrame:
    """Ledger base filtered by name, game and status, each only when given, then sorted."""
    rows = item_ledger_base(acquisitions, items, sales)
    if name.strip():
        columns = [F.col(c) for c in ("name", "set_code", "collector_number")]
        rows = rows.where(contains_any(columns, name.strip()))
    if game.strip():
        rows = rows.where(F.col("game") == game.strip())
    if status.strip():
        rows = rows.where(F.col("status") == status.strip())
    if sort is None:
        return rows
    order = o.pick(COLLECTION_SORTS, sort, DEFAULT_SORT)
    return rows.orderBy(*order, "item_id", o.asc("sale_date"))


def box_items(
    acquisitions, items, sales, candidates: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Ledger rows of boxes, by name, each with its grading tier."""
    if keys is not None:
        items = rows_with_keys(items, keys, "acquisition_id", ["item_id"])
        acquisitions = acquisitions.join(keys, "acquisition_id", "left_semi")
    tiers = staged(candidates.select("item_id", "tier"), "tiers")
    return ledger_rows(acquisitions, items, sales, tiers=tiers).select(*BASE_COLUMNS, "tier").orderBy(
        "acquisition_id", "name", "item_id"
    )


def _sales_per_item(sales: DataFrame, keys: list[str] = ["item_id"]) -> DataFrame:
    return sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sales"), F.sum("net_proceeds").alias("sale_net")
    )


def box_pl(
    acquisitions: DataFrame, items: DataFrame, sales: DataFrame, dedupe_sales: bool = False
) -> DataFrame:
    """Profit and loss per purchase.

    An item sold twice counts twice in its box's item sums, once per sale; ``dedupe_sales``
    counts it once. Sums go up in steps (sales to items, items to boxes), so each join is
    between inputs that are unique on the key and no fan-out is ever shuffled. Sales that come with
    the purchase of their item (``acquisition_id``) are joined by both, which needs no exchange
    where all tables are bucketed by purchase.
    """
    return box_report(acquisitions, box_sums(items, sales, dedupe_sales))


# Sums per purchase that its report is made of; they add up over any division of its items.
STATE = ("_grading", "_items", "_at_open", "_realized", "_unsold")


def item_sums(items: DataFrame, sales: DataFrame, dedupe_sales: bool = False) -> DataFrame:
    """What each item adds to the sums of its purchase: (acquisition_id, item_id, ``STATE``)."""
    keys = [c for c in ("acquisition_id", "item_id") if c in sales.columns]
    times = F.lit(1) if dedupe_sales else F.coalesce("n_sales", F.lit(1)).cast("decimal(10,0)")
    owned = F.col("status").isin(OWNED_STATUSES)

    def total(value: Column) -> Column:
        return (value * times).cast(SUM)

    return items.select(
        "item_id", "acquisition_id", "grading_total", "market_value_at_open", "market_value",
        "status",
    ).join(_sales_per_item(sales, keys), keys, "left").select(
        "acquisition_id", "item_id", total(F.col("grading_total")).alias("_grading"),
        times.cast("bigint").alias("_items"), total(F.col("market_value_at_open")).alias("_at_open"),
        F.col("sale_net").alias("_realized"),
        total(F.when(owned, F.col("market_value"))).alias("_unsold"),
    )


def box_sums(items: DataFrame, sales: DataFrame, dedupe_sales: bool = False) -> DataFrame:
    """(acquisition_id, ``STATE``) of every purchase that has items."""
    return item_sums(items, sales, dedupe_sales).groupBy("acquisition_id").agg(
        *[F.sum(c).alias(c) for c in STATE]
    )


def corrections(
    before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """By how much the sums of purchases change between two states of some (items, sales); purchases
    whose sums stay are left out. Rows that are the same in both may be left out of both."""
    left = box_sums(*before).select("acquisition_id", *[(-F.col(c)).alias(c) for c in STATE])
    moved = box_sums(*after).unionByName(left).groupBy("acquisition_id").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in STATE]
    )
    return moved.where(" or ".join(f"{c} <> 0" for c in STATE))


def corrected(state: DataFrame, moved: DataFrame) -> DataFrame:
    """``box_sums`` after ``corrections``."""
    kinds = {f.name: f.dataType for f in state.schema}
    both = state.unionByName(moved.select("acquisition_id", *[F.col(c).cast(kinds[c]).alias(c) for c in STATE]))
    return both.groupBy("acquisition_id").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in STATE])


def box_report(acquisitions: DataFrame, per_box: DataFrame) -> DataFrame:
    """Profit and loss of purchases from their sums (``box_sums``)."""

    def known(column: str) -> Column:
        return F.coalesce(column, F.lit(0)).cast(SUM)

    boxes = acquisitions.select(
        "acquisition_id", "purchase_date", "description", "game", "total_cost", "packs_total"
    ).join(per_box, "acquisition_id", "left")
    sums = boxes.withColumns({
        "grading_spend": known("_grading"),
        "items": F.coalesce("_items", F.lit(0)),
        "ev_at_open": known("_at_open"),
        "realized_net": known("_realized"),
        "unsold_value": known("_unsold"),
    })
    invested = F.col("total_cost") + F.col("grading_spend")
    recovered = F.col("realized_net") + F.col("unsold_value")
    net = recovered - F.col("total_cost") - F.col("grading_spend")
    hundred = F.lit(100).cast("decimal(3,0)")
    return sums.select(
        "acquisition_id", "purchase_date", "description", "game", "total_cost", "grading_spend",
        invested.cast(SUM).alias("total_invested"), "packs_total",
        safe_ratio(F.col("total_cost"), F.col("packs_total").cast("decimal(12,0)"), 2)
        .cast(MONEY).alias("cost_per_pack"),
        "items", "ev_at_open", "realized_net", "unsold_value",
        recovered.cast(SUM).alias("recovered_value"),
        F.round(net, 2).cast(SUM).alias("net_result"),
        safe_ratio(hundred * net.cast(SUM), invested.cast(SUM), 1)
        .cast("decimal(22,1)").alias("roi_pct"),
    )


def newest_first(boxes: DataFrame) -> DataFrame:
    return boxes.orderBy(o.desc("purchase_date"), F.col("acquisition_id").desc())


def boxes_by_key(acquisitions: DataFrame, keys: DataFrame) -> DataFrame:
    """Purchases of a key set (column ``acquisition_id``)."""
    return acquisitions.select(
        "acquisition_id", "purchase_date", "description", "game", "product_type", "set_code",
        "language", "packs_total", "packs_opened", "status", "source", "channel", "total_cost",
    ).join(keys.select("acquisition_id").distinct(), "acquisition_id", "left_semi")


def portfolio(acquisitions: DataFrame, items: DataFrame, sales: DataFrame) -> DataFrame:
    """All-time totals in one row: invested, realised and unrealised."""

    def total(value) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast(SUM)

    owned = F.col("status").isin(OWNED_STATUSES)
    sold = items.join(_sales_per_item(sales), "item_id").select(
        (F.col("sale_net") - F.col("n_sales").cast("decimal(10,0)") * total_basis()).alias("profit")
    )
    held = items.agg(
        total(F.when(owned, F.col("market_value"))).alias("unsold_market_value"),
        total(F.when(owned, F.col("market_value") - total_basis())).alias("unrealized_profit"),
    )
    return held.select(
        acquisitions.agg(total("total_cost")).scalar().alias("total_invested"),
        sales.agg(total("net_proceeds")).scalar().alias("total_realized_net"),
        sold.agg(total("profit")).scalar().alias("realized_profit"),
        "unsold_market_value", "unrealized_profit",
    )


def games(acquisitions: DataFrame, items: DataFrame) -> DataFrame:
    """Games in the collection: an item's own, else its purchase's."""
    # Items are reduced to (box, game) pairs, then joined to their boxes.
    pairs = items.select("acquisition_id", "game").distinct()
    boxes = acquisitions.select("acquisition_id", F.col("game").alias("_box_game"))
    return (
        pairs.join(boxes, "acquisition_id")
        .select(F.coalesce("game", "_box_game").alias("game"))
        .where(F.col("game").isNotNull()).distinct().orderBy("game")
    )


def statuses(items: DataFrame) -> DataFrame:
    return items.select("status").distinct().orderBy(o.asc("status"))


def appendable_boxes(acquisitions: DataFrame) -> DataFrame:
    """Purchases that more cards can be added to, newest first."""
    return newest_first(
        acquisitions.where(F.col("status").isin(APPENDABLE_STATUSES)).select(
            "acquisition_id", "description", "packs_opened", "packs_total", "status",
            "purchase_date",
        )
    ).drop("purchase_date")


def posters(items: DataFrame, limit: int = POSTERS, seed: int = 0) -> DataFrame:
    rows = items.where(is_filled(F.col("image_url"))).select(
        "item_id", "name", "set_code", "image_url", "market_value"
    )
    return sample(rows, "item_id", limit, seed)
