"""Imports of whole batches: new sealed boxes, singles, additions to boxes, the older loader.

A manifest holds one row per batch (file or typed list). Each import returns the acquisition and
item rows to store, both with their ``batch_id``; nothing is stored here. The numbered batches
and cards are staged: later steps read them several times, and a lost executor costs no more
than the step it was in.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.functions.numbers import does_not_fit, money, whole_number
from hoardbook.functions.text import blank_to_null
from hoardbook.operators.allocate import allocate_cost, box_shares
from hoardbook.operators.intake import (
    acquisition_rows, batches_with_summary, expand_quantity, with_first_index,
)
from hoardbook.operators.keysets import replace_rows, rows_with_keys, rows_without_keys
from hoardbook.operators.numbering import assign_keys, running_before
from hoardbook.operators.quality import violations
from hoardbook.operators.skew import join_one_to_many
from hoardbook.schemas import MONEY, TABLES
from hoardbook.sources.staging import staged
from hoardbook.sources.tables import conform

MODES = ["sealed", "singles", "append"]
AMOUNTS = ["price", "tax", "shipping", "other_fees"]
REQUIRED_FIELDS = {
    "sealed": ["description", "purchase_date", "price"],
    "singles": ["description", "purchase_date"],
}


@dataclass(frozen=True)
class Import:
    """Acquisition and item rows. Item rows given as a function are built when first asked for:
    who wants the boxes alone does not expand or write any card."""

    acquisitions: DataFrame
    item_source: DataFrame | Callable[[], DataFrame]

    @cached_property
    def items(self) -> DataFrame:
        return self.item_source() if callable(self.item_source) else self.item_source


def cards_of(rows: DataFrame) -> DataFrame:
    """Physical cards with ``card_index``: their place, from 0, in the batch."""
    return (
        expand_quantity(with_first_index(rows))
        .withColumn("card_index", F.col("first_index") + F.col("copy_no"))
        .drop("first_index")
    )


def item_rows(
    cards: DataFrame, batches: DataFrame, existing: DataFrame | None = None,
    rows_per_task: int | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Item rows of cards, whose basis is in ``cost_basis``.

    ``batches`` has batch_id, acquisition_id, language and n_cards. Item keys follow on from the
    existing ones, batch after batch and in card order.
    """
    batches = batches.select("batch_id", "acquisition_id", "language", "n_cards")
    numbered = assign_keys(batches, ["batch_id"], "batch_no")
    numbered = running_before(numbered, "batch_no", "n_cards", "_first_item").drop("n_cards")
    start = F.lit(0)
    if existing is not None:
        start = existing.agg(F.coalesce(F.max("item_id"), F.lit(0))).scalar()
    rows = join_one_to_many(
        numbered, cards, ["batch_id"], ["card_index"], "inner", rows_per_task
    ).withColumns({
        "item_id": start + F.col("_first_item") + F.col("card_index") + 1,
        "market_value_at_open": F.col("market_value"),
    })
    columns = [c for c in rows.columns if c in TABLES["item"].names]
    extra = ("batch_id", "card_index", *keep)
    return conform(rows.select(*columns, *extra), "item", extra)


def _numbered(rows: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Acquisition rows with new keys."""
    return staged(assign_keys(rows, ["batch_id"], "acquisition_id", existing), "import-batches")


def _boxes(keyed: DataFrame) -> DataFrame:
    return conform(keyed, "acquisition", ("batch_id",))


def _of_mode(manifest: DataFrame, mode: str, rows: DataFrame | None = None) -> DataFrame:
    """Batches of a mode; with their ``rows``, those of which every number could be held."""
    wanted = manifest.where(F.col("mode") == mode)
    if rows is None or "misfit" not in rows.columns:
        return wanted
    return wanted.join(rows.where("misfit <> ''").select("batch_id").distinct(), "batch_id", "left_anti")


def import_sealed(
    manifest: DataFrame, rows: DataFrame, acquisitions: DataFrame | None = None,
    items: DataFrame | None = None, rows_per_task: int | None = None,
) -> Import:
    """New sealed boxes: cards start without basis, then the box cost is allocated to them."""
    sealed = _of_mode(manifest, "sealed", rows)
    batches = batches_with_summary(sealed, rows)
    keyed = _numbered(acquisition_rows(batches, keep=("n_cards",)), acquisitions)

    def cards() -> DataFrame:
        mine = rows_with_keys(rows, sealed, "batch_id", ["row_pos"], rows_per_task)
        fresh = cards_of(mine).withColumn("cost_basis", F.lit(0).cast(MONEY))
        new = staged(item_rows(fresh, keyed, items, rows_per_task), "import-items")
        return _settled(_boxes(keyed), new, rows_per_task)

    return Import(_boxes(keyed), cards)


def _settled(boxes: DataFrame, new: DataFrame, rows_per_task: int | None) -> DataFrame:
    # Shares are staged, so that Spark knows them to be few: as a join of boxes and sums they seem more than the
    # items, which lie compressed in their files and would be sent to the driver in their place.
    shares = staged(box_shares(boxes.drop("batch_id"), new), "import-shares")
    return allocate_cost(boxes.drop("batch_id"), new, rows_per_task, shares).select(*new.columns)


def singles_basis(
    rows: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Cards with their as-paid basis: entered price, else paid, else market value, else 0.

    ``overrides`` has batch_id, card_index and the price entered as text. ``used_fallback``
    marks cards whose basis is their market value.
    """
    cards = cards_of(rows)
    if overrides is None:
        cards = cards.withColumn("_entered", F.lit(None).cast(MONEY))
    else:
        entered = overrides.select(
            "batch_id", F.col("card_index").cast("bigint").alias("card_index"),
            money(F.col("paid")).alias("_entered"),
        )
        # About a price per card. They may come of few rows that were expanded, by which Spark would take
        # them for few and send them to the driver.
        cards = cards.join(entered.hint("merge"), ["batch_id", "card_index"], "left")
    known = F.coalesce("_entered", "paid")
    return cards.withColumns({
        "cost_basis": F.coalesce(known, F.col("market_value"), F.lit(0)).cast(MONEY),
        "used_fallback": known.isNull() & F.col("market_value").isNotNull(),
    }).drop("_entered")


def import_singles(
    manifest: DataFrame, rows: DataFrame, overrides: DataFrame | None = None,
    acquisitions: DataFrame | None = None, items: DataFrame | None = None,
    rows_per_task: int | None = None,
) -> Import:
    """Single cards at the price paid: the purchase price is the sum of the bases."""
    singles = _of_mode(manifest, "singles", rows)
    mine = rows_with_keys(rows, singles, "batch_id", ["row_pos"], rows_per_task)
    cards = staged(singles_basis(mine, overrides), "import-cards")
    paid = cards.groupBy("batch_id").agg(F.sum("cost_basis").alias("_paid"))
    batches = batches_with_summary(singles, rows)
    nothing = F.lit(None).cast("int")
    row = (
        acquisition_rows(batches, keep=("n_cards",)).join(paid, "batch_id", "left")
        .withColumns({
            "product_type": F.lit("single"), "packs_total": nothing, "cards_per_pack": nothing,
            "packs_opened": nothing, "status": F.lit("opened"),
            "purchase_price": F.coalesce("_paid", F.lit(0)).cast(MONEY),
        }).drop("_paid")
    )
    keyed = _numbered(row, acquisitions)
    return Import(_boxes(keyed), item_rows(cards, keyed, items, rows_per_task))


def import_append(
    manifest: DataFrame, rows: DataFrame, acquisitions: DataFrame, items: DataFrame,
    rows_per_task: int | None = None, cards: DataFrame | None = None,
) -> Import:
    """Add cards to existing boxes and settle the cost of those boxes again.

    ``cards`` that come with a basis of their own keep it, and their boxes are not settled.

    Returns the boxes touched, with packs and status moved on, and all of their items. A batch
    with a row that breaks a table rule stays out as a whole, since it could not be told apart
    any more once its box has been settled.
    """
    wanted = _of_mode(manifest, "append").join(row_rejects(rows), "batch_id", "left_anti")
    listed = batches_with_summary(wanted, rows).select(
        "batch_id", "n_cards", whole_key(F.col("acquisition_id")).alias("acquisition_id"),
        F.coalesce(blank_to_null(F.col("language")), F.lit("EN")).alias("language"),
        whole_number(F.col("packs_now")).alias("packs_now"),
    ).join(acquisitions.select("acquisition_id"), "acquisition_id", "left_semi")
    batches = staged(listed, "import-batches")
    moves = batches.groupBy("acquisition_id").agg(F.sum("packs_now").alias("_more"))
    opened = F.coalesce("packs_opened", F.lit(0)) + F.col("_more")
    boxes = acquisitions.join(moves, "acquisition_id").withColumns({
        "packs_opened": F.when(F.col("_more").isNull(), F.col("packs_opened")).otherwise(opened)
        .cast("int"),
        "status": F.when(F.col("_more").isNull(), F.col("status"))
        .when(opened >= F.col("packs_total"), "opened").otherwise("partial"),
    }).drop("_more")

    def all_items() -> DataFrame:
        held = rows_with_keys(items, moves, "acquisition_id", ["item_id"], rows_per_task)
        added = cards
        if added is None:
            mine = rows_with_keys(rows, batches, "batch_id", ["row_pos"], rows_per_task)
            added = cards_of(mine).withColumn("cost_basis", F.lit(0).cast(MONEY))
        new = item_rows(added, batches.drop("packs_now"), items, rows_per_task)
        together = staged(held.unionByName(new, allowMissingColumns=True), "import-items")
        if cards is not None:
            return together
        return _settled(boxes, together, rows_per_task)

    return Import(boxes, all_items)


def import_legacy_append(
    manifest: DataFrame, rows: DataFrame, acquisitions: DataFrame, items: DataFrame,
    rows_per_task: int | None = None, status: str = "inventory",
) -> Import:
    """Additions by the older loader's rules: as-paid cards first, at their own basis, then
    the batches that settle their boxes. New items get ``status``."""
    rows = rows.withColumn("status", F.lit(status))
    based = _with_basis(_of_mode(manifest, "append"))
    paid, spread = based.where(F.col("basis") == "as_paid"), based.where(F.col("basis") == "allocate")
    counts = batches_with_summary(paid, rows).select("batch_id", "basis", "n_cards")
    first = import_append(
        paid, rows, acquisitions, items, rows_per_task,
        _legacy_cards(paid, counts, rows, rows_per_task).drop("basis"),
    )
    boxes = replace_rows(acquisitions, first.acquisitions, "acquisition_id", ["acquisition_id"])
    held = replace_rows(
        items, first.items, "acquisition_id", ["item_id"], rows_per_task,
        among=first.acquisitions,
    )
    second = import_append(spread, rows, boxes, held, rows_per_task)
    return Import(
        replace_rows(first.acquisitions, second.acquisitions, "acquisition_id", ["acquisition_id"]),
        replace_rows(
            first.items, second.items, "acquisition_id", ["item_id"], rows_per_task,
            among=second.acquisitions,
        ),
    )


def _legacy_cards(
    manifest: DataFrame, batches: DataFrame, rows: DataFrame, rows_per_task: int | None
) -> DataFrame:
    """Cards with the older loader's basis; ``batches`` has batch_id, basis and n_cards."""
    prices = manifest.select("batch_id", money(F.col("price")).alias("_price")).join(
        batches.select("batch_id", "basis", F.col("n_cards").alias("_cards")), "batch_id"
    )
    own_price = F.when(
        (F.col("_cards") == 1) & F.col("_price").isNotNull(), F.col("_price")
    ).otherwise(F.col("market_value"))
    basis = F.when(
        F.col("basis") == "as_paid",
        F.when(F.col("paid_text") != "", F.col("paid")).otherwise(own_price),
    ).otherwise(F.lit(0))
    return join_one_to_many(
        prices, cards_of(rows), ["batch_id"], ["card_index"], "inner", rows_per_task
    ).withColumn("cost_basis", basis.cast(MONEY)).drop("_price", "_cards")


def import_legacy(
    manifest: DataFrame, rows: DataFrame, acquisitions: DataFrame | None = None,
    items: DataFrame | None = None, rows_per_task: int | None = None, status: str = "inventory",
) -> Import:
    """New purchases by the older loader's rules (``rows`` normalised with ``legacy=True``). Items get
    ``status``.

    The manifest may force the basis ('allocate' or 'as_paid'); singles default to as paid. The
    purchase price is what was paid, else the price given, else the market value. A card's
    basis is its paid text, else the price given if it is the only card, else its market value;
    a text that is no number leaves it null.
    """
    rejects = legacy_rejects(manifest, rows)
    manifest = staged(
        _with_basis(manifest).join(rejects.select("batch_id"), "batch_id", "left_anti"),
        "import-manifest",
    )
    # A row with an unreadable price adds nothing to either sum.
    unreadable = (F.col("price_text") != "") & F.col("market_value").isNull()
    price_given = money(F.col("price"))
    as_paid = F.col("basis") == "as_paid"
    batches = (
        batches_with_summary(
            manifest, rows.withColumn("paid", F.when(~unreadable, F.col("paid")))
        )
        .join(
            rows.groupBy("batch_id").agg(F.bool_or(F.col("paid_text") != "").alias("_any_paid")),
            "batch_id", "left",
        )
        .withColumn("price", F.when(~as_paid, F.col("price")).otherwise(
            F.when(F.col("_any_paid"), F.col("sum_paid")).otherwise(
                F.coalesce(price_given, F.col("total_value"))
            ).cast("string")
        ))
    )
    keyed = _numbered(
        acquisition_rows(batches, legacy=True, keep=("n_cards", "basis")), acquisitions
    )
    boxes = _boxes(keyed)

    def all_items() -> DataFrame:
        mine = rows_with_keys(rows, keyed, "batch_id", ["row_pos"], rows_per_task)
        cards = _legacy_cards(manifest, keyed, mine, rows_per_task).withColumn("status", F.lit(status))
        new = staged(
            item_rows(cards, keyed.drop("basis"), items, rows_per_task, keep=("basis",)),
            "import-items",
        )
        spread = _settled(boxes, new.where(~as_paid), rows_per_task)
        return spread.unionByName(new.where(as_paid)).drop("basis")

    return Import(boxes, all_items)


def _with_basis(manifest: DataFrame) -> DataFrame:
    """Manifest with the basis forced by the user, else the one its product type implies."""
    if "basis" not in manifest.columns:
        manifest = manifest.withColumn("basis", F.lit(None).cast("string"))
    return manifest.withColumn("basis", F.coalesce(
        blank_to_null(F.col("basis")),
        F.when(F.col("product_type") == "single", "as_paid").otherwise("allocate"),
    ))


def legacy_rejects(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Batches the older loader refuses, each with the first reason found."""
    batches = batches_with_summary(_with_basis(manifest), rows)
    unnamed = blank_to_null(F.col("description")).isNull() | blank_to_null(
        F.col("purchase_date")
    ).isNull()
    reason = F.coalesce(
        F.when(unnamed, "A new purchase needs a description and a date."),
        F.when((F.col("basis") == "allocate") & money(F.col("price")).isNull(),
               "Allocating needs the price of the product."),
        F.when(F.col("n_cards") == 0, "No item rows parsed."),
    )
    return batches.select("batch_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def whole_key(value: Column) -> Column:
    """A key typed as text."""
    return F.when(value.cast("string").rlike(r"^\s*\d+\s*$"), F.trim(value.cast("string"))).try_cast(
        "bigint"
    )


def import_rejects(
    manifest: DataFrame, rows: DataFrame, acquisitions: DataFrame
) -> DataFrame:
    """Batches that may not be imported, each with the first reason found."""
    intake = F.when(F.col("intake") == "manual", "manual").otherwise("csv")
    mode = F.coalesce("mode", F.lit(""))

    def is_blank(name: str) -> Column:
        return blank_to_null(F.col(name)).isNull()

    def missing(fields: list[str]) -> Column:
        names = F.concat_ws(", ", *[F.when(is_blank(f), F.lit(f)) for f in fields])
        return F.when(names != "", F.concat(F.lit("Please fill in: "), names, F.lit(".")))

    boxes = acquisitions.select(
        F.col("acquisition_id").alias("_target"), F.lit(True).alias("_exists")
    )
    batches = batches_with_summary(manifest, rows).withColumn(
        "_target", whole_key(F.col("acquisition_id"))
    )
    empty = (F.col("n_cards") == 0) & ~((intake == "manual") & (mode == "sealed"))
    # A manifest may name the file of each upload.
    no_file = is_blank("file_name") & (intake == "csv") if "file_name" in manifest.columns else F.lit(False)
    too_large = F.concat_ws(", ", *[
        F.when(does_not_fit(F.col(f), money(F.col(f))), F.lit(f)) for f in AMOUNTS if f in manifest.columns
    ])
    # The texts a user gets to see.
    reason = F.coalesce(
        F.when(~mode.isin(MODES), "Unknown import mode."),
        *[F.when(mode == m, missing(fields)) for m, fields in REQUIRED_FIELDS.items()],
        F.when((mode == "append") & is_blank("acquisition_id"),
               "Pick an existing box to append to."),
        F.when((mode == "sealed") & (too_large != ""), F.concat(F.lit("Too large: "), too_large, F.lit("."))),
        F.when(no_file, "Choose a TCGplayer CSV export to upload."),
        F.when(empty & (intake == "manual"), "Enter at least one card."),
        F.when(empty, "No cards parsed from that CSV — check the format."),
        F.when((mode == "append") & F.col("_exists").isNull(), "That box no longer exists."),
    )
    return (
        batches.join(boxes, "_target", "left")
        .select("batch_id", reason.alias("reason")).where(F.col("reason").isNotNull())
    )


def without_rejects(frame: DataFrame, rejects: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows (manifest, export rows, items) of the batches that were not rejected."""
    return rows_without_keys(frame, rejects, "batch_id", spread_by)


def row_rejects(rows: DataFrame) -> DataFrame:
    """Batches with a normalised row that no item row could be made of."""
    cards = rows.select(
        "batch_id", F.col("row_pos").alias("item_id"), "name", "game", "condition"
    )
    broken = violations(cards, "item", ["batch_id"]).select("batch_id", "rule")
    if "misfit" in rows.columns:
        too_large = rows.where("misfit <> ''").select(
            "batch_id", F.concat("misfit", F.lit(" is too large")).alias("rule")
        )
        broken = broken.unionByName(too_large)
    return broken.groupBy("batch_id").agg(F.min("rule").alias("reason"))


def rule_rejects(result: Import) -> DataFrame:
    """Batches with a row that breaks a table rule: all of their rows must stay out."""
    parts = [
        violations(result.acquisitions, "acquisition", ["batch_id"]),
        violations(result.items, "item", ["batch_id"]),
    ]
    return parts[0].unionByName(parts[1]).groupBy("batch_id").agg(
        F.min("rule").alias("reason")
    )


def import_preview(
    manifest: DataFrame, rows: DataFrame, acquisitions: DataFrame
) -> DataFrame:
    """What each batch would do, without doing it: cards, value, cost, packs and warnings."""
    batches = batches_with_summary(manifest, rows)
    planned = acquisition_rows(batches).select(
        "batch_id", F.col("game").alias("box_game"), "status", "total_cost",
        F.col("packs_total").alias("_total"), F.col("packs_opened").alias("_opened"),
    )
    targets = acquisitions.select(
        F.col("acquisition_id").alias("_target"), F.col("packs_opened").alias("_had"),
        F.col("packs_total").alias("_of"), F.col("status").alias("_was"),
    )
    sealed, append = F.col("mode") == "sealed", F.col("mode") == "append"
    sealed_packs = F.when(F.col("_total").isNotNull(), F.concat(
        F.coalesce("_opened", F.lit(0)).cast("string"), F.lit(" / "),
        F.col("_total").cast("string"), F.lit(" → "), F.col("status"),
    ))
    target_packs = F.concat(
        F.coalesce("_had", F.lit(0)).cast("string"), F.lit(" / "),
        F.coalesce(F.col("_of").cast("string"), F.lit("?")), F.lit(" packs · "), F.col("_was"),
    )
    return (
        batches.select("batch_id", "mode", "n_cards", "total_value", "paid_seen", "warnings",
                       whole_key(F.col("acquisition_id")).alias("_target"))
        .join(planned, "batch_id").join(targets, "_target", "left")
        .select(
            "batch_id", "mode", "n_cards", "total_value",
            F.when(~append, F.col("box_game")).alias("game"),
            F.when(sealed, F.col("total_cost")).alias("total_cost"),
            F.when(sealed, sealed_packs).when(append, target_packs).alias("packs"),
            F.when(F.col("mode") == "singles", ~F.col("paid_seen")).alias("warn_paid"),
            F.concat_ws(" ", "warnings").alias("warnings"),
        )
    )
