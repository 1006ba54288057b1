"""Intake: export rows and typed rows become cards, batch summaries and acquisition rows."""

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.functions import cards as c
from hoardbook.functions.numbers import (
    checkbox, clean_number, does_not_fit, money, positive_whole_number, quantity, whole_number,
)
from hoardbook.functions.text import blank_to_null, strip
from hoardbook.operators.numbering import running_before
from hoardbook.schemas import MONEY, SEALED_TYPES

NO_ROWS = ("No item rows parsed — check the CSV format (expected a 'Product Name' column).")
COPIES_PER_CHUNK = 10_000
DEFAULT_GAME = "weiss"
DEFAULT_TYPE = "sealed_box"

CARD_COLUMNS = [
    "batch_id", "row_pos", "name", "game", "set_code", "collector_number", "variant",
    "condition", "market_value", "tcgplayer_product_id", "image_url", "paid", "quantity",
    "has_paid_column", "misfit",
]


def _misfit(market_value: str, paid: str, copies: str) -> Column:
    """The fields of a row whose numbers are too large to be held; '' if there is none."""
    return F.concat_ws(", ", *[
        F.when(does_not_fit(F.col(text), read(F.col(text))), F.lit(field))
        for field, text, read in (
            ("market_value", market_value, money), ("paid", paid, money), ("quantity", copies, whole_number),
        )
    ]).alias("misfit")


def normalize_export(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """Named export rows, one output row each, with codes, amounts and a quantity. ``misfit`` names the
    fields whose numbers are too large; their batches are rejected.

    ``legacy`` applies the older loader's rules: the number always loses its last word, the set
    comes from the number, and no game is told. It also keeps the price and paid texts.
    """
    named = rows.where(F.col("name") != "")
    if legacy:
        number = c.legacy_collector_number(F.col("number"))
        game, sets = F.lit(None).cast("string"), c.legacy_set_code(number)
    else:
        number = c.collector_number(F.col("number"), F.col("rarity"))
        game = c.game_code(F.col("product_line"))
        sets = c.set_code(game, number, F.col("set_name"))
    out = named.select(
        "batch_id", "row_pos", "name", game.alias("game"), sets.alias("set_code"),
        number.alias("collector_number"),
        c.variant(F.col("rarity"), F.col("printing")).alias("variant"),
        c.condition_code(F.col("condition")).alias("condition"),
        money(F.col("price")).alias("market_value"),
        F.nullif("product_id", F.lit("")).alias("tcgplayer_product_id"),
        F.nullif("image_url", F.lit("")).alias("image_url"),
        money(F.col("paid")).alias("paid"),
        quantity(F.col("quantity")).alias("quantity"),
        "has_paid_column", _misfit("price", "paid", "quantity"),
        *([F.col("price").alias("price_text"), F.col("paid").alias("paid_text")] if legacy else []),
    )
    return out


def normalize_typed(rows: DataFrame) -> DataFrame:
    """Rows typed by hand in the shape of normalised export rows; blanks are nulls.

    Typed rows have no product line, so a game is known only when it was typed.
    """
    missing = [n for n in ("game", "tcgplayer_product_id") if n not in rows.columns]
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else rows

    def text(name: str) -> Column:
        return blank_to_null(F.col(name))

    paid = money(F.col("paid"))
    return rows.where(text("name").isNotNull()).select(
        "batch_id", F.col("row_idx").alias("row_pos"), text("name").alias("name"),
        F.lower(text("game")).alias("game"), text("set_code").alias("set_code"),
        text("collector_number").alias("collector_number"), text("variant").alias("variant"),
        text("condition").alias("condition"), money(F.col("market_value")).alias("market_value"),
        text("tcgplayer_product_id").alias("tcgplayer_product_id"),
        text("image_url").alias("image_url"), paid.alias("paid"),
        quantity(F.col("qty")).alias("quantity"), paid.isNotNull().alias("has_paid_column"),
        _misfit("market_value", "paid", "qty"),
    )


def batch_summary(rows: DataFrame) -> DataFrame:
    """Per batch: card count, value, amount paid, games, and the first set in file order.

    Works on rows before their quantities are expanded.
    """
    price = F.col("market_value") * F.col("quantity")
    paid = F.col("paid") * F.col("quantity")
    has_set = F.coalesce(F.col("set_code"), F.lit("")) != ""
    return rows.groupBy("batch_id").agg(
        F.sum(F.col("quantity").cast("bigint")).alias("n_cards"),
        F.min_by("set_code", F.when(has_set, F.col("row_pos"))).alias("set_code"),
        F.array_sort(F.collect_set("game")).alias("games"),
        F.coalesce(F.sum(price), F.lit(0)).cast("decimal(22,2)").alias("total_value"),
        F.coalesce(F.sum(paid), F.lit(0)).cast("decimal(22,2)").alias("sum_paid"),
        F.bool_or(F.col("paid").isNotNull()).alias("paid_seen"),
        F.bool_or("has_paid_column").alias("has_paid_column"),
    ).withColumn("mixed", F.size("games") > 1)


def batches_with_summary(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Every manifest row with its summary; a batch without cards has zeros and a warning."""
    joined = manifest.join(batch_summary(rows), "batch_id", "left")
    zero = F.lit(0).cast("decimal(22,2)")
    nothing = F.coalesce("n_cards", F.lit(0)) == 0
    return joined.withColumns({
        "n_cards": F.coalesce("n_cards", F.lit(0)),
        "games": F.coalesce("games", F.array().cast("array<string>")),
        "mixed": F.coalesce("mixed", F.lit(False)),
        "total_value": F.coalesce("total_value", zero),
        "sum_paid": F.coalesce("sum_paid", zero),
        "paid_seen": F.coalesce("paid_seen", F.lit(False)),
        "has_paid_column": F.coalesce("has_paid_column", F.lit(False)),
        "warnings": F.when(
            nothing & (F.coalesce("intake", F.lit("csv")) != "manual"), F.array(F.lit(NO_ROWS))
        ).otherwise(F.array().cast("array<string>")),
    })


def with_first_index(rows: DataFrame) -> DataFrame:
    """Add ``first_index``: how many cards of the batch come before this row's cards."""
    counted = rows.withColumn("_n", F.col("quantity").cast("bigint"))
    return running_before(counted, "row_pos", "_n", "first_index", ["batch_id"]).drop("_n")


def expand_quantity(rows: DataFrame, chunk: int = COPIES_PER_CHUNK) -> DataFrame:
    """One row per physical card, numbered from 0 within its row as ``copy_no``.

    Rows that stand for very many copies are cut into chunks, and the chunks are spread over
    tasks before they are expanded.
    """
    whole = rows.where(F.col("quantity") <= chunk).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(0), F.col("quantity") - 1))
    )
    chunks = (
        rows.where(F.col("quantity") > chunk)
        .withColumn(
            "_from", F.explode(F.sequence(F.lit(0), F.col("quantity") - 1, F.lit(chunk)))
        )
        .repartition("batch_id", "row_pos", "_from")
    )
    cut = chunks.withColumn(
        "copy_no",
        F.explode(F.sequence(
            F.col("_from"), F.least(F.col("_from") + (chunk - 1), F.col("quantity") - 1)
        )),
    ).drop("_from")
    return whole.unionByName(cut).drop("quantity")


def box_game() -> Column:
    """Game of a batch: 'mixed' when its cards span games, else theirs, else the one chosen."""
    return (
        F.when(F.size("games") > 1, "mixed")
        .when(F.size("games") == 1, F.get("games", F.lit(0)))
        .otherwise(F.coalesce(F.col("game"), F.lit(DEFAULT_GAME)))
    )


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def acquisition_rows(
    batches: DataFrame, legacy: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The acquisition row each batch would write, with status and opened packs.

    Opened packs default to all packs. None opened leaves the box 'sealed' (the older loader
    calls that 'partial'). ``keep`` names batch columns to carry along.
    """
    product_type = F.coalesce("product_type", F.lit(DEFAULT_TYPE))
    total = positive_whole_number(F.col("packs_total"))
    now = whole_number(F.col("packs_now"))
    by_pack = product_type.isin(SEALED_TYPES) & total.isNotNull()
    opened = F.coalesce(now, total)
    unopened = F.lit(False) if legacy else opened <= 0
    status = (
        F.when(~by_pack, "opened").when(unopened, "sealed")
        .when(opened >= total, "opened").otherwise("partial")
    )
    zero = F.lit(0)
    row = batches.select(
        "batch_id", *keep,
        _text("purchase_date").try_cast("date").alias("purchase_date"),
        _text("description").alias("description"),
        (F.coalesce(F.col("game"), F.lit(DEFAULT_GAME)) if legacy else box_game()).alias("game"),
        product_type.alias("product_type"), F.col("set_code"),
        F.coalesce(_text("language"), F.lit("EN")).alias("language"),
        total.alias("packs_total"),
        positive_whole_number(F.col("cards_per_pack")).alias("cards_per_pack"),
        F.when(by_pack, opened).otherwise(now).alias("packs_opened"),
        money(F.col("price"), zero).alias("purchase_price"), money(F.col("tax"), zero).alias("tax"),
        money(F.col("shipping"), zero).alias("shipping_in"),
        money(F.col("other_fees"), zero).alias("other_fees"),
        _text("source").alias("source"), _text("channel").alias("channel"),
        status.alias("status"),
    )
    cost = F.expr("purchase_price + tax + shipping_in + other_fees")
    return row.withColumn("total_cost", cost.cast(MONEY))


def media_title_rows(forms: DataFrame) -> DataFrame:
    """Movie titles as entered: texts as they are, numbers and check boxes read."""
    return forms.select(
        "title", "type", "genre", clean_number(F.col("total_seasons")).alias("total_seasons"),
        checkbox(F.col("ongoing_ind")).alias("ongoing_ind"),
        checkbox(F.col("complete_collection")).alias("complete_collection"), "brand", "tmdb_id",
    )


def media_copy_rows(forms: DataFrame) -> DataFrame:
    def number(name: str) -> Column:
        return clean_number(F.col(name)).alias(name)

    def tick(name: str) -> Column:
        return checkbox(F.col(name)).alias(name)

    return forms.select(
        clean_number(F.col("media_title_id")).cast("bigint").alias("media_title_id"),
        number("season_number"), number("season_part"), number("episodes"), "location_label",
        "season_name", tick("box_set"), tick("complete_season"), "tmdb_id", "disk_type",
        number("disk_region"), number("file_size"), "category", tick("compressed"),
        number("adjusted_file_size"), "disk_type_uploaded",
    )


def purchase_rows(forms: DataFrame, copy_column: str) -> DataFrame:
    """Purchases of either catalogue; ``copy_column`` names the key of the copy."""
    return forms.select(
        clean_number(F.col(copy_column)).cast("bigint").alias(copy_column),
        F.nullif(strip(F.col("purchase_date")), F.lit("")).try_cast("date").alias("purchase_date"),
        clean_number(F.col("cost")).try_cast(MONEY).alias("cost"), "store", "condition", "notes",
    )


def game_title_rows(forms: DataFrame) -> DataFrame:
    return forms.select(
        "title", "franchise", "genre", "developer", "publisher",
        clean_number(F.col("release_year")).try_cast("smallint").alias("release_year"), "rawg_id",
        checkbox(F.col("complete_collection")).alias("complete_collection"),
    )


def game_copy_rows(forms: DataFrame) -> DataFrame:
    return forms.select(
        clean_number(F.col("game_title_id")).cast("bigint").alias("game_title_id"), "platform",
        "edition", "region", "condition", "location_label", "notes",
    )
