"""Table schemas, allowed values, defaults and row rules of the three collections.

Surrogate keys are LongType throughout: the catalogues hold more rows than a 32-bit key can
number once many collections share one table.
"""

from pyspark.sql import types as T

LONG, INT, SHORT, DOUBLE = T.LongType(), T.IntegerType(), T.ShortType(), T.DoubleType()
TEXT, BOOL, DATE, TIMESTAMP = T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType()
TIMESTAMP_NTZ = T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)
GAME_COST = T.DecimalType(8, 2)
GRADE = T.DecimalType(4, 1)
FX_RATE = T.DecimalType(14, 6)
SUBGRADES = T.MapType(TEXT, GRADE)


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


MEDIA_TITLES = _struct(
    ("id", LONG), ("title", TEXT), ("type", TEXT), ("genre", TEXT), ("total_seasons", DOUBLE),
    ("ongoing_ind", BOOL), ("complete_collection", BOOL), ("brand", TEXT), ("tmdb_id", TEXT),
)
DVD_ITEMS = _struct(
    ("id", LONG), ("media_title_id", LONG), ("season_name", TEXT), ("season_number", DOUBLE),
    ("season_part", DOUBLE), ("episodes", DOUBLE), ("location_label", TEXT), ("box_set", BOOL),
    ("complete_season", BOOL), ("disk_type", TEXT), ("disk_region", DOUBLE), ("file_size", DOUBLE),
    ("category", TEXT), ("compressed", BOOL), ("adjusted_file_size", DOUBLE),
    ("disk_type_uploaded", TEXT), ("tmdb_id", TEXT),
)
MEDIA_PURCHASES = _struct(
    ("id", LONG), ("dvd_item_id", LONG), ("purchase_date", DATE), ("cost", MONEY),
    ("store", TEXT), ("condition", TEXT), ("notes", TEXT),
)
GAME_TITLES = _struct(
    ("id", LONG), ("title", TEXT), ("franchise", TEXT), ("genre", TEXT), ("developer", TEXT),
    ("publisher", TEXT), ("release_year", SHORT), ("rawg_id", TEXT), ("complete_collection", BOOL),
)
GAME_COPIES = _struct(
    ("id", LONG), ("game_title_id", LONG), ("platform", TEXT), ("edition", TEXT),
    ("region", TEXT), ("condition", TEXT), ("location_label", TEXT), ("notes", TEXT),
)
GAME_PURCHASES = _struct(
    ("id", LONG), ("game_copy_id", LONG), ("purchase_date", DATE), ("cost", GAME_COST),
    ("store", TEXT), ("condition", TEXT), ("notes", TEXT), ("created_at", TIMESTAMP_NTZ),
    ("updated_at", TIMESTAMP_NTZ),
)
ACQUISITION = _struct(
    ("acquisition_id", LONG), ("purchase_date", DATE), ("description", TEXT), ("game", TEXT),
    ("product_type", TEXT), ("set_code", TEXT), ("language", TEXT), ("quantity", INT),
    ("packs_total", INT), ("cards_per_pack", INT), ("packs_opened", INT),
    ("purchase_price", MONEY), ("tax", MONEY), ("shipping_in", MONEY), ("other_fees", MONEY),
    ("currency", TEXT), ("fx_rate_to_usd", FX_RATE), ("total_cost", MONEY), ("source", TEXT),
    ("channel", TEXT), ("status", TEXT), ("notes", TEXT), ("created_at", TIMESTAMP),
)
ITEM = _struct(
    ("item_id", LONG), ("acquisition_id", LONG), ("kind", TEXT), ("name", TEXT), ("game", TEXT),
    ("set_code", TEXT), ("collector_number", TEXT), ("variant", TEXT), ("language", TEXT),
    ("condition", TEXT), ("grader", TEXT), ("grade", GRADE), ("subgrades", SUBGRADES),
    ("cert_number", TEXT), ("grade_date", DATE), ("cost_basis", MONEY), ("grading_fee", MONEY),
    ("grading_ship", MONEY), ("grading_extra", MONEY), ("grading_total", MONEY),
    ("market_value_at_open", MONEY), ("market_value", MONEY), ("status", TEXT),
    ("grade_candidate", BOOL), ("graded_value_est", MONEY), ("storage_location", TEXT),
    ("tcgplayer_product_id", TEXT), ("image_url", TEXT), ("notes", TEXT),
    ("created_at", TIMESTAMP),
)
SALE = _struct(
    ("sale_id", LONG), ("item_id", LONG), ("sale_date", DATE), ("channel", TEXT),
    ("gross_price", MONEY), ("shipping_charged", MONEY), ("marketplace_fee", MONEY),
    ("processing_fee", MONEY), ("promo_fee", MONEY), ("shipping_paid", MONEY),
    ("supplies_cost", MONEY), ("net_proceeds", MONEY), ("notes", TEXT), ("created_at", TIMESTAMP),
)

TABLES = {
    "media_titles": MEDIA_TITLES, "dvd_items": DVD_ITEMS, "media_purchases": MEDIA_PURCHASES,
    "game_titles": GAME_TITLES, "game_copies": GAME_COPIES, "game_purchases": GAME_PURCHASES,
    "acquisition": ACQUISITION, "item": ITEM, "sale": SALE,
}

# What the tables accept.
BOX_GAMES = ["mtg", "weiss", "pokemon", "other", "mixed"]
CARD_GAMES = ["mtg", "weiss", "pokemon", "other"]
PRODUCT_TYPES = ["sealed_box", "sealed_pack", "bundle", "single", "bulk_lot", "other"]
BOX_STATUSES = ["sealed", "partial", "opened", "resold_sealed"]
ITEM_KINDS = ["card", "sealed", "bulk"]
CONDITIONS = ["NM", "LP", "MP", "HP", "DMG", "sealed"]
GRADERS = ["PSA", "BGS", "CGC", "TAG", "SGC", "other"]
ITEM_STATUSES = ["inventory", "listed", "sold", "keep", "grading", "lost"]

# Status groups used by the reports.
OWNED_STATUSES = ["inventory", "listed", "keep", "grading"]
CANDIDATE_STATUSES = ["inventory", "keep"]
APPENDABLE_STATUSES = ["sealed", "partial"]

# Product types whose cost is spread over their contents.
SEALED_TYPES = ["sealed_box", "sealed_pack", "bundle", "bulk_lot"]

# Column defaults, as SQL expressions, used when a column is not supplied.
DEFAULTS = {
    "acquisition": {
        "language": "'EN'", "quantity": "1", "tax": "0", "shipping_in": "0", "other_fees": "0",
        "currency": "'USD'", "fx_rate_to_usd": "1", "status": "'sealed'",
        "created_at": "current_timestamp()",
    },
    "item": {
        "kind": "'card'", "language": "'EN'", "cost_basis": "0", "grading_fee": "0",
        "grading_ship": "0", "grading_extra": "0", "status": "'inventory'",
        "grade_candidate": "false", "created_at": "current_timestamp()",
    },
    "sale": {
        "shipping_charged": "0", "marketplace_fee": "0", "processing_fee": "0", "promo_fee": "0",
        "shipping_paid": "0", "supplies_cost": "0", "created_at": "current_timestamp()",
    },
    "game_titles": {"complete_collection": "false"},
    "game_purchases": {
        "purchase_date": "current_date()", "created_at": "localtimestamp()",
        "updated_at": "localtimestamp()",
    },
}

# Row rules. Each table: required columns, allowed values, minimum values, text lengths.
REQUIRED = {
    "acquisition": ["purchase_date", "description", "game", "product_type", "language", "quantity",
                    "purchase_price", "tax", "shipping_in", "other_fees", "currency",
                    "fx_rate_to_usd", "status", "created_at"],
    "item": ["acquisition_id", "kind", "name", "language", "grading_fee", "grading_ship",
             "grading_extra", "status", "grade_candidate", "created_at"],
    "sale": ["item_id", "sale_date", "gross_price", "shipping_charged", "marketplace_fee",
             "processing_fee", "promo_fee", "shipping_paid", "supplies_cost", "created_at"],
    "game_titles": ["title", "complete_collection"],
    "game_copies": ["game_title_id", "platform"],
    "game_purchases": ["game_copy_id", "purchase_date", "cost", "created_at", "updated_at"],
}
ALLOWED = {
    "acquisition": {"game": BOX_GAMES, "product_type": PRODUCT_TYPES, "status": BOX_STATUSES},
    "item": {"kind": ITEM_KINDS, "game": CARD_GAMES, "condition": CONDITIONS, "grader": GRADERS,
             "status": ITEM_STATUSES},
}
NOT_NEGATIVE = {
    "acquisition": ["packs_opened", "purchase_price", "tax", "shipping_in", "other_fees"],
    "item": ["grading_fee", "grading_ship", "grading_extra"],
    "sale": ["gross_price"],
    "game_purchases": ["cost"],
}
POSITIVE = {"acquisition": ["quantity", "packs_total", "cards_per_pack", "fx_rate_to_usd"]}
MAX_LENGTH = {
    "game_titles": {"title": 255, "franchise": 150, "genre": 100, "developer": 150,
                    "publisher": 150},
    "game_copies": {"platform": 60, "edition": 100, "region": 20, "condition": 20,
                    "location_label": 255},
    "game_purchases": {"store": 150, "condition": 15},
}
PRIMARY_KEY = {
    "media_titles": "id", "dvd_items": "id", "media_purchases": "id", "game_titles": "id",
    "game_copies": "id", "game_purchases": "id", "acquisition": "acquisition_id",
    "item": "item_id", "sale": "sale_id",
}
# child table -> (foreign key column, parent table)
FOREIGN_KEYS = {
    "item": ("acquisition_id", "acquisition"),
    "sale": ("item_id", "item"),
    "game_copies": ("game_title_id", "game_titles"),
    "game_purchases": ("game_copy_id", "game_copies"),
}
