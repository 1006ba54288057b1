"""Expressions that read the card fields of an export row, trimmed as the reader leaves them."""

from pyspark.sql import Column, functions as F

from hoardbook.functions.text import strip

# Condition texts and their codes.
CONDITION_CODES = {
    "near mint": "NM", "lightly played": "LP", "moderately played": "MP",
    "heavily played": "HP", "damaged": "DMG",
}
# Product lines and their game codes.
PRODUCT_LINE_GAMES = {
    "pokemon": "pokemon",
    "weiss schwarz": "weiss",
    "magic": "mtg",
    "magic: the gathering": "mtg",
}
# Header names, in lower case, of the column that holds the price paid.
PAID_HEADERS = ["paid", "cost", "purchase price", "my cost", "price paid", "paid price"]


def _lookup(value: Column, codes: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(table, F.lower(value))


def condition_code(value: Column) -> Column:
    return _lookup(value, CONDITION_CODES)


def game_code(product_line: Column) -> Column:
    """Game of a product line; unknown and blank lines are 'other'."""
    return F.coalesce(_lookup(product_line, PRODUCT_LINE_GAMES), F.lit("other"))


def collector_number(number: Column, rarity: Column) -> Column:
    """Number without its last word when that word repeats the rarity."""
    tail = F.substring_index(number, " ", -1)
    head = F.left(number, F.length(number) - F.length(tail) - 1)
    repeats = (
        F.contains(number, F.lit(" ")) & (rarity != "")
        & (F.lower(strip(tail)) == F.lower(rarity))
    )
    return F.when(F.coalesce(repeats, F.lit(False)), strip(head)).otherwise(
        F.nullif(number, F.lit(""))
    )


def set_code(game: Column, number: Column, set_name: Column) -> Column:
    """Weiss numbers carry the set before the first dash; other games name the set."""
    return F.when(
        (game == "weiss") & F.contains(number, F.lit("-")), F.substring_index(number, "-", 1)
    ).otherwise(F.nullif(set_name, F.lit("")))


def legacy_collector_number(number: Column) -> Column:
    """Older rule: the last word always goes."""
    return F.when(
        number != "", strip(F.regexp_replace(number, "(?s) [^ ]*$", ""))
    )


def legacy_set_code(legacy_number: Column) -> Column:
    """Older rule: the part before the first dash, for every game."""
    return F.when(
        F.contains(legacy_number, F.lit("-")), F.substring_index(legacy_number, "-", 1)
    )


def variant(rarity: Column, printing: Column) -> Column:
    """Rarity, followed by the printing unless that is the normal one."""
    special = (printing != "") & (F.lower(printing) != "normal")
    text = F.when(special, strip(F.concat(rarity, F.lit(" "), printing))).otherwise(rarity)
    return F.nullif(text, F.lit(""))
