"""What lies at a location, across all three collections."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hoardbook.functions import ordering as o
from hoardbook.functions.text import contains_any
from hoardbook.operators.catalog import Catalog, location_count, search

KINDS = ("movies", "cards", "games")


def cards_at(items: DataFrame, location: str) -> DataFrame:
    """Cards whose storage place contains the label, by name."""
    return _cards(items, location).orderBy(o.asc("name"), "item_id")


def _cards(items: DataFrame, location: str) -> DataFrame:
    return items.where(contains_any([F.col("storage_location")], location)).select(
        "item_id", "name", "set_code", "condition", "status", "storage_location"
    )


def _tagged(kind: str, rows: DataFrame, key: str, title: str, place: str) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("collection"), F.col(key).alias("entry_id"),
        F.col(title).alias("title"), F.col(place).alias("location"),
        *[c for c in rows.columns if c not in (key, title, place)],
    )


def locate(
    media: Catalog, items: DataFrame, games: Catalog, location: str, kind: str = "all"
) -> DataFrame:
    """Entries of the collections asked for at a location, each tagged with its collection.

    An unknown kind means all of them; a blank location finds nothing.
    """
    location = location.strip()
    wanted = [kind] if kind in KINDS else list(KINDS)
    parts = {
        "movies": _tagged("movies", search(media, location=location), "dvd_id", "title",
                          "location_label"),
        "cards": _tagged("cards", _cards(items, location), "item_id", "name", "storage_location"),
        "games": _tagged("games", search(games, location=location), "game_copy_id", "title",
                         "location_label"),
    }
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts[k] for k in wanted]
    )
    if not location:
        rows = rows.where(F.lit(False))
    purchase = [o.asc("pi_id")] if "pi_id" in rows.columns else []
    return rows.orderBy("collection", o.asc("title"), "entry_id", *purchase)


def locate_counts(
    media: Catalog, items: DataFrame, games: Catalog, location: str, kind: str = "all"
) -> DataFrame:
    """Entries per collection and in total, counted without forming the entries."""
    location = location.strip()
    wanted = ([kind] if kind in KINDS else list(KINDS)) if location else []
    counts = {
        "movies": location_count(media, location),
        "cards": _cards(items, location).agg(F.count(F.lit(1)).alias("count")),
        "games": location_count(games, location),
    }
    each = reduce(
        lambda a, b: a.unionByName(b),
        [rows.select(F.lit(k).alias("collection"), "count") for k, rows in counts.items()],
    ).where(F.col("collection").isin(wanted))
    number = lambda k: F.coalesce(F.sum(F.when(F.col("collection") == k, F.col("count"))), F.lit(0))
    return each.agg(
        *[number(k).alias(k) for k in KINDS], F.coalesce(F.sum("count"), F.lit(0)).alias("total")
    )
