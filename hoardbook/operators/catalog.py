"""The title / copy / purchase catalogues: base rows, search, statistics and samples.

One implementation serves movies and games; a ``CollectionSpec`` names their columns.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hoardbook.functions import ordering as o
from hoardbook.functions.text import contains_any, is_filled, strip
from hoardbook.operators.keysets import rows_with_keys
from hoardbook.operators.patterns import leading_matches
from hoardbook.operators.skew import join_one_to_many
from hoardbook.sources.staging import staged

NO_DATE = "9999-12-31"
RECENT = 10
SAMPLE = 30
PROBE_LIMIT = 5


@dataclass(frozen=True)
class CollectionSpec:
    """Column names of one catalogue. The base columns are SQL over prefixes t_, c_ and p_."""

    name: str
    title_id: str
    copy_id: str
    copy_title: str
    purchase_copy: str
    base: dict[str, str]
    search_columns: list[str]
    sorts: dict[str, list[tuple]]
    title_columns: list[str]
    copy_columns: dict[str, str]
    probe_columns: list[str]
    copies_label: str
    detail_sort: list[tuple]
    drop_no_date: bool = False


MEDIA = CollectionSpec(
    name="media", title_id="media_title_id", copy_id="dvd_id", copy_title="media_title_id",
    purchase_copy="dvd_item_id",
    base={
        "media_title_id": "t_id", "dvd_med_id": "c_media_title_id", "dvd_id": "c_id",
        "pi_dvd_id": "p_dvd_item_id", "pi_id": "p_id", "type": "t_type", "genre": "t_genre",
        "title": "t_title", "season_name": "c_season_name", "season_number": "c_season_number",
        "season_part": "c_season_part", "location_label": "c_location_label",
        "purchase_date": "p_purchase_date", "cost": "p_cost", "store": "p_store",
        "condition": "p_condition", "notes": "p_notes", "box_set": "c_box_set",
        "complete_season": "c_complete_season", "category": "c_category",
        "complete_collection": "t_complete_collection", "disk_type": "c_disk_type",
        "file_size": "c_file_size", "tmdb_id": "coalesce(c_tmdb_id, t_tmdb_id)",
    },
    search_columns=["title", "season_name"],
    sorts={
        "title": [(o.asc, "title")],
        "acquired_desc": [(o.desc_nulls_last, "purchase_date"), (o.asc, "title")],
        "acquired_asc": [(o.asc, "purchase_date"), (o.asc, "title")],
        "cost_desc": [(o.desc_nulls_last, "cost")],
        "cost_asc": [(o.asc, "cost")],
        "genre": [(o.asc, "genre"), (o.asc, "title")],
    },
    title_columns=["id", "title", "type", "genre", "total_seasons", "ongoing_ind",
                   "complete_collection", "brand", "tmdb_id"],
    copy_columns={
        "dvd_id": "c_id", "season_name": "c_season_name", "season_number": "c_season_number",
        "season_part": "c_season_part", "episodes": "c_episodes",
        "location_label": "c_location_label", "disk_type": "c_disk_type",
        "disk_region": "c_disk_region", "box_set": "c_box_set",
        "complete_season": "c_complete_season", "category": "c_category",
        "file_size": "c_file_size", "compressed": "c_compressed", "disk_tmdb_id": "c_tmdb_id",
    },
    probe_columns=["id", "title", "type", "genre", "tmdb_id", "total_seasons",
                   "complete_collection"],
    copies_label="disk_count",
    detail_sort=[(o.asc, "season_number"), (o.asc, "season_part"), (o.asc, "purchase_date")],
    drop_no_date=True,
)

GAMES = CollectionSpec(
    name="game", title_id="game_title_id", copy_id="game_copy_id", copy_title="game_title_id",
    purchase_copy="game_copy_id",
    base={
        "game_title_id": "t_id", "copy_title_id": "c_game_title_id", "game_copy_id": "c_id",
        "pi_copy_id": "p_game_copy_id", "pi_id": "p_id", "title": "t_title",
        "franchise": "t_franchise", "genre": "t_genre", "developer": "t_developer",
        "publisher": "t_publisher", "release_year": "t_release_year", "rawg_id": "t_rawg_id",
        "complete_collection": "t_complete_collection", "platform": "c_platform",
        "edition": "c_edition", "region": "c_region", "copy_condition": "c_condition",
        "location_label": "c_location_label", "copy_notes": "c_notes",
        "purchase_date": "p_purchase_date", "cost": "p_cost", "store": "p_store",
        "condition": "p_condition", "notes": "p_notes",
    },
    search_columns=["title", "franchise"],
    sorts={
        "title": [(o.asc, "title")],
        "acquired_desc": [(o.desc_nulls_last, "purchase_date"), (o.asc, "title")],
        "acquired_asc": [(o.asc, "purchase_date"), (o.asc, "title")],
        "cost_desc": [(o.desc_nulls_last, "cost")],
        "cost_asc": [(o.asc, "cost")],
        "platform": [(o.asc, "platform"), (o.asc, "title")],
        "year_desc": [(o.desc_nulls_last, "release_year"), (o.asc, "title")],
    },
    title_columns=["id", "title", "franchise", "genre", "developer", "publisher",
                   "release_year", "rawg_id", "complete_collection"],
    copy_columns={
        "game_copy_id": "c_id", "platform": "c_platform", "edition": "c_edition",
        "region": "c_region", "copy_condition": "c_condition",
        "location_label": "c_location_label", "copy_notes": "c_notes",
    },
    probe_columns=["id", "title", "franchise", "genre", "rawg_id", "developer"],
    copies_label="copy_count",
    detail_sort=[(o.asc, "platform"), (o.asc, "purchase_date")],
)

DEFAULT_SORT = "title"


@dataclass(frozen=True)
class Catalog:
    """The three tables of one catalogue."""

    spec: CollectionSpec
    titles: DataFrame
    copies: DataFrame
    purchases: DataFrame


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Columns renamed to ``<prefix>_<name>``, so the three tables can sit side by side."""
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns})


def _copies_with_purchases(catalog: Catalog, rows_per_task: int | None) -> DataFrame:
    """Copies, each repeated for its purchases and kept when it has none."""
    copies = _prefixed(catalog.copies, "c").withColumn("_key", F.col("c_id"))
    purchases = _prefixed(catalog.purchases, "p").withColumn(
        "_key", F.col(f"p_{catalog.spec.purchase_copy}")
    )
    return join_one_to_many(copies, purchases, ["_key"], ["p_id"], "left", rows_per_task)


def base(catalog: Catalog, rows_per_task: int | None = None) -> DataFrame:
    """One row per copy and purchase, with its title: the input of search and statistics."""
    spec = catalog.spec
    titles = _prefixed(catalog.titles, "t").withColumn("_key", F.col("t_id"))
    copies = _copies_with_purchases(catalog, rows_per_task).withColumn(
        "_key", F.col(f"c_{spec.copy_title}")
    )
    rows = join_one_to_many(titles, copies, ["_key"], ["c_id", "p_id"], "inner", rows_per_task)
    return rows.selectExpr(*[f"{sql} as {name}" for name, sql in spec.base.items()])


def library(catalog: Catalog, rows_per_task: int | None = None) -> DataFrame:
    """The games view: 20 of the base columns, the purchase key by its full name."""
    rows = base(catalog, rows_per_task).withColumnRenamed("pi_id", "purchase_id")
    return rows.select(
        "game_title_id", "game_copy_id", "purchase_id", "title", "franchise", "genre",
        "developer", "publisher", "release_year", "rawg_id", "platform", "edition", "region",
        "copy_condition", "location_label", "purchase_date", "cost", "store", "condition", "notes",
    )


def recent(catalog: Catalog, limit: int = RECENT, rows_per_task: int | None = None) -> DataFrame:
    """Newest purchases; the far-future placeholder date of the movie catalogue does not count."""
    spec = catalog.spec
    order = [F.col("purchase_date").desc(), F.col("pi_id").asc()]
    rows = base(catalog, rows_per_task).where(F.col("purchase_date").isNotNull())
    if spec.drop_no_date:
        rows = rows.where(F.col("purchase_date") != F.lit(NO_DATE).cast("date"))
    # Keys of the ``limit`` rows first, from four columns; then their copies and purchases in full.
    keys = rows.select(spec.copy_id, "pi_id", "purchase_date").orderBy(*order).limit(limit)
    keys = F.broadcast(staged(keys, "recent-keys"))
    few = Catalog(
        spec, catalog.titles,
        catalog.copies.join(keys.select(F.col(spec.copy_id).alias("id")), "id", "left_semi"),
        catalog.purchases.join(keys.select(F.col("pi_id").alias("id")), "id", "left_semi"),
    )
    return base(few, rows_per_task).where(F.col("pi_id").isNotNull()).orderBy(*order).limit(limit)


def _at_location(catalog: Catalog, location: str) -> Catalog:
    """The catalogue with the copies whose place contains the text, and their purchases, only.

    Purchases stream past a table of the keys of these copies, so that only those kept get sorted.
    """
    copies = catalog.copies.where(contains_any([F.col("location_label")], location))
    keys = copies.select(F.col("id").alias("_key")).hint("shuffle_hash")
    kept = F.col(catalog.spec.purchase_copy) == F.col("_key")
    return Catalog(
        catalog.spec, catalog.titles, copies, catalog.purchases.join(keys, kept, "left_semi")
    )


def search(
    catalog: Catalog, name: str = "", location: str = "", sort: str | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Base rows whose name and location contain the texts given, sorted by a named order.

    ``sort=None`` leaves the rows unsorted, for callers that aggregate or join them further.
    """
    spec = catalog.spec
    if location.strip():
        catalog = _at_location(catalog, location.strip())
    rows = base(catalog, rows_per_task)
    if name.strip():
        rows = rows.where(contains_any([F.col(c) for c in spec.search_columns], name.strip()))
    if sort is None:
        return rows
    return rows.orderBy(*o.pick(spec.sorts, sort, DEFAULT_SORT), o.asc(spec.copy_id), o.asc("pi_id"))


def stats(
    rows: DataFrame, metrics: dict[str, Column], by: list[str] | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """Aggregates over base rows, grouped and ordered when asked."""
    result = rows.groupBy(*(by or [])).agg(*[m.alias(name) for name, m in metrics.items()])
    return result.orderBy(*order) if order else result


def tallies(catalog: Catalog, columns: list[str] | None = None, location: str = "") -> DataFrame:
    """How many base rows there are and what they cost, (``columns``, rows, cost): one row per title
    and values of its copies. Base columns of titles and copies may be asked for.

    Purchases are counted per copy, copies per title, before titles join, so no base row is ever
    formed and a title with very many copies moves one row per task.
    """
    spec = catalog.spec
    sources = {c: spec.base[c].split("_", 1) for c in columns or []}
    of_copy = [F.col(name).alias(c) for c, (side, name) in sources.items() if side == "c"]
    of_title = [F.col(name).alias(c) for c, (side, name) in sources.items() if side == "t"]
    per_copy = catalog.purchases.groupBy(F.col(spec.purchase_copy).alias("_copy")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("cost").alias("_cost")
    )
    copies = catalog.copies
    if location.strip():
        copies = copies.where(contains_any([F.col("location_label")], location.strip()))
    per_title = (
        copies.select(F.col("id").alias("_id"), F.col(spec.copy_title).alias("_title"), *of_copy)
        .join(per_copy, F.col("_id") == F.col("_copy"), "left")
        .groupBy("_title", *[c for c, (side, _) in sources.items() if side == "c"])
        .agg(F.sum(F.coalesce("_rows", F.lit(1))).alias("rows"), F.sum("_cost").alias("cost"))
    )
    titles = catalog.titles.select(F.col("id").alias("_key"), *of_title)
    return per_title.join(titles, F.col("_title") == F.col("_key")).select(
        *(columns or []), "rows", "cost"
    )


def _total(catalog: Catalog) -> Column:
    """Sum of the costs of ``tallies``, of the type that a sum over the purchases has."""
    return F.sum("cost").cast(catalog.purchases.select(F.sum("cost")).schema[0].dataType)


def row_count(catalog: Catalog, location: str = "") -> DataFrame:
    return stats(
        tallies(catalog, location=location), {"count": F.coalesce(F.sum("rows"), F.lit(0))}
    )


def count_by(catalog: Catalog, column: str, order: list[Column] | None = None) -> DataFrame:
    """Rows per value; the rows without a value count as 0."""
    filled = F.when(F.col(column).isNotNull(), F.col("rows")).otherwise(0)
    return stats(tallies(catalog, [column]), {"count": F.sum(filled)}, [column], order)


def cost_by(catalog: Catalog, column: str) -> DataFrame:
    return stats(tallies(catalog, [column]), {"sum": _total(catalog)}, [column])


def dashboard(catalog: Catalog, columns: list[str]) -> DataFrame:
    """All numbers of a dashboard in one pass, (metric, value, count, sum): rows and spend in all
    (metric ``total``) and per value of each column, null being a value."""
    metrics = [F.struct(F.lit("total").alias("metric"), F.lit(None).cast("string").alias("value"))] + [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    rows = tallies(catalog, columns).select(F.explode(F.array(*metrics)).alias("m"), "rows", "cost")
    return stats(
        rows.select("m.*", "rows", "cost"), {"count": F.sum("rows"), "sum": _total(catalog)},
        ["metric", "value"],
    )


def cost_by_store(catalog: Catalog) -> DataFrame:
    """Spend per store, from the purchases alone."""
    return stats(catalog.purchases, {"sum": F.sum("cost")}, ["store"], [o.asc("store")])


def location_count(catalog: Catalog, location: str = "") -> DataFrame:
    """Rows at a location; the whole catalogue when no location is given."""
    return row_count(catalog, location)


def shelf(catalog: Catalog, location: str) -> DataFrame:
    """What lies at a location, each row with the total."""
    rows = search(catalog, location=location, sort=DEFAULT_SORT)
    return rows.withColumn("shelf_count", location_count(catalog, location).scalar())


def genres(catalog: Catalog) -> DataFrame:
    return (
        catalog.titles.where(is_filled(F.col("genre"))).select("genre").distinct()
        .orderBy("genre")
    )


def titles_by_key(catalog: Catalog, keys: DataFrame) -> DataFrame:
    """Titles of a key set (column ``id``)."""
    return catalog.titles.select(*catalog.spec.title_columns).join(
        keys.select("id").distinct(), "id", "left_semi"
    )


def title_detail(
    catalog: Catalog, keys: DataFrame | None = None, rows_per_task: int | None = None
) -> DataFrame:
    """Copies and purchases of titles, for a key set or for all titles, in display order."""
    spec = catalog.spec
    copies = catalog.copies
    if keys is not None:
        wanted = keys.select(F.col("id").alias(spec.copy_title))
        copies = rows_with_keys(copies, wanted, spec.copy_title, ["id"], rows_per_task)
    rows = _copies_with_purchases(
        Catalog(spec, catalog.titles, copies, catalog.purchases), rows_per_task
    )
    purchase = {
        "purchase_id": "p_id", "purchase_date": "p_purchase_date", "cost": "p_cost",
        "store": "p_store", "condition": "p_condition", "notes": "p_notes",
    }
    columns = {"title_id": f"c_{spec.copy_title}", **spec.copy_columns, **purchase}
    return rows.selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()]).orderBy(
        "title_id", *o.columns(spec.detail_sort), spec.copy_id, o.asc("purchase_id")
    )


def title_spend(catalog: Catalog) -> DataFrame:
    """Total spend of every title, 0 when nothing was paid. Sums go up copy by copy."""
    spec = catalog.spec
    per_copy = catalog.purchases.groupBy(F.col(spec.purchase_copy).alias("id")).agg(
        F.sum("cost").alias("cost")
    )
    per_title = (
        catalog.copies.select("id", spec.copy_title).join(per_copy, "id", "left")
        .groupBy(F.col(spec.copy_title).alias("id")).agg(F.sum("cost").alias("cost"))
    )
    return catalog.titles.select("id").join(per_title, "id", "left").select(
        F.col("id").alias(spec.title_id),
        F.coalesce("cost", F.lit(0)).cast("decimal(22,2)").alias("total"),
    )


def duplicate_check(
    catalog: Catalog, probes: DataFrame, limit: int = PROBE_LIMIT,
    rows_per_task: int | None = None,
) -> DataFrame:
    """First titles, by name, that contain each probe text (column ``probe``), with copy counts."""
    spec = catalog.spec
    counts = catalog.copies.groupBy(F.col(spec.copy_title).alias("id")).agg(
        F.count("id").alias(spec.copies_label)
    )
    texts = (
        probes.select(strip(F.col("probe")).alias("probe")).where(F.col("probe") != "").distinct()
        .withColumn("_pattern", F.concat(F.lit("%"), "probe", F.lit("%")))
    )
    # Many titles may share one name: patterns meet each name once, in the order of names.
    named = catalog.titles.select("title").where(F.col("title").isNotNull()).distinct()
    hits = leading_matches(named, "title", [F.col("title").asc()], texts, "_pattern", limit)
    # Only the first ``limit`` titles of a name can be among the first of a probe.
    same_name = W.partitionBy("title").orderBy("id")
    leading = (
        catalog.titles.select(*spec.probe_columns)
        .withColumn("_rank", F.row_number().over(same_name))
        .where(F.col("_rank") <= limit).drop("_rank")
    )
    first_names = W.partitionBy("_pattern").orderBy("title")
    names = (
        hits.withColumn("_rank", F.row_number().over(first_names))
        .where(F.col("_rank") <= limit).drop("_rank")
    )
    per_probe = W.partitionBy("probe").orderBy("title", "id")
    found = (
        join_one_to_many(
            leading, names.join(texts, "_pattern"), ["title"], ["probe"], "inner", rows_per_task
        )
        .withColumn("position", F.row_number().over(per_probe))
        .where(F.col("position") <= limit)
    )
    return found.join(counts, "id", "left").select(
        "probe", "position", *spec.probe_columns,
        F.coalesce(spec.copies_label, F.lit(0)).alias(spec.copies_label),
    )


def sample(rows: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """``limit`` rows in an order that depends on key and seed only."""
    shuffled = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return rows.orderBy(shuffled, key).limit(limit)


def media_posters(catalog: Catalog, limit: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Sample of titles with a picture id; of a title's copies the first one with an id counts."""
    titles = catalog.titles.select("id", "title", "type", F.col("tmdb_id").alias("_own"))
    per_title = catalog.copies.groupBy(F.col("media_title_id").alias("id")).agg(
        F.min_by("tmdb_id", F.when(F.col("tmdb_id").isNotNull(), F.col("id"))).alias("_first"),
        F.min_by("tmdb_id", "id").alias("_oldest"),
    )
    # The first copy shows its own id, else the title's; without a title id the first copy that
    # has one decides.
    rows = titles.join(per_title, "id").select(
        F.col("id").alias("media_title_id"), "title", "type",
        F.coalesce("_oldest", "_own", "_first").alias("tmdb_id"),
    ).where(F.col("tmdb_id").isNotNull())
    return sample(rows, "media_title_id", limit, seed)


def game_covers(catalog: Catalog, limit: int = SAMPLE, seed: int = 0) -> DataFrame:
    rows = catalog.titles.where(is_filled(F.col("rawg_id"))).select(
        F.col("id").alias("game_title_id"), "title", "rawg_id"
    )
    return sample(rows, "game_title_id", limit, seed)
