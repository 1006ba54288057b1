"""Every registered query: (spark, folder of the given tables) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from hoardbook.functions import cards as c, numbers as n, ordering as o
from hoardbook.functions.reports import title_url
from hoardbook.operators import (
    allocate, catalog, changes, grading, imports, intake, ledger, locate, metadata, quality,
)
from hoardbook.operators.numbering import assign_keys
from hoardbook.operators.ranking import positioned, positions_by
from hoardbook.plans import mapping as m
from hoardbook.plans.inputs import Inputs
from hoardbook.schemas import ACQUISITION, APPENDABLE_STATUSES, ITEM
from hoardbook.sources.exports import HEADERS, export_rows, scan_exports
from hoardbook.sources.staging import staged, staging_path
from hoardbook.sources.store import Store
from hoardbook.sources.tables import evolve, with_defaults, with_generated

LABEL = "shelf 1"
EXPORT_FOLDERS = 512
# On a plain local disk no checksum file beside each file, which would take longer than the file itself.
NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
QUERIES = {}


def query(function):
    """Register a function of ``Inputs`` under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Inputs(spark, sf_dir))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


# Sources


@query
def intake_csv_scan(t: Inputs):
    """Export files written from the lines, scanned back through their headers.

    Each batch has a file of its own, and another one for every further million lines.
    """
    path = staging_path(t.spark, "exports")
    file = F.concat_ws("-", "batch_id", F.floor(F.col("row_pos") / 1_000_000))
    # A folder of files is written by one task, which publishes it whole, and listed by one.
    folder = F.pmod(F.hash("file"), F.lit(EXPORT_FOLDERS))
    (
        t.raw_export.withColumn("file", file).withColumn("folder", folder).repartition("folder")
        .sortWithinPartitions("folder", "file", "row_pos").drop("batch_id", "row_pos")
        .write.partitionBy("folder", "file").options(**NO_CHECKSUMS)
        .option("header", True).option("escape", '"').csv(path)
    )
    rows = export_rows(scan_exports(t.spark, path, any_folder=True))
    file = F.regexp_extract("batch_id", r"/file=([-0-9]+)/", 1)
    return rows.select(file.alias("file"), "row_pos", *HEADERS, "paid", "has_paid_column")


def _write_exports(rows: DataFrame, headers: DataFrame, files: list[str], path: str) -> None:
    """Text files, a header line each and their rows by ``line_id`` (columns ``value`` and ``files``);
    a file holds a million lines at most, and its lines may hold line breaks."""
    first = rows.select(*files).distinct().join(F.broadcast(headers), files[:1]).select(
        *files, F.lit(0).cast("bigint").alias("line_id"), "value"
    )
    (
        rows.select(*files, "line_id", "value").unionByName(first).repartition(*files)
        .sortWithinPartitions(*files, "line_id").drop("line_id")
        .write.partitionBy(*files).text(path)
    )


def _quoted(value: str) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.col(value), F.lit('"'), F.lit('""')), F.lit('"'))


def _broken_export(t: Inputs) -> DataFrame:
    """Export rows with names that hold commas, quotes and line breaks."""
    return t.text_lines.withColumn("broken", F.expr(m.BROKEN_NAME)).selectExpr(
        "line_id", "broken", f"{m.DIALECT} as dialect", "cast(line_id div 1000000 as bigint) as file",
        *[f"{m.LINE_EXPORT[c]} as `{c}`" for c in ("Number", "TCG Market Price", "Paid", "Add to Quantity")],
    )


@query
def intake_export_split(t: Inputs):
    """Large export files with line breaks inside quoted cells, read by several tasks each."""
    path = staging_path(t.spark, "split-exports")
    kind = F.lit(0).alias("kind")
    rows = _broken_export(t).select(
        kind, "file", "line_id",
        F.concat_ws(",", _quoted("broken"), "Number", "TCG Market Price", _quoted("Paid"), "Add to Quantity").alias("value"),
    )
    header = "\ufeffProduct Name,Number,TCG Market Price,\"Paid\",Add to Quantity"
    headers = t.spark.range(1).select(kind, F.lit(header).alias("value"))
    _write_exports(rows, headers, ["kind", "file"], path)
    found = export_rows(scan_exports(t.spark, path))
    file = F.regexp_extract("batch_id", r"/file=([0-9]+)/", 1).cast("bigint")
    return found.select(
        file.alias("file"), "row_pos", "name", "number", "price", "paid", "quantity", "has_paid_column"
    )


@query
def intake_export_dialects(t: Inputs):
    """Export files with four kinds of header, read in one scan: other names for the same field, a
    repeated header, no paid column, no name, and cells beyond the header."""
    path = staging_path(t.spark, "export-dialects")
    name, paid = _quoted("broken"), _quoted("Paid")
    price, number, copies = (F.col(c) for c in ("TCG Market Price", "Number", "Add to Quantity"))
    beyond = F.when(F.col("line_id") % 50_000 == 1, F.lit("," * 5_000)).otherwise("")
    kinds = [
        ("Product Name,Add to Quantity,Paid,TCG Market Price", F.concat_ws(",", name, copies, paid, price)),
        ("Total Quantity,Title,TCG Market Price", F.concat_ws(",", copies, name, price, beyond)),
        ('Title,"Title",Number,Paid Price,Total Quantity', F.concat_ws(",", F.lit("old"), name, number, paid, copies)),
        ("Something,Number,Add to Quantity", F.concat_ws(",", name, number, copies)),
    ]
    value = F.lit(None)
    for k, (_, line) in enumerate(kinds):
        value = F.when(F.col("dialect") == k, line).otherwise(value)
    headers = t.spark.createDataFrame([(k, h) for k, (h, _) in enumerate(kinds)], "dialect int, value string")
    _write_exports(_broken_export(t).withColumn("value", value), headers, ["dialect", "file"], path)
    found = export_rows(scan_exports(t.spark, path))
    part = lambda n: F.regexp_extract("batch_id", rf"/{n}=([0-9]+)/", 1).cast("bigint").alias(n)
    return found.select(
        part("dialect"), part("file"), "row_pos", "name", "number", "price", "paid", "quantity", "has_paid_column"
    )


@query
def intake_manual_rows(t: Inputs):
    return intake.normalize_typed(t.typed_rows).drop("misfit")


@query
def intake_media_rows(t: Inputs):
    """Movie copies entered as texts."""
    forms = t.lines.selectExpr(
        "cast(l_orderkey as string) as media_title_id",
        "case l_linenumber%4 when 0 then '' when 1 then ' 2 ' when 2 then '2.5' else 'two' end"
        " as season_number",
        "case when l_partkey%2=0 then '1' end as season_part", "'1_0' as episodes",
        "'Shelf '||(l_orderkey%50) as location_label", "'' as season_name",
        "case when l_partkey%3=0 then 'on' end as box_set",
        "case when l_partkey%3=1 then 'off' else 'on' end as complete_season",
        "'d'||line_id as tmdb_id", "l_linestatus as disk_type", "'1' as disk_region",
        "cast(l_quantity as string) as file_size", "l_returnflag as category",
        "'on' as compressed", "'1e2' as adjusted_file_size", "'' as disk_type_uploaded",
    )
    return intake.media_copy_rows(forms)


@query
def intake_media_titles(t: Inputs):
    forms = t.table("customer").selectExpr(
        "c_name as title", "case when c_custkey%3=0 then 'tv_show' else 'movie' end as type",
        "c_mktsegment as genre",
        "case c_custkey%3 when 0 then '' when 1 then '4' else 'many' end as total_seasons",
        "case when c_custkey%2=0 then 'on' end as ongoing_ind",
        "case when c_custkey%5=0 then 'on' else '' end as complete_collection",
        "'' as brand", "'t'||c_custkey as tmdb_id",
    )
    return intake.media_title_rows(forms)


@query
def intake_game_rows(t: Inputs):
    """Game purchases entered as texts."""
    forms = t.lines.selectExpr(
        "cast(line_id as string) as game_copy_id",
        "case when l_partkey%7=0 then '' else cast(cast(l_shipdate as date) as string) end"
        " as purchase_date",
        "case l_linenumber%3 when 0 then '' when 1 then '12.50' else '$3' end as cost",
        "'Store '||(l_suppkey%20) as store", "'' as condition", "cast(null as string) as notes",
    )
    return intake.purchase_rows(forms, "game_copy_id")


@query
def intake_game_titles(t: Inputs):
    forms = t.table("part").selectExpr(
        "p_name as title", "p_brand as franchise", "p_type as genre", "'' as developer",
        "'' as publisher",
        "case when p_partkey%4=0 then '' else cast(1980+p_size as string) end as release_year",
        "'r'||p_partkey as rawg_id",
        "case when p_partkey%2=0 then 'on' end as complete_collection",
    )
    return intake.game_title_rows(forms)


@query
def intake_game_copies(t: Inputs):
    forms = t.lines.selectExpr(
        "case when l_partkey%6=0 then ' '||l_partkey else cast(l_partkey as string) end"
        " as game_title_id",
        "l_returnflag||l_linestatus as platform", "'' as edition", "'PAL' as region",
        "'Loose' as condition", "'Shelf '||(l_orderkey%50) as location_label", "'' as notes",
    )
    return intake.game_copy_rows(forms)


@query
def generated_columns(t: Inputs):
    """Stored sums of purchases, items and sales, computed anew."""
    boxes = with_generated(t.boxes.drop("total_cost"), "acquisition")
    items = with_generated(t.items.drop("grading_total"), "item")
    sales = with_generated(t.sales.drop("net_proceeds"), "sale")
    parts = [("acquisition", boxes, "acquisition_id", "total_cost"),
             ("item", items, "item_id", "grading_total"), ("sale", sales, "sale_id", "net_proceeds")]
    frames = [
        df.select(F.lit(name).alias("table_name"), F.col(key).alias("key"),
                  F.col(value).alias("amount")) for name, df, key, value in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def apply_defaults(t: Inputs):
    """Purchases without optional columns; a null tax that was supplied stays null."""
    given = t.boxes.select(
        "acquisition_id", "purchase_price",
        F.when(F.col("acquisition_id") % 3 != 0, F.col("tax")).alias("tax"),
    )
    return with_defaults(given, "acquisition").drop("created_at")


# Catalogues


def _catalog_queries(name: str, get):
    def add(key: str, function):
        function.__name__ = key
        query(function)

    add(f"{name}_base", lambda t: catalog.base(get(t)))
    add(f"{name}_recent", lambda t: catalog.recent(get(t)))
    add(f"{name}_count", lambda t: catalog.row_count(get(t)))
    add(f"{name}_count_by_genre",
        lambda t: catalog.count_by(get(t), "genre", [o.asc("genre"), o.asc("count")]))
    add(f"{name}_cost_by_store", lambda t: catalog.cost_by_store(get(t)))
    add(f"{name}_location_count", lambda t: catalog.location_count(get(t), LABEL))
    add(f"{name}_genres", lambda t: catalog.genres(get(t)))
    add(f"{name}_title_detail", lambda t: catalog.title_detail(get(t)))
    add(f"{name}_title_spend", lambda t: catalog.title_spend(get(t)))
    add(f"{name}_search_location", lambda t: catalog.search(get(t), location=LABEL, sort="title"))


_catalog_queries("media", lambda t: t.media)
_catalog_queries("game", lambda t: t.games)


@query
def game_library(t: Inputs):
    return catalog.library(t.games)


@query
def media_count_by_type(t: Inputs):
    return catalog.count_by(t.media, "type")


@query
def media_cost_by_type(t: Inputs):
    return catalog.cost_by(t.media, "type")


@query
def media_cost_by_disk(t: Inputs):
    return catalog.cost_by(t.media, "disk_type")


@query
def game_count_by_platform(t: Inputs):
    return catalog.count_by(t.games, "platform", [o.desc("count"), o.asc("platform")])


@query
def game_cost_by_platform(t: Inputs):
    return catalog.cost_by(t.games, "platform")


@query
def media_dashboard(t: Inputs):
    return catalog.dashboard(t.media, ["type", "genre", "disk_type"])


@query
def game_dashboard(t: Inputs):
    return catalog.dashboard(t.games, ["genre", "platform"])


@query
def media_search_name(t: Inputs):
    return catalog.search(t.media, name=" CUSTOMER#00000012", sort="title")


@query
def game_search_name(t: Inputs):
    return catalog.search(t.games, name="br_nd#1", sort="title")


@query
def media_search_sorted(t: Inputs):
    return catalog.search(t.media, name="urgent", sort="acquired_desc")


@query
def game_search_sorted(t: Inputs):
    return catalog.search(t.games, name="ring", location="Shelf 4", sort="year_desc")


@query
def media_shelf(t: Inputs):
    return catalog.shelf(t.media, "Shelf 7")


@query
def lookup_titles(t: Inputs):
    """Titles named by the purchases of one store."""
    keys = t.table("orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as id")
    return catalog.titles_by_key(t.media, keys)


@query
def lookup_games(t: Inputs):
    keys = t.lines.where("l_returnflag = 'R'").selectExpr("l_partkey as id")
    return catalog.titles_by_key(t.games, keys)


@query
def media_dup_check(t: Inputs):
    """Is each supplier number part of a movie title?"""
    probes = t.table("supplier").selectExpr("substring(s_name, 10) as probe")
    return catalog.duplicate_check(t.media, probes)


@query
def game_dup_check(t: Inputs):
    """Every name in the catalogue probed, and each word pair as a pattern."""
    probes = t.table("part").selectExpr(
        "case p_partkey%4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '%')"
        " when 2 then left(p_name, 2) else replace(p_name, 'e', '_') end as probe"
    )
    return catalog.duplicate_check(t.games, probes)


@query
def media_posters(t: Inputs):
    return catalog.media_posters(t.media, seed=7)


@query
def game_covers(t: Inputs):
    return catalog.game_covers(t.games, seed=7)


@query
def poster_urls(t: Inputs):
    rows = t.media.titles.where(F.col("tmdb_id").isNotNull())
    return rows.select("id", title_url(F.col("type"), F.col("tmdb_id")).alias("url"))


@query
def media_sorted_all(t: Inputs):
    """Places of all rows under every named order."""
    return positions_by(catalog.search(t.media), t.media.spec.sorts, ["dvd_id", "pi_id"])


@query
def game_sorted_all(t: Inputs):
    return positions_by(catalog.search(t.games), t.games.spec.sorts, ["game_copy_id", "pi_id"])


# Ledger


@query
def ledger_sorted_all(t: Inputs):
    rows = ledger.ledger_rows(t.boxes, t.items, t.sales)
    return positions_by(rows, ledger.COLLECTION_SORTS, ["item_id", "sale_id"])


@query
def boxes_sorted_all(t: Inputs):
    """Purchases newest first, all and those that more can be added to, with their places."""
    order = [o.desc("purchase_date"), F.col("acquisition_id").desc()]
    rows = t.boxes.select("acquisition_id", "purchase_date", "status")
    frames = [
        positioned(frame, order).select(F.lit(name).alias("list"), "position", "acquisition_id")
        for name, frame in (("all", rows), ("appendable", rows.where(F.col("status").isin(APPENDABLE_STATUSES))))
    ]
    return frames[0].unionByName(frames[1])


@query
def item_ledger(t: Inputs):
    return ledger.item_ledger(t.boxes, t.items, t.sales)


@query
def item_ledger_base(t: Inputs):
    return ledger.item_ledger_base(t.boxes, t.items, t.sales)


@query
def ledger_search_name(t: Inputs):
    return ledger.collection(t.boxes, t.items, t.sales, name="S1")


@query
def ledger_filter_game_status(t: Inputs):
    return ledger.collection(t.boxes, t.items, t.sales, game="weiss", status="keep")


@query
def ledger_collection(t: Inputs):
    return ledger.collection(t.boxes, t.items, t.sales, sort="basis_desc")


@query
def card_detail(t: Inputs):
    return ledger.card_detail(t.boxes, t.items, t.sales)


@query
def lookup_cards(t: Inputs):
    """Detail of all cards that were sold at one place."""
    keys = t.sales.where("channel = 'lgs'").select("item_id")
    return ledger.card_detail(t.boxes, t.items, t.sales, keys)


@query
def lookup_boxes(t: Inputs):
    keys = t.items.where("grader is not null").select("acquisition_id")
    return ledger.boxes_by_key(t.boxes, keys)


@query
def box_items(t: Inputs):
    return ledger.box_items(t.boxes, t.items, t.sales, grading.grade_candidates(t.items))


@query
def box_pl(t: Inputs):
    return ledger.box_pl(t.boxes, t.items, t.sales)


@query
def box_pl_sorted(t: Inputs):
    return ledger.newest_first(ledger.box_pl(t.boxes, t.items, t.sales))


@query
def box_pl_dedupe(t: Inputs):
    return ledger.box_pl(t.boxes, t.items, t.sales, dedupe_sales=True)


@query
def portfolio(t: Inputs):
    return ledger.portfolio(t.boxes, t.items, t.sales)


@query
def ledger_games(t: Inputs):
    return ledger.games(t.boxes, t.items)


@query
def ledger_statuses(t: Inputs):
    return ledger.statuses(t.items)


@query
def appendable_boxes(t: Inputs):
    return ledger.appendable_boxes(t.boxes)


@query
def ledger_posters(t: Inputs):
    return ledger.posters(t.items, seed=7)


@query
def ledger_location(t: Inputs):
    return locate.cards_at(t.items, LABEL)


@query
def locate_all(t: Inputs):
    rows = locate.locate(t.media, t.items, t.games, LABEL)
    return rows.select(
        "collection", "entry_id", "title", "location", "purchase_date", "cost", "platform",
        "status", "genre", "pi_id",
    )


QUERIES["locate"] = QUERIES.pop("locate_all")


@query
def locate_movies(t: Inputs):
    return locate.locate(t.media, t.items, t.games, LABEL, "movies").select(
        "collection", "entry_id", "title", "location", "genre", "pi_id"
    )


@query
def locate_cards(t: Inputs):
    return locate.locate(t.media, t.items, t.games, LABEL, "cards").select(
        "collection", "entry_id", "title", "location", "status"
    )


@query
def locate_games(t: Inputs):
    return locate.locate(t.media, t.items, t.games, LABEL, "games").select(
        "collection", "entry_id", "title", "location", "platform", "pi_id"
    )


@query
def locate_counts(t: Inputs):
    return locate.locate_counts(t.media, t.items, t.games, LABEL)


# Allocation and grading


@query
def allocate_cost(t: Inputs):
    return allocate.allocate_cost(t.boxes, t.items).select("item_id", "acquisition_id", "cost_basis")


@query
def box_median(t: Inputs):
    return grading.box_median(t.items)


@query
def grade_candidates(t: Inputs):
    return grading.best_first(grading.grade_candidates(t.items))


@query
def grade_candidates_v1(t: Inputs):
    return grading.grade_candidates(t.items, review=False)


@query
def grade_reasons(t: Inputs):
    rows = grading.with_reasons(grading.grade_candidates(t.items))
    return rows.select("item_id", "tier", "reason", "median_multiple")


@query
def grading_scorecard(t: Inputs):
    return grading.grading_scorecard(t.items, t.sales)


def _asked_names(t: Inputs) -> DataFrame:
    """Part names in several spellings, some of which act as patterns."""
    return t.table("part").selectExpr(
        "case p_partkey%5 when 0 then upper(p_name) when 1 then replace(p_name, 'a', '_')"
        " when 2 then left(p_name, 4)||'%' when 3 then '%'||right(p_name, 5) else p_name end"
        " as query_name"
    )


@query
def grading_history(t: Inputs):
    return grading.grading_history(t.items, t.sales, _asked_names(t))


@query
def grading_report(t: Inputs):
    rows = grading.grading_report(t.items, t.sales)
    first = F.get("history", F.lit(0))
    return rows.select(
        "item_id", "name", "tier", "reason", "est_upside",
        F.coalesce(F.size("history"), F.lit(0)).alias("n_history"),
        first["item_id"].alias("latest_item"),
        first["profit_after_grading"].alias("latest_profit"),
        F.concat_ws(",", F.transform("history", lambda h: h["item_id"].cast("string")))
        .alias("history_items"),
    )


# Intake


@query
def intake_normalize(t: Inputs):
    return intake.normalize_export(t.export_rows).drop("misfit")


@query
def intake_summary(t: Inputs):
    rows = intake.batch_summary(intake.normalize_export(t.export_rows))
    return rows.withColumn("games", F.concat_ws(",", "games"))


@query
def intake_expand_qty(t: Inputs):
    rows = intake.normalize_export(t.export_rows)
    return intake.expand_quantity(rows).select("batch_id", "row_pos", "copy_no", "name", "variant")


@query
def scalar_clean_number(t: Inputs):
    text = F.expr(
        "case line_id%8 when 0 then '' when 1 then ' 12.345 ' when 2 then '-3' when 3 then '$4'"
        " when 4 then cast(l_partkey as string) when 5 then '1e2' when 6 then '2.9' end"
    )
    rows = t.lines.select("line_id", text.alias("text"))
    value = F.col("text")
    return rows.select(
        "line_id", n.clean_number(value).alias("number"), n.money(value).alias("amount"),
        n.money(value, F.lit(0)).alias("amount_or_zero"), n.whole_number(value).alias("whole"),
        n.positive_whole_number(value).alias("positive"), n.quantity(value).alias("quantity"),
    )


@query
def scalar_strip_rarity(t: Inputs):
    number = c.collector_number(F.col("number"), F.col("rarity"))
    game = c.game_code(F.col("product_line"))
    legacy = c.legacy_collector_number(F.col("number"))
    return t.export_rows.select(
        "row_pos", game.alias("game"), number.alias("collector_number"),
        c.set_code(game, number, F.col("set_name")).alias("set_code"),
        legacy.alias("legacy_number"), c.legacy_set_code(legacy).alias("legacy_set"),
    )


@query
def scalar_variant_condition(t: Inputs):
    return t.export_rows.select(
        "row_pos", c.variant(F.col("rarity"), F.col("printing")).alias("variant"),
        c.condition_code(F.col("condition")).alias("condition"),
        n.quantity(F.col("quantity")).alias("quantity"),
    )


@query
def intake_acquisition(t: Inputs):
    return intake.acquisition_rows(intake.batches_with_summary(t.manifest, t.import_rows))


@query
def singles_basis(t: Inputs):
    rows = imports.singles_basis(t.import_rows, t.overrides)
    return rows.select("batch_id", "card_index", "cost_basis", "used_fallback")


def _accepted(t: Inputs) -> DataFrame:
    rejects = imports.import_rejects(t.manifest, t.import_rows, t.boxes)
    return t.manifest.join(rejects, "batch_id", "left_anti")


IMPORTED = ["item_id", "batch_id", "card_index", "acquisition_id", "name", "game", "set_code",
            "language", "condition", "cost_basis", "market_value", "status"]


@query
def import_sealed(t: Inputs):
    result = imports.import_sealed(_accepted(t), t.import_rows, t.boxes, t.items)
    return result.items.select(*IMPORTED)


@query
def import_sealed_boxes(t: Inputs):
    result = imports.import_sealed(_accepted(t), t.import_rows, t.boxes, t.items)
    return result.acquisitions.drop("created_at")


@query
def import_singles(t: Inputs):
    result = imports.import_singles(_accepted(t), t.import_rows, t.overrides, t.boxes, t.items)
    return result.items.select(*IMPORTED)


@query
def import_singles_boxes(t: Inputs):
    result = imports.import_singles(_accepted(t), t.import_rows, t.overrides, t.boxes, t.items)
    return result.acquisitions.drop("created_at")


@query
def import_append(t: Inputs):
    result = imports.import_append(_accepted(t), t.import_rows, t.boxes, t.items)
    return result.items.select("item_id", "acquisition_id", "name", "cost_basis", "status")


@query
def import_append_boxes(t: Inputs):
    result = imports.import_append(_accepted(t), t.import_rows, t.boxes, t.items)
    return result.acquisitions.select("acquisition_id", "packs_total", "packs_opened", "status")


@query
def import_rejects(t: Inputs):
    return imports.import_rejects(t.manifest, t.import_rows, t.boxes)


@query
def import_row_rejects(t: Inputs):
    return imports.row_rejects(t.import_rows)


@query
def import_preview(t: Inputs):
    return imports.import_preview(t.manifest, t.import_rows, t.boxes)


@query
def import_legacy(t: Inputs):
    result = imports.import_legacy(t.manifest, t.legacy_rows, t.boxes, t.items)
    return result.items.select(*IMPORTED)


@query
def import_legacy_boxes(t: Inputs):
    result = imports.import_legacy(t.manifest, t.legacy_rows, t.boxes, t.items)
    return result.acquisitions.drop("created_at")


@query
def import_legacy_append(t: Inputs):
    """Additions by the older rules, new items with a status of their own."""
    result = imports.import_legacy_append(
        t.manifest, t.legacy_rows, t.boxes, t.items, status="listed"
    )
    return result.items.select("item_id", "acquisition_id", "name", "cost_basis", "status")


@query
def import_legacy_rejects(t: Inputs):
    return imports.legacy_rejects(t.manifest, t.legacy_rows)


@query
def assign_new_keys(t: Inputs):
    rows = t.table("part").select("p_partkey")
    return assign_keys(rows, ["p_partkey"], "acquisition_id", t.boxes)


QUERIES["assign_keys"] = QUERIES.pop("assign_new_keys")


# Stored tables


def _store(t: Inputs) -> Store:
    """The collection's tables as an import of a new store."""
    store = Store(t.spark, staging_path(t.spark, "store"))
    store.add_import("base", t.boxes, t.items, t.sales)
    return store


@query
def sink_roundtrip(t: Inputs):
    """Import, import again, add to boxes, fold, clean up, read back."""
    store = _store(t)
    sealed = store.keyed(imports.import_sealed(_accepted(t), t.import_rows))
    for _ in range(2):
        store.add_import("sealed", sealed.acquisitions, sealed.items)
    more = imports.import_append(
        _accepted(t), t.import_rows, store.table("acquisition"), store.table("item")
    )
    store.replace_boxes(more.acquisitions, more.items)
    store.compact()
    store.clean()
    return store.table("item").select("item_id", "acquisition_id", "name", "cost_basis", "status")


@query
def box_pl_stored(t: Inputs):
    """Profit and loss over stored tables, where what belongs to a purchase lies together."""
    store = _store(t)
    return ledger.box_pl(store.table("acquisition"), store.table("item"), store.table("sale"))


@query
def box_pl_incremental(t: Inputs):
    """Profit and loss after changes: the sums of purchases from before, corrected by the buckets that
    the changes touched."""
    store = _store(t)
    before = store.version()
    sums = staged(ledger.box_sums(store.table("item", before), store.table("sale", before)), "box-sums")
    after, _ = store.merge(t.events)
    touched = store.changed(before, after)
    rows = [[store.table(name, v, touched) for name in ("item", "sale")] for v in (before, after)]
    moved = staged(ledger.corrections(*map(tuple, rows)), "box-corrections")
    return ledger.box_report(store.table("acquisition"), ledger.corrected(sums, moved))


# Changes and quality

CHANGED = ["item_id", "status", "condition", "storage_location", "market_value",
           "graded_value_est", "grade_candidate", "notes", "grader", "grade", "cert_number",
           "grade_date", "grading_fee", "grading_ship", "grading_extra", "grading_total"]


def _changed(t: Inputs, *kinds: str) -> changes.Snapshot:
    return changes.apply_changes(t.items, t.sales, t.events.where(F.col("kind").isin(*kinds)))


@query
def apply_edits(t: Inputs):
    return _changed(t, "edit").items.select(*CHANGED)


@query
def apply_gradings(t: Inputs):
    return _changed(t, "grade").items.select(*CHANGED)


@query
def apply_locations(t: Inputs):
    return _changed(t, "location").items.select("item_id", "acquisition_id", "storage_location")


@query
def apply_sales(t: Inputs):
    return _changed(t, "sale").sales.drop("created_at", "notes")


@query
def apply_changes(t: Inputs):
    return _changed(t, "edit", "sale", "grade", "location").items.select(*CHANGED)


@query
def merge_changes(t: Inputs):
    """All changes folded into the stored buckets they touch."""
    store = _store(t)
    store.merge(t.events)
    return store.table("item").select(*CHANGED)


@query
def merge_sales(t: Inputs):
    store = _store(t)
    store.merge(t.events.where("kind = 'sale'"))
    return store.table("sale").drop("created_at", "notes", "acquisition_id")


@query
def change_rejects(t: Inputs):
    return changes.event_rejects(t.events, t.items).select("event_id", "kind", "reason")


@query
def backfill_game(t: Inputs):
    return changes.backfill_game(t.boxes, t.items).select("item_id", "game")


@query
def evolve_schema(t: Inputs):
    """Items of the first table version, brought up to date."""
    lacking = ["game", "tcgplayer_product_id", "image_url", "grade_candidate", "graded_value_est"]
    items = evolve(t.items.drop(*lacking), "item")
    return items.select("item_id", "name", *lacking)


@query
def cascade_delete(t: Inputs):
    """Keys left in each table once resold boxes are removed."""
    removed = t.boxes.where("status = 'resold_sealed'")
    boxes, items, sales = changes.cascade_delete(t.boxes, t.items, t.sales, removed)
    frames = [
        df.select(F.lit(name).alias("table_name"), F.col(key).alias("key"))
        for name, df, key in [("acquisition", boxes, "acquisition_id"), ("item", items, "item_id"),
                              ("sale", sales, "sale_id")]
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def violations(t: Inputs):
    """Rules broken by unchecked imports; the stored tables break none."""
    result = imports.import_sealed(t.manifest, t.import_rows, t.boxes, t.items)
    tables = {
        "acquisition": t.boxes.unionByName(result.acquisitions.select(*ACQUISITION.names)),
        "item": t.items.unionByName(result.items.select(*ITEM.names)),
        "sale": t.sales, "game_titles": t.games.titles, "game_copies": t.games.copies,
        "game_purchases": t.games.purchases,
    }
    return quality.all_violations(tables)


@query
def orphans(t: Inputs):
    """Rows left without a parent when sealed boxes and graded items are dropped alone."""
    return quality.orphans({
        "acquisition": t.boxes.where("status <> 'sealed'"),
        "item": t.items.where("grader is null"), "sale": t.sales,
        "game_titles": t.games.titles, "game_copies": t.games.copies,
        "game_purchases": t.games.purchases,
    })


# Saved service answers


@query
def metadata_media_hits(t: Inputs):
    return metadata.media_hits(t.media_payloads)


@query
def metadata_media_genre(t: Inputs):
    return metadata.media_genres(metadata.media_hits(t.media_payloads), t.genres)


@query
def metadata_game_hits(t: Inputs):
    return metadata.game_hits(t.game_payloads)


@query
def metadata_game_companies(t: Inputs):
    return metadata.game_companies(t.game_pages)


@query
def metadata_poster_path(t: Inputs):
    return metadata.poster_lookup(t.media_payloads)
