"""Reports, gradings and changes on worked cases."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hoardbook.functions.ordering import columns
from hoardbook.operators import catalog, changes, grading, ledger, locate, quality
from hoardbook.plans.inputs import Inputs
from hoardbook.sources.tables import conform, evolve

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Inputs(spark, FOLDER)


@pytest.fixture()
def items(table):
    def make(*cards):
        names = ["item_id", "acquisition_id", "name", "condition", "market_value", "grade_candidate",
                 "graded_value_est", "grader", "status"]
        data = [tuple(c.get(n) for n in names) for c in cards]
        df = table(data, "item_id bigint, acquisition_id bigint, name string, condition string,"
                         " market_value string, grade_candidate boolean, graded_value_est string,"
                         " grader string, status string")
        return conform(df.withColumns({
            "status": F.coalesce("status", F.lit("inventory")),
            "grade_candidate": F.coalesce("grade_candidate", F.lit(False)),
        }), "item")
    return make


def test_candidates(items):
    cards = items(
        dict(item_id=1, acquisition_id=1, name="at threshold", condition="NM", market_value="25.00"),
        dict(item_id=2, acquisition_id=2, name="below", condition="NM", market_value="24.99"),
        *[dict(item_id=10 + i, acquisition_id=3, name="box", condition="LP", market_value=v)
          for i, v in enumerate(["0.50", "1", "1", "4"])],
        dict(item_id=20, acquisition_id=4, name="estimate", condition="NM", market_value="30", graded_value_est="120"),
        dict(item_id=21, acquisition_id=4, name="flagged", grade_candidate=True),
        dict(item_id=22, acquisition_id=4, name="graded", condition="NM", market_value="90", grader="PSA"),
        dict(item_id=23, acquisition_id=4, name="listed", condition="NM", market_value="90", status="listed"),
    )
    got = grading.grade_candidates(cards)
    assert rows(got, "item_id", "tier", "est_upside") == [
        (1, "grade", None), (13, "review", None), (20, "grade", D("60.00")), (21, "grade", None)]
    assert grading.box_median(cards).where("acquisition_id = 3").first()[1] == 1.0
    assert [r["item_id"] for r in grading.best_first(got).collect()] == [20, 1, 13, 21]


def test_orderings(table):
    data = table([(1, None), (2, 5), (3, 7)], "k int, v int")
    from hoardbook.functions import ordering as o

    def order(direction):
        return [r["k"] for r in data.orderBy(*columns([(direction, "v")])).collect()]

    assert (order(o.asc), order(o.desc), order(o.desc_nulls_last)) == ([2, 3, 1], [1, 3, 2], [3, 2, 1])


@pytest.mark.parametrize("sort", [*catalog.MEDIA.sorts, "unknown"])
def test_media_sorts(t, sort):
    got = catalog.search(t.media, sort=sort).collect()
    keys = {
        "cost_desc": lambda r: (r["cost"] is None, -(r["cost"] or 0)),
        "cost_asc": lambda r: (r["cost"] is None, r["cost"] or 0),
        "genre": lambda r: (r["genre"] is None, r["genre"] or "", r["title"]),
        "acquired_asc": lambda r: (r["purchase_date"] is None, str(r["purchase_date"]), r["title"]),
        "acquired_desc": lambda r: (r["purchase_date"] is None,
                                    -(r["purchase_date"].toordinal() if r["purchase_date"] else 0), r["title"]),
    }
    key = keys.get(sort, lambda r: r["title"])
    assert [key(r) for r in got] == sorted(key(r) for r in got)


@pytest.mark.parametrize("sort", [*ledger.COLLECTION_SORTS, "unknown"])
def test_collection_sorts(t, sort):
    got = ledger.collection(t.boxes, t.items, t.sales, sort=sort).collect()
    column, down = {
        "value_desc": ("market_value", True), "value_asc": ("market_value", False),
        "basis_desc": ("total_basis", True), "status": ("status", False),
        "acquired_asc": ("purchase_date", False), "acquired_desc": ("purchase_date", True),
    }.get(sort, ("name", False))
    values = [r[column] for r in got]
    known = [v for v in values if v is not None]
    assert known == sorted(known, reverse=down)
    assert values == known + [None] * (len(values) - len(known))


def test_locate(t):
    parts = {k: locate.locate(t.media, t.items, t.games, "Shelf 1", k).count() for k in locate.KINDS}
    assert locate.locate(t.media, t.items, t.games, " Shelf 1 ", "nonsense").count() == sum(parts.values())
    assert locate.locate(t.media, t.items, t.games, "  ").count() == 0
    counts = locate.locate_counts(t.media, t.items, t.games, "Shelf 1").first().asDict()
    assert counts == {**parts, "total": sum(parts.values())}


def test_search_by_location_joins_located_copies_only(t, capsys):
    for kind in (t.media, t.games):
        found = catalog.search(kind, location=" Shelf 1 ")
        every = catalog.base(kind).where(F.contains("location_label", F.lit("Shelf 1")))
        assert rows(found) == rows(every) and found.count()
        found.explain()
        plan = capsys.readouterr().out
        assert "LeftSemi" in plan


def test_samples_depend_on_the_seed_only(t):
    first = rows(catalog.media_posters(t.media, seed=1))
    assert first == rows(catalog.media_posters(t.media, seed=1)) and len(first) == 30
    assert first != rows(catalog.media_posters(t.media, seed=2))


def test_box_items_move_the_items_not_for_their_tiers(t, capsys):
    """Each sale of an item, and an item without sales, carries the tier; one join brings both."""
    candidates = grading.grade_candidates(t.items)
    found = ledger.box_items(t.boxes, t.items, t.sales, candidates)
    want = ledger.item_ledger_base(t.boxes, t.items, t.sales).join(
        candidates.select("item_id", "tier"), "item_id", "left"
    ).select(found.columns)
    assert rows(found) == rows(want)
    assert {"grade", "review", None} <= {r["tier"] for r in found.collect()}
    found.explain()  # the tiers are read from where they were written
    assert "/tiers-" in capsys.readouterr().out


def test_items_without_sales_are_found_without_their_boxes(t):
    """The boxes are joined once, to the items, and not again to find the items without sales."""
    plan = ledger.item_ledger(t.boxes, t.items, t.sales)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") and plan.count("orders.parquet") <= 1 and plan.count("LeftAnti") == 1
    assert plan.count("Join Inner") == 4  # items and boxes, these and sales, parts twice


def test_fan_out_of_sales(t):
    assert ledger.item_ledger(t.boxes, t.items, t.sales).count() > t.items.count()


EVENT = "event_id bigint, seq bigint, kind string, item_id bigint, acquisition_id bigint, fields map<string,string>"


def test_changes(items, table):
    cards = items(*[dict(item_id=i, acquisition_id=1, name=f"c{i}", condition="NM", market_value="5",
                         grade_candidate=True) for i in range(1, 5)])
    sales = conform(table([], "sale_id bigint, item_id bigint, sale_date date, gross_price decimal(12,2)"), "sale")
    events = table([
        (1, 1, "edit", 1, None, {"condition": "", "market_value": "bad", "notes": "n", "grade_candidate": "on"}),
        (2, 2, "edit", 1, None, {"status": "keep"}),
        (3, 3, "edit", 2, None, {"status": ""}),
        (4, 4, "sale", 3, None, {"sale_date": "2026-01-02", "gross_price": "40", "shipping_charged": "4",
                                 "marketplace_fee": "5.20", "processing_fee": "1.30", "shipping_paid": "4.50",
                                 "supplies_cost": "0.50"}),
        (5, 5, "sale", 2, None, {"gross_price": "40"}),
        (6, 6, "grade", 4, None, {"grader": "PSA", "grade": "9.5", "grading_fee": "20", "grading_ship": "x"}),
        (7, 7, "location", None, 1, {"storage_location": "Bin"}),
        (8, 8, "edit", 4, None, {"storage_location": ""}),
        (9, 9, "sale", 99, None, {"sale_date": "2026-01-02", "gross_price": "1"}),
        # Of equal seq the higher event_id wins.
        (12, 10, "edit", 3, None, {"notes": "second"}),
        (11, 10, "edit", 3, None, {"notes": "first"}),
    ], EVENT)
    after = changes.apply_changes(cards, sales, events)
    got = {r["item_id"]: r for r in after.items.collect()}
    one = got[1]
    assert (one["condition"], one["market_value"], one["notes"], one["status"], one["grade_candidate"]) == (
        None, None, "n", "keep", False)
    assert (got[2]["status"], got[3]["status"], got[2]["grade_candidate"]) == ("inventory", "sold", True)
    four = got[4]
    assert (four["grader"], four["grade"], four["grading_total"], four["status"]) == ("PSA", D("9.5"), D("20.00"), "inventory")
    assert [got[i]["storage_location"] for i in (1, 2, 3, 4)] == ["Bin", "Bin", "Bin", None]
    assert rows(after.sales, "sale_id", "item_id", "net_proceeds") == [(1, 3, D("32.50"))]
    assert got[3]["notes"] == "second"
    assert rows(after.rejected, "event_id", "reason") == [(3, "status"), (5, "sale_date"), (9, "item_id")]
    again = changes.apply_changes(after.items, sales, events).items
    assert rows(again.drop("created_at", "subgrades")) == rows(after.items.drop("created_at", "subgrades"))


def test_rules_and_references(t, spark):
    stored = {"acquisition": t.boxes, "item": t.items, "sale": t.sales, "game_titles": t.games.titles,
              "game_copies": t.games.copies, "game_purchases": t.games.purchases}
    assert quality.all_violations(stored).count() == 0
    assert quality.orphans(stored).count() == 0
    broken = t.games.copies.limit(1).withColumns({"platform": F.lit("p" * 61), "edition": F.lit(None).cast("string")})
    assert [r["rule"] for r in quality.violations(broken, "game_copies").collect()] == ["platform is longer than 60"]


def test_evolution_is_idempotent(t):
    old = t.items.drop("grade_candidate", "image_url")
    once = evolve(old, "item")
    assert evolve(once, "item").columns == once.columns
    assert once.select("grade_candidate", "image_url").distinct().collect() == [(False, None)]
