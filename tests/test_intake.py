"""Export files, batches and imports on worked cases."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hoardbook.operators import imports, intake
from hoardbook.operators.allocate import allocate_cost, box_shares
from hoardbook.operators.ledger import box_pl
from hoardbook.sources.exports import export_rows, read_typed_rows, scan_exports
from hoardbook.sources.store import Store
from hoardbook.sources.tables import conform, read_numbered

FIELDS = ("batch_id mode intake description purchase_date product_type game language price tax"
          " shipping other_fees packs_total cards_per_pack packs_now source channel"
          " acquisition_id basis").split()


@pytest.fixture()
def manifest(table):
    def make(*batches):
        return table(
            [tuple(b.get(f) for f in FIELDS) for b in batches],
            ", ".join(f"{f} string" for f in FIELDS),
        )
    return make


@pytest.fixture()
def typed(table):
    def make(*cards):
        names = ["batch_id", "row_idx", "name", "market_value", "paid", "qty", "set_code",
                 "collector_number", "variant", "condition", "image_url", "game"]
        data = [tuple(c.get(n) for n in names) for c in cards]
        schema = ", ".join(f"{n} {'bigint' if n == 'row_idx' else 'string'}" for n in names)
        return intake.normalize_typed(table(data, schema))
    return make


@pytest.fixture()
def tables(table):
    """One stored box: cost 96.29, 4 of 16 packs, three cards valued 10, 5 and nothing."""
    boxes = conform(table(
        [(1, "2026-06-12", "Box", "weiss", "sealed_box", 16, 4, "89.99", "6.30", "partial")],
        "acquisition_id bigint, purchase_date string, description string, game string,"
        " product_type string, packs_total int, packs_opened int, purchase_price string,"
        " tax string, status string",
    ).withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("purchase_price", "tax")}), "acquisition")
    items = conform(table(
        [(1, 1, "a", "10"), (2, 1, "b", "5"), (3, 1, "c", None)],
        "item_id bigint, acquisition_id bigint, name string, market_value_at_open string",
    ).withColumn("market_value_at_open", F.col("market_value_at_open").cast("decimal(12,2)")), "item")
    return boxes, items


SEALED = dict(batch_id="b1", mode="sealed", intake="manual", description="Box",
              purchase_date="2026-06-12", product_type="sealed_box", price="89.99", tax="6.30",
              packs_total="16", packs_now="4")


def test_allocation(tables):
    boxes, items = tables
    assert boxes.first()["total_cost"] == D("96.29")
    assert rows(box_shares(boxes, items), "allocatable", "total_value") == [(D("24.07"), D("15.00"))]
    settled = allocate_cost(boxes, items)
    assert rows(settled, "item_id", "cost_basis") == [(1, D("16.05")), (2, D("8.02")), (3, D("0.00"))]
    unvalued = items.withColumn("market_value_at_open", F.lit(None).cast("decimal(12,2)"))
    assert [r[0] for r in rows(allocate_cost(boxes, unvalued), "cost_basis")] == [D("8.02")] * 3


def test_allocation_of_unopened_overopened_and_unknown_boxes(tables):
    boxes, items = tables
    for opened, total, expected in [(0, 16, "0.00"), (20, 16, "96.29"), (None, 16, "96.29"),
                                    (4, None, "96.29"), (8, 16, "48.15")]:
        changed = boxes.withColumns({
            "packs_opened": F.lit(opened).cast("int"), "packs_total": F.lit(total).cast("int"),
        })
        assert box_shares(changed, items).first()["allocatable"] == D(expected)


def test_box_result(tables):
    boxes, items = tables
    held = items.where("item_id = 1").withColumn("market_value", F.lit("50").cast("decimal(12,2)"))
    sold = items.where("item_id = 2").withColumn("status", F.lit("sold"))
    sales = sold.select(
        F.lit(1).alias("sale_id"), "item_id", F.lit("32.50").cast("decimal(12,2)").alias("net_proceeds")
    )
    row = box_pl(boxes, held.unionByName(sold), sales).first()
    assert (row["cost_per_pack"], row["recovered_value"], row["net_result"], row["roi_pct"]) == (
        D("6.02"), D("82.50"), D("-13.79"), D("-14.3"))


@pytest.mark.parametrize("extra,status,opened", [
    ({}, "partial", 4), ({"packs_now": "0"}, "sealed", 0), ({"packs_now": ""}, "opened", 16),
    ({"packs_now": "16"}, "opened", 16), ({"packs_total": "0"}, "opened", 4),
    ({"product_type": "single"}, "opened", 4), ({"product_type": None}, "partial", 4),
])
def test_status(manifest, typed, extra, status, opened):
    batches = intake.batches_with_summary(
        manifest({**SEALED, **extra}), typed(dict(batch_id="x", row_idx=1, name="n"))
    )
    row = intake.acquisition_rows(batches).first()
    assert (row["status"], row["packs_opened"]) == (status, opened)


def test_box_game(manifest, typed):
    batches = [dict(SEALED, batch_id=b, game="weiss") for b in ("two", "one", "none")]
    cards = typed(
        dict(batch_id="two", row_idx=1, name="a", game="Pokemon"),
        dict(batch_id="two", row_idx=2, name="b", game="weiss "),
        dict(batch_id="one", row_idx=1, name="c", game="mtg"),
        dict(batch_id="none", row_idx=1, name="d"),
    )
    got = intake.acquisition_rows(intake.batches_with_summary(manifest(*batches), cards))
    assert rows(got, "batch_id", "game") == [("none", "weiss"), ("one", "mtg"), ("two", "mixed")]


def test_singles_basis(table, typed):
    cards = typed(
        dict(batch_id="b", row_idx=1, name="a", paid="2", market_value="5"),
        dict(batch_id="b", row_idx=2, name="b", market_value="5"),
        dict(batch_id="b", row_idx=3, name="c"),
    )
    entered = table([("b", 0, "3"), ("b", 1, " "), ("b", 2, "zero")], "batch_id string, card_index int, paid string")
    got = imports.singles_basis(cards, entered)
    assert rows(got, "card_index", "cost_basis", "used_fallback") == [
        (0, D("3.00"), False), (1, D("5.00"), True), (2, D("0.00"), False)]


def test_entered_prices_are_not_broadcast(spark):
    """They may be few rows that were expanded into one for every card."""
    entered = spark.range(1).selectExpr(
        "'a' as batch_id", "explode(sequence(0L, 99L)) as card_index", "'1' as paid"
    )
    lines = spark.range(1).selectExpr(
        "'a' as batch_id", "0L as row_pos", "2 as quantity", "cast(1 as decimal(12,2)) as paid",
        "cast(1 as decimal(12,2)) as market_value",
    )
    cards = imports.singles_basis(lines, entered)
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftOuter, BuildRight" not in plan


def test_headers_are_stored_before_they_are_compared(spark, tmp_path):
    """Else the cells of every line are formed."""
    (tmp_path / "a.csv").write_text("Title,Number\nx,1\ny,2\n")
    found = scan_exports(spark, str(tmp_path))
    assert any("/file-headers-" in f for f in found.inputFiles())
    assert found.count() == 2


def test_shares_of_an_import_are_a_table(spark):
    """Spark knows their size, so the items are not taken for the smaller side and broadcast."""
    boxes = spark.sql("select 1L as acquisition_id, 2 as packs_opened, 4 as packs_total, cast(8 as decimal(12,2)) as total_cost, 7 as batch_id")
    items = spark.sql("select id as item_id, 1L as acquisition_id, cast(id as decimal(12,2)) as market_value_at_open, cast(null as decimal(12,2)) as cost_basis from range(1, 4)")
    settled = imports._settled(boxes, items, None)
    assert settled._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r["item_id"], str(r["cost_basis"])) for r in settled.collect()) == [(1, "0.67"), (2, "1.33"), (3, "2.00")]


def test_sealed_import_then_append_equals_one_import(spark, manifest, typed, tmp_path):
    """Two days of opening end where one import of all cards with the same packs ends."""
    day1 = [dict(batch_id="b1", row_idx=i, name=f"c{i}", market_value=str(i)) for i in range(1, 5)]
    day2 = [dict(batch_id="b2", row_idx=i, name=f"d{i}", market_value=str(i), qty="2") for i in range(1, 4)]
    first = imports.import_sealed(manifest(SEALED), typed(*day1))
    assert {r["status"] for r in first.acquisitions.collect()} == {"partial"}
    key = first.acquisitions.first()["acquisition_id"]
    more = dict(batch_id="b2", mode="append", intake="manual", acquisition_id=str(key), packs_now="4")
    both = imports.import_append(
        manifest(more), typed(*day2), first.acquisitions, first.items.drop("batch_id", "card_index")
    )
    assert rows(both.acquisitions, "packs_opened", "status") == [(8, "partial")]
    whole = imports.import_sealed(
        manifest(dict(SEALED, packs_now="8")),
        typed(*day1, *[dict(c, batch_id="b1", row_idx=c["row_idx"] + 10) for c in day2]),
    )
    assert rows(both.items, "name", "cost_basis") == rows(whole.items, "name", "cost_basis")
    assert both.items.count() == 10
    store = Store(spark, str(tmp_path), buckets=2)
    store.add_import("1", first.acquisitions, first.items)
    store.replace_boxes(both.acquisitions, both.items)
    assert rows(store.table("item"), "item_id", "cost_basis") == rows(both.items, "item_id", "cost_basis")
    assert rows(store.table("acquisition"), "packs_opened") == [(8,)]
    assert sorted(r[0] for r in rows(both.items, "item_id")) == list(range(1, 11))


def test_published_versions(spark, manifest, typed, tmp_path):
    """Import, import again, add to a box, fail before the marker, read back."""
    store = Store(spark, str(tmp_path), buckets=4)
    two = [dict(SEALED, batch_id=b) for b in ("b1", "b9")]
    cards = [dict(batch_id=b, row_idx=1, name=f"c-{b}", market_value="2") for b in ("b1", "b9")]
    first = imports.import_sealed(manifest(*two), typed(*cards))
    for _ in range(2):
        store.add_import("1", first.acquisitions, first.items)
    boxes, items = store.table("acquisition"), store.table("item")
    assert sorted(rows(items, "name")) == [("c-b1",), ("c-b9",)] and boxes.count() == 2
    key = boxes.agg(F.min("acquisition_id")).first()[0]
    more = dict(batch_id="b2", mode="append", intake="manual", acquisition_id=str(key), packs_now="4")
    both = imports.import_append(
        manifest(more), typed(dict(batch_id="b2", row_idx=1, name="d", market_value="5")), boxes, items
    )
    store.replace_boxes(both.acquisitions, both.items)
    boxes, items = store.table("acquisition"), store.table("item")
    other = first.items.where(F.col("acquisition_id") != key)
    want = sorted(rows(both.items, "item_id", "cost_basis") + rows(other, "item_id", "cost_basis"))
    assert sorted(rows(items, "item_id", "cost_basis")) == want and len(want) == 3
    assert boxes.count() == 2
    store._write("acquisition", first.acquisitions, 4)
    boxes, items = store.table("acquisition"), store.table("item")
    assert boxes.count() == 2 and sorted(rows(items, "item_id", "cost_basis")) == want


def test_append_leaves_out_batches_that_break_a_rule(manifest, typed, tables):
    boxes, items = tables
    more = dict(mode="append", intake="manual", acquisition_id="1", packs_now="2")
    got = imports.import_append(
        manifest(dict(more, batch_id="good"), dict(more, batch_id="bad")),
        typed(dict(batch_id="good", row_idx=1, name="d", market_value="5"),
              dict(batch_id="bad", row_idx=1, name="e", condition="Mint")),
        boxes, items,
    )
    assert rows(got.items, "name") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(got.acquisitions, "packs_opened") == [(6,)]


def test_large_quantities_are_cut_and_spread(typed):
    cards = typed(
        dict(batch_id="b", row_idx=1, name="a", qty="25"), dict(batch_id="b", row_idx=2, name="b", qty="2"),
        dict(batch_id="b", row_idx=3, name="c", qty="10"),
    )
    cut = intake.expand_quantity(cards, chunk=10)
    assert rows(cut, "name", "copy_no") == rows(intake.expand_quantity(cards), "name", "copy_no")
    assert cut.count() == 37


def test_import_rejects(manifest, typed, tables):
    boxes, _ = tables
    batches = manifest(
        dict(SEALED, batch_id="ok"), dict(SEALED, batch_id="mode", mode="other"),
        dict(SEALED, batch_id="fields", description=" ", price=""),
        dict(batch_id="single", mode="singles", intake="manual", description="d", purchase_date=""),
        dict(batch_id="pick", mode="append", intake="csv", acquisition_id=" "),
        dict(batch_id="gone", mode="append", intake="csv", acquisition_id="99"),
        dict(SEALED, batch_id="empty_csv", intake="csv"), dict(SEALED, batch_id="empty_typed"),
        dict(batch_id="empty_single", mode="singles", intake="manual", description="d", purchase_date="2026-01-01"),
    )
    cards = typed(*[dict(batch_id=b, row_idx=1, name="n") for b in ("ok", "mode", "fields", "single", "pick", "gone")])
    assert dict(rows(imports.import_rejects(batches, cards, boxes))) == {
        "mode": "Unknown import mode.", "fields": "Please fill in: description, price.",
        "single": "Please fill in: purchase_date.", "pick": "Pick an existing box to append to.",
        "gone": "That box no longer exists.",
        "empty_csv": "No cards parsed from that CSV — check the format.",
        "empty_single": "Enter at least one card.",
    }


@pytest.fixture()
def exports(tmp_path):
    files = {
        "a.csv": "﻿Product Name,Product Line,Set Name,Number,Rarity,Printing,Condition,TCG Market Price,"
                 "Add to Quantity,My Cost\r\n"
                 '"Frieren, ""the"" mage",Weiss Schwarz,Set,SFN/S108-E006 R,R,Foil,Near Mint,12.5,2.9,3\r\n'
                 '"Two\nlines",Pokemon,Base,064/113,Common,Normal,Lightly Played,,0,\r\n'
                 "Short\r\n\r\n"
                 "   ,Pokemon,Base,1,,,,9,1,\r\n",
        "b.csv": "Total Quantity,Title,TCG Market Price\n3,Plain,1.50\nx,Other,bad\n1,Extra,2,more,cells\n",
        "c.csv": "Something,Else\n1,2\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


@pytest.mark.parametrize("limit", [None, 1])
def test_export_files(spark, exports, limit):
    scanned = scan_exports(spark, exports, rows_per_task=limit)
    named = export_rows(scanned).withColumn("batch_id", F.regexp_extract("batch_id", "([a-z]).csv", 1))
    got = intake.normalize_export(named)
    assert rows(got, "batch_id", "row_pos", "name", "game", "collector_number", "variant", "condition",
                "market_value", "paid", "quantity") == [
        ("a", 1, 'Frieren, "the" mage', "weiss", "SFN/S108-E006", "R Foil", "NM", D("12.50"), D("3.00"), 2),
        ("a", 2, "Two\nlines", "pokemon", "064/113", "Common", "LP", None, None, 1),
        ("a", 3, "Short", "other", None, None, None, None, None, 1),
        ("b", 1, "Plain", "other", None, None, None, D("1.50"), None, 3),
        ("b", 2, "Other", "other", None, None, None, None, None, 1),
        ("b", 3, "Extra", "other", None, None, None, D("2.00"), None, 1),
    ]
    summary = intake.batch_summary(got)
    assert rows(summary, "batch_id", "n_cards", "set_code", "total_value", "sum_paid", "has_paid_column", "mixed") == [
        ("a", 4, "SFN/S108", D("25.00"), D("6.00"), True, True),
        ("b", 5, None, D("6.50"), D("0.00"), False, False),
    ]


def test_wide_exports_keep_every_column(spark, tmp_path):
    headers = ["Product Name"] + [f"h{i}" for i in range(39)] + ["", "Paid"]
    cells = ["Wide"] + ["x"] * 39 + ["", "4.25"]
    (tmp_path / "wide.csv").write_text(",".join(headers) + "\n" + ",".join(cells) + "\n")
    got = export_rows(scan_exports(spark, str(tmp_path)))
    assert rows(got, "name", "paid", "has_paid_column") == [("Wide", "4.25", True)]


def test_split_export_files_keep_their_order(spark, tmp_path):
    lines = ["Product Name"] + [f"card {i}" for i in range(5000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = export_rows(scan_exports(spark, str(tmp_path), multiline=False))
        found = rows(got, "row_pos", "name")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == [(i + 1, f"card {i}") for i in range(5000)]


def test_typed_rows_from_json(spark, tmp_path):
    cards = [dict(batch_id="b", row_idx=2, name=" B ", qty="2", paid="1"), dict(batch_id="b", row_idx=0, name=" ")]
    (tmp_path / "rows.json").write_text("\n".join(json.dumps(c) for c in cards))
    got = intake.normalize_typed(read_typed_rows(spark, str(tmp_path)))
    assert rows(got, "row_pos", "name", "game", "paid", "quantity") == [(2, "B", None, D("1.00"), 2)]


def test_rows_of_many_files_are_numbered_in_order(spark, tmp_path):
    path = str(tmp_path / "many files")
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    got = read_numbered(spark, path, "n")
    assert rows(got.where("n <> id + 1")) == []
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 1000, 1000)


def test_import_is_stored_whole_or_not_at_all_and_once(spark, manifest, typed, tmp_path):
    batches = manifest(dict(SEALED, batch_id="good"), dict(SEALED, batch_id="bad"), dict(SEALED, batch_id="cost", price="-5"))
    cards = typed(
        dict(batch_id="good", row_idx=1, name="a", market_value="1", condition="NM"),
        dict(batch_id="bad", row_idx=1, name="b", condition="NM"),
        dict(batch_id="bad", row_idx=2, name="c", condition="Mint"),
        dict(batch_id="cost", row_idx=1, name="d"),
    )
    result = imports.import_sealed(batches, cards)
    store = Store(spark, str(tmp_path), buckets=2)
    for _ in range(2):
        rejects = store.add_result("run-1", result)
    assert {r["batch_id"] for r in rejects.collect()} == {"bad", "cost"}
    assert rows(store.table("item"), "name", "cost_basis") == [("a", D("24.07"))]
    assert store.table("acquisition").count() == 1


@pytest.fixture()
def legacy(table):
    def make(*cards):
        names = ["batch_id", "row_pos", "Product Name", "Number", "TCG Market Price", "Paid"]
        schema = "`batch_id` string, `row_pos` bigint, " + ", ".join(f"`{n}` string" for n in names[2:])
        from hoardbook.sources.exports import named_export_rows
        return intake.normalize_export(
            named_export_rows(table(list(cards), schema), "batch_id", "row_pos"), legacy=True)

    return make


def test_legacy_additions(manifest, legacy, tables):
    boxes, items = tables
    stored = boxes.unionByName(boxes.withColumn("acquisition_id", F.lit(2).cast("bigint")))
    more = dict(mode="append", intake="csv", packs_now="1")
    batches = manifest(
        dict(more, batch_id="p", acquisition_id="1", product_type="single"),
        dict(more, batch_id="q", acquisition_id="2", product_type="sealed_box"),
        dict(more, batch_id="r", acquisition_id="2", product_type="sealed_box", basis="as_paid"),
    )
    cards = legacy(("p", 1, "d", "", "5", "2"), ("p", 2, "e", "", "7", ""),
                   ("q", 1, "f", "", "1", "8"), ("r", 1, "g", "", "3", "9"))
    got = imports.import_legacy_append(batches, cards, stored, items)
    # Box 1 is not settled; box 2 (6 of 16 packs: 36.11) is, with the as-paid card among its items.
    assert sorted(r["item_id"] for r in got.items.collect()) == list(range(1, 8))
    assert rows(got.items, "name", "cost_basis") == [
        ("a", D("0.00")), ("b", D("0.00")), ("c", D("0.00")), ("d", D("2.00")), ("e", D("7.00")),
        ("f", D("9.03")), ("g", D("27.08"))]
    assert rows(got.acquisitions, "acquisition_id", "packs_opened") == [(1, 5), (2, 6)]


def test_legacy_basis(manifest, legacy):
    export = legacy
    single = dict(mode="singles", intake="csv", description="d", purchase_date="2026-06-12", product_type="single")
    batches = manifest(
        dict(single, batch_id="paid", price="50"), dict(single, batch_id="given", price="7"),
        dict(single, batch_id="value"), dict(SEALED, batch_id="forced", basis="as_paid"),
        dict(SEALED, batch_id="sealed", packs_now="0"), dict(SEALED, batch_id="free", price=" "),
        dict(single, batch_id="undated", purchase_date=""), dict(single, batch_id="empty"),
    )
    cards = export(
        ("free", 1, "x", "", "1", ""), ("undated", 1, "y", "", "1", ""),
        ("paid", 1, "a", "A-1 R", "5", "2"), ("paid", 2, "b", "A-2 R", "5", "free"), ("paid", 3, "c", "", "bad", "4"),
        ("given", 1, "d", "X 1", "5", ""), ("value", 1, "e", "", "5", ""), ("value", 2, "f", "", "", ""),
        ("forced", 1, "g", "", "1", "9"), ("sealed", 1, "h", "", "1", ""),
    )
    result = imports.import_legacy(batches, cards)
    assert rows(result.items, "name", "cost_basis") == [
        ("a", D("2.00")), ("b", None), ("c", D("4.00")), ("d", D("7.00")), ("e", D("5.00")), ("f", None),
        ("g", D("9.00")), ("h", D("0.00"))]
    assert [r[0] for r in rows(imports.legacy_rejects(batches, cards), "batch_id")] == [
        "empty", "free", "undated"]
    # A row whose price is unreadable adds nothing to the sum of what was paid.
    assert rows(result.acquisitions, "batch_id", "purchase_price", "status", "set_code") == [
        ("forced", D("9.00"), "partial", None), ("given", D("7.00"), "opened", None),
        ("paid", D("2.00"), "opened", "A"), ("sealed", D("89.99"), "partial", None),
        ("value", D("5.00"), "opened", None)]


def test_numbers_that_do_not_fit_reject_their_batch(spark, manifest, typed, tables):
    """Three billion copies, or an amount beyond what a table holds: told by name, never misread."""
    boxes, _ = tables
    cards = typed(
        dict(batch_id="ok", row_idx=1, name="a", qty="2147483647", market_value="9999999999.99"),
        dict(batch_id="many", row_idx=1, name="b", qty="3000000000"), dict(batch_id="many", row_idx=2, name="c"),
        dict(batch_id="dear", row_idx=1, name="d", market_value="12345678901.5", paid="1e300"),
        dict(batch_id="odd", row_idx=1, name="e", qty="lots", market_value="n/a", paid="1_0.5"),
    )
    got = {r["name"]: (r["quantity"], r["misfit"]) for r in cards.collect()}
    assert got == {"a": (2147483647, ""), "b": (1, "quantity"), "c": (1, ""), "d": (1, "market_value, paid"), "e": (1, "")}
    assert dict(rows(imports.row_rejects(cards))) == {
        "many": "quantity is too large", "dear": "market_value, paid is too large"}
    few = cards.where("name <> 'a'")
    batches = manifest(*[dict(SEALED, batch_id=b) for b in ("many", "dear", "odd")])
    result = imports.import_sealed(batches, few)
    assert rows(result.acquisitions, "batch_id") == [("odd",)] and rows(result.items, "name") == [("e",)]
    priced = manifest(dict(SEALED, batch_id="odd", price="99999999999"), dict(SEALED, batch_id="dear", tax="1e200"))
    assert dict(rows(imports.import_rejects(priced, few, boxes))) == {"odd": "Too large: price.", "dear": "Too large: tax."}


def test_upload_without_a_file(spark, manifest, typed, tables):
    boxes, _ = tables
    csv = manifest(dict(SEALED, batch_id="b", intake="csv"), dict(SEALED, batch_id="f", intake="csv"), dict(SEALED, batch_id="m"))
    named = csv.withColumn("file_name", F.when(F.col("batch_id") == "f", "x.csv"))
    cards = typed(dict(batch_id="f", row_idx=1, name="n"), dict(batch_id="b", row_idx=1, name="n"))
    assert dict(rows(imports.import_rejects(named, cards, boxes))) == {"b": "Choose a TCGplayer CSV export to upload."}


def test_status_of_items_of_the_older_loader(manifest, legacy):
    cards = legacy(("b", 1, "one", "S-1 R", "4.00", ""))
    batch = manifest(dict(SEALED, batch_id="b", intake="csv"))
    assert rows(imports.import_legacy(batch, cards).items, "status") == [("inventory",)]
    assert rows(imports.import_legacy(batch, cards, status="keep").items, "status") == [("keep",)]
