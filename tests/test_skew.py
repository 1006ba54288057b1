"""The spread joins, running totals, keys and pattern joins against plain results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hoardbook.operators.keysets import rows_with_keys, rows_without_keys
from hoardbook.operators.numbering import assign_keys, running_before
from hoardbook.operators.patterns import match_patterns
from hoardbook.operators.skew import hot_keys, join_one_to_many
from hoardbook.sources.tables import read_numbered


@pytest.fixture(scope="module")
def uneven(table):
    """A third of 3,000 rows under key 7, a few without a key, the rest spread out."""
    chance = random.Random(1)
    many = [(i, 7 if i % 3 == 0 else chance.randrange(200) if i % 50 else None) for i in range(3000)]
    one = [(k, f"n{k}") for k in range(-5, 150)]
    return table(one, "k int, name string"), table(many, "id int, k int")


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_spread_join_equals_plain_join(uneven, how):
    one, many = uneven
    spread = join_one_to_many(one, many, ["k"], ["id"], how, rows_per_task=20)
    plain = one.join(many, "k", how)
    assert sorted(spread.columns) == sorted(plain.columns)
    assert rows(spread, *plain.columns) == rows(plain)


def test_hot_key_is_spread_over_tasks(uneven):
    one, many = uneven
    hot = hot_keys(many, ["k"], 100).collect()
    assert [(h["k"], h["_salts"] >= 10) for h in hot] == [(7, True)]
    plan = join_one_to_many(one, many, ["k"], ["id"], "inner", 100)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_every_hot_key_is_spread(spark, table):
    """1,500 hot keys and a third of the rows without a key."""
    many = table([(i, None if i % 3 == 0 else i % 1500) for i in range(45_000)], "id int, k int")
    one = table([(k, "x") for k in range(1600)], "k int, name string")
    assert hot_keys(many, ["k"], 10).count() == 1500 - 500
    for how in ("inner", "left", "right"):
        spread = join_one_to_many(one, many, ["k"], ["id"], how, 10)
        assert rows(spread, "k", "name", "id") == rows(one.join(many, "k", how), "k", "name", "id")


def test_joins_are_plain_by_default(uneven):
    one, many = uneven
    plan = join_one_to_many(one, many, ["k"], ["id"])._jdf.queryExecution().toString()
    assert "_salt" not in plan


def test_left_join_moves_the_kept_rows_once(table):
    one = table([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "key int, wide string")
    many = table([(1, 10), (1, 11), (3, 12), (4, 13), (None, 14)], "key int, n int")
    joined = join_one_to_many(one, many, ["key"], ["n"], "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<[^>]*wide", plan)) == 1
    assert joined.columns == ["key", "wide", "n"]
    assert rows(joined) == sorted(
        [(1, "a", 10), (1, "a", 11), (2, "b", None), (3, "c", 12), (None, "d", None)], key=repr
    )


def test_rows_of_several_files_are_numbered_where_they_are(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = read_numbered(spark, str(tmp_path / "t"), "n")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["n"] for r in found.collect()) == list(range(1, 31))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_key_sets(uneven):
    one, many = uneven
    keys = one.where("k in (7, 8, 149)")
    for limit in (None, 20):
        kept = rows_with_keys(many, keys, "k", ["id"], limit)
        left = rows_without_keys(many, keys, "k", ["id"], limit)
        assert rows(kept) == rows(many.join(keys, "k", "left_semi").select("id", "k"))
        assert rows(left) == rows(many.join(keys, "k", "left_anti").select("id", "k"))


@pytest.mark.parametrize("block", [1, 7, 1000, 1_000_000])
def test_running_totals(table, block):
    chance = random.Random(2)
    data = [("a" if i % 3 else "b", i * 5 + 2, chance.randrange(9)) for i in range(500)]
    got = running_before(table(data, "g string, pos bigint, v bigint"), "pos", "v", "before", ["g"], block)
    want, sums = [], {}
    for g, pos, v in data:
        want.append((g, pos, v, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + v
    assert rows(got, "g", "pos", "v", "before") == sorted(want, key=repr)


def test_keys_are_dense_and_repeatable(table):
    data = table([(f"u{i}",) for i in range(700)], "u string")
    existing = table([(41,), (12,)], "id bigint")
    first = rows(assign_keys(data, ["u"], "id", existing, digits=1))
    again = rows(assign_keys(data.repartition(3), ["u"], "id", existing, digits=3))
    assert first == again
    assert sorted(r[1] for r in first) == list(range(42, 742))


def like(pattern, text):
    """Plain matcher for the patterns of these tests."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(ch, re.escape(ch))
        i += 1
    return re.fullmatch(out, text, re.S | re.I) is not None


@pytest.mark.parametrize("limit", [None, 3])
def test_pattern_join_equals_brute_force(table, limit):
    texts = ["red ring", "Red Rod", "blue ring", "50% off", "500 off", "a_b", "axb", "", "x", "xy",
             "ring", "ringing", "Ünder", "red%", "aaaa", "abab"] + [f"red {i}" for i in range(30)]
    patterns = ["%ring%", "red%", "_ed r%", "%", "_", "__", "", r"50\%%", r"a\_b", "a_b", "RING",
                "%e_ r%", "%ü%", r"red\%", "_%", "%a%b%", "zzz%", "%r_n%", "____"]
    got = match_patterns(
        table([(t,) for t in texts], "t string"), "t", "t",
        table([(p,) for p in patterns], "p string"), "p", limit,
    )
    want = {(p, t) for p in patterns for t in texts if like(p, t)}
    found = [tuple(r) for r in got.select("p", "t").collect()]
    assert len(found) == len(set(found))
    assert set(found) == want


def test_pattern_join_has_no_pairwise_comparison(table):
    got = match_patterns(
        table([("red",)], "t string"), "t", "t", table([("r%",)], "p string"), "p"
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_task_gets_the_hot_key_alone(spark, table):
    """With a third of the rows under one key, no task of the join holds a quarter of them."""
    many = table([(i, 7 if i % 3 == 0 else i) for i in range(30_000)], "id int, k int")
    one = table([(k, "x") for k in range(30_000)], "k int, name string")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        def fullest(limit):
            joined = join_one_to_many(one, many, ["k"], ["id"], "left", limit)
            counts = joined.where("id is not null").groupBy(F.spark_partition_id()).count()
            return max(r["count"] for r in counts.collect())

        assert fullest(None) >= 10_000
        assert fullest(200) < 7_500
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_top_rows_are_cut_before_the_shuffle(spark):
    """History keeps the latest few per name within each map task already."""
    from hoardbook.plans.queries import QUERIES

    plan = QUERIES["grading_history"](spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_aggregates_are_combined_before_the_shuffle(spark):
    from hoardbook.plans.queries import QUERIES

    plan = QUERIES["box_pl"](spark, "/root/testdata/sf0.001")
    assert "partial_sum" in plan._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    from hoardbook.plans.queries import QUERIES

    plan = QUERIES["media_cost_by_store"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in text and "l_shipdate" not in text.split("ReadSchema")[1]


def test_spread_reports_equal_plain_reports(spark):
    """Operators with their joins forced to spread, against the plain plans."""
    from hoardbook.operators import allocate, catalog, changes, grading, ledger
    from hoardbook.plans.inputs import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    pairs = [
        lambda n: catalog.base(t.media, n), lambda n: catalog.title_detail(t.games, None, n),
        lambda n: allocate.allocate_cost(t.boxes, t.items, n).select("item_id", "cost_basis"),
        lambda n: ledger.item_ledger(t.boxes, t.items, t.sales, n),
        lambda n: grading.grade_candidates(t.items, rows_per_task=n),
        lambda n: grading.grading_scorecard(t.items, t.sales, n),
        lambda n: changes.backfill_game(t.boxes, t.items, n).select("item_id", "game"),
        lambda n: changes.apply_changes(t.items, t.sales, t.events, n).items.select(
            "item_id", "status", "storage_location", "grading_total"
        ),
    ]
    for make in pairs:
        assert rows(make(4)) == rows(make(None))


def test_median_of_full_boxes(table):
    from hoardbook.operators.grading import box_median

    chance = random.Random(3)
    data = [(i, 1 if i % 3 else i % 40, f"{chance.choice([chance.randrange(90), chance.randrange(5_000_000)])}.{chance.randrange(100):02d}")
            for i in range(900)]
    data += [(5000, 77, "-3.25"), (5001, 77, "20000.10"), (5002, 78, None)]
    items = table(data, "item_id int, acquisition_id int, v string").select(
        "item_id", "acquisition_id", F.col("v").cast("decimal(12,2)").alias("market_value")
    )
    want = {}
    for box, value in rows(items.dropna(), "acquisition_id", "market_value"):
        want.setdefault(box, []).append(value)
    for box, values in want.items():
        values.sort()
        low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
        want[box] = float(low) + 0.5 * (float(high) - float(low))
    assert rows(box_median(items)) == sorted(want.items(), key=repr)
