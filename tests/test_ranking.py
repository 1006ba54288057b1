"""Positions in a total order, and the first matches of patterns, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hoardbook.functions import ordering as o
from hoardbook.operators import patterns
from hoardbook.operators.patterns import leading_matches
from hoardbook.operators.ranking import positioned, positions_by


def test_positions_of_many_equal_rows(spark):
    """Nulls, ties and one value in a third of the rows; ranges meet without gap."""
    r = random.Random(1)
    data = [(i, r.choice([None, "a", "b", "b", "c"]) if i % 3 else "b", r.choice([None, 1.5, -2.0])) for i in range(5000)]
    frame = spark.createDataFrame(data, "id bigint, name string, cost double").repartition(7)
    sorts = {"name": [(o.asc, "name")], "cost_desc": [(o.desc_nulls_last, "cost"), (o.asc, "name")], "nulls_first": [(o.desc, "cost")]}
    got = {(x["sort"], x["id"]): x["position"] for x in positions_by(frame, sorts, ["id"]).collect()}
    text = lambda n: (n is None, n or "")
    keys = {
        "name": lambda x: (*text(x[1]), x[0]), "cost_desc": lambda x: (x[2] is None, -(x[2] or 0), *text(x[1]), x[0]),
        "nulls_first": lambda x: (x[2] is not None, -(x[2] or 0), x[0]),
    }
    for sort, key in keys.items():
        for place, row in enumerate(sorted(data, key=key), 1):
            assert got[sort, row[0]] == place
    assert len(got) == 3 * len(data)


def test_positions_need_no_single_task(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positioned(spark.range(20_000).select((-F.col("id")).alias("v")), [F.col("v").asc()])
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Sort [v" not in plan and got.where("position <> v + 20000").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert positioned(spark.range(0), [F.col("id").asc()]).count() == 0


def test_stored_positions_are_compressed_well(spark):
    """Keys in the order of something else: three of their eight bytes tell them apart."""
    import pyarrow.parquet as pq

    got = positioned(spark.range(200_000).withColumn("v", F.xxhash64("id")), [o.asc("v")])
    files = [pq.ParquetFile(path.removeprefix("file://")) for path in got.inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert {g.column(0).compression for g in groups} == {"ZSTD"}
    assert sum(g.column(0).total_compressed_size for g in groups) < 4 * 200_000


def like(pattern, text):
    """A pattern as users type it, on lower-cased text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, text, re.S | re.I) is not None


def firsts(texts, asked, limit, key):
    return {p: [t for t in sorted(texts, key=key) if like(p, t)][:limit] for p in asked}


@pytest.mark.parametrize("look, longer", [(1, 2), (8, 2), (64, 8)])
def test_first_matches_like_a_full_scan(spark, monkeypatch, look, longer):
    monkeypatch.setattr(patterns, "FIRST_LOOK", look)
    monkeypatch.setattr(patterns, "LONGER", longer)
    r = random.Random(look)
    texts = list({"".join(r.choice("abAB c%_") for _ in range(r.randint(0, 9))) for _ in range(900)})
    asked = ["%a%", "%ab%", "a%", "%zz%", "%", "_", "___", "%____%", "abc", "%a_b%", r"%\%%", r"%\_%", "%c", "", "%bbbb%", "%B%"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    probes = spark.createDataFrame([(p,) for p in asked], "p string")
    for order, key in (([F.col("t").asc()], lambda t: t), ([F.length("t").desc(), F.col("t").desc()], lambda t: (len(t), t))):
        got = leading_matches(frame, "t", order, probes, "p", 5)
        found = {}
        for p, t in rows(got, "p", "t"):
            found.setdefault(p, []).append(t)
        reverse = key("b") != "b"
        for p, want in firsts(texts, asked, 10**9, key).items():
            want = want[::-1] if reverse else want
            have = sorted(found.get(p, []), key=key, reverse=reverse)
            assert have[:5] == want[:5] and have == want[: len(have)] and len(have) == len(set(have))


def test_common_pattern_reads_few_texts(spark):
    """One letter that all of 200,000 names hold: as many candidates as the first look, not as names."""
    names = spark.range(200_000).select(F.concat(F.lit("name e "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("t"))
    got = leading_matches(names, "t", [F.col("t").asc()], spark.createDataFrame([("%e%",), ("%e 199999%",), ("%q%",)], "p string"), "p", 5)
    found = {}
    for p, t in rows(got, "p", "t"):
        found.setdefault(p, []).append(t)
    assert found["%e 199999%"] == ["name e 199999"] and "%q%" not in found
    assert sorted(found["%e%"])[:5] == [f"name e {i:06d}" for i in range(5)] and len(found["%e%"]) <= 2 * patterns.FIRST_LOOK


def test_first_matches_of_nothing(spark):
    none = spark.createDataFrame([], "t string")
    probes = spark.createDataFrame([("%a%",), ("%",)], "p string")
    assert leading_matches(none, "t", [F.col("t").asc()], probes, "p", 5).count() == 0
    texts = spark.createDataFrame([("abc",)], "t string")
    assert leading_matches(texts, "t", [F.col("t").asc()], probes.limit(0), "p", 5).count() == 0
