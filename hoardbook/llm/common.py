"""Helpers shared by the operators: staged tables, balanced group totals, ranks, components."""

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine (master ``local``), as in tests, may lack the setting and gets a
    folder of its own, which all its tasks see. Anywhere else a missing setting is an error.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return tempfile.mkdtemp(prefix="hoardbook-llm-")
    raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Write rows once and read them back: later jobs do not recompute them, and need none of
    the executors that did."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(rows.schema).parquet(path)
    found.staged_at = path
    return found


def unstaged(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote and that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    settle(*tables[:1])


def settle(*tables: DataFrame) -> None:
    """Let the shuffle files of finished jobs go now, and what the driver holds of their plans and tasks:
    Spark drops the files whose plans are garbage, but looks for garbage only every half hour by itself."""
    for table in tables:
        gc.collect()  # Python's frames hold plans too
        table.sparkSession.sparkContext._jvm.System.gc()


def extended(rows: DataFrame, columns: str) -> T.StructType:
    """The schema of ``rows`` followed by the columns of a DDL text."""
    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(columns).fields])


def salt_of(spark: SparkSession, by: list[str]) -> Column:
    """As many salts as shuffle partitions: one key's rows spread over the whole cluster."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def with_group_totals(
    rows: DataFrame, keys: list[str], spread_by: list[str], totals: dict[str, tuple[str, str]]
) -> DataFrame:
    """Add to each row totals over its group; a group may hold most of the rows.

    ``totals``: new column -> (function, column), the function one of sum, min, max. Rows are
    first totalled per key and salt, then per key over its salts (as many rows as there are
    salts at most); a row finds its totals by key and salt. So no task gathers a group. Null
    keys form a group like any other.
    """
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    safe = [f"_k{i}" for i in range(len(keys))]
    salted = rows.withColumn("_salt", salt_of(rows.sparkSession, spread_by))
    part = salted.groupBy(*[F.col(c).alias(s) for c, s in zip(keys, safe)], "_salt").agg(
        *[fn[how](c).alias(f"_t_{new}") for new, (how, c) in totals.items()]
    )
    over = W.partitionBy(*safe)
    part = part.select(
        *safe, F.col("_salt").alias("_s"),
        *[fn[how](f"_t_{new}").over(over).alias(new) for new, (how, _) in totals.items()],
    )
    on = F.col("_salt") == F.col("_s")
    for c, s in zip(keys, safe):
        on = on & F.col(c).eqNullSafe(F.col(s))
    return salted.join(part, on).drop(*safe, "_salt", "_s")


def hex_number(digest: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def with_place(
    rows: DataFrame, group: list[str], digest: str, order: list[str], sums: dict[str, str],
    rows_per_bucket: int = 1_000,
) -> DataFrame:
    """Add, for each ``new: column`` of ``sums``, the sum of the column over the group's rows
    that come before this one in the order of (``digest``, ``order``).

    ``digest`` is a hexadecimal hash, evenly spread. Its leading 32 bits cut each group into
    buckets of about ``rows_per_bucket`` rows; bucket totals are summed per group, rows only
    within their bucket. No group is sorted in one task.
    """
    size = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else None
    if group:
        safe = [f"_g{i}" for i in range(len(group))]
        size = size.select(*[F.col(c).alias(s) for c, s in zip(group, safe)], "_n")
        size = size.withColumn(
            "_buckets", F.least(F.lit(1 << 31), F.ceil(F.col("_n") / F.lit(rows_per_bucket)))
        ).drop("_n")
        raise_if = [F.col(c).eqNullSafe(F.col(s)) for c, s in zip(group, safe)]
        on = raise_if[0]
        for more in raise_if[1:]:
            on = on & more
        placed = rows.join(size, on).drop(*safe)
    else:
        n = rows.count()
        placed = rows.withColumn("_buckets", F.lit(max(1, -(-n // rows_per_bucket))).cast("bigint"))
    placed = placed.withColumn(
        "_bucket",
        F.shiftrightunsigned(hex_number(F.col(digest)) * F.col("_buckets"), 32),
    ).drop("_buckets")
    starts = running_starts(
        placed.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()]),
        group, {f"_b_{n}": f"_s_{n}" for n in sums},
    )
    within = (
        W.partitionBy(*group, "_bucket").orderBy(digest, *order)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    summed = placed.select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{n}") for n, c in sums.items()]
    )
    safe = [f"_g{i}" for i in range(len(group))]
    starts = starts.select(
        *[F.col(c).alias(s) for c, s in zip(group, safe)], F.col("_bucket").alias("_sb"),
        *[f"_s_{n}" for n in sums],
    )
    on = F.col("_bucket") == F.col("_sb")
    for c, s in zip(group, safe):
        on = on & F.col(c).eqNullSafe(F.col(s))
    return summed.join(starts, on).select(
        *rows.columns, *[(F.col(f"_s_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums]
    )


def running_starts(buckets: DataFrame, group: list[str], sums: dict[str, str]) -> DataFrame:
    """For each ``column: new`` the sum over the group's earlier buckets, in two levels: blocks of
    10,000 buckets, then buckets within a block."""
    blocks = buckets.withColumn("_block", F.floor(F.col("_bucket") / 10_000))
    over = (
        W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        if group else W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    )
    before = blocks.groupBy(*group, "_block").agg(*[F.sum(c).alias(f"_x_{c}") for c in sums]).select(
        *[F.col(c).alias(f"_h{i}") for i, c in enumerate(group)], F.col("_block").alias("_hb"),
        *[F.coalesce(F.sum(f"_x_{c}").over(over), F.lit(0)).alias(f"_y_{c}") for c in sums],
    )
    inner = (
        W.partitionBy(*group, "_block").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    )
    on = F.col("_block") == F.col("_hb")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_h{i}"))
    return blocks.select(
        "*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_z_{c}") for c in sums]
    ).join(before, on).select(
        *group, "_bucket", *[(F.col(f"_y_{c}") + F.col(f"_z_{c}")).alias(n) for c, n in sums.items()]
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Alternates two rewirings: every node hands its larger neighbours to its smallest one, then
    its smaller neighbours; trees flatten into stars around their smallest node within a few
    rounds. A hub's neighbours are totalled by salts, never gathered. Each round is staged, which
    cuts the lineage, and takes the place of the one before; a round that changes nothing ends the
    loop. Totals stand twice in a plan, so a round's rows are doubled by ``explode``, not by unions,
    which would double the plan too.
    """
    stars = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )

    def mark(table: DataFrame):
        return tuple(
            table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )

    def pair(u: str, v: str) -> Column:
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    def exploded(table: DataFrame, pairs: Column) -> DataFrame:
        return table.select(F.explode(pairs).alias("_pair")).select("_pair.u", "_pair.v")

    seen = mark(stars)
    while True:
        both = exploded(stars, F.array(pair("u", "v"), pair("v", "u")))
        low = with_group_totals(both, ["u"], ["v"], {"m": ("min", "v")})
        large = (
            low.withColumn("m", F.least("m", "u")).where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = with_group_totals(large, ["u"], ["v"], {"m": ("min", "v")})
        small = exploded(low, F.when(
            F.col("v") != F.col("m"), F.array(pair("v", "m"), pair("u", "m"))
        ).otherwise(F.array(pair("u", "m")))).distinct()
        before, stars = stars, staged(small, name)
        unstaged(before)
        now = mark(stars)
        if now == seen:
            break
        seen = now
    # A node may be listed under one centre only, once nothing changes.
    return stars.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    )


def keep_marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that ``marks`` (doc_id, _sha, kept; one row per row of
    ``docs``) keeps, found by id and the text's digest. Of rows that agree in both and of which only
    some are kept, one stays. Whole rows move once, and once more only those of the last kind."""
    name = lambda doc, sha: F.concat_ws(":", sha, F.coalesce(doc.cast("string"), F.lit("none")))
    lost = staged(
        marks.groupBy("doc_id", "_sha").agg(
            F.max("kept").alias("_any"), F.count(F.lit(1)).alias("_n"),
            F.sum(F.col("kept").cast("int")).alias("_stay"),
        ).where("_stay < _n").select(name(F.col("doc_id"), F.col("_sha")).alias("_name"), "_any"),
        "lost",
    )
    named = docs.select(whole_row(docs), name(F.col("doc_id"), text_digest()).alias("_name"))
    kept = named.join(lost, "_name", "left_anti")
    repeated = lost.where("_any").select("_name")
    if not repeated.isEmpty():
        kept = kept.unionByName(named.join(repeated, "_name", "left_semi").dropDuplicates(["_name"]))
    return kept.select("_row.*")


def whole_row(rows: DataFrame) -> Column:
    """All columns as one, ``_row``: whatever their names, they clash with no helper column."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text in UTF-8, in lower-case hexadecimal; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
