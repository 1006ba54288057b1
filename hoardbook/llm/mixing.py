"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Built from DataFrame functions only.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hoardbook.llm.common import settle, staged, whole_row, with_place

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2


def source_targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """Add ``target`` to ``totals`` (source, source_size; one row per source).

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share``
    times all sizes by weight, but none gets more than ``most`` times its size: what is above is
    shared anew until nobody is above. That fills all uncapped sources to one level per weight.
    With sources in the order of their cap per weight, the level if just those before a source were
    capped is what is left over the weight left; it rises as long as the caps hold and falls beyond,
    so the highest is the level sought.

    Ranks and sums run over all sources in one task: meant for up to some hundred thousand sources,
    not for millions (such as one for each web host).
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy("_cap_per_weight", "_i")
    upto = by_cap.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")
    )
    return (
        totals.withColumn("_i", F.row_number().over(by_name) - 1)
        .withColumn("_weight", weight.cast("bigint"))
        .withColumn("_cap", F.lit(most) * F.col("source_size"))
        .withColumn("_cap_per_weight", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_capped_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn(
            "_weight_left",
            F.sum("_weight").over(everything) - F.sum("_weight").over(upto) + F.col("_weight"),
        )
        .withColumn(
            "_level",
            (F.lit(float(share)) * F.col("_all") - F.col("_capped_before")) / F.col("_weight_left"),
        )
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn(
            "target",
            F.when(F.col("_cap_per_weight") < F.col("_level"), F.col("_cap").cast("double"))
            .otherwise(F.col("_weight") * F.col("_level")),
        )
        .select("source", "source_size", "target")
    )


def mix(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
    most: int = MOST_REPEATS, seed: str = "mix", rows_per_bucket: int = 1_000,
) -> DataFrame:
    """Per row of ``rows`` (doc_id, source, size): source_size, target and ``taken``, the words
    the mix takes from it, repeats counted.

    A source gives its whole content as often as it fits into its target; the rest comes from its
    documents in the order of a hash of their id, each whole, up to the exact budget, where the
    last one is cut. So a source's taken words are its target rounded down. Equal input gives
    equal output, whatever the partitioning.

    Null sources form a source of their own; null sizes count as 0; rows with equal id, source
    and size are interchangeable copies: they are counted once, placed side by side, and listed
    again (``copy`` numbers them from 0, ``alike`` is their number). An empty table gives no rows.
    """
    # Copies as one row: equal hashes never pile up in a bucket.
    distinct = staged(
        rows.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_words", F.col("size") * F.col("_copies"))
        .withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(
            F.col("doc_id").cast("string"), F.lit("")
        )))),
        "mix",
    )
    totals = distinct.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(totals, weights, share, most).select(
        F.col("source").alias("_source"), "source_size", "target"
    )
    placed = with_place(
        distinct, ["source"], "_hash", ["doc_id", "size"], {"_before": "_words"}, rows_per_bucket
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    rest = F.floor(F.col("target")) - F.col("_full") * F.col("source_size")
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_full", F.coalesce(full, F.lit(0)))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
        .withColumn("_left", rest - F.col("_before") - F.col("_copy") * F.col("size"))
        .withColumn(
            "taken",
            (F.col("_full") * F.col("size")
             + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))).cast("bigint"),
        )
        .select(
            "doc_id", "source", "size", "source_size", "target", "taken",
            F.col("_copy").alias("copy"), F.col("_copies").alias("alike"),
        )
    )


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words of the whole text, 0 for null."""
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as it is taken whole, then, for the one row at a
    source's cut, its first words (joined by single spaces). Columns as in ``docs``; ``n_chars``
    follows the text where there is one.

    A row is found again by id, source and size; rows alike in all three are told apart by the
    order of their texts' hashes. Rows without words are in no mix.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(
        whole_row(docs), F.col("doc_id"), F.col("source"), F.col("text"), size.alias("size")
    )
    shares = staged(mix(rows.select("doc_id", "source", "size"), **options).where("taken > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_src"), F.col("size").alias("_sz"),
        F.col("copy").alias("_nth"), "taken", "alike",
    ), "shares")  # read three times below
    settle(shares)
    on = (
        F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_src"))
        & (F.col("size") == F.col("_sz"))
    )
    single = rows.join(shares.where("alike = 1"), on)
    # Rows alike in id, source and size are numbered by their text's hash.
    nth = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"))) - 1
    several = (
        rows.join(shares.where("alike > 1").select("_d", "_src", "_sz").distinct(), on, "left_semi")
        .withColumn("_n", nth).join(shares.where("alike > 1"), on & (F.col("_n") == F.col("_nth")))
        .drop("_n")
    )
    times = (
        single.unionByName(several)
        .withColumn("_whole", F.floor(F.col("taken") / F.col("size")))
        .withColumn("_part", F.col("taken") - F.col("_whole") * F.col("size"))
        .withColumn(
            "_k", F.explode(F.sequence(
                F.lit(1).cast("bigint"), F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0)
            )),
        )
    )
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " ")
    whole = F.col("_k") <= F.col("_whole")
    changed = F.col("_row").withField("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withField(
            "n_chars", F.when(whole, F.col("_row.n_chars")).otherwise(F.length(cut).cast(kind))
        )
    return times.select(changed.alias("_row")).select("_row.*")
