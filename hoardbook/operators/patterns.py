"""Join texts to many case-insensitive patterns at once, without comparing every pair.

A pattern with some literal text can only match texts that hold it. Each pattern is filed under
one short piece of its literal text, the piece that fewest texts share; each text is filed under
all its pieces that some pattern uses. Equal pieces meet in an equi-join and ``ilike`` decides.
A pattern without literal text (wildcards only) asks for a length, so it meets texts by length.
"""

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.functions.text import like_pattern_column
from hoardbook.operators.ranking import positioned
from hoardbook.operators.skew import join_one_to_many
from hoardbook.sources.staging import staged

PIECE = 3
# How many texts of its piece a pattern looks at first, and how many times more each time it goes on.
FIRST_LOOK, LONGER = 64, 8


def _pieces(text: Column, size: int) -> Column:
    """All distinct substrings of ``size`` characters."""
    starts = F.when(
        F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _literal_runs(pattern: Column) -> Column:
    """Literal stretches of a pattern, lower-cased, escapes removed."""
    # Wildcards that are not escaped become a separator; escaped characters stand for themselves.
    marked = F.regexp_replace(pattern, r"(?s)\\(.)|[%_]", "$1\u0000")
    # An escaped character leaves itself plus the separator, which only shortens the stretch.
    return F.filter(F.split(F.lower(marked), "\u0000"), lambda run: F.length(run) > 0)


def match_patterns(
    texts: DataFrame, text_key: str, text: str, patterns: DataFrame, pattern: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Pairs (``pattern``, ``text_key``) with the text matching the pattern.

    ``texts`` is unique on ``text_key``, ``patterns`` on ``pattern``. The pattern column holds
    patterns as users type them.
    """
    sized = _sized(patterns, pattern)
    offers = _offers(sized, pattern)
    wanted = offers.select("_piece").distinct()
    # Without any such pattern no text needs to be taken apart.
    some = offers.agg(F.count(F.lit(1))).scalar()
    filed = (
        texts.where(some > 0).select(text_key, F.col(text).alias("_text"))
        .select(text_key, "_text", F.explode(_all_pieces(F.lower("_text"))).alias("_piece"))
    )
    filed = join_one_to_many(wanted, filed, ["_piece"], [text_key], "inner", rows_per_task)
    shared = filed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_texts"))
    chosen = (
        join_one_to_many(shared, offers, ["_piece"], [pattern], "inner", rows_per_task)
        .groupBy(pattern, "_like")
        .agg(F.min_by("_piece", F.struct("_texts", "_piece")).alias("_piece"))
    )
    by_piece = (
        join_one_to_many(chosen, filed, ["_piece"], [text_key], "inner", rows_per_task)
        .where("_text ilike _like")
        .select(pattern, text_key)
    )

    # Wildcards only: '_' stands for one character each, '%' for any further ones.
    least = F.length("_like") - F.length(F.replace("_like", F.lit("_"), F.lit("")))
    longest_text = texts.agg(F.coalesce(F.max(F.length(text)), F.lit(0))).scalar()
    lengths = F.when(
        F.contains("_like", F.lit("%")), F.sequence(least, F.greatest(least, longest_text))
    ).otherwise(F.array(least))
    blank = sized.where(F.col("_size") == 0).select(pattern, F.explode(lengths).alias("_length"))
    measured = texts.select(text_key, F.length(text).alias("_length"))
    by_length = join_one_to_many(
        blank, measured, ["_length"], [text_key], "inner", rows_per_task
    ).select(pattern, text_key)
    return by_piece.unionByName(by_length)


def _sized(patterns: DataFrame, pattern: str) -> DataFrame:
    """Patterns as ``ilike`` takes them, with their literal runs and the size of their pieces."""
    tidy = patterns.select(pattern, like_pattern_column(F.col(pattern)).alias("_like"))
    runs = tidy.withColumn("_runs", _literal_runs(F.col("_like")))
    longest = F.array_max(F.transform(F.col("_runs"), F.length))
    return runs.withColumn("_size", F.least(F.lit(PIECE), F.coalesce(longest, F.lit(0))))


def _offers(sized: DataFrame, pattern: str) -> DataFrame:
    """Pieces a pattern could be filed under."""
    return sized.where(F.col("_size") > 0).select(
        pattern, "_like",
        F.explode(
            F.array_distinct(
                F.flatten(F.transform("_runs", lambda run: _sized_pieces(run, F.col("_size"))))
            )
        ).alias("_piece"),
    )


def leading_matches(
    texts: DataFrame, text: str, order: list[Column], patterns: DataFrame, pattern: str, limit: int
) -> DataFrame:
    """Pairs (``pattern``, ``text``) that hold, for each pattern, the first ``limit`` texts in the order of
    ``order`` that it matches, and perhaps more of them; all if there are fewer.

    ``texts`` is unique on ``text``, ``patterns`` on ``pattern``. Texts get their positions, and postings
    (piece, position) are stored in the order of positions. A pattern looks at the postings of its
    rarest piece from the first position on, as far as about ``FIRST_LOOK`` of them reach, and goes
    on to ``LONGER`` times as many until ``limit`` texts have been verified before the place it has
    come to. So a pattern that very many texts match reads few of them, and one that few texts
    match has few postings to read.
    """
    numbered = staged(positioned(texts, order).select("position", F.col(text).alias("_text")), "numbered-texts")
    total = numbered.count()
    sized = staged(_sized(patterns, pattern), "patterns")
    offers = _offers(sized, pattern).unionByName(_blank_offers(sized, pattern))
    wanted = offers.select("_piece").distinct()
    every = _all_pieces(F.lower("_text"))
    if not sized.where(F.col("_size") == 0).isEmpty():
        every = F.concat(every, F.array(F.lit(""), _length_piece(F.length("_text"))))
    postings = numbered.select("position", F.explode(every).alias("_piece")).join(wanted, "_piece", "left_semi")
    postings = staged(
        postings.repartitionByRange("position", "_piece").sortWithinPartitions("position", "_piece"), "postings"
    )
    shared = postings.groupBy("_piece").agg(F.count(F.lit(1)).alias("_texts"))
    chosen = offers.join(shared, "_piece").groupBy(pattern, "_like").agg(
        F.min(F.struct("_texts", "_piece")).alias("_best")
    )
    # A piece that no text has rules its pattern out.
    missing = offers.join(shared, "_piece", "left_anti").select(pattern).distinct()
    chosen = chosen.join(missing, pattern, "left_anti")
    open_ = staged(chosen.select(
        pattern, "_like", "_best._piece", "_best._texts", F.lit(0).cast("bigint").alias("_from")
    ), "open-patterns")
    found, look = [], FIRST_LOOK
    while True:
        reach = F.ceil(F.lit(float(total)) * look / F.col("_texts")).cast("bigint")
        asked = open_.withColumn("_to", F.least(F.lit(total), reach))
        span = asked.agg(F.min("_from").alias("low"), F.max("_to").alias("high")).first()
        if span["low"] is None:
            break
        within = postings.where((F.col("position") > span["low"]) & (F.col("position") <= span["high"]))
        near = within.join(asked, "_piece").where("position > _from and position <= _to")
        hits = staged(
            near.select(pattern, "_like", "position").join(numbered, "position")
            .where("_text ilike _like").select(pattern, F.col("_text").alias(text)), "leading-matches",
        )
        found.append(hits)
        seen = found[0]
        for more in found[1:]:
            seen = seen.unionByName(more)
        enough = seen.groupBy(pattern).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
        open_ = staged(
            asked.where(F.col("_to") < total).join(enough, pattern, "left_anti")
            .select(pattern, "_like", "_piece", "_texts", F.col("_to").alias("_from")), "open-patterns",
        )
        look *= LONGER
    if not found:
        return patterns.select(pattern).where(F.lit(False)).withColumn(text, F.lit(None).cast("string"))
    return seen


def _length_piece(length: Column) -> Column:
    """What texts of one length are filed under; no text holds it."""
    return F.concat(F.lit("\u0000"), length.cast("string"))


def _blank_offers(sized: DataFrame, pattern: str) -> DataFrame:
    """Pieces of patterns made of wildcards only: those that name a length ask for texts of that length,
    the others for any text."""
    least = F.length("_like") - F.length(F.replace("_like", F.lit("_"), F.lit("")))
    piece = F.when(F.contains("_like", F.lit("%")), F.lit("")).otherwise(_length_piece(least))
    return sized.where(F.col("_size") == 0).select(pattern, "_like", piece.alias("_piece"))


def _sized_pieces(run: Column, size: Column) -> Column:
    return (
        F.when(size == 3, _pieces(run, 3)).when(size == 2, _pieces(run, 2)).otherwise(_pieces(run, 1))
    )


def _all_pieces(text: Column) -> Column:
    return F.concat(_pieces(text, 1), _pieces(text, 2), _pieces(text, 3))
