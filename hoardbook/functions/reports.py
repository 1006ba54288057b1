"""Expressions for texts shown in reports."""

from pyspark.sql import Column, functions as F

TITLE_PAGE = "https://www.themoviedb.org"
IMAGES = "https://image.tmdb.org/t/p"


def value_multiple(value: Column, median: Column) -> Column:
    """Value as a multiple of the box median, 0 without a median."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.coalesce(value / F.nullif(median, F.lit(0.0)), F.lit(0.0))


def grade_reason(
    tier: Column, condition: Column, value: Column, flagged: Column, median: Column,
    value_threshold: float = 25,
) -> Column:
    """Why a card is a grading candidate, worded by tier."""
    amount = F.coalesce(value.cast("double"), F.lit(0.0))
    middle = F.coalesce(median, F.lit(0.0))
    outlier = F.concat(
        F.lit("$"), F.format_number(amount, 2), F.lit(" raw — "),
        F.replace(F.format_number(value_multiple(value, median), 1), F.lit(","), F.lit("")),
        F.lit("× the box median ($"), F.format_number(middle, 2), F.lit(")"),
    )
    worthy = F.concat_ws(
        " · ",
        F.when(condition == "NM", "NM condition"),
        F.when(
            amount >= value_threshold,
            F.concat(F.lit("$"), F.format_number(amount, 0), F.lit(" raw value")),
        ),
        F.when(flagged, "flagged by you"),
        F.lit("ungraded"),
    )
    return F.when(tier == "review", outlier).otherwise(worthy)


def title_url(media_type: Column, tmdb_id: Column) -> Column:
    section = F.when(media_type == "movie", "movie").otherwise("tv")
    return F.concat(F.lit(TITLE_PAGE + "/"), section, F.lit("/"), tmdb_id)


def poster_url(poster_path: Column, size: str = "w500") -> Column:
    """Image address of a poster path (paths start with a slash)."""
    return F.concat(F.lit(f"{IMAGES}/{size}"), poster_path)
