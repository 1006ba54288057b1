"""Saved answers of movie and game services (JSON texts) turned into rows."""

from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.functions.reports import poster_url
from hoardbook.operators.skew import join_one_to_many

HITS = 5
NOT_FOUND = "Movie not found."
NO_POSTER = "Poster not available for this movie."

MEDIA_PAYLOAD = (
    "results array<struct<id: bigint, media_type: string, title: string, name: string,"
    " release_date: string, first_air_date: string, poster_path: string,"
    " genre_ids: array<bigint>>>"
)
GAME_PAYLOAD = (
    "results array<struct<id: bigint, name: string, released: string,"
    " genres: array<struct<name: string>>, background_image: string>>"
)
GAME_DETAIL = "developers array<struct<name: string>>, publishers array<struct<name: string>>"


def _or_empty(*values: Column) -> Column:
    """First text that is not blank, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def media_hits(payloads: DataFrame, limit: int = HITS) -> DataFrame:
    """First movie and TV hits of each saved search, in their order (``position`` from 1)."""
    results = F.from_json("payload", MEDIA_PAYLOAD)["results"]
    wanted = F.slice(
        F.filter(results, lambda r: r["media_type"].isin("movie", "tv")), 1, limit
    )
    hit = F.col("hit")
    poster = F.nullif(hit["poster_path"], F.lit(""))
    return payloads.select("query_id", F.posexplode(wanted).alias("position", "hit")).select(
        "query_id", (F.col("position") + 1).alias("position"), hit["id"].alias("tmdb_id"),
        _or_empty(hit["title"], hit["name"]).alias("title"),
        F.left(_or_empty(hit["release_date"], hit["first_air_date"]), F.lit(4)).alias("year"),
        F.when(hit["media_type"] == "movie", "movie").otherwise("tv_show").alias("type"),
        hit["media_type"].alias("media_type"),
        F.coalesce(poster_url(poster, "w92"), F.lit("")).alias("poster"),
        F.get(hit["genre_ids"], F.lit(0)).alias("first_genre_id"),
    )


def media_genres(
    hits: DataFrame, genres: DataFrame, rows_per_task: int | None = None
) -> DataFrame:
    """Hits with the name of their first genre. ``genres`` has media_type, id and name."""
    names = genres.select(
        "media_type", F.col("id").alias("first_genre_id"), F.col("name").alias("genre")
    )
    return join_one_to_many(
        names, hits, ["media_type", "first_genre_id"], ["query_id", "position"], "right",
        rows_per_task,
    ).select("query_id", "position", "tmdb_id", "genre")


def game_hits(payloads: DataFrame, limit: int = HITS) -> DataFrame:
    """First game hits of each saved search: name, year, first genre, cover."""
    results = F.slice(F.from_json("payload", GAME_PAYLOAD)["results"], 1, limit)
    hit = F.col("hit")
    return payloads.select("query_id", F.posexplode(results).alias("position", "hit")).select(
        "query_id", (F.col("position") + 1).alias("position"), hit["id"].alias("rawg_id"),
        _or_empty(hit["name"]).alias("title"), F.left(_or_empty(hit["released"]), F.lit(4)).alias("year"),
        _or_empty(F.get(hit["genres"], F.lit(0))["name"]).alias("genre"),
        _or_empty(hit["background_image"]).alias("cover"),
    )


def game_companies(payloads: DataFrame) -> DataFrame:
    """First developer and first publisher of each saved game page."""
    page = F.from_json("payload", GAME_DETAIL)
    return payloads.select(
        "query_id", F.get(page["developers"], F.lit(0))["name"].alias("developer"),
        F.get(page["publishers"], F.lit(0))["name"].alias("publisher"),
    )


def poster_lookup(payloads: DataFrame) -> DataFrame:
    """Poster address of the first result of each saved search, or why there is none."""
    results = F.from_json("payload", MEDIA_PAYLOAD)["results"]
    path = F.nullif(F.get(results, F.lit(0))["poster_path"], F.lit(""))
    return payloads.select(
        "query_id",
        F.when(F.size(results) == 0, NOT_FOUND).when(path.isNull(), NO_POSTER)
        .otherwise(poster_url(path)).alias("poster"),
    )
