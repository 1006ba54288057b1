"""Card exports: CSV files whose columns differ from file to file."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hoardbook.functions.cards import PAID_HEADERS
from hoardbook.functions.text import first_filled, strip
from hoardbook.sources.records import cells, part_starts, records, scan_lines
from hoardbook.sources.staging import staged

# Export headers by field, first match wins.
HEADERS = {
    "name": ["Product Name", "Title"],
    "product_line": ["Product Line"],
    "set_name": ["Set Name"],
    "number": ["Number"],
    "rarity": ["Rarity"],
    "printing": ["Printing"],
    "condition": ["Condition"],
    "price": ["TCG Market Price"],
    "product_id": ["Product ID"],
    "image_url": ["Photo URL"],
    "quantity": ["Add to Quantity", "Total Quantity"],
}


def header_dictionary(headers: DataFrame) -> DataFrame:
    """Distinct headers (column ``header``, the cells of a file's first record) with the places of
    the export fields in each: files may number millions, their headers are few."""
    return headers.select("header").distinct().select(
        "header", F.size("header").alias("width"), _places().alias("places")
    )


def scan_exports(
    spark: SparkSession, path: str, multiline: bool = True,
    rows_per_task: int | None = None, any_folder: bool = False,
) -> DataFrame:
    """Data rows of all export files under ``path``: file, position in it, cells, and the places
    of the export fields among them.

    Files of any size are read by as many tasks as they have parts, whether or not their quoted
    cells hold line breaks; ``multiline=False`` says that none do. Each file's first record is its
    header; cells are formed as far as the header goes. Lines are staged once. ``any_folder`` as in
    ``read_lines``.
    """
    lines = scan_lines(spark, path, multiline, any_folder)
    starts = staged(part_starts(lines), "file-parts")
    # Records of a part are numbered from its first one on, so only its first lines are read.
    early = F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records")) <= 1
    first = lines.join(starts.where("earlier <= 1"), ["file_path", "part"], "inner").where(
        (F.least("in_records", "out_records") <= 1) & early
    ).select(*lines.columns)
    # Stored, a row per file: else the cells of all lines would be formed to see which headers are null.
    headers = staged(
        records(first, starts).where("record = 1").select("file_path", cells(F.col("text")).alias("header")),
        "file-headers",
    )
    known = headers.join(header_dictionary(headers), "header").drop("header")
    rows = records(lines, starts.join(known, "file_path"), rows_per_task).where("record > 1")
    return rows.select(
        "file_path", (F.col("record") - 1).alias("row_pos"), "places",
        cells(F.col("text"), F.col("width")).alias("cells"),
    )


def _place(header: str | Column) -> Column:
    """Where a header stands, from 0; of repeated headers the last one counts."""
    last = F.size("header") - F.array_position(F.reverse("header"), header)
    return F.when(F.array_contains("header", header), last.cast("int"))


def _places() -> Column:
    """Places of all export fields in a file, found once per file."""
    # The first header that names the price paid, or null.
    paid = F.get(F.filter("header", lambda h: F.lower(strip(h)).isin(PAID_HEADERS)), F.lit(0))
    return F.struct(
        *[_place(h).alias(f"{field}_{i}")
          for field, headers in HEADERS.items() for i, h in enumerate(headers)],
        _place(paid).alias("paid"),
    )


def export_rows(scanned: DataFrame, batch: str = "file_path") -> DataFrame:
    """Scanned lines as named text fields, '' where a file lacks a field."""

    def cell(place: str) -> Column:
        return F.get("cells", F.col(f"places.{place}"))

    fields = {
        field: first_filled(*[cell(f"{field}_{i}") for i in range(len(headers))])
        for field, headers in HEADERS.items()
    }
    return scanned.select(
        F.col(batch).alias("batch_id"), "row_pos",
        *[c.alias(name) for name, c in fields.items()],
        first_filled(cell("paid")).alias("paid"),
        F.col("places.paid").isNotNull().alias("has_paid_column"),
    )


def named_export_rows(df: DataFrame, batch: str, position: str) -> DataFrame:
    """The same fields from a frame whose columns are named like export headers."""

    def pick(names: list[str]) -> Column:
        return first_filled(*[F.col(f"`{n}`") for n in names if n in df.columns])

    paid = [c for c in df.columns if c.strip().lower() in PAID_HEADERS][:1]
    return df.select(
        F.col(batch).alias("batch_id"), F.col(position).alias("row_pos"),
        *[pick(headers).alias(field) for field, headers in HEADERS.items()],
        pick(paid).alias("paid"), F.lit(bool(paid)).alias("has_paid_column"),
    )


def read_typed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows typed by hand, saved as JSON lines with a batch and a row index each."""
    texts = ["name", "set_code", "collector_number", "variant", "condition", "market_value",
             "paid", "image_url", "qty", "game", "tcgplayer_product_id"]
    schema = "batch_id string, row_idx bigint, " + ", ".join(f"{t} string" for t in texts)
    return spark.read.schema(schema).json(path)
