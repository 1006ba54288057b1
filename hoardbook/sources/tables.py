"""Parquet tables with a known schema, and row numbers taken from file positions."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hoardbook.schemas import DEFAULTS, TABLES


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the nine tables, read with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_numbered(spark: SparkSession, path: str, into: str) -> DataFrame:
    """A Parquet table with its rows numbered 1, 2, … in file order.

    The number is the row's position in its file plus the rows of the files before, so neither
    a sort nor a shuffle is needed and every run gives the same numbers. Only with several
    files are their lengths looked up, from row positions alone; they go to every task, so that no row moves.
    """
    rows = spark.read.parquet(path)
    files = rows.inputFiles()
    position = F.col("_metadata.row_index") + 1
    if len(files) <= 1:
        return rows.withColumn(into, position)
    earlier = W.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(F.col("_metadata.file_path").alias("_file"))
        .agg((F.max("_metadata.row_index") + 1).alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    placed = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn(into, position)
    return (
        placed.join(F.broadcast(starts), "_file").withColumn(into, F.col(into) + F.col("_start"))
        .drop("_file", "_start")
    )


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill columns the input does not have; a null in a column it has stays null."""
    missing = {
        name: F.expr(sql).cast(TABLES[table][name].dataType)
        for name, sql in DEFAULTS.get(table, {}).items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


# Stored columns computed when a row is written, as SQL.
GENERATED = {
    "acquisition": {"total_cost": "purchase_price + tax + shipping_in + other_fees"},
    "item": {"grading_total": "grading_fee + grading_ship + grading_extra"},
    "sale": {
        "net_proceeds": "gross_price + shipping_charged - marketplace_fee - processing_fee"
                        " - promo_fee - shipping_paid - supplies_cost"
    },
}


def with_generated(df: DataFrame, table: str) -> DataFrame:
    """Set the columns that follow from others in the same row."""
    return df.withColumns({
        name: F.expr(sql).cast(TABLES[table][name].dataType)
        for name, sql in GENERATED.get(table, {}).items()
    })


def conform(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns of the table, in order and type: defaults, generated columns, then nulls.

    Columns named in ``keep`` are carried along after them.
    """
    full = with_generated(with_defaults(df, table), table)
    return full.select(
        *[
            (F.col(f.name) if f.name in full.columns else F.lit(None))
            .cast(f.dataType).alias(f.name)
            for f in TABLES[table]
        ],
        *keep,
    )


def evolve(df: DataFrame, table: str) -> DataFrame:
    """Bring an older table up to the present schema by adding the columns it lacks."""
    full = with_defaults(df, table)
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in TABLES[table]
               if f.name not in full.columns}
    return full.withColumns(lacking) if lacking else full
