"""The collections' tables as Spark frames over the given Parquet tables."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from hoardbook.operators.catalog import GAMES, MEDIA, Catalog
from hoardbook.operators.intake import normalize_export, normalize_typed
from hoardbook.operators.skew import join_one_to_many
from hoardbook.plans import mapping as m
from hoardbook.schemas import SUBGRADES
from hoardbook.sources.exports import named_export_rows
from hoardbook.sources.staging import staged
from hoardbook.sources.tables import read_numbered


def mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} as `{name}`" for name, sql in columns.items()])


class Inputs:
    """Frames are built on first use, so a query plans only what it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return read_numbered(self.spark, f"{self.sf_dir}/lineitem.parquet", "line_id")

    @cached_property
    def named_lines(self) -> DataFrame:
        """Lines with the name of their part, which very many lines may share."""
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        return join_one_to_many(parts, self.lines, ["l_partkey"], ["line_id"])

    @cached_property
    def text_lines(self) -> DataFrame:
        """Named lines for string-heavy work."""
        return self.named_lines

    @cached_property
    def media(self) -> Catalog:
        return Catalog(
            MEDIA, mapped(self.table("customer"), m.CUSTOMER_TITLES),
            mapped(self.table("orders"), m.ORDER_COPIES), mapped(self.lines, m.LINE_PURCHASES),
        )

    @cached_property
    def games(self) -> Catalog:
        bought = self.lines.where(m.GAME_PURCHASE_FILTER)
        return Catalog(
            GAMES, mapped(self.table("part"), m.PART_TITLES), mapped(self.lines, m.LINE_COPIES),
            mapped(bought, m.LINE_GAME_PURCHASES),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        return mapped(self.table("orders"), m.ORDER_BOXES)

    @cached_property
    def items(self) -> DataFrame:
        return mapped(self.named_lines, m.LINE_ITEMS).withColumn(
            "subgrades", F.lit(None).cast(SUBGRADES)
        )

    @cached_property
    def sales(self) -> DataFrame:
        first = mapped(self.lines.where(m.FIRST_SALE_FILTER), m.FIRST_SALES)
        return first.unionByName(mapped(self.lines.where(m.SECOND_SALE_FILTER), m.SECOND_SALES))

    @cached_property
    def raw_export(self) -> DataFrame:
        return mapped(self.text_lines, m.LINE_EXPORT)

    @cached_property
    def export_rows(self) -> DataFrame:
        return named_export_rows(self.raw_export, "batch_id", "row_pos")

    @cached_property
    def typed_rows(self) -> DataFrame:
        return mapped(self.text_lines, m.LINE_TYPED)

    @cached_property
    def manifest(self) -> DataFrame:
        return mapped(self.table("supplier"), m.SUPPLIER_MANIFEST)

    @cached_property
    def import_rows(self) -> DataFrame:
        """Normalised rows of all batches: typed lists and exports, each batch one or the other.

        Staged, because an import reads them several times: to sum up the batches, to number
        the cards and to build the items.
        """
        typed = mapped(self.text_lines.where(m.TYPED_BATCH), m.LINE_TYPED)
        exported = mapped(self.text_lines.where(f"not ({m.TYPED_BATCH})"), m.LINE_EXPORT)
        rows = normalize_export(named_export_rows(exported, "batch_id", "row_pos"))
        return staged(rows.unionByName(normalize_typed(typed)), "import-rows")

    @cached_property
    def legacy_rows(self) -> DataFrame:
        return staged(normalize_export(self.export_rows, legacy=True), "legacy-rows")

    @cached_property
    def overrides(self) -> DataFrame:
        """Prices entered by hand for every card of every batch, by place in the batch."""
        cards = self.import_rows.groupBy("batch_id").agg(F.sum("quantity").alias("_cards"))
        return cards.selectExpr(
            "batch_id", "explode(sequence(0L, _cards - 1)) as card_index"
        ).withColumn("paid", F.expr(m.OVERRIDE_PRICE))

    @cached_property
    def events(self) -> DataFrame:
        texts = ", ".join(f"'{name}', {sql}" for name, sql in m.EVENT_FIELDS.items())
        return mapped(self.table("events"), {
            **m.CHANGE_EVENTS, "fields": f"map_filter(map({texts}), (k, v) -> v is not null)",
        })

    @cached_property
    def media_payloads(self) -> DataFrame:
        return self._payloads("customer", "c_custkey", m.MEDIA_RESULTS, {
            **m.MEDIA_RESULT, "genre_ids": f"array({m.FIRST_GENRE}, 7)",
        })

    @cached_property
    def game_payloads(self) -> DataFrame:
        return self._payloads("part", "p_partkey", m.GAME_RESULTS, {
            **m.GAME_RESULT,
            "genres": f"case when {m.GAME_GENRE} is not null then"
                      f" array(named_struct('name', {m.GAME_GENRE})) end",
        })

    @cached_property
    def game_pages(self) -> DataFrame:
        def named(sql: str) -> str:
            return f"case when {sql} is null then array() else array(named_struct('name', {sql})) end"

        return self.table("part").selectExpr(
            "p_partkey as query_id",
            f"to_json(named_struct('developers', {named(m.DEVELOPER)},"
            f" 'publishers', {named(m.PUBLISHER)})) as payload",
        )

    @cached_property
    def genres(self) -> DataFrame:
        return mapped(self.table("nation"), m.NATION_GENRES)

    def _payloads(self, table: str, key: str, count: str, result: dict[str, str]) -> DataFrame:
        fields = ", ".join(f"'{name}', {sql}" for name, sql in result.items())
        entry = f"named_struct({fields})"
        # A few results per search, so the array stays small however large the table is.
        results = f"transform(filter(sequence(1, 8), i -> i <= {count}), i -> {entry})"
        return self.table(table).selectExpr(
            f"{key} as query_id", f"to_json(named_struct('results', {results})) as payload"
        )
