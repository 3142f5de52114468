"""The TPC-H-like Parquet tables read as the recommendation star schema.

Players are customers, items are parts, play rounds are order lines, markets are world
regions; ``events`` is the gameplay stream. Every frame is lazy and reads whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.sources.tables import values

SOURCE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

# The instants at which the replayed data is looked at.
ROUNDS_AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

# Market codes of this data are up to eleven letters and may hold a blank.
REGION_PATTERN = "^[A-Z ]{4,11}$"
DEFAULT_REGION = "EUROPE"

# id, code, vertical, subvertical, name
CATEGORY_ROWS = [
    (1, "ECONOMY", "value", "economy", "Economy"),
    (2, "LARGE", "size", "large", "Large"),
    (3, "MEDIUM", "size", "medium", "Medium"),
    (4, "PROMO", "promo", "promo", "Promo"),
    (5, "SMALL", "size", "small", "Small"),
    (6, "STANDARD", "value", "standard", "Standard"),
]
AFFINITY = {row[0]: f"aff_{row[3]}" for row in CATEGORY_ROWS}

PLAY_TYPES = ("view", "click", "purchase")


class Star:
    """Domain frames over one folder of source tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def regions(self) -> DataFrame:
        return self.source("region").select(
            F.col("r_regionkey").cast("bigint").alias("region_id"),
            F.col("r_name").alias("region_code"),
            F.initcap("r_name").alias("region_name"),
            (F.col("r_regionkey") != 4).alias("is_active"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return values(
            self.spark,
            CATEGORY_ROWS,
            "category_id BIGINT, category_code STRING, vertical STRING, subvertical STRING, category_name STRING",
        )

    @cached_property
    def items(self) -> DataFrame:
        category = F.coalesce(*[F.when(F.col("p_type") == row[1], F.lit(row[0])) for row in CATEGORY_ROWS])
        market = F.element_at(
            F.array(*[F.lit(r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]),
            (F.col("p_partkey") % 5 + 1).cast("int"),
        )
        return self.source("part").select(
            F.col("p_partkey").alias("game_title_id"),
            category.cast("bigint").alias("category_id"),
            F.col("p_name").alias("game_title"),
            F.col("p_brand").alias("studio_name"),
            ((F.lit(9200) + F.col("p_size") % 56 * 10) * F.lit(0.01).cast("decimal(3,2)"))
            .cast("decimal(6,2)")
            .alias("return_to_player_pct"),
            (F.col("p_size") % 10 == 0).alias("has_jackpot_yn"),
            (F.col("p_size") != 50).alias("available_for_play_yn"),
            (F.col("p_partkey") % 4 != 0).alias("is_global_yn"),
            F.when(F.col("p_partkey") % 8 != 0, market).alias("home_region_code"),
            F.concat(F.lit("tiles/"), F.col("p_partkey").cast("string"), F.lit(".svg")).alias("tile_image_url"),
            F.when(F.col("p_size") % 2 == 0, F.lit("#336699")).otherwise(F.lit("#993366")).alias("tile_color_hex"),
        )

    @cached_property
    def players(self) -> DataFrame:
        nations = self.source("nation").select("n_nationkey", "n_regionkey")
        return (
            self.source("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("player_id"),
                F.col("n_regionkey").cast("bigint").alias("region_id"),
                F.col("c_mktsegment").alias("player_segment"),
                F.col("c_name").alias("display_name"),
                F.sha2(F.concat(F.lower("c_name"), F.lit("@example.org")), 256).alias("email_hash"),
                (F.col("c_acctbal") >= 0).alias("is_active"),
            )
        )

    @cached_property
    def rounds(self) -> DataFrame:
        orders = self.source("orders").select("o_orderkey", "o_custkey")
        stake = F.col("l_extendedprice").cast("decimal(18,2)")
        kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
        return (
            self.source("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws("-", F.lit("R"), F.col("l_orderkey"), F.col("l_linenumber")).alias("round_source_key"),
                F.col("o_custkey").alias("player_id"),
                F.col("l_partkey").alias("game_title_id"),
                F.col("l_shipdate").alias("round_start_timestamp"),
                F.to_date("l_shipdate").alias("round_date"),
                stake.cast("decimal(18,6)").alias("stake_total_amt_eur"),
                (stake * kept).cast("decimal(18,6)").alias("payout_total_amt_eur"),
            )
        )

    @cached_property
    def events(self) -> DataFrame:
        """All events; only a PLAY carries an item and its category."""
        played = F.col("event_type").isin(*PLAY_TYPES)
        item = F.get_json_object("props", "$.k").cast("bigint")
        return self.source("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("user_id").alias("player_id"),
            F.col("ts").alias("event_ts"),
            F.when(played, F.lit("PLAY")).otherwise(F.upper("event_type")).alias("event_type"),
            F.when(played, item).alias("game_title_id"),
            F.when(played, item % 6 + 1).alias("category_id"),
            F.lit(None).cast("string").alias("region_code"),
            F.col("value").cast("decimal(18,2)").alias("stake_amt"),
        )

    @cached_property
    def market_game_block(self) -> DataFrame:
        return (
            self.source("part")
            .filter(F.col("p_partkey") % 97 == 0)
            .select(
                F.lit("EUROPE").alias("region_code"),
                F.col("p_partkey").alias("game_title_id"),
                F.lit("regulatory restriction").alias("reason"),
            )
        )

    @cached_property
    def market_category_exclusion(self) -> DataFrame:
        return values(
            self.spark, [("ASIA", 4, "not licensed")], "region_code STRING, category_id BIGINT, reason STRING"
        )

    @cached_property
    def player_category_exclusion(self) -> DataFrame:
        return (
            self.source("customer")
            .filter(F.col("c_custkey") % 50 == 1)
            .select(
                F.col("c_custkey").alias("player_id"),
                (F.col("c_custkey") % 6 + 1).alias("category_id"),
                F.lit("self-exclusion").alias("reason"),
            )
        )

    @cached_property
    def player_subvertical_exclusion(self) -> DataFrame:
        return (
            self.source("customer")
            .filter(F.col("c_custkey") % 70 == 1)
            .select(
                F.col("c_custkey").alias("player_id"),
                F.lit("small").alias("subvertical"),
                F.lit("self-exclusion").alias("reason"),
            )
        )

    @cached_property
    def policies(self) -> dict[str, DataFrame]:
        return {
            "market_game_block": self.market_game_block,
            "market_category_exclusion": self.market_category_exclusion,
            "player_category_exclusion": self.player_category_exclusion,
            "player_subvertical_exclusion": self.player_subvertical_exclusion,
        }

    @cached_property
    def requests(self) -> DataFrame:
        """One request per player: some name a market, some none, some an invalid one."""
        key = F.col("c_custkey")
        return self.source("customer").select(
            F.concat(F.lit("q"), key.cast("string")).alias("request_id"),
            key.alias("player_id"),
            F.when(key % 7 == 0, F.lit("??")).when(key % 5 == 0, F.lit("ASIA")).alias("region_code"),
            F.lit("home").alias("page_context"),
            F.lit(12).alias("top_n"),
            (key % 4 / F.lit(2.0)).alias("context_weight"),
        )
