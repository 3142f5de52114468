"""Policy tables: listing, editing, previews and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.operators import policy
from recloom.plans import registration
from recloom.queries.features import eligible
from recloom.queries.registry import query
from recloom.queries.windows import edited_blocks
from recloom.session import scratch_path
from recloom.sources import versions
from recloom.sources.star import Star
from recloom.sources.tables import conform


@query(
    "po1_policy_listing",
    """SELECT 'market_game_block' AS policy, region_code AS subject, game_title AS name, reason
       FROM market_game_block JOIN items USING (game_title_id)
       UNION ALL SELECT 'market_category_exclusion', region_code, category_name, reason
       FROM market_category_exclusion JOIN categories USING (category_id)
       UNION ALL SELECT 'player_category_exclusion', CAST(player_id AS VARCHAR), category_name, reason
       FROM player_category_exclusion JOIN categories USING (category_id)
       UNION ALL SELECT 'player_subvertical_exclusion', CAST(player_id AS VARCHAR), subvertical, reason
       FROM player_subvertical_exclusion""",
)
def po1(star: Star) -> DataFrame:
    subverticals = star.categories.select("subvertical", F.col("subvertical").alias("label"))
    listed = [
        ("market_game_block", star.items, "game_title_id", "game_title", "region_code"),
        ("market_category_exclusion", star.categories, "category_id", "category_name", "region_code"),
        ("player_category_exclusion", star.categories, "category_id", "category_name", "player_id"),
        ("player_subvertical_exclusion", subverticals, "subvertical", "label", "player_id"),
    ]
    out = None
    for table, names, key, name, subject in listed:
        rows = policy.listing(star.policies[table], names, key, name, subject).select(
            F.lit(table).alias("policy"), F.col(subject).cast("string").alias("subject"), "name", "reason"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "po2_add_rules",
    """WITH adds AS (SELECT 'EUROPE' AS region_code, game_title_id, 'title review' AS reason FROM items WHERE has_jackpot_yn)
       SELECT region_code, game_title_id, reason, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS updated_by
       FROM market_game_block
       UNION ALL SELECT region_code, game_title_id, reason, TIMESTAMP '2001-11-05 00:00:00', 'policy_console' FROM adds a
       WHERE NOT EXISTS (SELECT 1 FROM market_game_block b WHERE b.region_code = a.region_code AND b.game_title_id = a.game_title_id)""",
)
def po2(star: Star) -> DataFrame:
    current = conform(star.market_game_block, "market_game_block")
    adds = star.items.filter("has_jackpot_yn").select(
        F.lit("EUROPE").alias("region_code"), "game_title_id", F.lit(" title review ").alias("reason")
    )
    return policy.add_rules(
        current, adds, ["region_code", "game_title_id"], "2001-11-05 00:00:00", "policy_console"
    )


@query(
    "po3_remove_rules",
    """SELECT region_code, game_title_id, reason FROM market_game_block
       WHERE game_title_id NOT IN (SELECT game_title_id FROM items WHERE has_jackpot_yn)""",
)
def po3(star: Star) -> DataFrame:
    """Publish the blocks, publish them again without some, and read what is current."""
    root = scratch_path(star.spark, "policies")
    versions.publish(conform(star.market_game_block, "market_game_block"), root, "market_game_block")
    current = versions.current(star.spark, root, "market_game_block")
    gone = star.items.filter("has_jackpot_yn").select(F.lit("EUROPE").alias("region_code"), "game_title_id")
    versions.publish(
        policy.remove_rules(current, gone, ["region_code", "game_title_id"]), root, "market_game_block"
    )
    return versions.current(star.spark, root, "market_game_block").select("region_code", "game_title_id", "reason")


@query(
    "po4_eligible_catalogue",
    """SELECT e.region_code, e.game_title_id, g.game_title, c.category_name FROM eligible e
       JOIN items g ON g.game_title_id = e.game_title_id JOIN categories c ON c.category_id = e.category_id WHERE e.is_eligible""",
)
def po4(star: Star) -> DataFrame:
    return (
        eligible(star)
        .filter("is_eligible")
        .select("region_code", "game_title_id", "category_id")
        .join(star.items.select("game_title_id", "game_title"), "game_title_id")
        .join(star.categories.select("category_id", "category_name"), "category_id")
        .select("region_code", "game_title_id", "game_title", "category_name")
        .orderBy("region_code", "game_title", "game_title_id")
    )


@query(
    "po5_eligibility_summary",
    """SELECT region_code, count(*) FILTER (is_eligible) AS eligible, count(*) FILTER (NOT is_eligible) AS ineligible,
         count(*) FILTER (is_eligible IS NULL) AS undecided, count(*) FILTER (ineligible_reason = 'MARKET_GAME_BLOCK') AS blocked
       FROM eligible GROUP BY region_code""",
)
def po5(star: Star) -> DataFrame:
    return (
        eligible(star)
        .groupBy("region_code")
        .agg(
            F.count_if("is_eligible").alias("eligible"),
            F.count_if(~F.col("is_eligible")).alias("ineligible"),
            F.count_if(F.col("is_eligible").isNull()).alias("undecided"),
            F.count_if(F.col("ineligible_reason") == "MARKET_GAME_BLOCK").alias("blocked"),
        )
    )


@query(
    "po6_what_changed",
    """WITH new AS (SELECT p_partkey AS game_title_id,
                 CASE WHEN p_partkey % 5 = 0 THEN 'reviewed' ELSE 'regulatory restriction' END AS reason
               FROM part WHERE p_partkey % 97 = 0 AND p_partkey % 2 = 0 OR p_partkey % 101 = 0)
       SELECT change, count(*) AS rules FROM (
         SELECT CASE WHEN o.game_title_id IS NULL THEN 'ADDED' WHEN n.game_title_id IS NULL THEN 'REMOVED'
                     WHEN o.reason <> n.reason THEN 'CHANGED' END AS change
         FROM market_game_block o FULL JOIN new n ON o.game_title_id = n.game_title_id) WHERE change IS NOT NULL GROUP BY change""",
)
def po6(star: Star) -> DataFrame:
    changed = policy.diff(star.market_game_block, edited_blocks(star), ["region_code", "game_title_id"], ["reason"])
    return changed.groupBy("change").agg(F.count(F.lit(1)).alias("rules"))


@query(
    "po7_policy_violations",
    """SELECT (SELECT count(*) FROM eligible e JOIN market_game_block b USING (region_code, game_title_id) WHERE e.is_eligible) AS blocked_yet_eligible,
              (SELECT count(*) FROM eligible e JOIN market_category_exclusion x USING (region_code, category_id) WHERE e.is_eligible) AS excluded_yet_eligible""",
)
def po7(star: Star) -> DataFrame:
    universe = eligible(star)
    blocked = policy.violations(universe, star.market_game_block, ["region_code", "game_title_id"])
    excluded = policy.violations(universe, star.market_category_exclusion, ["region_code", "category_id"])
    return blocked.agg(F.count(F.lit(1)).alias("blocked_yet_eligible")).select(
        "blocked_yet_eligible", excluded.agg(F.count(F.lit(1))).scalar().alias("excluded_yet_eligible")
    )


def registrations(star: Star) -> DataFrame:
    """Every supplier registers; so does every tenth customer again, and some suppliers twice."""
    supplier = star.source("supplier").join(
        star.source("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    market = star.regions.select(F.col("region_id").alias("n_regionkey"), "region_code")
    fresh = supplier.join(market, "n_regionkey").select(
        F.col("s_suppkey").alias("registration_id"),
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
        "region_code",
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("display_name"),
    )
    again = fresh.filter(F.col("registration_id") % 4 == 0).withColumn(
        "registration_id", F.col("registration_id") + 10_000_000
    )
    known = (
        star.source("customer")
        .filter(F.col("c_custkey") % 10 == 0)
        .select(
            (F.col("c_custkey") + 20_000_000).alias("registration_id"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.lit("ASIA").alias("region_code"),
            F.lit(None).cast("string").alias("display_name"),
        )
    )
    return fresh.unionByName(again).unionByName(known)


@query(
    "rc7_bulk_registration",
    """SELECT s_suppkey AS registration_id,
         (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS player_id,
         CAST(n_regionkey AS BIGINT) AS region_id,
         'PC' || lpad(CAST((SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS VARCHAR), 7, '0') AS player_code,
         CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE lower(s_name) END AS display_name,
         sha256(lower(s_name) || '@example.org') AS email_hash
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def rc7(star: Star) -> DataFrame:
    added, _, _ = registration.register(registrations(star), star.players, star.regions, "2001-11-05 00:00:00")
    return added.select("registration_id", "player_id", "region_id", "player_code", "display_name", "email_hash")


@query(
    "rc7_rejected_registrations",
    """SELECT s_suppkey + 10000000 AS registration_id, lower(s_name) || '@example.org' AS email FROM supplier WHERE s_suppkey % 4 = 0
       UNION ALL SELECT c_custkey + 20000000, lower(c_name) || '@example.org' FROM customer WHERE c_custkey % 10 = 0""",
)
def rc7_rejected(star: Star) -> DataFrame:
    _, _, rejected = registration.register(registrations(star), star.players, star.regions, "2001-11-05 00:00:00")
    return rejected.select("registration_id", "email")
