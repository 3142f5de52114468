"""Explicit schemas for every table. Batch readers and streams share them; nothing is inferred."""

from __future__ import annotations

# Table and column names with their types.
TABLES: dict[str, str] = {
    "region_dim": """
        region_id BIGINT, region_source_key STRING, region_code STRING, region_name STRING,
        region_description STRING, license_authority_id BIGINT, is_active BOOLEAN""",
    "game_category_dim": """
        category_id BIGINT, category_source_key STRING, category_code STRING, vertical STRING,
        subvertical STRING, product_domain STRING, category_group STRING, category_name STRING,
        is_active BOOLEAN""",
    "game_title_dim": """
        game_title_id BIGINT, game_title_source_key STRING, category_id BIGINT, game_code STRING,
        game_title STRING, game_slug STRING, game_description STRING, studio_name STRING,
        studio_brand STRING, play_environment STRING, min_stake_amt DECIMAL(18,2),
        max_stake_amt DECIMAL(18,2), return_to_player_pct DECIMAL(6,2), has_free_spins_yn BOOLEAN,
        has_jackpot_yn BOOLEAN, is_progressive_jackpot_yn BOOLEAN, available_for_play_yn BOOLEAN,
        release_timestamp TIMESTAMP_NTZ, is_global_yn BOOLEAN, home_region_code STRING,
        tile_image_url STRING, tile_color_hex STRING, is_active BOOLEAN""",
    "player_dim": """
        player_id BIGINT, player_source_key STRING, region_id BIGINT, residence_country_id BIGINT,
        currency_id BIGINT, player_segment_id BIGINT, language_id BIGINT, player_code STRING,
        display_name STRING, email_hash STRING, age_band STRING, acquisition_channel STRING,
        player_segment STRING, is_test_player_yn BOOLEAN, registration_timestamp TIMESTAMP_NTZ,
        first_deposit_timestamp TIMESTAMP_NTZ, is_active BOOLEAN""",
    "game_round_fact": """
        round_source_key STRING, player_id BIGINT, game_title_id BIGINT, session_id BIGINT,
        currency_id BIGINT, stake_cash_amt DECIMAL(18,6), stake_cash_amt_eur DECIMAL(18,6),
        stake_total_amt DECIMAL(18,6), stake_total_amt_eur DECIMAL(18,6),
        payout_total_amt_eur DECIMAL(18,6), is_round_finished_yn BOOLEAN, is_freespin_yn BOOLEAN,
        round_start_timestamp TIMESTAMP_NTZ, round_end_timestamp TIMESTAMP_NTZ, round_date DATE,
        is_active BOOLEAN""",
    "gameplay_events": """
        event_id STRING, player_id BIGINT, event_ts TIMESTAMP_NTZ, event_type STRING,
        game_title_id BIGINT, category_id BIGINT, region_code STRING, stake_amt DECIMAL(18,2),
        session_id STRING, ingested_at TIMESTAMP_NTZ""",
    "gameplay_stream": """
        player_id BIGINT, event_ts TIMESTAMP_NTZ, event_type STRING, game_title_id BIGINT,
        category_id BIGINT, region_code STRING, stake_amt DOUBLE, session_id STRING, game_key STRING""",
    "market_game_block": """
        region_code STRING, game_title_id BIGINT, reason STRING, updated_at TIMESTAMP_NTZ, updated_by STRING""",
    "market_category_exclusion": """
        region_code STRING, category_id BIGINT, reason STRING, updated_at TIMESTAMP_NTZ, updated_by STRING""",
    "player_category_exclusion": """
        player_id BIGINT, category_id BIGINT, reason STRING, updated_at TIMESTAMP_NTZ, updated_by STRING""",
    "player_subvertical_exclusion": """
        player_id BIGINT, subvertical STRING, reason STRING, updated_at TIMESTAMP_NTZ, updated_by STRING""",
    "recommendation_output": """
        rec_id STRING, player_id BIGINT, region_code STRING, rail STRING, rank BIGINT,
        game_title_id BIGINT, score DOUBLE, model_version STRING, generated_at TIMESTAMP_NTZ""",
    "recommendation_trace": """
        trace_id STRING, request_ts TIMESTAMP_NTZ, player_id BIGINT, region_code STRING,
        page_context STRING, candidate_set_size BIGINT, excluded_count BIGINT,
        rules_applied STRUCT<market_eligibility: BOOLEAN, market_game_blocks: ARRAY<BIGINT>,
            market_category_exclusions: ARRAY<BIGINT>, player_category_exclusions: ARRAY<BIGINT>,
            player_subvertical_exclusions: ARRAY<STRING>, feature_source: STRING, scoring: STRING,
            recent_categories: MAP<BIGINT, DOUBLE>>,
        excluded_candidates ARRAY<STRUCT<game_title_id: BIGINT, reason: STRING>>,
        top_n ARRAY<STRUCT<rail: STRING, game_title_id: BIGINT, score: DOUBLE>>,
        model_version STRING,
        latency_breakdown_ms STRUCT<resolve: DOUBLE, recent_activity: DOUBLE, assemble: DOUBLE,
            rank: DOUBLE, total: DOUBLE>""",
    "ranker_inference_log": """
        row_id STRING, event_ts TIMESTAMP_NTZ, aff_for_category DOUBLE, game_rounds_30d_norm DOUBLE,
        popularity_trend DOUBLE, rtp_frac DOUBLE, player_rounds_30d DOUBLE,
        recent_cat_activity_norm DOUBLE, score DOUBLE, region_code STRING""",
    "ranker_baseline": """
        aff_for_category DOUBLE, game_rounds_30d_norm DOUBLE, popularity_trend DOUBLE, rtp_frac DOUBLE,
        player_rounds_30d DOUBLE, recent_cat_activity_norm DOUBLE, score DOUBLE, region_code STRING""",
    "request": """
        request_id STRING, player_id BIGINT, region_code STRING, page_context STRING,
        because_you_played BIGINT, top_n INT, context_weight DOUBLE""",
}

# Declared keys, checked by ``operators.checks.duplicate_keys``.
KEYS: dict[str, tuple[str, ...]] = {
    "region_dim": ("region_id",),
    "game_category_dim": ("category_id",),
    "game_title_dim": ("game_title_id",),
    "player_dim": ("player_id",),
    "market_game_block": ("region_code", "game_title_id"),
    "market_category_exclusion": ("region_code", "category_id"),
    "player_category_exclusion": ("player_id", "category_id"),
    "player_subvertical_exclusion": ("player_id", "subvertical"),
    "recommendation_trace": ("trace_id",),
}

# The ranker signature, in model order.
FEATURE_COLS = [
    "aff_for_category",
    "game_rounds_30d_norm",
    "popularity_trend",
    "rtp_frac",
    "player_rounds_30d",
    "recent_cat_activity_norm",
]

# Wide affinity column of each category.
AFFINITY_COLUMNS: dict[int, str] = {
    1: "aff_slots",
    2: "aff_jackpot",
    3: "aff_classic",
    4: "aff_table",
    5: "aff_scratch",
    6: "aff_live_roulette",
    7: "aff_live_blackjack",
    8: "aff_live_baccarat",
    9: "aff_game_show",
    10: "aff_sportsbook",
    11: "aff_esports",
    12: "aff_megaways",
}
