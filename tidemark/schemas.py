"""Types of every entity, and the data-quality rules that its constraints become."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity -> Spark DDL. Instants are UTC timestamps, ids are strings or longs, unknown is NULL.
ENTITIES = {
    "users": "user_id string, email string, bankroll decimal(14,2), kelly_fraction decimal(6,5), stake_cap decimal(6,5), created_at timestamp, updated_at timestamp",
    "sports": "sport_id string, key string, name string, active boolean",
    "books": "book_id string, key string, name string, is_sharp boolean",
    "teams": "team_id string, sport_id string, name string, external_ids map<string,string>",
    "events": "event_id string, sport_id string, home_team_id string, away_team_id string, start_time_utc timestamp, status string, external_ids map<string,string>",
    "event_results": "event_id string, home_score int, away_score int, f5_home_score int, f5_away_score int",
    "players": "player_id string, person_id bigint, name string, hand string",
    "pitching_game_logs": "event_id string, player_id string, team_id string, is_home boolean, is_starter boolean, outs_recorded int, batters_faced int, strikeouts int, walks int, hit_batsmen int, home_runs int, fly_outs int, sac_flies int, pitches_thrown int",
    "batting_game_logs": "event_id string, player_id string, team_id string, is_home boolean, batting_order int, at_bats int, hits int, doubles int, triples int, home_runs int, walks int, intentional_walks int, strikeouts int, hit_by_pitch int, sac_flies int, sac_bunts int",
    "event_probables": "event_id string, side string, player_id string, first_seen_at timestamp",
    "event_lineups": "event_id string, side string, batting_order int, player_id string, first_seen_at timestamp",
    "player_transactions": "transaction_id bigint, player_id string, team_id string, type_code string, type_desc string, description string, transaction_date date",
    "odds_snapshots": "event_id string, book_id string, market string, side string, price_decimal decimal(8,3), price_american int, captured_at timestamp, is_closing boolean",
    "model_versions": "model_version_id string, name string, git_sha string, window_start date, window_end date, metrics string",
    "feature_snapshots": "snapshot_id string, event_id string, market string, as_of timestamp, features string, features_hash string",
    "predictions": "prediction_id string, event_id string, market string, side string, model_version_id string, snapshot_id string, p_raw decimal(7,6), p_calibrated decimal(7,6), created_at timestamp",
    "picks": "pick_id string, prediction_id string, book_id string, price_decimal decimal(8,3), edge decimal(8,6), ev decimal(10,4), kelly decimal(8,6), stake decimal(14,2), status string, created_at timestamp",
    "pick_results": "pick_id string, result string, profit_units decimal(10,4), settled_at timestamp",
    "clv_records": "pick_id string, closing_fair_prob decimal(7,6), clv decimal(8,6), beat_close boolean",
    "daily_scans": "scan_date date, sport_id string, scheduled int, evaluated int, published int, details string",
}

MARKETS = ("moneyline", "f5_moneyline")
STATUSES = ("scheduled", "live", "final", "postponed", "cancelled")
SIDES = ("home", "away")
PICK_STATUSES = ("pending", "won", "lost", "push", "void")

#: Entity -> rule name -> SQL that holds for a valid row (a NULL answer is no violation, as with a CHECK).
RULES: dict[str, dict[str, str]] = {
    "users": {"bankroll_positive": "bankroll > 0", "kelly_range": "kelly_fraction > 0 AND kelly_fraction <= 1", "cap_range": "stake_cap > 0 AND stake_cap <= 0.10"},
    "events": {"two_teams": "home_team_id <> away_team_id", "status_known": "status IN ('scheduled','live','final','postponed','cancelled')"},
    "event_results": {"scores": "home_score >= 0 AND away_score >= 0", "f5_scores": "f5_home_score >= 0 AND f5_away_score >= 0"},
    "players": {"hand_known": "hand IN ('L','R','S')"},
    "pitching_game_logs": {"counts": "outs_recorded >= 0 AND batters_faced >= 0 AND strikeouts >= 0 AND walks >= 0 AND hit_batsmen >= 0 AND home_runs >= 0"},
    "batting_game_logs": {"counts": "at_bats >= 0 AND hits >= 0 AND walks >= 0", "hits_in_at_bats": "hits <= at_bats", "extra_bases_in_hits": "doubles + triples + home_runs <= hits", "intentional_in_walks": "intentional_walks <= walks"},
    "odds_snapshots": {"price": "price_decimal > 1", "american": "price_american <= -100 OR price_american >= 100"},
    "model_versions": {"sha": "git_sha RLIKE '^[0-9a-f]{7,40}$'", "window": "window_end > window_start"},
    "feature_snapshots": {"hash": "features_hash RLIKE '^[0-9a-f]{64}$'"},
    "predictions": {"raw_range": "p_raw BETWEEN 0 AND 1", "calibrated_range": "p_calibrated BETWEEN 0 AND 1"},
    "picks": {"edge": "edge > 0", "ev": "ev > 0", "kelly": "kelly > 0 AND kelly <= 1"},
    "pick_results": {"won": "result <> 'won' OR profit_units > 0", "lost": "result <> 'lost' OR profit_units < 0", "even": "result NOT IN ('push','void') OR profit_units = 0"},
    "clv_records": {"range": "closing_fair_prob BETWEEN 0 AND 1", "beat": "beat_close = (clv > 0)"},
    "daily_scans": {"order": "evaluated <= scheduled AND published <= evaluated"},
}


def violations(rules: Mapping[str, str]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~F.expr(sql), F.lit(name)) for name, sql in sorted(rules.items())])) if rules else F.array().cast("array<string>")


def checked(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """df with ``violations`` and ``valid``."""
    return df.withColumn("violations", violations(rules)).withColumn("valid", F.size("violations") == 0)


def enforced(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """df, failing at run time at the first row that breaks a rule."""
    bad = violations(rules)
    return df.where(F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("violated: "), F.concat_ws(",", bad))).cast("boolean")).otherwise(True))
