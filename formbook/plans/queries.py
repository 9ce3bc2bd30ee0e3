"""Registered queries (one per operator group of SURVEY §2) with their
DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.plans.gold import Gold
from formbook.plans.oracle import with_ctes
from formbook.plans.registry import query

ENRICHED_COLS = ("match_id", "innings_seq", "over_number", "delivery_seq", "batter_key", "bowler_key",
                 "innings_overs", "is_chase", "is_close_match", "is_knockout", "death_over_threshold", "phase")


# ------------------------------------------------------------------ enrichment / facts

@query("deliveries_enriched", with_ctes(["enp"], f"SELECT {', '.join(ENRICHED_COLS)} FROM enp"))
def deliveries_enriched(spark, sf_dir):
    return Gold(spark, sf_dir).enriched.select(*ENRICHED_COLS)


@query("batting_innings", with_ctes(["bat"], "SELECT * FROM bat"))
def batting_innings(spark, sf_dir):
    return Gold(spark, sf_dir).bat


@query("bowling_innings", with_ctes(["bowl"], "SELECT * FROM bowl"))
def bowling_innings(spark, sf_dir):
    return Gold(spark, sf_dir).bowl


# ------------------------------------------------------------------ form slices

for _name, _cte, _attr in (
    ("batting_form_career", "bat_career", "bat_career"),
    ("bowling_form_career", "bowl_career", "bowl_career"),
    ("batting_form_t20_leagues", "bat_t20", "bat_t20"),
    ("bowling_form_t20_leagues", "bowl_t20", "bowl_t20"),
    ("batting_form_recent", "bat_recent", "bat_recent"),
    ("bowling_form_recent", "bowl_recent", "bowl_recent"),
    ("batting_form_by_venue", "bat_venue", "bat_venue"),
    ("bowling_form_by_venue", "bowl_venue", "bowl_venue"),
    ("batting_phase_splits", "bat_phase", "bat_phase"),
    ("bowling_phase_splits", "bowl_phase", "bowl_phase"),
    ("batting_phase_wide", "bat_phase_wide", "bat_phase_wide"),
    ("bowling_phase_wide", "bowl_phase_wide", "bowl_phase_wide"),
    ("batting_situational", "bat_sit", "bat_sit"),
    ("bowling_situational", "bowl_sit", "bowl_sit"),
    ("allrounders", "allround", "allrounders"),
    ("batting_position", "pos_sum", "position_summary"),
    ("keeper_signal", "keeper", "keeper"),
    ("batter_profile", "batter_profile", "batter_profile"),
    ("bowler_profile", "bowler_profile", "bowler_profile"),
):
    query(_name, with_ctes([_cte], f"SELECT * FROM {_cte}"))(
        (lambda attr: lambda spark, sf_dir: getattr(Gold(spark, sf_dir, staged=True), attr))(_attr))


# ------------------------------------------------------------------ leaderboards (O1/O2)

TOP_RECENT_BAT_COLS = ("batter_key", "player_name", "innings", "runs", "balls_faced", "strike_rate",
                       "regressed_strike_rate")


@query("top_recent_regressed_sr", with_ctes(
    ["bat_recent"],
    f"SELECT {', '.join(TOP_RECENT_BAT_COLS)} FROM bat_recent "
    "ORDER BY regressed_strike_rate DESC, batter_key LIMIT 10"))
def top_recent_regressed_sr(spark, sf_dir):
    """Flagship: best recent-form regressed strike rates (top 10)."""
    return (Gold(spark, sf_dir, staged=True).bat_recent.select(*TOP_RECENT_BAT_COLS)
            .orderBy(F.desc("regressed_strike_rate"), "batter_key").limit(10))


# ------------------------------------------------------------------ names
from formbook.operators import league, names  # noqa: E402


@query("resolve_names", with_ctes(["resolved_roster"],
       "SELECT roster_id, player_name, matched_key, matched_key_tier AS match_tier FROM resolved_roster"))
def resolve_names_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    r = g.roster.select("roster_id", "player_name")
    return names.resolve_names(r, "player_name", g.batter_profile, key_col="batter_key")


@query("search_names", with_ctes(["searched_roster"], "SELECT * FROM searched_roster"))
def search_names_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    return names.search_names(g.roster, "player_name", "roster_id", g.batter_profile, key_col="batter_key",
                              max_matches=3)


# ------------------------------------------------------------------ league analytics
@query("league_summary", with_ctes(["league_summary"], "SELECT * FROM league_summary"))
def league_summary_q(spark, sf_dir):
    return Gold(spark, sf_dir, staged=True).league_summary


@query("cap_status", with_ctes(["cap_status"], "SELECT * FROM cap_status"))
def cap_status_q(spark, sf_dir):
    return league.cap_status(Gold(spark, sf_dir, staged=True).league_summary)


@query("purse_board", with_ctes(["purse_board"], "SELECT * FROM purse_board"))
def purse_board_q(spark, sf_dir):
    return league.purse_board(Gold(spark, sf_dir, staged=True).franchises)


@query("league_totals", with_ctes(["league_totals"], "SELECT * FROM league_totals"))
def league_totals_q(spark, sf_dir):
    return league.league_totals(Gold(spark, sf_dir, staged=True).league_summary)


@query("unowned_pool", with_ctes(["unowned"], "SELECT * FROM unowned"))
def unowned_pool_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    return league.unowned_pool(g.pool, g.roster)


@query("pool_composition", with_ctes(["pool_comp"], "SELECT * FROM pool_comp"))
def pool_composition_q(spark, sf_dir):
    return league.pool_composition(Gold(spark, sf_dir, staged=True).pool)


@query("franchise_status", with_ctes(["franchise_status"], "SELECT * FROM franchise_status"))
def franchise_status_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    asked = g.table("customer").select(F.col("c_mktsegment").alias("q")).union(
        g.table("nation").select(F.col("n_name").alias("q")))
    return league.franchise_status(asked, "q", g.franchises, g.roster)


@query("auction_targets", with_ctes(["auction_targets"], "SELECT * FROM auction_targets"))
def auction_targets_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    return league.auction_targets(g.pool, g.roster, g.batter_profile, g.bowler_profile)


@query("retention_analysis", with_ctes(["retention"], "SELECT * FROM retention"))
def retention_analysis_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    return league.retention_analysis(g.franchises, g.roster, g.batter_profile, g.bowler_profile,
                                     g.bat_venue, g.bowl_venue)
