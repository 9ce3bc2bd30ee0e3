"""Bid validation against the league snapshot (B3), accepted-bid effects
(B4). The order-dependent ledger (T5) lives in ``formbook.streaming.ledger``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.league import active_roster

# Reason texts (fixed output values):
R_UNKNOWN_TEAM = "unknown franchise"
R_UNKNOWN_PLAYER = "unknown player"
R_OWNED = "already on an active roster"
R_PURSE = "bid exceeds remaining purse"
R_SQUAD = "squad at max size"
R_OVERSEAS = "overseas cap reached"
R_BASE = "bid below base price"


def bid_context(bids: DataFrame, franchises: DataFrame, pool: DataFrame, roster: DataFrame) -> DataFrame:
    """Each bid with the snapshot it is judged against: franchise limits and
    counters, player attributes, snapshot ownership. All joins are keyed
    (franchise id, pool id, lower(name)); counters are pre-aggregated."""
    counts = active_roster(roster).groupBy("franchise_id").agg(
        F.count("*").alias("squad_size"), F.count_if(F.col("is_overseas")).alias("overseas_count"))
    f = franchises.select(
        "franchise_id", F.col("name").alias("franchise_name"),
        F.col("purse_remaining_cr").cast("double").alias("purse_remaining_cr"),
        "max_squad_size", "max_overseas", F.lit(True).alias("_f_known"))
    owned = active_roster(roster).select(F.lower("player_name").alias("_lname")).distinct() \
        .withColumn("owned_at_snapshot", F.lit(True))
    # ownership is a fact of the pool row, so no bid is joined by name
    p = pool.select("pool_id", "player_name", "role", "is_overseas",
                    (F.col("base_price_lakh").cast("double") / 100.0).alias("base_price_cr"),
                    F.lit(True).alias("_p_known"), F.lower("player_name").alias("_lname")).join(owned, "_lname", "left")
    return (
        bids.join(f, "franchise_id", "left")
        .join(counts, "franchise_id", "left")
        .join(p, "pool_id", "left")
        .select(
            "bid_id", "auction_id", "franchise_id", "pool_id", "price_cr", "franchise_name", "player_name",
            "role", "is_overseas", "base_price_cr", "purse_remaining_cr", "max_squad_size", "max_overseas",
            F.coalesce("squad_size", F.lit(0)).alias("squad_size"),
            F.coalesce("overseas_count", F.lit(0)).alias("overseas_count"),
            F.coalesce("owned_at_snapshot", F.lit(False)).alias("owned_at_snapshot"),
            F.coalesce("_f_known", F.lit(False)).alias("franchise_known"),
            F.coalesce("_p_known", F.lit(False)).alias("player_known"),
        )
    )


def bid_reasons(ctx: DataFrame) -> DataFrame:
    """Every violated rule, in rule order, joined by '; '. Unknown
    franchise / player are reported alone (nothing else can be judged)."""
    rules = F.array(
        F.when(F.col("owned_at_snapshot"), F.lit(R_OWNED)),
        F.when(F.col("price_cr") > F.col("purse_remaining_cr"), F.lit(R_PURSE)),
        F.when(F.col("squad_size") >= F.col("max_squad_size"), F.lit(R_SQUAD)),
        F.when(F.col("is_overseas") & (F.col("overseas_count") >= F.col("max_overseas")), F.lit(R_OVERSEAS)),
        F.when(F.col("price_cr") < F.col("base_price_cr"), F.lit(R_BASE)),
    )
    joined = F.array_join(F.filter(rules, lambda x: x.isNotNull()), "; ")
    reasons = (F.when(~F.col("franchise_known"), F.lit(R_UNKNOWN_TEAM))
               .when(~F.col("player_known"), F.lit(R_UNKNOWN_PLAYER))
               .otherwise(F.when(F.length(joined) > 0, joined)))
    return (ctx.withColumn("reasons", reasons)
            .withColumn("accepted", F.col("reasons").isNull())
            .withColumn("result_status", F.when(F.col("accepted"), F.lit("success"))
                        .otherwise(F.concat(F.lit("blocked: "), F.col("reasons")))))


def validate_bids(bids: DataFrame, franchises: DataFrame, pool: DataFrame, roster: DataFrame) -> DataFrame:
    """B3 on the snapshot: each bid judged independently."""
    return bid_reasons(bid_context(bids, franchises, pool, roster)).select(
        "bid_id", "auction_id", "franchise_id", "pool_id", "price_cr", "player_name", "accepted", "result_status")


def bid_effects(outcomes: DataFrame, franchises: DataFrame) -> dict[str, DataFrame]:
    """From judged bids (``accepted`` flag) derive the three outputs:
    new roster rows, purse after the auction, and audit events."""
    acc = outcomes.where(F.col("accepted"))
    roster_rows = acc.select("auction_id", "franchise_id", "player_name", "price_cr",
                             F.lit("auction").alias("acquisition_type"), F.lit("active").alias("status"))
    spent = acc.groupBy("auction_id", "franchise_id").agg(F.round(F.sum("price_cr"), 2).alias("spent_cr"),
                                                         F.count("*").alias("players_bought"))
    purse = spent.join(franchises.select("franchise_id", F.col("purse_remaining_cr").cast("double")
                                         .alias("purse_before_cr")), "franchise_id") \
        .withColumn("purse_after_cr", F.round(F.col("purse_before_cr") - F.col("spent_cr"), 2))
    audit = outcomes.select(
        "bid_id", "auction_id",
        F.when(F.col("accepted"), "data_change").otherwise("tool_call").alias("event_type"),
        F.lit("franchise_roster").alias("table_name"),
        F.lit("execute_player_bid").alias("tool_name"),
        "franchise_id",
        F.to_json(F.struct("franchise_id", "player_name", "price_cr")).alias("payload"),
        "result_status")
    return {"roster_rows": roster_rows, "purse": purse, "audit": audit}
