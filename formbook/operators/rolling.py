"""Figures over the last n rows of a key (form of the last 5 or 10
innings, price of the last bids), for keys of any size.

Rows are numbered by key over sorted ranges, so no task sorts a whole key.
Each key is cut into chunks of ``chunk`` places; the last places of a chunk
are also sent to the next one (its halo), so every row finds its frame in
its own chunk and a key that holds a third of all rows is many window groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.audit import running_count

CHUNK = 100_000


def numbered(df: DataFrame, key: str, order: str, out: str = "place") -> DataFrame:
    """``df`` plus the row's place in its key by ``order`` (from 1); null keys
    are a key."""
    placed = running_count(df, key, order)
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("running_count").alias("_first"))
    return (placed.join(first, F.col(key).eqNullSafe(F.col("_key")))
            .withColumn(out, F.col("running_count") - F.col("_first") + 1).drop("_key", "_first", "running_count"))


def last_rows(df: DataFrame, key: str, order: str, frames: Sequence[int], figures: dict[str, Column],
              chunk: int = CHUNK) -> DataFrame:
    """``df`` plus ``place`` and, for each width n of ``frames``, the sums of
    ``figures`` over the row and the n - 1 before it in its key, named
    ``<figure>_last_<n>``. ``order`` is unique in a key; a row with fewer
    before it has those there are."""
    halo = max(frames) - 1
    chunk = max(chunk, halo, 1)
    rows = numbered(df, key, order)
    own = F.floor((F.col("place") - 1) / chunk)
    tail = F.col("place") > (own + 1) * chunk - halo
    rows = rows.withColumn("_chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    of = Window.partitionBy(key, "_chunk").orderBy("place")
    for n in frames:
        frame = of.rowsBetween(1 - n, 0)
        rows = rows.withColumns({f"{name}_last_{n}": F.sum(value).over(frame) for name, value in figures.items()})
    return rows.where(F.col("_chunk") == own).drop("_chunk")


def rolling_batting(facts: DataFrame, frames: Sequence[int] = (5, 10), chunk: int = CHUNK) -> DataFrame:
    """Runs, balls and strike rate over a batter's last innings, by innings."""
    order = F.concat_ws("|", "match_date", "match_id", F.col("innings_seq").cast("string"))
    rows = facts.select("batter_key", "match_id", "innings_seq", "runs", "balls_faced", order.alias("_order"))
    out = last_rows(rows, "batter_key", "_order", frames, {"runs": F.col("runs"), "balls": F.col("balls_faced")}, chunk)
    for n in frames:
        rate = F.round(F.col(f"runs_last_{n}") * 100.0 / F.col(f"balls_last_{n}"), 2)
        out = out.withColumn(f"strike_rate_last_{n}", F.when(F.col(f"balls_last_{n}") > 0, rate))
    return out.withColumnRenamed("place", "innings_no").drop("_order")


def bid_trajectory(bids: DataFrame, frame: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Each bid with its number among the bids for that player in its auction
    and the mean price of the last ``frame`` of them."""
    rows = bids.select("bid_id", "auction_id", "pool_id", "price_cr",
                       F.concat_ws("|", F.col("auction_id").cast("string"), F.col("pool_id").cast("string")).alias("_player"))
    # prices have two decimals: whole hundredths add up alike in any order
    out = last_rows(rows, "_player", "bid_id", [frame], {"cents": F.round(F.col("price_cr") * 100).cast("long")}, chunk)
    mean = F.round(F.col(f"cents_last_{frame}") / F.least(F.col("place"), F.lit(frame)) / 100, 4)
    return out.select("bid_id", "auction_id", "pool_id", "price_cr", F.col("place").alias("bid_no"),
                      mean.alias(f"mean_price_last_{frame}"))


def purse_burn_down(ledger: DataFrame) -> DataFrame:
    """The purse of each franchise after each of its accepted bids in an
    auction; squad caps and purses bound the group."""
    of = Window.partitionBy("auction_id", "franchise_id").orderBy("bid_id")
    return ledger.where("accepted").select(
        "auction_id", "franchise_id", "bid_id", F.row_number().over(of).cast("bigint").alias("purchase_no"), "price_cr",
        "purse_after_cr")
