"""Views over the driver tables that have the shape of the sports data.

D1 deliveries (ball grain) is derived from ``events``; D3 league state
from ``nation``/``customer``/``supplier``/``orders``; D4 change log from
``events``; D5 articles from ``pages``; D6 notes from ``conversations``.
All are lazy DataFrames whose work grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the fixture mapping (competition by match number mod 9):
COMPETITION_BY_MOD9 = ("IPL", "BBL", "PSL", "CPL", "SA20", "ILT20", "T20I", "ODI", "TEST")
WICKET_KIND_BY_MOD6 = ("caught", "bowled", "run out", "lbw", "stumped", "retired hurt")
ROLE_BY_MOD4 = ("batter", "bowler", "all-rounder", "wicketkeeper")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(expr: Column, values) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(expr == i, F.lit(v)) if out is None else out.when(expr == i, F.lit(v))
    return out


def player(user: Column) -> Column:
    """Every third user plays as one of four persons, who so have enough
    balls for every sample floor at every venue (and are hot keys)."""
    return F.when(user % 3 == 0, user % 4).otherwise(user)


def person_name(user: Column) -> Column:
    """``<letter> Surname<n>`` where the letter is user mod 26 and n = user div 4."""
    return F.concat(
        F.char((F.lit(65) + user % 26).cast("int")),
        F.lit(" Surname"),
        F.floor(user / 4).cast("bigint").cast("string"),
    )


def person_id(user: Column) -> Column:
    return F.when(user % 37 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("r"), user.cast("string")))


def deliveries(events: DataFrame, partitions: int | None = None, by_match: bool = True) -> DataFrame:
    """One row per ball, hash-partitioned by ``match_id`` (into
    ``partitions`` when given, sized from the input by the caller).

    240 events form one match (2 innings x 20 overs x 6 balls). The
    match-level window is evaluated on the same ``match_id`` partitioning
    as the innings/over windows, so the whole view costs one shuffle, and
    one sort of narrow rows: the windows ask for no order of their own (the
    first event is the least ``event_id``), and match, innings, over is an
    order that serves all three and the readers' windows over an innings.
    Without ``by_match`` exchange and sort are left to the windows: a reader
    of none of their columns (a count a competition) shuffles no ball.
    """
    e = events.select(
        "event_id", player(F.col("user_id")).alias("user_id"), "event_type", "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        F.floor(F.col("event_id") / 240).cast("bigint").alias("match_no"),
        (F.floor((F.col("event_id") % 240) / 120).cast("bigint") + 1).alias("innings_seq"),
        F.floor((F.col("event_id") % 120) / 6).cast("bigint").alias("over_number"),
        (F.col("event_id") % 6).alias("delivery_seq"),
    ).withColumn("match_id", F.concat(F.lit("1"), F.lpad(F.col("match_no").cast("string"), 6, "0")))
    if by_match:
        e = e.repartition(partitions, "match_id") if partitions else e.repartition("match_id")
        e = e.sortWithinPartitions("match_id", "innings_seq", "over_number")

    def of_first_event(name: str, *within: str) -> Column:
        return F.min(F.struct("event_id", name)).over(Window.partitionBy(*within)).getField(name)

    k = (
        e.withColumn("match_date", of_first_event("ts", "match_id").cast("date").cast("string"))
        .withColumn("keeper_user", of_first_event("user_id", "match_id", "innings_seq"))
        .withColumn("bowler_user", of_first_event("user_id", "match_id", "innings_seq", "over_number"))
    )
    v, mno = F.col("v"), F.col("match_no")
    is_error = F.col("event_type") == "error"
    is_wicket = (F.col("event_type") == "signup") & (v % 5 == 0)
    kind = F.when(is_wicket, _case(F.floor(v / 5).cast("bigint") % 6, WICKET_KIND_BY_MOD6))
    runs_batter = (
        F.when(is_error, 0).when(v % 10 < 4, 0).when(v % 10 < 7, 1)
        .when(v % 10 == 7, 2).when(v % 10 == 8, 4).otherwise(6)
    ).cast("bigint")
    ext = {name: F.when(is_error & (v % 4 == i), 1).otherwise(0).cast("bigint")
           for i, name in enumerate(("extras_wides", "extras_noballs", "extras_byes", "extras_legbyes"))}
    batter = person_name(F.col("user_id"))
    keeper_name = person_name(F.col("keeper_user"))
    team_1 = F.concat(F.lit("Team "), (mno % 10).cast("string"))
    team_2 = F.concat(F.lit("Team "), ((mno + 3) % 10).cast("string"))
    match_type = F.when(mno % 9 == 8, "Test").when(mno % 9 == 7, "ODI").otherwise("T20")
    in_pp = (mno % 9 != 8) & (F.col("over_number") < 6)
    out = k.select(
        "match_id",
        _case(mno % 9, COMPETITION_BY_MOD9).alias("competition"),
        "innings_seq", "over_number", "delivery_seq",
        F.concat(F.col("over_number").cast("string"), F.lit("."), (F.col("delivery_seq") + 1).cast("string"))
        .alias("actual_delivery"),
        F.when(F.col("innings_seq") == 1, team_1).otherwise(team_2).alias("batting_team"),
        batter.alias("batter"),
        person_id(F.col("user_id")).alias("batter_id"),
        person_name(F.col("bowler_user")).alias("bowler"),
        person_id(F.col("bowler_user")).alias("bowler_id"),
        runs_batter.alias("runs_batter"),
        (v % 97 == 0).alias("non_boundary"),
        *[col.alias(name) for name, col in ext.items()],
        F.lit(0).cast("bigint").alias("extras_penalty"),
        is_wicket.alias("is_wicket"),
        kind.alias("wicket_kind"),
        F.when(is_wicket, F.array(F.struct(
            kind.alias("kind"), batter.alias("player_out"),
            F.array(F.struct(keeper_name.alias("name"), F.lit(False).alias("substitute"))).alias("fielders"),
        ))).alias("wickets"),
        keeper_name.alias("fielder_name"),
        person_id(F.col("keeper_user")).alias("fielder_id"),
        F.concat(F.lit("Venue "), (mno % 7).cast("string")).alias("venue"),
        F.col("match_date"),
        F.when(F.col("innings_seq") == 2, 100 + mno % 50).alias("innings_target_runs"),
        F.when(mno % 3 == 0, mno % 25).alias("outcome_by_runs"),
        F.when(mno % 3 == 1, mno % 10).alias("outcome_by_wickets"),
        F.when(mno % 8 == 0, F.lit("Final")).alias("event_stage"),
        match_type.alias("match_type"),
        in_pp.alias("in_powerplay"),
        F.when(in_pp, F.lit("mandatory")).alias("powerplay_type"),
        F.lit(False).alias("is_super_over"),
        team_1.alias("team_1"), team_2.alias("team_2"),
        F.year(F.col("match_date").cast("date")).cast("string").alias("season"),
    )
    return (
        out.withColumn("runs_extras", F.col("extras_wides") + F.col("extras_noballs")
                       + F.col("extras_byes") + F.col("extras_legbyes") + F.col("extras_penalty"))
        .withColumn("runs_total", F.col("runs_batter") + F.col("runs_extras"))
    )


def matches_from_events(events: DataFrame) -> DataFrame:
    """Match dimension straight from ``events``: the only non-derived
    attribute is the date (first timestamp by event id), a
    ``min_by`` hash aggregate per match with partial aggregation — one row
    per match crosses the shuffle, not one per ball. The other attributes
    are functions of the match number."""
    m = events.groupBy(F.floor(F.col("event_id") / 240).cast("bigint").alias("match_no")).agg(
        F.min_by("ts", "event_id").alias("_ts0"))
    mno = F.col("match_no")
    date = F.col("_ts0").cast("date")
    return m.select(
        F.concat(F.lit("1"), F.lpad(mno.cast("string"), 6, "0")).alias("match_id"),
        _case(mno % 9, COMPETITION_BY_MOD9).alias("competition"),
        F.year(date).cast("string").alias("season"),
        date.cast("string").alias("start_date"),
        F.concat(F.lit("Venue "), (mno % 7).cast("string")).alias("venue"),
        F.when(mno % 9 == 8, "Test").when(mno % 9 == 7, "ODI").otherwise("T20").alias("match_type"),
        F.lit("male").alias("team_type"),
        F.concat(F.lit("Team "), (mno % 10).cast("string")).alias("team_1"),
        F.concat(F.lit("Team "), ((mno + 3) % 10).cast("string")).alias("team_2"),
        F.when(mno % 3 == 0, mno % 25).alias("outcome_by_runs"),
        F.when(mno % 3 == 1, mno % 10).alias("outcome_by_wickets"),
        F.when(mno % 8 == 0, F.lit("Final")).alias("event_stage"),
    )


def matches_from_deliveries(d: DataFrame) -> DataFrame:
    """Match dimension (1 row per match) from ball rows. The attributes are
    constant within a match, so this is a key-only distinct (a hash
    aggregate, no string buffers); shuffle-free when ``d`` is already
    partitioned by ``match_id``."""
    return d.select(
        "match_id", "competition", "season", F.col("match_date").alias("start_date"), "venue", "match_type",
        F.lit("male").alias("team_type"), "team_1", "team_2", "outcome_by_runs", "outcome_by_wickets",
        "event_stage",
    ).distinct()


def silver_deliveries(d: DataFrame) -> DataFrame:
    """Ball rows restricted to the silver schema columns (drops the
    match attributes so that enrichment must join them back, J1)."""
    return d.select(
        "match_id", "competition", "innings_seq", "batting_team", "over_number", "delivery_seq",
        "actual_delivery", "batter", "batter_id", "bowler", "bowler_id",
        "runs_batter", "runs_extras", "runs_total", "non_boundary",
        "extras_byes", "extras_legbyes", "extras_noballs", "extras_penalty", "extras_wides",
        "is_wicket", "wickets", "innings_target_runs", "is_super_over", "powerplay_type",
    )


def registry_from_deliveries(d: DataFrame) -> DataFrame:
    """Per-match name -> id map (the bronze ``player_registry``), built
    from the resolved names seen in that match (bounded by match size).
    Both persons of a ball come from one scan, which keeps balls that lie
    by match there."""
    persons = [F.struct(F.col(p).alias("name"), F.col(f"{p}_id").alias("id")) for p in ("batter", "bowler")]
    pairs = d.select("match_id", F.inline(F.array(*persons))).where(F.col("id").isNotNull()).distinct()
    return pairs.groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "id"))).alias("player_registry"))


# --------------------------------------------------------------------- D3

def franchises(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("bigint").alias("franchise_id"),
        F.col("n_name").alias("name"),
        F.lit(125).cast("decimal(10,2)").alias("purse_total_cr"),
        (5 + F.col("n_nationkey") % 20).cast("decimal(10,2)").alias("purse_remaining_cr"),
        # every roster row stands in a squad, so odd keys get room for more
        F.when(F.col("n_nationkey") % 2 == 1, 1_000_000).otherwise(25).alias("max_squad_size"),
        F.when(F.col("n_nationkey") % 4 == 1, 1_000_000).otherwise(8).alias("max_overseas"),
        F.concat(F.lit("Venue "), (F.col("n_nationkey") % 7).cast("string")).alias("home_venue"),
        (F.col("n_nationkey") % 12 != 11).alias("is_active"),
    )


def roster(customer: DataFrame) -> DataFrame:
    """Every customer is a roster row (odd keys carry a longer first name,
    so exact matching fails and surname + initial must resolve)."""
    k = F.col("c_custkey")
    return customer.select(
        k.alias("roster_id"),
        F.col("c_nationkey").cast("bigint").alias("franchise_id"),
        F.concat(F.char((F.lit(65) + k % 26).cast("int")),
                 F.when(k % 2 == 1, F.lit("lex")).otherwise(F.lit("")),
                 F.lit(" Surname"), F.floor(k / 4).cast("bigint").cast("string")).alias("player_name"),
        _case(k % 4, ROLE_BY_MOD4).alias("role"),
        F.when(k % 3 == 0, "pace").when(k % 3 == 1, "spin").otherwise("na").alias("bowling_style"),
        (k % 3 == 0).alias("is_overseas"),
        F.when(k % 5 == 0, "auction").otherwise("imported").alias("acquisition_type"),
        (k % 9).cast("decimal(10,2)").alias("price_cr"),
        F.when(k % 11 == 0, "released").otherwise("active").alias("status"),
    )


def player_pool(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("pool_id"),
        (k + 1).alias("sr_no"),
        F.concat(F.char((F.lit(65) + (k * 7) % 26).cast("int")), F.lit(" Surname"),
                 F.floor(k * 7 / 4).cast("bigint").cast("string")).alias("player_name"),
        F.concat(F.lit("Country "), F.col("s_nationkey").cast("string")).alias("country"),
        (20 + k % 20).alias("age"),
        _case(k % 4, ROLE_BY_MOD4).alias("role"),
        F.when(k % 2 == 0, "capped").otherwise("uncapped").alias("capped_status"),
        F.when(k % 3 == 0, "spin").when(k % 3 == 1, "pace").otherwise("na").alias("bowling_style"),
        (k % 3 == 0).alias("is_overseas"),
        (30 + (k % 5) * 40).cast("decimal(10,2)").alias("base_price_lakh"),
        (k % 13 != 12).alias("is_current_reference"),
    )


def bids(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Every order is a bid, 500 order keys an auction; franchise ids 25/26
    and one pool id in eleven are unknown on purpose."""
    k = F.col("o_orderkey")
    pool = supplier.agg((F.count("*") + F.floor(F.count("*") / 10)).alias("n")).scalar()
    return orders.select(
        k.alias("bid_id"),
        F.floor(k / 500).cast("bigint").alias("auction_id"),
        (F.col("o_custkey") % 27).alias("franchise_id"),
        (k % pool).alias("pool_id"),
        (F.floor(F.col("o_totalprice") / 1000).cast("double") / 100).alias("price_cr"),
    )


# --------------------------------------------------------------------- D4

def change_log(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return events.select(
        (F.col("event_id") + 1).alias("event_id"),
        F.when(et.isin("purchase", "signup"), "data_change").otherwise("tool_call").alias("event_type"),
        F.when(et == "click", "get_player_form_profile").when(et == "view", "search_player_news")
        .when(et == "purchase", "save_strategy_note").otherwise("execute_player_bid").alias("tool_name"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("user_id") % 25).alias("franchise_id"),
        F.col("props").alias("payload"),
        F.when(et == "error", "blocked: purse").when(et.isin("signup", "purchase"), "success")
        .otherwise("found").alias("result_status"),
        F.col("ts").alias("created_at"),
    )


# --------------------------------------------------------------------- D5

def articles(pages: DataFrame) -> DataFrame:
    """Each page is an article for one player; every tenth page is also
    filed under a second player (the same url for two players)."""
    shifts = F.when(F.col("page_id") % 10 == 0, F.array(F.lit(0), F.lit(10))).otherwise(F.array(F.lit(0)))
    p = pages.select("page_id", "url", "html", F.explode(shifts).alias("k"))
    return p.select(
        F.concat(F.lit("r"), ((F.col("page_id") + F.col("k")) % 150).cast("string")).alias("player_key"),
        "url",
        F.col("html").alias("content"),
        ((F.col("page_id") % 100).cast("double") / 100).alias("score"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")).alias("ingested_on"),
    )


# --------------------------------------------------------------------- D6

def notes(conversations: DataFrame) -> DataFrame:
    t = F.col("turn") % 6
    return conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("note_id"),
        (F.col("conv_id") % 30).alias("franchise_id"),
        F.when(t == 0, "retention_plan").when(t == 1, "auction_targets").when(t == 2, "playing_xi")
        .when(t == 3, "scouting").when(t == 4, "general").otherwise("unlisted_type").alias("note_type"),
        F.when(F.col("conv_id") % 17 == 0, F.lit("  ")).otherwise(F.col("text")).alias("content"),
        F.col("role").alias("created_by"),
    )
