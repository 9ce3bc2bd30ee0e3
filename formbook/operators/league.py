"""League / squad / auction analytics as set-based DataFrame jobs
(A33, A38-A42, B2, B5-B7, B10, B11, B13, B18, J9, J11, J14, J19-J21, U2).

Lists stay flat (one row per player) instead of being collected into
per-team arrays: a team's row count grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.exprs import lower_trim
from formbook.operators.names import resolve_and_attach, resolve_names, salted, salted_lookup
from formbook.operators.textsearch import substring_join

ROLE_COUNTS = {"batters": "batter", "bowlers": "bowler", "all_rounders": "all-rounder",
               "wicketkeepers": "wicketkeeper"}


def active_roster(roster: DataFrame) -> DataFrame:
    return roster.where(F.col("status") == "active")


def league_squad_summary(franchises: DataFrame, roster: DataFrame) -> DataFrame:
    """B10 + J14 + A33: active franchises, left join active roster with the
    status predicate in the join condition (empty squads kept)."""
    f = franchises.where(F.col("is_active"))
    r = active_roster(roster).select("franchise_id", "roster_id", "is_overseas", "role")
    rid = F.col("roster_id")
    return (
        f.join(r, "franchise_id", "left")
        .groupBy("franchise_id", "name", "purse_total_cr", "purse_remaining_cr", "max_squad_size",
                 "max_overseas", "home_venue")
        .agg(
            F.count(rid).alias("squad_size"),
            F.count(F.when(F.col("is_overseas"), rid)).alias("overseas_count"),
            *[F.count(F.when(F.col("role") == role, rid)).alias(alias) for alias, role in ROLE_COUNTS.items()],
        )
    )


def cap_status(summary: DataFrame) -> DataFrame:
    """Slots left / "OVER BY n", over-cap flags, purse share left."""
    slots = F.col("max_squad_size") - F.col("squad_size")
    os_left = F.col("max_overseas") - F.col("overseas_count")

    def label(x):
        return F.when(x >= 0, F.concat(x.cast("string"), F.lit(" LEFT"))) \
            .otherwise(F.concat(F.lit("OVER BY "), (-x).cast("string")))
    return summary.select(
        "franchise_id", "name", "squad_size", "max_squad_size", "overseas_count", "max_overseas",
        slots.alias("slots_left"), os_left.alias("overseas_left"),
        label(slots).alias("squad_slots_label"), label(os_left).alias("overseas_slots_label"),
        (F.col("squad_size") > F.col("max_squad_size")).alias("over_squad_cap"),
        (F.col("overseas_count") > F.col("max_overseas")).alias("over_overseas_cap"),
        F.when(F.col("purse_total_cr") > 0,
               F.round(F.col("purse_remaining_cr").cast("double") / F.col("purse_total_cr").cast("double") * 100, 2))
        .alias("purse_pct_left"),
    )


def purse_board(franchises: DataFrame) -> DataFrame:
    """Spent vs remaining per active team."""
    return franchises.where(F.col("is_active")).select(
        "franchise_id", "name",
        F.col("purse_remaining_cr").cast("double").alias("remaining_cr"),
        (F.col("purse_total_cr") - F.col("purse_remaining_cr")).cast("double").alias("spent_cr"),
    )


def league_totals(summary: DataFrame) -> DataFrame:
    """Purse in play, team with the largest purse (ties -> smallest
    name), count of teams over the squad cap — one row."""
    purse = F.col("purse_remaining_cr").cast("double")
    return summary.agg(
        F.round(F.sum(purse), 2).alias("total_purse_left_cr"),
        F.max_by("name", F.struct(purse, F.lit(0) - F.col("franchise_id"))).alias("max_purse_team"),
        F.max(purse).alias("max_purse_cr"),
        F.count_if(F.col("squad_size") > F.col("max_squad_size")).alias("teams_over_cap"),
    )


def current_pool(pool: DataFrame) -> DataFrame:
    """Pool listing (current reference rows)."""
    return pool.where(F.col("is_current_reference"))


def unowned_pool(pool: DataFrame, roster: DataFrame) -> DataFrame:
    """Current pool players not on any active roster (case-folded). The
    owned names grow with the roster: merged, not broadcast."""
    owned = active_roster(roster).select(F.lower("player_name").alias("_lname")).distinct()
    return (current_pool(pool).withColumn("_lname", F.lower("player_name"))
            .join(owned.hint("merge"), "_lname", "left_anti").drop("_lname"))


def pool_composition(pool: DataFrame) -> DataFrame:
    """GROUP BY role, overseas, capped."""
    return pool.groupBy("role", "is_overseas", "capped_status").agg(F.count("*").alias("players"))


def player_universe(batter_profile: DataFrame, bowler_profile: DataFrame, pool: DataFrame) -> DataFrame:
    """U2 + J11 + B18: distinct names over both profiles and the pool,
    an in-pool flag (semi join on lower(name)) and a role read."""
    names = (batter_profile.select("player_name").union(bowler_profile.select("player_name"))
             .union(current_pool(pool).select("player_name")).distinct())
    in_pool = current_pool(pool).select(F.lower("player_name").alias("_lname")).distinct() \
        .withColumn("in_pool", F.lit(True))
    u = names.withColumn("_lname", F.lower("player_name")).join(in_pool, "_lname", "left") \
        .withColumn("in_pool", F.coalesce("in_pool", F.lit(False))).drop("_lname")
    u = resolve_names(u, "player_name", batter_profile, key_col="batter_key", out_key="_bat", out_tier=None)
    u = resolve_names(u, "player_name", bowler_profile, key_col="bowler_key", out_key="_bowl", out_tier=None)
    role = (F.when(F.col("_bat").isNotNull() & F.col("_bowl").isNotNull(), "all-rounder")
            .when(F.col("_bowl").isNotNull(), "bowler").otherwise("batter"))
    return u.withColumn("role_read", role).drop("_bat", "_bowl")


def _gold_name_hit(names: DataFrame, name_col: str, profiles: DataFrame, out: str) -> DataFrame:
    """B7's set-membership rule: exact name (case-sensitive) in the set,
    else exactly one distinct name with the surname, else exactly one
    with surname + first initial."""
    pn = profiles.select(F.col("player_name").alias("_n")).distinct()
    exact = pn.select(F.col("_n").alias("_name"), F.lit(True).alias("_exact"))
    words = F.split(F.lower(F.col("_n")), r"\s+")
    pk = pn.withColumn("_sur", F.element_at(words, -1)).withColumn("_ini", F.substring(lower_trim("_n"), 1, 1))
    sur = pk.groupBy("_sur").agg(F.count("*").alias("_ns"))
    si = pk.groupBy("_sur", "_ini").agg(F.count("*").alias("_nsi"))
    qw = F.split(lower_trim(name_col), r"\s+")
    q = salted(names.withColumn("_sur", F.element_at(qw, -1)).withColumn("_ini", F.substring(qw[0], 1, 1))
               .withColumn("_name", F.col(name_col)))
    q = salted_lookup(q, exact, ["_name"])
    q = salted_lookup(salted_lookup(q, sur, ["_sur"]), si, ["_sur", "_ini"])
    blank = F.length(F.trim(F.col(name_col))) == 0
    hit = ~blank & (F.col("_exact").isNotNull() | (F.col("_ns") == 1) | (F.col("_nsi") == 1))
    return q.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_salt", "_sur", "_ini", "_name", "_exact", "_ns", "_nsi")


def role_inference(roster: DataFrame, pool: DataFrame, batter_profile: DataFrame,
                   bowler_profile: DataFrame) -> DataFrame:
    """Role and bowling style from the pool first, then from gold
    evidence, then default, with the provenance of each answer. Gold tells
    no style: who only bowls is taken for pace."""
    p = (current_pool(pool).withColumn("_lname", F.lower("player_name"))
         .withColumn("_rn", F.row_number().over(Window.partitionBy("_lname").orderBy("pool_id")))
         .where("_rn = 1").select("_lname", F.col("role").alias("_prole"), F.col("bowling_style").alias("_pstyle")))
    r = roster.select("roster_id", "franchise_id", "player_name").withColumn("_lname", F.lower("player_name"))
    r = r.join(p, "_lname", "left")
    r = _gold_name_hit(r, "player_name", batter_profile, "has_bat")
    r = _gold_name_hit(r, "player_name", bowler_profile, "has_bowl")
    pool_hit = F.col("_prole").isNotNull()
    both, bowl_only, bat_only = (F.col("has_bat") & F.col("has_bowl"), F.col("has_bowl"), F.col("has_bat"))
    return r.select(
        "roster_id", "franchise_id", "player_name",
        F.when(pool_hit, F.col("_prole")).when(both, "all-rounder").when(bowl_only, "bowler")
        .otherwise("batter").alias("inferred_role"),
        F.when(pool_hit, F.col("_pstyle")).when(both, "na").when(bowl_only, "pace").otherwise("na")
        .alias("inferred_bowling_style"),
        F.when(pool_hit, "player_pool").when(both, "gold (bat+bowl)").when(bowl_only, "gold (bowl only)")
        .when(bat_only, "gold (bat only)").otherwise("default").alias("role_source"),
        (~pool_hit & ~F.col("has_bat") & ~F.col("has_bowl")).alias("needs_review"),
    )


BAT_RECENT = {"recent_innings": "recent_innings", "recent_strike_rate": "recent_strike_rate",
              "recent_average": "recent_average"}
BOWL_RECENT = {"recent_innings": "recent_innings", "recent_economy": "recent_economy",
               "recent_wickets": "recent_wickets", "bowler_type": "bowler_type"}


def auction_targets(pool: DataFrame, roster: DataFrame, batter_profile: DataFrame,
                    bowler_profile: DataFrame, role: str | None = None, overseas: bool | None = None,
                    max_results: int = 12) -> DataFrame:
    """B5 (J9 + P26 + J21 + O5): unowned pool, optional filters, recent
    form both disciplines, players with data first, then sr_no."""
    u = unowned_pool(pool, roster)
    if role:
        u = u.where(F.lower("role") == role.strip().lower())
    if overseas is not None:
        u = u.where(F.col("is_overseas") == F.lit(bool(overseas)))
    u = u.select("pool_id", "sr_no", "player_name", "role", "country", "age", "is_overseas", "capped_status",
                 (F.col("base_price_lakh").cast("double") / 100.0).alias("base_price_cr"))
    u = resolve_and_attach(u, "player_name", batter_profile, "batter_key",
                           {"innings": "recent_innings", "strike_rate": "recent_strike_rate",
                            "average": "recent_average"}, prefix="bat_")
    u = resolve_and_attach(u, "player_name", bowler_profile, "bowler_key",
                           {"innings": "recent_innings", "economy": "recent_economy",
                            "wickets": "recent_wickets", "bowler_type": "bowler_type"}, prefix="bowl_")
    has_data = F.col("bat_innings").isNotNull() | F.col("bowl_innings").isNotNull()
    n = max(1, min(int(max_results), 25))
    return u.withColumn("has_data", has_data).orderBy(F.desc("has_data"), "sr_no", "pool_id").limit(n)


def home_venue_matches(franchises: DataFrame, keywords: DataFrame, venues: DataFrame) -> DataFrame:
    """(franchise_id, venue) where a franchise keyword occurs in
    the venue name (case-insensitive) — an n-gram equi-join, not a
    product of the two dimensions."""
    kw = keywords.select("franchise_id", "keyword").withColumn(
        "_kid", F.concat_ws("|", F.col("franchise_id").cast("string"), "keyword"))
    v = venues.select("venue").distinct()
    pairs = substring_join(kw, "keyword", ["_kid"], v, "venue", ["venue"])
    return pairs.join(kw, "_kid").select("franchise_id", "venue").distinct().join(
        franchises.select("franchise_id"), "franchise_id")


def venue_keyword_table(franchises: DataFrame, keywords: dict | None = None) -> DataFrame:
    """The fixed keyword dimension joined to franchises by
    case-folded name -> (franchise_id, keyword)."""
    from formbook.schema import VENUE_KEYWORDS
    kw = keywords if keywords is not None else VENUE_KEYWORDS
    rows = [(name.lower(), k) for name, ks in kw.items() for k in ks]
    dim = franchises.sparkSession.createDataFrame(rows, "_lname string, keyword string")
    return franchises.select("franchise_id", F.lower("name").alias("_lname")).join(dim, "_lname") \
        .select("franchise_id", "keyword")


def venue_keywords_from_home(franchises: DataFrame) -> DataFrame:
    """Keyword dimension when only ``home_venue`` is known: the venue text."""
    return franchises.where(F.col("home_venue").isNotNull()) \
        .select("franchise_id", F.col("home_venue").alias("keyword"))


def venue_form_resolved(roster: DataFrame, franchise_venues: DataFrame, venue_form: DataFrame,
                        key_col: str, columns: dict[str, str], prefix: str) -> DataFrame:
    """Resolve each roster name inside the venue-restricted form rows
    of its own franchise (uniqueness counted within that subset). Lookups are
    salted: one squad or surname may hold any share of the roster."""
    sub = venue_form.join(franchise_venues, "venue").select(
        "franchise_id", "venue", F.col(key_col).alias("_k"), "player_name", *set(columns.values()))
    sub = sub.withColumn("_rowid", F.concat_ws("|", "_k", "venue"))
    exact = sub.groupBy("franchise_id", F.lower("player_name").alias("_lname")).agg(
        F.min("_rowid").alias("_e"))
    words = F.split(F.lower(F.col("player_name")), r"\s+")
    sk = sub.withColumn("_sur", F.element_at(words, -1)).withColumn("_ini", F.substring(lower_trim("player_name"), 1, 1))
    sur = sk.groupBy("franchise_id", "_sur").agg(F.count("*").alias("_ns"), F.min("_rowid").alias("_s"))
    si = sk.groupBy("franchise_id", "_sur", "_ini").agg(F.count("*").alias("_nsi"), F.min("_rowid").alias("_si"))
    qw = F.split(lower_trim("player_name"), r"\s+")
    r = salted(roster.withColumn("_lname", lower_trim("player_name"))
               .withColumn("_sur", F.element_at(qw, -1)).withColumn("_ini", F.substring(qw[0], 1, 1)))
    for index, keys in ((exact, ["_lname"]), (sur, ["_sur"]), (si, ["_sur", "_ini"])):
        r = salted_lookup(r, index, ["franchise_id", *keys])
    pick = F.coalesce(F.col("_e"), F.when(F.col("_ns") == 1, F.col("_s")), F.when(F.col("_nsi") == 1, F.col("_si")))
    r = r.withColumn("_rowid", pick).drop("_lname", "_sur", "_ini", "_e", "_ns", "_s", "_nsi", "_si")
    vals = sub.select("franchise_id", "_rowid", *[F.col(src).alias(prefix + alias) for alias, src in columns.items()])
    return salted_lookup(r, vals, ["franchise_id", "_rowid"]).drop("_rowid", "_salt")


def retention_analysis(franchises: DataFrame, roster: DataFrame, batter_profile: DataFrame,
                       bowler_profile: DataFrame, bat_venue: DataFrame, bowl_venue: DataFrame,
                       keywords: DataFrame | None = None) -> DataFrame:
    """B6 (J20): every active roster player with recent form in both
    disciplines and form at the franchise's home venue (NULL when not
    qualified) — one lazy plan, flat columns (see ``nest_retention``)."""
    f = franchises.where(F.col("is_active"))
    kw = keywords if keywords is not None else venue_keywords_from_home(f)
    venues = bat_venue.select("venue").union(bowl_venue.select("venue"))
    fv = home_venue_matches(f, kw, venues)
    r = active_roster(roster).join(f.select("franchise_id", F.col("name").alias("franchise_name"), "home_venue"),
                                   "franchise_id").select(
        "roster_id", "franchise_id", "franchise_name", "home_venue", "player_name", "role", "is_overseas")
    r = resolve_and_attach(r, "player_name", batter_profile, "batter_key",
                           {"innings": "recent_innings", "strike_rate": "recent_strike_rate",
                            "regressed_strike_rate": "regressed_strike_rate",
                            "average": "recent_average"}, prefix="bat_recent_")
    r = resolve_and_attach(r, "player_name", bowler_profile, "bowler_key",
                           {"innings": "recent_innings", "economy": "recent_economy",
                            "regressed_economy": "regressed_economy",
                            "wickets": "recent_wickets"}, prefix="bowl_recent_")
    r = venue_form_resolved(r, fv, bat_venue, "batter_key",
                            {"innings": "innings", "strike_rate": "strike_rate", "average": "average"},
                            "venue_bat_")
    r = venue_form_resolved(r, fv, bowl_venue, "bowler_key",
                            {"innings": "innings", "economy": "economy", "wickets": "wickets"}, "venue_bowl_")
    return r


def nest_retention(flat: DataFrame) -> DataFrame:
    """The tool-shaped view: ``recent_form`` / ``home_venue_form`` structs,
    each NULL when neither discipline qualified."""
    def block(prefix_bat, prefix_bowl, bat_cols, bowl_cols):
        bat = F.when(F.col(prefix_bat + bat_cols[0]).isNotNull(),
                     F.struct(*[F.col(prefix_bat + c_).alias(c_) for c_ in bat_cols]))
        bowl = F.when(F.col(prefix_bowl + bowl_cols[0]).isNotNull(),
                      F.struct(*[F.col(prefix_bowl + c_).alias(c_) for c_ in bowl_cols]))
        return F.when(bat.isNotNull() | bowl.isNotNull(), F.struct(bat.alias("batting"), bowl.alias("bowling")))
    return flat.select(
        "franchise_id", "franchise_name", "home_venue", "player_name", "role", "is_overseas",
        block("bat_recent_", "bowl_recent_", ["innings", "strike_rate", "average"],
              ["innings", "economy", "wickets"]).alias("recent_form"),
        block("venue_bat_", "venue_bowl_", ["innings", "strike_rate", "average"],
              ["innings", "economy", "wickets"]).alias("home_venue_form"))


def franchise_status(franchise_names: DataFrame, name_col: str, franchises: DataFrame,
                     roster: DataFrame) -> DataFrame:
    """B2: look each requested name up case-insensitively; found flag,
    squad size and overseas count of the active roster."""
    q = franchise_names.select(F.col(name_col).alias("query")).distinct() \
        .withColumn("_lname", F.lower("query"))
    f = franchises.withColumn("_lname", F.lower("name"))
    counts = active_roster(roster).groupBy("franchise_id").agg(
        F.count("*").alias("squad_size"), F.count_if(F.col("is_overseas")).alias("overseas_count"))
    return (q.join(f, "_lname", "left").join(counts, "franchise_id", "left")
            .select("query", F.col("franchise_id").isNotNull().alias("found"), "franchise_id", "name",
                    F.col("purse_total_cr").cast("double").alias("purse_total_cr"),
                    F.col("purse_remaining_cr").cast("double").alias("purse_remaining_cr"),
                    "max_squad_size", "max_overseas",
                    F.when(F.col("franchise_id").isNotNull(), F.coalesce("squad_size", F.lit(0)))
                    .alias("squad_size"),
                    F.when(F.col("franchise_id").isNotNull(), F.coalesce("overseas_count", F.lit(0)))
                    .alias("overseas_count")))


def franchise_squads(franchise_names: DataFrame, name_col: str, franchises: DataFrame, roster: DataFrame) -> DataFrame:
    """B2: the active players of each requested team, looked up
    case-insensitively, one row a player."""
    q = franchise_names.select(F.col(name_col).alias("query")).distinct().withColumn("_lname", F.lower("query"))
    f = franchises.select("franchise_id", F.lower("name").alias("_lname"))
    return q.join(f, "_lname").join(active_roster(roster), "franchise_id").select(
        "query", "franchise_id", "roster_id", "player_name", "role", "bowling_style", "is_overseas", "price_cr")
