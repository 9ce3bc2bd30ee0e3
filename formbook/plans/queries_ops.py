"""Registered queries of the operational side: bids, ledger, notes,
audit, sync, news, vectors, quality and leaderboards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formbook.operators import audit, bids, news, notes
from formbook.plans.gold import Gold
from formbook.plans.oracle import NEWS_SEARCH, TEXT_EMBED_TOPK, with_ctes
from formbook.plans.registry import query
from formbook.session import checkpoint_dir
from formbook.sources import fixtures as fx
from formbook.streaming import ledger, sync

AS_OF = "2024-01-30"


# ------------------------------------------------------------------ bids
@query("bid_validation", with_ctes(["bid_validation"], "SELECT * FROM bid_validation"))
def bid_validation_q(spark, sf_dir):
    g = Gold(spark, sf_dir)
    return bids.validate_bids(g.bids, g.franchises, g.pool, g.roster)


@query("bid_ledger", with_ctes(["bid_ledger"], "SELECT * FROM bid_ledger"))
def bid_ledger_q(spark, sf_dir):
    """T5: sequential ledger (stateful stream); oracle: recursive CTE per auction."""
    g = Gold(spark, sf_dir)
    return ledger.run_bid_ledger(spark, bids.bid_context(g.bids, g.franchises, g.pool, g.roster))


def _effects(spark, sf_dir):
    """B4 from the whole ledger."""
    g = Gold(spark, sf_dir)
    led = ledger.run_bid_ledger(spark, bids.bid_context(g.bids, g.franchises, g.pool, g.roster))
    return bids.bid_effects(led, g.franchises)


@query("bid_effects", with_ctes(["bid_effects"], "SELECT * FROM bid_effects"))
def bid_effects_q(spark, sf_dir):
    """An audit event for each bid."""
    return _effects(spark, sf_dir)["audit"]


@query("bid_roster_rows", with_ctes(["bid_roster_rows"], "SELECT * FROM bid_roster_rows"))
def bid_roster_rows_q(spark, sf_dir):
    """A roster row for each accepted bid."""
    return _effects(spark, sf_dir)["roster_rows"]


@query("bid_purse", with_ctes(["bid_purse"], "SELECT * FROM bid_purse"))
def bid_purse_q(spark, sf_dir):
    """Purse after the auction per (auction, franchise)."""
    return _effects(spark, sf_dir)["purse"]


# ------------------------------------------------------------------ notes
def _notes(g):
    return notes.validate_notes(fx.notes(g.table("conversations")), g.franchises)


@query("notes_validate", with_ctes(["notes_valid"], "SELECT * FROM notes_valid"))
def notes_validate_q(spark, sf_dir):
    return _notes(Gold(spark, sf_dir))


@query("notes_latest", with_ctes(["notes_latest"], "SELECT * FROM notes_latest"))
def notes_latest_q(spark, sf_dir):
    g = Gold(spark, sf_dir)
    return notes.list_notes(_notes(g), g.franchises)


@query("notes_audit", with_ctes(["notes_audit"], "SELECT * FROM notes_audit"))
def notes_audit_q(spark, sf_dir):
    return notes.notes_audit(_notes(Gold(spark, sf_dir)))


# ------------------------------------------------------------------ change log
def _log(g):
    return fx.change_log(g.table("events"))


@query("audit_trail", with_ctes(["audit_trail"], "SELECT * FROM audit_trail"))
def audit_trail_q(spark, sf_dir):
    g = Gold(spark, sf_dir)
    return audit.audit_trail(_log(g), g.franchises)


@query("tool_usage", with_ctes(["tool_usage"], "SELECT * FROM tool_usage"))
def tool_usage_q(spark, sf_dir):
    return audit.tool_usage(_log(Gold(spark, sf_dir)))


@query("bid_outcomes", with_ctes(["bid_outcomes"], "SELECT * FROM bid_outcomes"))
def bid_outcomes_q(spark, sf_dir):
    return audit.bid_outcomes(_log(Gold(spark, sf_dir)))


@query("activity_over_time", with_ctes(["activity"], "SELECT * FROM activity"))
def activity_over_time_q(spark, sf_dir):
    return audit.running_count(_log(Gold(spark, sf_dir)), "created_at", "event_id")


def _synced(spark, sf_dir):
    """Land the log in two arrivals (before / from mid-month; the second
    re-delivers the whole first one) and run the sync after each."""
    g = Gold(spark, sf_dir)
    log = _log(g)
    root = f"{checkpoint_dir(spark).rstrip('/')}/sync-{uuid.uuid4().hex}"
    cut = F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    args = dict(source=f"{root}/landing", schema=log.schema, target=f"{root}/target",
                watermark=f"{root}/watermark", checkpoint=f"{root}/_checkpoint")
    log.where(cut).write.mode("append").parquet(f"{root}/landing/arrival=1")
    sync.sync_change_log(spark, **args)
    log.write.mode("append").parquet(f"{root}/landing/arrival=2")
    sync.sync_change_log(spark, **args)
    sync.sync_change_log(spark, **args)  # a re-run with nothing new adds nothing
    return log, spark.read.parquet(args["target"]).select(*log.columns), args


@query("log_sync", with_ctes(["change_log"], "SELECT * FROM change_log"))
def log_sync_q(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


@query("sync_lag", "SELECT count(*) AS live_events, count(*) AS synced_events, CAST(0 AS BIGINT) AS missing_ids, "
                   "CAST(0 AS BIGINT) AS lag FROM events")
def sync_lag_q(spark, sf_dir):
    live, target, _ = _synced(spark, sf_dir)
    return sync.sync_lag(live, target)


#: The log in two arrivals: the second brings the second half of the month, a tenth of the first half late, and a
#: seventh of everything again. The first one's watermark decides which of these rows come behind it.
ARRIVALS = """
  first AS (SELECT * FROM change_log WHERE created_at < TIMESTAMP '2024-01-15' AND event_id % 10 <> 3),
  second AS (SELECT * FROM change_log WHERE created_at >= TIMESTAMP '2024-01-15' OR event_id % 10 = 3
             UNION ALL SELECT * FROM change_log WHERE event_id % 7 = 0),
  marks AS (SELECT (SELECT epoch_us(max(created_at)) // 1000 - 3600000 FROM first) AS w1,
                   (SELECT epoch_us(max(created_at)) // 1000 - 3600000 FROM change_log) AS w2,
                   (SELECT count(*) FROM change_log) AS n),
  behind AS (SELECT * FROM second, marks WHERE epoch_us(created_at) <= w1 * 1000),
  held AS (SELECT event_id FROM first UNION
           SELECT event_id FROM second, marks WHERE epoch_us(created_at) > w1 * 1000)"""


def _synced_by_event_time(spark, sf_dir):
    """The two arrivals synced, and a third call that settles; the table, and
    each call's progress with the lag after it. A call is one batch here, so
    that the figures do not depend on how files are batched."""
    log = _log(Gold(spark, sf_dir))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("created_at"))
    timed = log.withColumn("event_time", F.timestamp_micros(micros))
    early = F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    held_back = F.col("event_id") % 10 == 3
    arrivals = [timed.where(early & ~held_back),
                timed.where(~early | held_back).unionByName(timed.where("event_id % 7 = 0"))]
    root = f"{checkpoint_dir(spark).rstrip('/')}/sync-{uuid.uuid4().hex}"
    args = dict(source=f"{root}/landing", schema=timed.schema, target=f"{root}/target",
                checkpoint=f"{root}/_checkpoint", event_time="event_time", max_files_per_trigger=1_000_000)
    calls = []
    for call in (1, 2, 3):
        if call <= len(arrivals):
            arrivals[call - 1].write.parquet(f"{root}/landing/arrival={call}")
        done = sync.sync_by_event_time(spark, settle=call != 2, **args)
        lag = sync.sync_lag(log, sync.read_synced(spark, args["target"], timed.schema)).first()
        mark = None if done.watermark is None else round(done.watermark.timestamp() * 1000)
        calls.append((call, mark, done.taken, done.behind, done.settled, *lag))
    return sync.read_synced(spark, args["target"], timed.schema).select(*log.columns), calls


@query("event_time_sync", with_ctes(["change_log"], "SELECT * FROM change_log"))
def event_time_sync_q(spark, sf_dir):
    """The log through the event-time sync, with late and repeated
    events; each event is there once."""
    return _synced_by_event_time(spark, sf_dir)[0]


@query("event_time_progress", with_ctes(["change_log"], f"""
  SELECT * FROM (WITH {ARRIVALS.strip()},
  calls AS (
    SELECT 1 AS call, w1 AS watermark_ms, (SELECT count(*) FROM first) AS taken, 0 AS behind, 0 AS settled,
           (SELECT count(*) FROM first) AS synced_events FROM marks
    UNION ALL SELECT 2, w2, (SELECT count(*) FROM second), (SELECT count(*) FROM behind), 0,
           (SELECT count(*) FROM held) FROM marks
    UNION ALL SELECT 3, NULL, 0, 0, n - (SELECT count(*) FROM held), n FROM marks)
  SELECT call, watermark_ms, taken, CAST(behind AS BIGINT) AS behind, CAST(settled AS BIGINT) AS settled,
         n AS live_events, synced_events, n - synced_events AS missing_ids, n - synced_events AS lag
  FROM calls, marks)"""))
def event_time_progress_q(spark, sf_dir):
    """A35 + A43: watermark, late rows and lag after each call of the sync;
    after the second call the events behind its watermark are missing."""
    return spark.createDataFrame(_synced_by_event_time(spark, sf_dir)[1],
                                 "call int, watermark_ms long, taken long, behind long, settled long, live_events long, "
                                 "synced_events long, missing_ids long, lag long")


@query("tool_call_log", with_ctes(["change_log"], """
  SELECT CASE WHEN result_status = 'success' THEN 'data_change' ELSE 'tool_call' END AS event_type,
         CASE WHEN tool_name = 'save_strategy_note' THEN 'strategy_notes' ELSE 'auction' END AS table_name,
         tool_name, franchise_id, json_object('event_id', event_id, 'tool', tool_name)::VARCHAR AS payload, result_status
  FROM change_log"""))
def tool_call_log_q(spark, sf_dir):
    """Every tool call as a row of the change log."""
    calls = _log(Gold(spark, sf_dir)).select(
        F.when(F.col("tool_name") == "save_strategy_note", "strategy_notes").otherwise("auction").alias("table_name"),
        "tool_name", "franchise_id", F.struct("event_id", F.col("tool_name").alias("tool")).alias("payload"),
        "result_status")
    return audit.log_tool_calls(calls)


# ------------------------------------------------------------------ news / vectors
def _articles(g):
    return fx.articles(g.table("pages"))


@query("article_ids", with_ctes(["article_ids"], "SELECT * FROM article_ids"))
def article_ids_q(spark, sf_dir):
    a = news.with_article_id(_articles(Gold(spark, sf_dir)))
    return a.select("player_key", "url", "score", "ingested_on",
                    F.length("content").alias("content_chars"), "article_id")


@query("news_shortlist", with_ctes(["shortlist"], "SELECT * FROM shortlist"))
def news_shortlist_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    return news.news_shortlist(g.batter_profile, g.bowler_profile)


@query("refresh_targets", with_ctes(["refresh"], "SELECT * FROM refresh"))
def refresh_targets_q(spark, sf_dir):
    g = Gold(spark, sf_dir, staged=True)
    return news.refresh_targets(news.news_shortlist(g.batter_profile, g.bowler_profile), _articles(g), AS_OF)


@query("article_freshness", with_ctes(["freshness"], "SELECT * FROM freshness"))
def article_freshness_q(spark, sf_dir):
    return news.article_freshness(_articles(Gold(spark, sf_dir)))


@query("url_extract", with_ctes(["urls"], "SELECT * FROM urls"))
def url_extract_q(spark, sf_dir):
    """Bare links of messages that cite the page of their number, once bare
    and once in brackets."""
    g = Gold(spark, sf_dir)
    pages = g.table("pages").select(F.col("page_id").alias("conv_id"), "url")
    conv = g.table("conversations").join(pages, "conv_id", "left").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("msg_id"),
        F.concat_ws(" ", "text", "url", F.concat(F.lit("("), "url", F.lit(")"))).alias("text"))
    return news.extract_urls(conv, "text", "msg_id")


@query("similar_topk", with_ctes(["similar_vecs"], "SELECT * FROM similar_vecs"))
def similar_topk_q(spark, sf_dir):
    emb = Gold(spark, sf_dir).table("embeddings")
    cents = news.label_centroids(emb)
    return news.cosine_topk(emb, cents, corpus_id="vec_id", corpus_vec="embedding", query_id="label",
                            query_vec="centroid", k=5)


@query("text_embed_topk", TEXT_EMBED_TOPK)
def text_embed_topk_q(spark, sf_dir):
    """B22 + B21: TF-IDF embedding of every document, top-5 documents per
    benchmark passage."""
    g = Gold(spark, sf_dir)
    return news.text_embed_topk(g.table("documents"), "doc_id", "text", g.table("benchmark"), "item_id", "text")


@query("news_search", NEWS_SEARCH)
def news_search_q(spark, sf_dir):
    """Five articles of the whole index for each "player: question"."""
    g = Gold(spark, sf_dir)
    asked = g.table("benchmark").select("item_id", F.concat_ws(
        ": ", F.concat(F.lit("r"), (F.col("item_id") % 150).cast("string")), "text").alias("question"))
    return news.search_articles(_articles(g), asked, "item_id", "question")


# ------------------------------------------------------------------ quality
@query("kind_histogram", with_ctes(["kind_hist"], "SELECT * FROM kind_hist"))
def kind_histogram_q(spark, sf_dir):
    d = Gold(spark, sf_dir).scanned_deliveries
    return (d.where(F.col("is_wicket")).select(F.explode("wickets.kind").alias("dismissal_kind"))
            .groupBy("dismissal_kind").agg(F.count("*").alias("dismissals")))


def ball_summary(spark, sf_dir):
    """One row a competition from one pass over the balls: counts a match
    first (the distinct matches are then rows), then a competition."""
    per_match = Gold(spark, sf_dir).scanned_deliveries.groupBy("competition", "match_id").agg(
        F.count("*").alias("balls"), F.count("batter_id").alias("keyed"))
    share = F.col("deliveries_with_batter_id") * 100.0 / F.col("deliveries")
    return (per_match.groupBy("competition")
            .agg(F.count("*").alias("matches"), F.sum("balls").alias("deliveries"),
                 F.sum("keyed").alias("deliveries_with_batter_id"))
            .withColumn("avg_deliveries_per_match", F.round(F.col("deliveries") * 1.0 / F.col("matches"), 1))
            .withColumn("batter_id_coverage_pct", F.round(share, 2)))


@query("volume_check", with_ctes(["volume"], "SELECT * FROM volume"))
def volume_check_q(spark, sf_dir):
    return ball_summary(spark, sf_dir).select("competition", "matches", "deliveries", "avg_deliveries_per_match")


@query("key_coverage", with_ctes(["coverage"], "SELECT * FROM coverage"))
def key_coverage_q(spark, sf_dir):
    return ball_summary(spark, sf_dir).select(
        "competition", "deliveries", "deliveries_with_batter_id", "batter_id_coverage_pct")


# ------------------------------------------------------------------ boards
@query("top_recent_economy", with_ctes(["top_recent_economy"], "SELECT * FROM top_recent_economy"))
def top_recent_economy_q(spark, sf_dir):
    return (Gold(spark, sf_dir, staged=True).bowl_recent
            .select("bowler_key", "player_name", "innings", "balls_bowled", "economy", "regressed_economy")
            .orderBy("regressed_economy", "bowler_key").limit(10))


@query("death_specialists", with_ctes(["death_specialists"], "SELECT * FROM death_specialists"))
def death_specialists_q(spark, sf_dir):
    return (Gold(spark, sf_dir, staged=True).bat_phase.where(F.col("phase") == "death")
            .select("batter_key", "player_name", "balls_faced", "strike_rate")
            .orderBy(F.desc("strike_rate"), "batter_key").limit(10))


@query("genuine_allrounders", with_ctes(["genuine_allrounders"], "SELECT * FROM genuine_allrounders"))
def genuine_allrounders_q(spark, sf_dir):
    from formbook.schema import GENUINE_ALLROUNDER_PCT
    return (Gold(spark, sf_dir, staged=True).allrounders
            .where(F.col("bowling_involvement_pct") >= GENUINE_ALLROUNDER_PCT)
            .orderBy(F.desc("runs"), "player_key").limit(10))


@query("name_lookup_board", with_ctes(["name_board"], "SELECT * FROM name_board"))
def name_lookup_board_q(spark, sf_dir):
    bp = Gold(spark, sf_dir, staged=True).batter_profile
    return bp.where(F.lower("player_name").contains("surname1")).select(
        "batter_key", "player_name", "recent_innings", "recent_strike_rate", "usual_batting_position",
        "likely_keeper_signal")


@query("radar_vectors", with_ctes(["radar"], "SELECT * FROM radar"))
def radar_vectors_q(spark, sf_dir):
    from formbook.operators.boards import batting_radar
    return batting_radar(Gold(spark, sf_dir, staged=True).batter_profile)



# ------------------------------------------------------------------ bronze / silver
ROUNDTRIP_COLS = ("match_id", "competition", "innings_seq", "over_number", "delivery_seq", "batting_team",
                  "batter", "batter_id", "bowler", "bowler_id", "runs_batter", "runs_total", "extras_wides",
                  "extras_noballs", "extras_byes", "extras_legbyes", "is_wicket", "wicket_kind", "in_powerplay",
                  "innings_target_runs")


def _bronze(spark, sf_dir, infer_schema=False):
    from formbook.sources import bronze as br
    g = Gold(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/docs-{uuid.uuid4().hex}"
    br.write_documents(br.nested_documents(g.d1), root)
    config = (g.d1.select(F.col("competition").alias("competition_code")).distinct()
              .withColumn("is_active", F.lit(True)))
    bronze_df, _status = br.read_competitions(spark, root, config, id_pattern=r"match_id=([0-9]+)/",
                                              folder="competition={code}/*/*.json", infer_schema=infer_schema)
    return bronze_df


@query("bronze_silver_roundtrip", with_ctes(["roundtrip"], "SELECT * FROM roundtrip"))
def bronze_silver_roundtrip_q(spark, sf_dir):
    from formbook.sources import silver
    s = silver.silver_deliveries(_bronze(spark, sf_dir))
    return s.select(*[c for c in ROUNDTRIP_COLS if c not in ("wicket_kind", "in_powerplay")],
                    F.get("wickets", 0)["kind"].alias("wicket_kind"),
                    F.col("powerplay_type").isNotNull().alias("in_powerplay")).select(*ROUNDTRIP_COLS)


@query("silver_matches", with_ctes(["silver_matches"], "SELECT * FROM silver_matches"))
def silver_matches_q(spark, sf_dir):
    from formbook.sources import silver
    m = silver.silver_matches(_bronze(spark, sf_dir))
    return m.select("match_id", "competition", "start_date", "end_date", "num_days", "season", "venue", "team_1",
                    "team_2", "outcome_by_runs", "outcome_by_wickets", "event_stage", "match_type", "num_innings")


# ------------------------------------------------------------------ coverage additions
from formbook.functions import display  # noqa: E402
from formbook.operators import boards, league, names  # noqa: E402


@query("role_inference", with_ctes(["role_inf"], "SELECT * FROM role_inf"))
def role_inference_q(spark, sf_dir):
    """B7 for every roster row."""
    g = Gold(spark, sf_dir, staged=True)
    return league.role_inference(g.roster, g.pool, g.batter_profile, g.bowler_profile)


@query("pool_universe", with_ctes(["universe"], "SELECT * FROM universe"))
def pool_universe_q(spark, sf_dir):
    """U2 + J11 + B18."""
    g = Gold(spark, sf_dir, staged=True)
    return league.player_universe(g.batter_profile, g.bowler_profile, g.pool)


@query("player_lookup", with_ctes(["player_lookup"], "SELECT * FROM player_lookup"))
def player_lookup_q(spark, sf_dir):
    """B1 + J16 for every pool name (3 hits per side), flattened."""
    g = Gold(spark, sf_dir, staged=True)
    out = names.player_lookup(g.pool.select("pool_id", "player_name"), "player_name", "pool_id",
                              g.batter_profile, g.bowler_profile, max_matches=3)
    return out.select(
        "pool_id", "player_key", "player_name",
        F.col("batting.recent_innings").alias("bat_recent_innings"),
        F.col("batting.recent_strike_rate").alias("bat_recent_strike_rate"),
        F.col("batting.regressed_strike_rate").alias("bat_regressed_strike_rate"),
        F.col("bowling.recent_innings").alias("bowl_recent_innings"),
        F.col("bowling.recent_economy").alias("bowl_recent_economy"),
        F.col("bowling.recent_wickets").alias("bowl_recent_wickets"),
        F.col("bowling.bowler_type").alias("bowl_bowler_type"),
        "match_count", "is_ambiguous")


@query("recent_vs_career", with_ctes(["recent_vs_career"], "SELECT * FROM recent_vs_career"))
def recent_vs_career_q(spark, sf_dir):
    return boards.recent_vs_career(Gold(spark, sf_dir, staged=True).batter_profile)


@query("bowler_role_map", with_ctes(["role_map"], "SELECT * FROM role_map"))
def bowler_role_map_q(spark, sf_dir):
    return boards.bowler_role_map(Gold(spark, sf_dir, staged=True).bowler_profile)


@query("partition_rows", with_ctes(["partition_rows"], "SELECT * FROM partition_rows"))
def partition_rows_q(spark, sf_dir):
    """Matches per competition partition."""
    return Gold(spark, sf_dir).matches.groupBy("competition").agg(F.count("*").alias("matches"))


@query("current_rules", with_ctes(["current_rules"], "SELECT * FROM current_rules"))
def current_rules_q(spark, sf_dir):
    """The current rule row after the version flip."""
    from formbook.plans.queries_tables import flip_current_q
    return flip_current_q(spark, sf_dir).where(F.col("is_current"))


@query("activity_feed", with_ctes(["activity_feed"], "SELECT * FROM activity_feed"))
def activity_feed_q(spark, sf_dir):
    """Newest events with display labels (tool name, short time)."""
    g = Gold(spark, sf_dir)
    log = _log(g).join(g.franchises.select("franchise_id", F.col("name").alias("franchise_name")),
                       "franchise_id", "left")
    return (log.select("event_id", "franchise_name", "result_status",
                       display.tool_label("tool_name").alias("tool_label"),
                       display.time_label("created_at").alias("time_label"))
            .orderBy(F.desc("event_id")).limit(25))


@query("message_text", with_ctes(["message_text"], "SELECT * FROM message_text"))
def message_text_q(spark, sf_dir):
    """Typed content blocks -> text with the reasoning block dropped."""
    conv = Gold(spark, sf_dir).table("conversations")
    blocks = F.to_json(F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("reasoning").alias("type"), F.lit("internal notes").alias("text")),
        F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    return conv.select("conv_id", "turn", display.blocks_text(blocks).alias("message"))


@query("index_refresh", with_ctes(["index_refresh"], "SELECT * FROM index_refresh"))
def index_refresh_q(spark, sf_dir):
    """Articles land in two arrivals (the second re-delivers the first);
    the triggered index refresh holds every article once."""
    from formbook.streaming import index
    a = news.with_article_id(_articles(Gold(spark, sf_dir)))
    root = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    args = dict(source=f"{root}/landing", schema=a.schema, index_path=f"{root}/index",
                checkpoint=f"{root}/_checkpoint")
    a.where(F.col("ingested_on") < F.lit("2024-01-15").cast("date")).write.parquet(f"{root}/landing/arrival=1")
    index.refresh_index(spark, **args)
    a.write.parquet(f"{root}/landing/arrival=2")
    index.refresh_index(spark, **args)
    listed = F.array_join(F.transform("vector", lambda x: F.concat_ws(":", x["term"], x["weight"])), ",")
    return spark.read.parquet(f"{root}/index").select(
        "article_id", "player_key", "url", F.size("vector").cast("bigint").alias("terms"), F.md5(listed).alias("vector_md5"))


@query("bowler_roles", with_ctes(["bowler_roles"], "SELECT * FROM bowler_roles"))
def bowler_roles_q(spark, sf_dir):
    """W4 breakdown: bowlers per role label."""
    bp = Gold(spark, sf_dir, staged=True).bowler_profile
    return bp.groupBy("bowler_type").agg(F.count("*").alias("bowlers"))


@query("top_activity", with_ctes(["top_activity"], "SELECT * FROM top_activity"))
def top_activity_q(spark, sf_dir):
    """O1: the most active recent batters (shortlist lens 1)."""
    bp = Gold(spark, sf_dir, staged=True).batter_profile
    return (bp.select("batter_key", "player_name", "recent_innings")
            .orderBy(F.desc("recent_innings"), "batter_key").limit(100))


@query("top_quality", with_ctes(["top_quality"], "SELECT * FROM top_quality"))
def top_quality_q(spark, sf_dir):
    """O2: best regressed economy with a 60-ball recent sample (lens 2)."""
    bp = Gold(spark, sf_dir, staged=True).bowler_profile
    return (bp.where(F.col("recent_balls_bowled") >= 60)
            .select("bowler_key", "player_name", "recent_balls_bowled", "regressed_economy")
            .orderBy("regressed_economy", "bowler_key").limit(75))


@query("quality_report", with_ctes(["quality_report"], "SELECT * FROM quality_report"))
def quality_report_q(spark, sf_dir):
    """The data-quality gates as one long table (check, subject, value)."""
    gates = ["matches", "deliveries", "avg_deliveries_per_match", "batter_id_coverage_pct"]
    summary = ball_summary(spark, sf_dir).select(
        F.col("competition").alias("subject"), *[F.col(g).cast("double").alias(g) for g in gates])
    kinds = kind_histogram_q(spark, sf_dir).select(
        F.lit("dismissal_kind").alias("check_name"), F.col("dismissal_kind").alias("subject"),
        F.col("dismissals").cast("double").alias("value"))
    return kinds.unionByName(summary.unpivot("subject", gates, "check_name", "value"))


@query("squad_counts", with_ctes(["franchises", "roster"], """
  SELECT f.franchise_id, f.name, count(*) AS squad_size
  FROM franchises f JOIN roster r ON r.franchise_id = f.franchise_id AND r.status = 'active' GROUP BY 1, 2"""))
def squad_counts_q(spark, sf_dir):
    """J15 + S15: active players of the teams that have any, over temporary views."""
    g = Gold(spark, sf_dir)
    g.franchises.createOrReplaceTempView("formbook_franchises")
    league.active_roster(g.roster).createOrReplaceTempView("formbook_active_roster")
    return spark.sql("""SELECT f.franchise_id, f.name, count(*) AS squad_size
                        FROM formbook_franchises f JOIN formbook_active_roster r USING (franchise_id)
                        GROUP BY f.franchise_id, f.name""")


@query("auction_targets_filtered", with_ctes(["targets_filtered"], "SELECT * FROM targets_filtered"))
def auction_targets_filtered_q(spark, sf_dir):
    """B5 with its optional filters (P26): overseas bowlers."""
    g = Gold(spark, sf_dir, staged=True)
    return league.auction_targets(g.pool, g.roster, g.batter_profile, g.bowler_profile, role="Bowler ", overseas=True)


@query("franchise_squads", with_ctes(["franchises", "roster"], """
  SELECT q.query, f.franchise_id, r.roster_id, r.player_name, r.role, r.bowling_style, r.is_overseas, r.price_cr
  FROM (SELECT DISTINCT c_mktsegment AS query FROM customer UNION SELECT DISTINCT n_name FROM nation) q
  JOIN franchises f ON lower(f.name) = lower(q.query)
  JOIN roster r ON r.franchise_id = f.franchise_id AND r.status = 'active'"""))
def franchise_squads_q(spark, sf_dir):
    """B2: the squads behind the status of each asked team."""
    g = Gold(spark, sf_dir)
    asked = g.table("customer").select(F.col("c_mktsegment").alias("q")).union(
        g.table("nation").select(F.col("n_name").alias("q")))
    return league.franchise_squads(asked, "q", g.franchises, g.roster)


@query("inferred_matches", with_ctes(["silver_matches"], """
  SELECT match_id, competition, start_date, season, venue, team_1, team_2, match_type, num_innings FROM silver_matches"""))
def inferred_matches_q(spark, sf_dir):
    """The match dimension through the inferred scan; fields that no
    document carries are NULL of their declared types."""
    from formbook.sources import silver
    return silver.silver_matches(_bronze(spark, sf_dir, infer_schema=True)).select(
        "match_id", "competition", "start_date", "season", "venue", "team_1", "team_2", "match_type", "num_innings")


@query("competition_ingest", with_ctes(["roundtrip"], """
  SELECT competition, competition <> (SELECT max(competition) FROM roundtrip) AS ok,
         CASE WHEN competition <> (SELECT max(competition) FROM roundtrip) THEN count(DISTINCT match_id) END AS documents,
         CASE WHEN competition = (SELECT max(competition) FROM roundtrip)
              THEN concat('1 malformed and 0 unreadable of ', count(DISTINCT match_id) + 1, ' files') END AS error
  FROM roundtrip GROUP BY competition
  UNION ALL SELECT 'no such league', false, NULL, 'no files'"""))
def competition_ingest_q(spark, sf_dir):
    """One scan and one write; the competition with a cut document and
    the one without files fail alone."""
    from formbook.sources import bronze as br
    g = Gold(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    br.write_documents(br.nested_documents(g.d1), f"{root}/landing")
    competitions = g.d1.select(F.col("competition").alias("competition_code")).distinct()
    cut = competitions.agg(F.max("competition_code").alias("competition")).select(
        "competition", F.lit("0").alias("match_id"), F.lit('{"info": {"season": "2024", "teams": [').alias("value"))
    cut.write.mode("append").partitionBy("competition", "match_id").text(f"{root}/landing")
    config = competitions.unionByName(spark.range(1).select(F.lit("no such league").alias("competition_code"))) \
        .withColumn("is_active", F.lit(True))
    return br.ingest_competitions(spark, f"{root}/landing", config, f"{root}/bronze", r"match_id=([0-9]+)/",
                                  "competition={code}/*/*")


# ------------------------------------------------------------------ T6
from formbook.operators import rolling  # noqa: E402


@query("rolling_batting_form", with_ctes(["rolling_batting"], "SELECT * FROM rolling_batting"))
def rolling_batting_form_q(spark, sf_dir):
    """Form over the last 5 and 10 innings, innings by innings."""
    return rolling.rolling_batting(Gold(spark, sf_dir, staged=True).bat)


@query("bid_trajectory", with_ctes(["bid_trajectory"], "SELECT * FROM bid_trajectory"))
def bid_trajectory_q(spark, sf_dir):
    """How the bids for a player develop."""
    return rolling.bid_trajectory(Gold(spark, sf_dir).bids)


@query("purse_burn_down", with_ctes(["purse_burn_down"], "SELECT * FROM purse_burn_down"))
def purse_burn_down_q(spark, sf_dir):
    """Purses over the purchases of an auction."""
    g = Gold(spark, sf_dir)
    return rolling.purse_burn_down(ledger.run_bid_ledger(spark, bids.bid_context(g.bids, g.franchises, g.pool, g.roster)))
