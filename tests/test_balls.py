"""The ball view and the tables written from it: one sort, one exchange, few files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from formbook.operators import enrich, innings
from formbook.plans.gold import Gold
from formbook.sources import fixtures as fx

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_rows(n=960):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 241 == 0 else day + dt.timedelta(hours=i), None if i % 121 == 0 else rng.randrange(50),
             rng.choice(("click", "signup", "error", "view")), rng.random() * 100, "{}") for i in range(n)]
    rng.shuffle(rows)
    return rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def without_broadcast(spark, f):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return f()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_events_name_bowler_keeper_and_date(spark):
    rows = event_rows()
    got = {(r.match_id, r.innings_seq, r.over_number, r.delivery_seq): (r.match_date, r.bowler_id, r.fielder_id)
           for r in fx.deliveries(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    by_id = {r[0]: r for r in rows}

    def pid(i):
        u = by_id[i][2]
        if u is None:
            return None
        u = u % 4 if u % 3 == 0 else u
        return None if u % 37 == 0 else f"r{u}"

    assert len(got) == len(rows)
    for i in by_id:
        ts = by_id[i - i % 240][1]
        key = (f"1{i // 240:06d}", i % 240 // 120 + 1, i % 120 // 6, i % 6)
        assert got[key] == (ts and ts.date().isoformat(), pid(i - i % 6), pid(i - i % 120)), key


def test_enriched_balls_are_sorted_once(spark):
    """The wide rows are not sorted: one sort of the narrow balls, one of the matches."""
    e = spark.createDataFrame(event_rows(), SCHEMA)
    text = without_broadcast(spark, lambda: plan(enrich.enrich_deliveries(
        fx.silver_deliveries(fx.deliveries(e)), fx.matches_from_events(e))))
    assert "SortMergeJoin" in text and text.count("Sort [") == 2, text


def test_staged_balls_follow_the_input_not_the_session(spark, tmp_dir):
    """Small input, a session of many shuffle partitions: no file a partition and competition."""
    spark.createDataFrame(event_rows(), SCHEMA).coalesce(1).write.parquet(f"{tmp_dir}/events.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        g = Gold(spark, tmp_dir, staged=True)
        assert g.d1.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        text = plan(innings.batting_innings(g.by_match))
        assert text.count("Exchange") == 1, text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lazy = Gold(spark, tmp_dir).bat
    assert g.bat.select(lazy.columns).exceptAll(lazy).count() == 0 and g.bat.count() == lazy.count() > 0
    assert g.bat.where(F.col("match_id").isNull()).count() == 0


def test_readers_of_staged_balls_move_no_ball(spark, tmp_dir):
    """Staged balls and facts stay dealt by match: what is rolled up, ranked
    or joined within a match has no exchange, and a small input few files."""
    rows = event_rows() + [(None, None, 7, "signup", 5.0, "{}"), (5, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_dir}/events.parquet")
    g, lazy = Gold(spark, tmp_dir, staged=True), Gold(spark, tmp_dir)
    assert g.enriched.select(lazy.enriched.columns).exceptAll(lazy.enriched).count() == 0
    assert g.enriched.count() == lazy.enriched.count() == len(rows)
    for one_match in (innings.batting_innings(g.enriched), innings.bowling_innings(g.enriched), g.positions,
                      g.balls.groupBy("match_id", "innings_seq").count(), g.registry,
                      without_broadcast(spark, lambda: g.balls.select("match_id").join(g.registry, "match_id"))):
        text = without_broadcast(spark, lambda: plan(one_match))
        assert "Exchange" not in text, text
    # players are summed over matches: one exchange, of what each match adds
    assert plan(g.bat.groupBy("batter_key").agg(F.count_distinct("match_id", "innings_seq"))).count("Exchange") == 1
    for got, want in ((g.bat, lazy.bat), (g.bowl, lazy.bowl), (g.positions, lazy.positions), (g.keeper, lazy.keeper)):
        got = got.select(want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


def test_staged_tables_are_read_when_the_catalog_lost_them(spark, tmp_dir):
    spark.createDataFrame(event_rows(), SCHEMA).coalesce(1).write.parquet(f"{tmp_dir}/events.parquet")
    first = Gold(spark, tmp_dir, staged=True).bat
    rows = {tuple(r) for r in first.collect()}
    for table in spark.catalog.listTables():
        if table.name.startswith("formbook_batting_innings_"):
            spark.sql(f"DROP TABLE {table.name}")  # external: its files stay
    assert {tuple(r) for r in Gold(spark, tmp_dir, staged=True).bat.select(first.columns).collect()} == rows
