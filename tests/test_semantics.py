"""Hand-written micro-frames for the semantics that must not be lost."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from formbook.functions.exprs import credited_wickets, nan_to_default
from formbook.operators import enrich, form, innings, profiles
from formbook.operators.measures import BATTING

WK = "array<struct<kind:string,player_out:string,fielders:array<struct<name:string,substitute:boolean>>>>"


def ball(match="1", inn=1, over=0, seq=0, batter="A Bat", bowler="B Bowl", rb=0, wides=0, noballs=0, byes=0,
         legbyes=0, penalty=0, nb=False, wickets=None, pp="mandatory", target=None, comp="IPL", bid="rA",
         wid="rB", team="T1"):
    extras = wides + noballs + byes + legbyes + penalty
    return Row(match_id=match, competition=comp, innings_seq=inn, batting_team=team, over_number=over,
               delivery_seq=seq, actual_delivery=f"{over}.{seq + 1}", batter=batter, batter_id=bid,
               bowler=bowler, bowler_id=wid, runs_batter=rb, runs_extras=extras, runs_total=rb + extras,
               non_boundary=nb, extras_byes=byes, extras_legbyes=legbyes, extras_noballs=noballs,
               extras_penalty=penalty, extras_wides=wides, is_wicket=bool(wickets), wickets=wickets,
               innings_target_runs=target, is_super_over=False, powerplay_type=pp)


SCHEMA = ("match_id string, competition string, innings_seq long, batting_team string, over_number long, "
          "delivery_seq long, actual_delivery string, batter string, batter_id string, bowler string, "
          "bowler_id string, runs_batter long, runs_extras long, runs_total long, non_boundary boolean, "
          "extras_byes long, extras_legbyes long, extras_noballs long, extras_penalty long, extras_wides long, "
          f"is_wicket boolean, wickets {WK}, innings_target_runs long, is_super_over boolean, powerplay_type string")


def matches(spark, match="1", mtype="T20", by_runs=None, by_wkts=None, stage=None):
    return spark.createDataFrame(
        [Row(match_id=match, season="2024", start_date="2024-01-01", venue="V", match_type=mtype, team_type="club",
             team_1="T1", team_2="T2", outcome_by_runs=by_runs, outcome_by_wickets=by_wkts, event_stage=stage)],
        "match_id string, season string, start_date string, venue string, match_type string, team_type string, "
        "team_1 string, team_2 string, outcome_by_runs long, outcome_by_wickets long, event_stage string")


def test_legal_ball_and_conceded(spark):
    balls = [ball(seq=0, wides=1), ball(seq=1, noballs=1, rb=4), ball(seq=2, byes=2), ball(seq=3, legbyes=1),
             ball(seq=4, penalty=5), ball(seq=5, rb=1)]
    d = spark.createDataFrame(balls, SCHEMA)
    en = enrich.enrich_deliveries(d, matches(spark))
    bat = innings.batting_innings(en).first()
    bowl = innings.bowling_innings(en).first()
    assert bat.balls_faced == 4            # wide and no-ball are not legal
    assert bat.runs == 5
    assert bowl.balls_bowled == 4
    assert bowl.runs_conceded == 1 + (1 + 4) + 1  # wide + (no-ball + 4 off the bat) + 1; byes, leg-byes, penalty excluded
    assert bowl.wides == 1 and bowl.noballs == 1


def test_two_wickets_one_run_out_credits_one(spark):
    wk = [Row(kind="caught", player_out="A Bat", fielders=None), Row(kind="run out", player_out="C", fielders=None)]
    d = spark.createDataFrame([ball(wickets=wk)], SCHEMA)
    assert d.select(credited_wickets().alias("n")).first().n == 1


def test_dismissal_dedupe_keeps_last(spark):
    rh = [Row(kind="retired hurt", player_out="A Bat", fielders=None)]
    out = [Row(kind="bowled", player_out="A Bat", fielders=None)]
    d = spark.createDataFrame([ball(over=1, seq=0, wickets=rh), ball(over=5, seq=2, wickets=out)], SCHEMA)
    rows = innings.dismissals(d).collect()
    assert len(rows) == 1 and rows[0].dismissal_kind == "bowled"


def test_batting_facts_equal_a_join_with_dismissals(spark):
    """Wickets in the roll-up give what facts joined with the last wicket of
    each name give: also for one out at the other end, one who faced nothing,
    a name with two ids, a nameless wicket and two wickets on a ball."""
    def out(*pairs):
        return [Row(kind=k, player_out=p, fielders=None) for k, p in pairs]
    d = spark.createDataFrame([
        ball(over=0, seq=0, batter="A", bid="r1", rb=4),
        ball(over=0, seq=1, batter="A", bid="r2", rb=1, wickets=out(("run out", "B"), ("bowled", "A"))),
        ball(over=1, seq=0, batter="B", bid=None, rb=2),
        ball(over=1, seq=1, batter="C", bid="r3", wickets=out(("run out", "never faced"), ("caught", None))),
        ball(over=2, seq=0, batter="C", bid="r3", wickets=out(("retired hurt", "A"), ("caught", "A"), (None, "C"))),
        ball(inn=2, over=0, seq=0, batter="A", bid="r1", rb=6)], SCHEMA)
    en = enrich.enrich_deliveries(d, matches(spark))
    got = innings.batting_innings(en)
    ended = innings.dismissals(en).withColumnRenamed("player_out", "batter")
    want = (innings.innings_facts(en, BATTING).join(ended, ["match_id", "innings_seq", "batter"], "left")
            .withColumn("is_out", F.col("dismissal_kind").isNotNull()).select(*got.columns))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {(r.innings_seq, r.batter_id, r.runs): r.dismissal_kind for r in got.collect()} == {
        (1, "r1", 4): "retired hurt", (1, "r2", 1): "retired hurt", (1, None, 2): "run out", (1, "r3", 0): None,
        (2, "r1", 6): None}


def test_death_threshold_by_innings_length_and_test(spark):
    def phase_of(n_overs, mtype):
        d = spark.createDataFrame([ball(over=o, pp=None) for o in range(n_overs)], SCHEMA)
        en = enrich.enrich_deliveries(d, matches(spark, mtype=mtype))
        return {r.over_number: (r.phase, r.death_over_threshold) for r in en.collect()}
    p12 = phase_of(12, "T20")
    assert p12[7] == ("middle", 8) and p12[8] == ("death", 8)
    p20 = phase_of(20, "T20")
    assert p20[15][0] == "middle" and p20[16][0] == "death"
    p50 = phase_of(50, "ODI")
    assert p50[39][0] == "middle" and p50[40] == ("death", 40)
    pt = phase_of(3, "Test")
    assert all(v == (None, None) for v in pt.values())


def test_powerplay_from_actual_delivery_and_fallback(spark):
    from formbook.sources import silver
    doc = spark.createDataFrame(
        [Row(match_id="9", competition="IPL", player_registry={"A": "r1"}, innings=[Row(
            team="T1", powerplays=[Row(**{"from": 0.1, "to": 5.6, "type": "mandatory"})], target=None,
            super_over=None, declared=None, forfeited=None,
            overs=[Row(over=0, deliveries=[Row(actual_delivery=None, batter="A", bowler="B", non_striker=None,
                                               extras=None, runs=Row(batter=1, extras=0, total=1, non_boundary=None),
                                               wickets=None, review=None, replacements=None)])])])],
        "match_id string, competition string, player_registry map<string,string>, innings array<struct<"
        "team:string, powerplays:array<struct<from:double,to:double,type:string>>, "
        "target:struct<overs:double,runs:long>, super_over:boolean, declared:boolean, forfeited:boolean, "
        "overs:array<struct<over:long, deliveries:array<struct<actual_delivery:string, batter:string, "
        "bowler:string, non_striker:string, extras:struct<byes:long,legbyes:long,noballs:long,penalty:long,"
        "wides:long>, runs:struct<batter:long,extras:long,total:long,non_boundary:boolean>, wickets:" + WK + ", "
        "review:struct<batter:string>, replacements:struct<match:array<string>>>>>>>>")
    r = silver.silver_deliveries(doc).first()
    assert r.powerplay_type is None and r.batter_id == "r1" and r.bowler_id is None and r.non_boundary is False
    r2 = silver.silver_deliveries(doc, ordinal_fallback=True).first()
    assert r2.powerplay_type == "mandatory"


def test_non_boundary_not_counted(spark):
    d = spark.createDataFrame([ball(rb=4, nb=True), ball(seq=1, rb=6)], SCHEMA)
    b = innings.batting_innings(enrich.enrich_deliveries(d, matches(spark))).first()
    assert b.fours == 0 and b.sixes == 1


def test_never_out_average_null_and_situational_flags(spark):
    d = spark.createDataFrame([ball(seq=i, rb=1, target=150) for i in range(6)], SCHEMA)
    en = enrich.enrich_deliveries(d, matches(spark, by_runs=10))
    bat = innings.batting_innings(en)
    s = form.summarize(bat, BATTING).first()
    assert s.average is None and s.dismissals == 0 and s.not_out_pct == 100.0
    row = bat.first()
    assert row.is_chase and row.is_close_match and not row.is_knockout


def test_close_match_boundaries(spark):
    def close(runs, wkts):
        d = spark.createDataFrame([ball()], SCHEMA)
        return enrich.enrich_deliveries(d, matches(spark, by_runs=runs, by_wkts=wkts)).first().is_close_match
    assert close(10, None) and not close(11, None) and close(None, 2) and not close(None, 3)
    assert close(None, None) is False


def test_percent_rank_exact_matches_window(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(7)
    vals = [(i, None if rnd.random() < 0.3 else round(rnd.uniform(5, 10), 2)) for i in range(300)]
    df = spark.createDataFrame(vals, "id long, v double")
    ours = profiles.percent_rank_exact(df, "v", "p").select("id", "p")
    ref = df.select("id", F.round(F.percent_rank().over(Window.orderBy(F.col("v").asc_nulls_first())), 3).alias("p"))
    assert sorted(ours.collect()) == sorted(ref.collect())


def test_bowler_type_null_for_zero_wickets(spark):
    df = spark.createDataFrame([(0, 0.9, 0.1), (3, 0.9, 0.1), (3, 0.1, 0.9), (3, 0.5, 0.5)],
                               "recent_wickets long, economy_percentile double, strike_rate_percentile double")
    got = [r.t for r in df.select(profiles.bowler_type().alias("t")).collect()]
    assert got == [None, "strike bowler", "containment bowler", "balanced"]


def test_nan_vs_null_default(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.5,)], "x double")
    assert [r.y for r in df.select(nan_to_default("x", 0.0).alias("y")).collect()] == [0.0, 0.0, 2.5]
    assert not math.isnan(0.0)


def test_shrinkage_between_raw_and_prior(spark):
    rows = [("k1", "P1", "m1", 1, "IPL", "2024-01-01", 100, 50, 0, 0, 0, 0, 0, 0, True),
            ("k2", "P2", "m1", 1, "IPL", "2024-01-01", 30, 60, 0, 0, 0, 0, 0, 0, True)]
    bat = spark.createDataFrame(rows, "batter_key string, batter string, match_id string, innings_seq long, "
                                      "competition string, match_date string, runs long, balls_faced long, "
                                      "fours long, sixes long, pp_runs long, pp_balls long, death_runs long, "
                                      "death_balls long, is_out boolean")
    out = {r.batter_key: r for r in form.t20(bat, BATTING, floor=1).collect()}
    prior = 130 / 110 * 100
    for r in out.values():
        lo, hi = sorted([r.strike_rate, prior])
        assert lo - 0.01 <= r.regressed_strike_rate <= hi + 0.01


def test_empty_inputs(spark):
    d = spark.createDataFrame([], SCHEMA)
    en = enrich.enrich_deliveries(d, matches(spark))
    assert innings.batting_innings(en).count() == 0
    assert innings.bowling_innings(en).count() == 0
    assert form.recent(innings.batting_innings(en), BATTING).count() == 0
