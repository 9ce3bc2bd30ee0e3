"""Names, search, league, bids, ledger, sync and table maintenance on
small literal frames, each against a brute-force statement."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from formbook.operators import audit, bids, names, textsearch
from formbook.sources import tables as T
from formbook.streaming import ledger, sync


def test_resolve_names_tiers(spark):
    prof = spark.createDataFrame(
        [("k1", "JJ Bumrah"), ("k2", "R Sharma"), ("k3", "S Sharma"), ("k4", "SD Hope"), ("k5", "SK Hope")],
        "batter_key string, player_name string")
    q = spark.createDataFrame(
        [(1, "jj bumrah"), (2, "Jasprit Bumrah"), (3, "Rohit Sharma"), (4, "Shai Hope"), (5, "Hope"),
         (6, "  "), (7, "Unknown Person")], "id long, name string")
    got = {r.id: (r.matched_key, r.match_tier)
           for r in names.resolve_names(q, "name", prof, key_col="batter_key").collect()}
    assert got[1] == ("k1", "exact")
    assert got[2] == ("k1", "surname")            # unique surname, initial not needed
    assert got[3] == ("k2", "surname_initial")    # Sharma ambiguous, R unique
    assert got[4] == (None, None)                 # Hope + S still ambiguous -> NULL
    assert got[5] == (None, None)
    assert got[6] == (None, None)                 # blank
    assert got[7] == (None, None)


def test_search_names_tiers_and_cap(spark):
    prof = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(
        ["JJ Bumrah", "R Sharma", "S Sharma", "RG Sharma", "AB de Villiers", "V Kohli"])],
        "batter_key string, player_name string")
    q = spark.createDataFrame([(1, "sharma"), (2, "Rohit Sharma"), (3, "Virat Kohli"), (4, "nobody here")],
                              "id long, term string")
    res = names.search_names(q, "term", "id", prof, key_col="batter_key", max_matches=2).collect()
    by = {}
    for r in res:
        by.setdefault(r.id, []).append((r.match_rank, r.player_name, r.match_tier))
    assert [x[1] for x in sorted(by[1])] == ["R Sharma", "RG Sharma"]   # substring, capped at 2
    assert {x[2] for x in by[2]} == {"surname_initial"} and len(by[2]) == 2
    assert by[3] == [(1, "V Kohli", "surname_initial")]
    assert 4 not in by


def test_substring_join_matches_brute_force(spark):
    rnd = random.Random(3)
    alphabet = "abcde "
    texts = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    pats = [(j, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5)))) for j in range(60)]
    t = spark.createDataFrame(texts, "tid long, txt string")
    p = spark.createDataFrame(pats, "pid long, pat string")
    got = {(r.pid, r.tid) for r in textsearch.substring_join(p, "pat", ["pid"], t, "txt", ["tid"]).collect()}
    want = {(j, i) for j, pat in pats for i, txt in texts if pat.lower() in txt.lower()}
    assert got == want


def test_substring_join_with_a_shared_part(spark):
    """A third of the patterns are one text, most share a part; small blocks
    on both sides; plan without a gram or pattern key."""
    rnd = random.Random(2)
    pats = [(i, "Surname") for i in range(40)] + [(100 + i, f"rname{i % 30}") for i in range(60)]
    pats += [(200, ""), (201, None), (202, "É"), (203, "x" * 300), (204, " s")]
    txts = [(i, rnd.choice(["", "A ", "é"]) + f"Surname{rnd.randint(0, 99)}" + rnd.choice(["", "X" * 400])) for i in range(150)]
    txts += [(900, None), (901, ""), (7, "surname7 again")]
    p = spark.createDataFrame(pats, "pid long, pat string").repartition(3)
    t = spark.createDataFrame(txts, "tid long, txt string").repartition(5)
    want = sorted((a, b) for a, x in pats for b, y in txts if x and y and x.lower() in y.lower())
    for sizes in ({}, {"pattern_bytes": 64, "text_bytes": 200}):
        out = textsearch.substring_join(p, "pat", ["pid"], t, "txt", ["tid"], **sizes)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 6000
        exchanges = [ln for ln in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in ln]
        assert all("_pat" not in ln and "_txt" not in ln for ln in exchanges)
    few = textsearch.substring_join(p, "pat", ["pid"], t, "txt", ["tid"], first=3, pattern_bytes=64, text_bytes=200)
    got = {}
    for a, b in map(tuple, few.collect()):
        got.setdefault(a, set()).add(b)
    for a, x in pats:
        best = sorted((y, b) for b, y in txts if x and y and x.lower() in y.lower())[:3]
        assert {b for _, b in best} <= got.get(a, set())
    none = textsearch.substring_join(p.limit(0), "pat", ["pid"], t, "txt", ["tid"])
    assert none.count() == 0 and none.columns == ["pid", "tid"]


def test_top_k_matches_row_number(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b"]), i, rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    got = textsearch.top_k(df, ["g"], [F.desc("v"), "id"], 5, salt_buckets=4).select("g", "id")
    w = Window.partitionBy("g").orderBy(F.desc("v"), "id")
    want = df.withColumn("r", F.row_number().over(w)).where("r <= 5").select("g", "id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_running_count_matches_row_number(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 20)) for i in range(400)]       # many ties on the timestamp
    df = spark.createDataFrame(rows, "event_id long, created_at long")
    got = audit.running_count(df, "created_at", "event_id", partitions=5).select("event_id", "running_count")
    want = df.select("event_id", F.row_number().over(Window.orderBy("created_at", "event_id")).alias("running_count"))
    assert sorted(got.collect()) == sorted(want.collect())


def _league(spark):
    fr = spark.createDataFrame([(1, "Alpha", 10.0, 3, 2), (2, "Beta", 100.0, 25, 8)],
                               "franchise_id long, name string, purse_remaining_cr double, max_squad_size int, "
                               "max_overseas int")
    pool = spark.createDataFrame([(10, "P Owned", True, 100.0, "batter"), (11, "P Free", True, 50.0, "bowler"),
                                  (12, "P Local", False, 50.0, "batter")],
                                 "pool_id long, player_name string, is_overseas boolean, base_price_lakh double, "
                                 "role string")
    roster = spark.createDataFrame([(1, "p owned", True, "active"), (1, "X", False, "active")],
                                   "franchise_id long, player_name string, is_overseas boolean, status string")
    return fr, pool, roster


def test_bid_breaking_all_five_rules(spark):
    fr, pool, roster = _league(spark)
    fr = fr.withColumn("max_squad_size", F.lit(2)).withColumn("max_overseas", F.lit(1))
    b = spark.createDataFrame([(1, 0, 1, 10, 20.0), (2, 0, 9, 10, 1.0), (3, 0, 1, 99, 1.0)],
                              "bid_id long, auction_id long, franchise_id long, pool_id long, price_cr double")
    out = {r.bid_id: r.result_status for r in bids.validate_bids(b, fr, pool, roster).collect()}
    # owned, over purse (20 > 10), squad full (2 >= 2), overseas cap (1 >= 1)... price 20 >= base 1.0
    assert out[1] == ("blocked: already on an active roster; bid exceeds remaining purse; squad at max size; "
                      "overseas cap reached")
    assert out[2] == "blocked: unknown franchise"
    assert out[3] == "blocked: unknown player"
    b2 = spark.createDataFrame([(4, 0, 1, 10, 0.5)], "bid_id long, auction_id long, franchise_id long, "
                                                     "pool_id long, price_cr double")
    poor = fr.withColumn("purse_remaining_cr", F.lit(0.2))   # purse 0.2 < price 0.5 < base 1.0
    r = bids.validate_bids(b2, poor, pool, roster).first()
    assert r.result_status == ("blocked: already on an active roster; bid exceeds remaining purse; "
                               "squad at max size; overseas cap reached; bid below base price")


def test_ledger_is_sequential(spark, tmp_dir):
    fr, pool, roster = _league(spark)
    b = spark.createDataFrame(
        [(1, 0, 1, 11, 6.0), (2, 0, 2, 11, 6.0), (3, 0, 1, 12, 6.0), (4, 1, 2, 11, 6.0)],
        "bid_id long, auction_id long, franchise_id long, pool_id long, price_cr double")
    ctx = bids.bid_context(b, fr, pool, roster)
    led = {r.bid_id: r for r in ledger.run_bid_ledger(spark, ctx, work_dir=tmp_dir, rows_per_file=2).collect()}
    assert led[1].accepted and led[1].purse_after_cr == 4.0      # Alpha: squad 2 -> 3, purse 10 -> 4
    assert led[2].result_status == "blocked: already on an active roster"   # bought by Alpha earlier
    assert not led[3].accepted and "squad at max size" in led[3].result_status
    assert "bid exceeds remaining purse" in led[3].result_status
    assert led[4].accepted                                        # another auction, independent state


def test_sync_is_idempotent(spark, tmp_dir):
    src = f"{tmp_dir}/landing"
    schema = "event_id long, payload string"
    args = dict(source=src, target=f"{tmp_dir}/t", watermark=f"{tmp_dir}/w", checkpoint=f"{tmp_dir}/c")
    spark.createDataFrame([(i, "x") for i in range(1, 6)], schema).write.parquet(f"{src}/arrival=1")
    df_schema = spark.read.parquet(f"{src}/arrival=1").schema
    sync.sync_change_log(spark, schema=df_schema, **args)
    spark.createDataFrame([(i, "y") for i in range(4, 9)], schema).write.parquet(f"{src}/arrival=2")  # overlap 4,5
    sync.sync_change_log(spark, schema=df_schema, **args)
    sync.sync_change_log(spark, schema=df_schema, **args)
    tgt = spark.read.parquet(args["target"])
    assert tgt.count() == 8 and tgt.select("event_id").distinct().count() == 8
    assert sync.read_watermark(spark, args["watermark"]) == 8


def test_upsert_idempotent_and_versions(spark, tmp_dir):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    once = T.upsert(t, s, ["k"])
    twice = T.upsert(once, s, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "B"), (3, "c")]
    vt = T.VersionedTable(spark, f"{tmp_dir}/tbl")
    vt.commit(t)
    vt.commit(T.upsert(vt.read(), s, ["k"]))
    assert vt.versions() == [1, 2] and vt.read(1).count() == 2 and vt.read().count() == 3


def test_replace_one_partition_and_flip_and_backfill(spark, tmp_dir):
    path = f"{tmp_dir}/p"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "part long, v string")
    T.write_counted(df, path, partition_by=["part"])
    T.replace_partition(spark.createDataFrame([(1, "z")], "part long, v string"), path, "part")
    assert sorted(spark.read.parquet(path).select("v", "part").collect()) == [("c", 2), ("z", 1)]
    T.replace_partition(df.where("part = 1"), path, "part", values=[1, 2])  # nothing replaces 2
    assert sorted(spark.read.parquet(path).select("v", "part").collect()) == [("a", 1), ("b", 1)]
    T.replace_partition(df.where("false"), path, "part", values=[2])
    assert spark.read.parquet(path).count() == 2
    rules = spark.createDataFrame([(1, True)], "rule_version long, is_current boolean")
    flipped = T.flip_current(rules, spark.createDataFrame([(2,)], "rule_version long"))
    assert sorted(flipped.collect()) == [(1, False), (2, True)]
    a = spark.createDataFrame([("x", None), ("y", "keep")], "u string, id string")
    filled = T.backfill_key(a, "id", F.concat(F.lit("h-"), F.col("u")))
    assert sorted(filled.collect()) == [("x", "h-x"), ("y", "keep")]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k long, v string")
    got = sorted((r.k, r.change_type, r.v) for r in T.snapshot_diff(old, new, ["k"]).collect())
    assert got == [(2, "update", "B"), (3, "delete", "c"), (4, "insert", "d")]


def test_not_null_enforced_and_display(spark, tmp_dir):
    from formbook.functions import display
    ok = spark.createDataFrame([(1, "a")], "k long, v string")
    assert T.with_not_null(ok, ["k", "v"]).count() == 1
    bad = spark.createDataFrame([(1, None)], "k long, v string")
    with pytest.raises(Exception):
        T.with_not_null(bad, ["v"]).write.mode("overwrite").parquet(f"{tmp_dir}/nn")
    df = spark.createDataFrame([("get_player_form_profile", None), ("x_y", 2.25)], "t string, x double")
    got = df.select(display.tool_label("t").alias("l"), display.fmt_num("x", 1).alias("n")).collect()
    assert [tuple(r) for r in got] == [("Get Player Form Profile", "—"), ("X Y", "2.3")]


def test_inferred_and_declared_scan_agree_on_ids(spark, tmp_dir):
    import json
    import os
    from formbook.sources import bronze
    os.makedirs(f"{tmp_dir}/IPL")
    doc = {"info": {"dates": ["2024-01-01"], "teams": ["A", "B"], "extra_field": 1},
           "innings": [{"team": "A", "overs": [{"over": 0, "deliveries": [
               {"batter": "x", "bowler": "y", "runs": {"batter": 1, "extras": 0, "total": 1}}]}]}]}
    with open(f"{tmp_dir}/IPL/123.json", "w") as fh:
        json.dump(doc, fh, indent=2)
    declared = bronze.read_match_documents(spark, f"{tmp_dir}/IPL/*.json", "IPL").first()
    inferred = bronze.read_match_documents(spark, f"{tmp_dir}/IPL/*.json", "IPL", infer_schema=True).first()
    assert declared.match_id == inferred.match_id == "123"
    assert declared.overs_per_innings is None and declared.event is None     # absent optional fields
    assert "extra_field" not in str(spark.read.schema(bronze.MATCH_SCHEMA).option("multiLine", True)
                                    .json(f"{tmp_dir}/IPL/*.json").schema)  # undeclared field dropped


def test_hot_surname_resolution_is_exact_and_row_preserving(spark):
    """A third of all profile rows share one surname; resolution must stay
    exact (ambiguous -> NULL, unique initial -> match) and never multiply
    the queried rows."""
    n = 300
    prof = [(f"k{i}", f"{chr(65 + i % 26)}{i} Hot") for i in range(n // 3)] + \
           [(f"c{i}", f"Z Cold{i}") for i in range(2 * n // 3)]
    p = spark.createDataFrame(prof, "batter_key string, player_name string")
    q = spark.createDataFrame([(i, "Q Hot") for i in range(50)] + [(100 + i, f"Zed Cold{i}") for i in range(50)]
                              + [(200, "A0 Hot")], "id long, name string")
    out = names.resolve_names(q, "name", p, key_col="batter_key")
    rows = {r.id: (r.matched_key, r.match_tier) for r in out.collect()}
    assert out.count() == q.count() == len(rows)
    assert all(rows[i] == (None, None) for i in range(50))          # 'Hot' + 'q': no unique candidate
    assert all(rows[100 + i] == (f"c{i}", "surname") for i in range(50))
    assert rows[200] == ("k0", "exact")


def test_hot_surname_is_dealt_over_tasks(spark):
    profiles = spark.createDataFrame([("k1", "Al Hot"), ("k2", "Bo Hot"), ("k3", "Cy Rare")],
                                     "batter_key string, player_name string")
    rows = spark.createDataFrame([(i, "Alan Hot" if i % 3 else "Cy Rare") for i in range(3000)], "i long, name string")
    salts = names.salted(rows).groupBy("_salt").count().collect()
    assert len(salts) == names.SALTS and max(r["count"] for r in salts) < 300
    got = names.resolve_names(rows, "name", profiles)
    assert got.columns == ["i", "name", "matched_key", "match_tier"] and got.count() == 3000
    assert {(r.name, r.matched_key) for r in got.collect()} == {("Alan Hot", "k1"), ("Cy Rare", "k3")}


def test_article_search_equals_brute_force(spark):
    import math
    import re
    from collections import Counter

    from formbook.operators import news
    pages = [("r1", "u1", "<title>Injury news</title><p>knee injury rules him out</p>"),
             ("r1", "u2", "<title>Form</title><p>runs and more runs</p>"),
             ("r2", "u3", "<title>Transfer</title><script>injury injury</script><p>moves to a new club</p>"),
             ("r2", "u4", None), ("r3", "u5", "<p>knee brace, no title, long injury</p>"), ("r1", "u1", "<title>old</title>")]
    a = spark.createDataFrame([(p, u, c, 0.5, 2 if i < 5 else 1) for i, (p, u, c) in enumerate(pages)],
                              "player_key string, url string, content string, score double, ingested_on int")
    asked = spark.createDataFrame([(1, "r1: knee injury"), (2, "r2: new club"), (3, None)], "q long, text string")

    def tokens(x):
        return [t for t in re.split(r"\W+", x.lower()) if t]

    texts = {u: tokens(f"{p} " + re.sub(r"<script>.*?</script>|<[^>]*>", " ", c or "")) for p, u, c in pages[:5]}
    df = Counter(t for ts in texts.values() for t in set(ts))

    def vector(ts):
        v = {t: n * math.log(6 / (df[t] + 1)) for t, n in Counter(ts).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    got = news.search_articles(a, asked, "q", "text", k=2).collect()
    assert len(got) == 4 and {r.title for r in got if r.url == "u1"} <= {"Injury news"}  # a null question has no answer
    for q, text in ((1, "r1: knee injury"), (2, "r2: new club")):
        ask = vector([t for t in tokens(text)])
        want = sorted((sum(x * ask.get(t, 0) for t, x in vector(ts).items()) for ts in texts.values()), reverse=True)[:2]
        found = [r.score for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])]
        assert found == pytest.approx(want, abs=2e-5)  # scores add up whole millionths


def test_a_bad_competition_fails_alone(spark, tmp_dir):
    import os

    from formbook.sources import bronze
    for code, name, body in (("a", "1.json", b'{"info": {"season": "2024"}, "innings": []}'),
                             ("b", "2.json.gz", b'{"info": {}}')):  # not in gzip format
        os.makedirs(f"{tmp_dir}/in/{code}")
        with open(f"{tmp_dir}/in/{code}/{name}", "wb") as f:
            f.write(body)
    spark.range(3).write.parquet(f"{tmp_dir}/out/competition=b")  # what it held before
    config = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "competition_code string, is_active boolean")
    got = {r.competition: r for r in bronze.ingest_competitions(spark, f"{tmp_dir}/in", config, f"{tmp_dir}/out", folder="{code}/*").collect()}
    assert {c: (r.ok, r.documents) for c, r in got.items()} == {"a": (True, 1), "b": (False, None), "c": (False, None)}
    assert spark.read.parquet(f"{tmp_dir}/out/competition=b").count() == 3
    assert got["b"].error and [r.match_id for r in spark.read.parquet(f"{tmp_dir}/out/competition=a").collect()] == ["1"]


def test_nested_retention_and_venue_keywords(spark):
    from formbook.operators import league
    flat = spark.sql("""SELECT 1L AS franchise_id, 'X' AS franchise_name, 'V' AS home_venue, 'p' AS player_name,
        'batter' AS role, false AS is_overseas, 3 AS bat_recent_innings, 120.0 AS bat_recent_strike_rate,
        30.0 AS bat_recent_average, CAST(NULL AS INT) AS bowl_recent_innings, CAST(NULL AS DOUBLE) AS bowl_recent_economy,
        CAST(NULL AS INT) AS bowl_recent_wickets, CAST(NULL AS INT) AS venue_bat_innings,
        CAST(NULL AS DOUBLE) AS venue_bat_strike_rate, CAST(NULL AS DOUBLE) AS venue_bat_average,
        CAST(NULL AS INT) AS venue_bowl_innings, CAST(NULL AS DOUBLE) AS venue_bowl_economy,
        CAST(NULL AS INT) AS venue_bowl_wickets""")
    row = league.nest_retention(flat).first()
    assert row.recent_form.batting.innings == 3 and row.recent_form.bowling is None and row.home_venue_form is None
    teams = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "Gamma")], "franchise_id long, name string")
    words = league.venue_keyword_table(teams, {"ALPHA": ("east", "park"), "Beta": ("lake",)})
    assert sorted(map(tuple, words.collect())) == [(1, "east"), (1, "park"), (2, "lake")]


def test_ledger_order_lies_in_the_data(spark, tmp_dir):
    """Files in reverse order, one of them twice: the same ledger as in bid
    order, each bid once; what comes before its turn waits."""
    rnd = random.Random(5)
    fr, pool, roster = _league(spark)
    names = [r.pool_id for r in pool.collect()]
    b = spark.createDataFrame([(i, i % 3, rnd.choice([1, 2, 9]), rnd.choice(names + [99]), rnd.choice([0.1, 1.0, 2.5, 6.0]))
                               for i in range(60)],
                              "bid_id long, auction_id long, franchise_id long, pool_id long, price_cr double")
    ctx = bids.bid_context(b, fr, pool, roster)
    want = sorted(map(tuple, ledger.run_bid_ledger(spark, ctx, work_dir=f"{tmp_dir}/a").collect()))
    assert len(want) == 60 and any(r[6] for r in want)
    schema = ledger.land_bids(ctx, f"{tmp_dir}/all")
    rows = spark.read.schema(schema).parquet(f"{tmp_dir}/all")
    assert sorted((r.auction_id, r.seq) for r in rows.collect()) == [(a, s) for a in range(3) for s in range(1, 21)]
    counts = []
    for lo in (14, 7, 14, 0):  # places 15 to 20, 8 to 14, 15 to 20 again, 1 to 7
        rows.where((F.col("seq") > lo) & (F.col("seq") <= lo + 7)).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        ledger.judge_landed(spark, f"{tmp_dir}/in", schema, f"{tmp_dir}/out", f"{tmp_dir}/c")
        counts.append(spark.read.schema(ledger.LEDGER_SCHEMA).parquet(f"{tmp_dir}/out").count())
    assert counts == [0, 0, 0, 60]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/out").collect())) == want


def test_empty_ledger(spark, tmp_dir):
    fr, pool, roster = _league(spark)
    none = spark.createDataFrame([], "bid_id long, auction_id long, franchise_id long, pool_id long, price_cr double")
    assert ledger.run_bid_ledger(spark, bids.bid_context(none, fr, pool, roster), work_dir=tmp_dir).count() == 0




def test_bids_of_an_auction_lie_together(spark, tmp_dir):
    """An auction is judged in one call, or in a few if it is large: its bids
    land in one file or in two, and places have no gaps over the ranges."""
    from pyspark.sql import functions as F

    from formbook.streaming import ledger
    kinds = dict(c.split() for c in ledger.BID_COLUMNS.split(", ")) | {"auction_id": "long"}
    known = {"bid_id": F.col("id") * 3, "auction_id": F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40)}
    ctx = spark.range(3000).select(*[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items() if c != "seq"])
    ctx = ctx.union(ctx.where("bid_id < 0")).repartition(9)
    ledger.land_bids(ctx, f"{tmp_dir}/bids")
    rows = spark.read.parquet(f"{tmp_dir}/bids").select("auction_id", "bid_id", "seq", F.input_file_name().alias("file"))
    files = {r.auction_id: r.n for r in rows.groupBy("auction_id").agg(F.count_distinct("file").alias("n")).collect()}
    assert len(files) == 40 and all(n <= 2 for a, n in files.items() if a != 7) and files[7] > 1
    places = {}
    for r in rows.orderBy("bid_id").collect():
        places.setdefault(r.auction_id, []).append(r.seq)
    assert all(seqs == list(range(1, len(seqs) + 1)) for seqs in places.values())


def test_auction_targets_send_no_index_through_the_driver(spark):
    # small rows pass for small tables: only the plan shows what copies of them would broadcast
    from formbook.operators import league
    pool = spark.createDataFrame(
        [(1, 9, "A Singh", "bowler", "X", 20, True, "capped", 50, True), (2, 8, "B Singh", "Bowler", "X", 21, True, "capped", 50, True),
         (3, 7, "Nobody Known", "bowler", "Y", 22, True, "uncapped", 50, True), (4, 6, None, "bowler", "Y", 23, True, "uncapped", 50, True),
         (5, 5, "C Owned", "bowler", "Y", 24, True, "capped", 50, True), (6, 4, "D Bat", "batter", "Y", 25, True, "capped", 50, True)],
        "pool_id long, sr_no long, player_name string, role string, country string, age int, is_overseas boolean, "
        "capped_status string, base_price_lakh int, is_current_reference boolean")
    roster = spark.createDataFrame([("c owned", "active"), ("A Singh", "released"), (None, "active")], "player_name string, status string")
    bat = spark.createDataFrame([("r1", "A Singh", 4, 120.0, 30.0), ("r2", "B Singh", 5, 110.0, 20.0)],
                                "batter_key string, player_name string, recent_innings long, recent_strike_rate double, recent_average double")
    bowl = spark.createDataFrame([("r3", "Alex Singh", 6, 7.5, 3, "balanced")],
                                 "bowler_key string, player_name string, recent_innings long, recent_economy double, recent_wickets long, "
                                 "bowler_type string")
    got = league.auction_targets(pool, roster, bat, bowl, role="Bowler ", overseas=True)
    assert [(r.pool_id, r.bat_innings, r.bowl_innings, r.has_data) for r in got.collect()] == [
        (2, 5, 6, True), (1, 4, 6, True), (4, None, None, False), (3, None, None, False)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_unmatched_names_are_dealt_over_tasks(spark):
    people = spark.createDataFrame([("b1", "A Known", 3)], "batter_key string, player_name string, n int")
    q = spark.range(200).select("id", F.concat(F.lit("Q Nobody"), F.col("id").cast("string")).alias("name"))
    r = names.resolve_and_attach(q, "name", people, "batter_key", {"n": "n"}, prefix="bat_")
    assert r.columns == ["id", "name", "bat_n"]
    assert r.where("bat_n IS NULL").count() == 200
    joins = [x for x in r._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 4 and all("_salt" in x for x in joins)  # three indexes and the columns, of a null key here
