"""Registered table-maintenance queries: every change is committed as a
new table version under the shared checkpoint folder and the final
table is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formbook.operators import news
from formbook.plans.gold import Gold
from formbook.plans.oracle import with_ctes
from formbook.plans.registry import query
from formbook.session import checkpoint_dir
from formbook.sources import fixtures as fx
from formbook.sources import tables as T


def _root(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _config_source(g):
    r = g.table("region")
    upd = r.select(F.col("r_regionkey").cast("bigint").alias("franchise_id"), F.col("r_name").alias("name"),
                   F.lit(125).cast("decimal(10,2)").alias("purse_total_cr"),
                   (50 + F.col("r_regionkey")).cast("decimal(10,2)").alias("purse_remaining_cr"),
                   F.lit(25).alias("max_squad_size"), F.lit(8).alias("max_overseas"),
                   F.concat(F.lit("Venue "), F.col("r_regionkey").cast("string")).alias("home_venue"),
                   F.lit(True).alias("is_active"))
    new = r.select((100 + F.col("r_regionkey")).cast("bigint").alias("franchise_id"),
                   F.concat("r_name", F.lit(" XI")).alias("name"),
                   F.lit(125).cast("decimal(10,2)").alias("purse_total_cr"),
                   F.lit(125).cast("decimal(10,2)").alias("purse_remaining_cr"),
                   F.lit(25).alias("max_squad_size"), F.lit(8).alias("max_overseas"),
                   F.lit(None).cast("string").alias("home_venue"), F.lit(True).alias("is_active"))
    return upd.unionByName(new)


@query("config_upsert", with_ctes(["config_upsert"], "SELECT * FROM config_upsert"))
def config_upsert_q(spark, sf_dir):
    """S11 (+S12/S13 typed table): seed, then upsert the same source twice."""
    g = Gold(spark, sf_dir)
    vt = T.VersionedTable(spark, _root(spark, "config"))
    vt.commit(g.franchises)
    src = _config_source(g)
    vt.commit(T.upsert(vt.read(), src, ["franchise_id"]))
    vt.commit(T.upsert(vt.read(), src, ["franchise_id"]))
    return vt.read()


@query("typed_table", with_ctes(["roster"], "SELECT * FROM roster WHERE status = 'active'"))
def typed_table_q(spark, sf_dir):
    """S12 + S13: a named table of a database that is made where it is not
    there; a NULL in a required column would fail the write."""
    g = Gold(spark, sf_dir)
    T.ensure_database(spark, "formbook")
    T.ensure_database(spark, "formbook")  # as every run does
    name = f"formbook.squads_{uuid.uuid4().hex}"
    rows = T.with_not_null(g.roster.where(F.col("status") == "active"), ["roster_id", "franchise_id", "player_name"])
    rows.write.option("path", _root(spark, "squads")).saveAsTable(name)
    return spark.table(name)


@query("insert_absent", with_ctes(["insert_absent"], "SELECT * FROM insert_absent"))
def insert_absent_q(spark, sf_dir):
    """Roster players offered to the pool, inserted only when the
    name is not there yet."""
    g = Gold(spark, sf_dir)
    cand = g.roster.select(
        (1000000 + F.col("roster_id")).alias("pool_id"), (1000000 + F.col("roster_id")).alias("sr_no"),
        "player_name", F.lit("Unknown").alias("country"), F.lit(None).cast("bigint").alias("age"), "role",
        F.lit("uncapped").alias("capped_status"), "bowling_style", "is_overseas",
        F.lit(30).cast("decimal(10,2)").alias("base_price_lakh"), F.lit(True).alias("is_current_reference"))
    vt = T.VersionedTable(spark, _root(spark, "pool"))
    vt.commit(g.pool)
    vt.commit(T.insert_absent(vt.read(), cand, ["player_name"]))
    return vt.read()


@query("flip_current", with_ctes(["flip_current"], "SELECT * FROM flip_current"))
def flip_current_q(spark, sf_dir):
    """New current rule version, older versions kept as history."""
    r = Gold(spark, sf_dir).table("region")
    top = r.agg(F.max("r_regionkey").alias("m")).scalar()
    rules = r.select(F.col("r_regionkey").cast("bigint").alias("rule_version"),
                     (100 + 5 * F.col("r_regionkey")).cast("decimal(10,2)").alias("max_purse_cr"),
                     F.lit(25).alias("max_squad_size"), F.lit(8).alias("max_overseas_players"),
                     (F.col("r_regionkey") == top).alias("is_current"))
    new = rules.agg((F.max("rule_version") + 1).alias("rule_version")).select(
        "rule_version", F.lit(125).cast("decimal(10,2)").alias("max_purse_cr"),
        F.lit(25).alias("max_squad_size"), F.lit(8).alias("max_overseas_players"))
    return T.flip_current(rules, new)


@query("partition_replace", with_ctes(["partition_replace"], "SELECT * FROM partition_replace"))
def partition_replace_q(spark, sf_dir):
    """Roster partitioned by team; the squads of inactive teams are
    rewritten as released, every other partition is untouched."""
    g = Gold(spark, sf_dir)
    path = _root(spark, "roster")
    T.write_counted(g.roster, path, partition_by=["franchise_id"])
    inactive = g.franchises.where(~F.col("is_active")).select("franchise_id")
    current = spark.read.parquet(path)
    repl = current.join(inactive, "franchise_id", "left_semi").withColumn("status", F.lit("released"))
    staged = _root(spark, "roster-staged")
    T.write_counted(repl, staged)  # never overwrite from a plan that reads the same path
    T.replace_partition(spark.read.parquet(staged), path, "franchise_id")
    return spark.read.schema(g.roster.schema).parquet(path).select(*g.roster.columns)


@query("backfill_key", with_ctes(["backfill"], "SELECT * FROM backfill"))
def backfill_key_q(spark, sf_dir):
    """Older article rows were stored without a key; fill only those."""
    a = fx.articles(Gold(spark, sf_dir).table("pages")).select("player_key", "url", "ingested_on")
    key = F.sha2(F.concat_ws("|", "player_key", "url"), 256)
    partial = a.withColumn("article_id", F.when(F.col("ingested_on") >= F.lit("2024-01-15").cast("date"), key))
    assert T.needs_backfill(partial, "article_id")
    return T.backfill_key(partial, "article_id", key)


def _roster_new(g):
    c = g.table("customer").select(F.col("c_custkey").alias("roster_id"), "c_acctbal", "c_mktsegment")
    kept = (g.roster.join(c, "roster_id").where(F.col("c_acctbal") >= 0)
            .withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("released"))
                        .otherwise(F.col("status"))).drop("c_acctbal", "c_mktsegment"))
    s = g.table("supplier")
    new = s.select((1000000 + F.col("s_suppkey")).alias("roster_id"), F.col("s_nationkey").cast("bigint")
                   .alias("franchise_id"), F.col("s_name").alias("player_name"), F.lit("batter").alias("role"),
                   F.lit("na").alias("bowling_style"), F.lit(False).alias("is_overseas"),
                   F.lit("auction").alias("acquisition_type"), F.lit(1).cast("decimal(10,2)").alias("price_cr"),
                   F.lit("active").alias("status"))
    return kept.unionByName(new)


@query("snapshot_diff", with_ctes(["snapshot_diff"], "SELECT * FROM snapshot_diff"))
def snapshot_diff_q(spark, sf_dir):
    """Change feed between two roster snapshots."""
    g = Gold(spark, sf_dir)
    return T.snapshot_diff(g.roster, _roster_new(g), ["roster_id"])


def _case_folded(spark, sf_dir):
    """Update-or-insert on (team, lower(name), acquisition, status)."""
    g = Gold(spark, sf_dir)
    c = g.table("customer").select(F.col("c_custkey").alias("roster_id"), "c_mktsegment")
    upd = (g.roster.join(c, "roster_id").where(F.col("c_mktsegment") == "MACHINERY").drop("c_mktsegment")
           .withColumn("player_name", F.upper("player_name"))
           .withColumn("price_cr", (F.col("price_cr") + 1).cast("decimal(10,2)")))
    s = g.table("supplier")
    new = s.select(F.lit(None).cast("bigint").alias("roster_id"), F.col("s_nationkey").cast("bigint")
                   .alias("franchise_id"), F.col("s_name").alias("player_name"), F.lit("bowler").alias("role"),
                   F.lit("pace").alias("bowling_style"), F.lit(False).alias("is_overseas"),
                   F.lit("auction").alias("acquisition_type"), F.lit(2).cast("decimal(10,2)").alias("price_cr"),
                   F.lit("active").alias("status"))
    return T.upsert_case_folded(g.roster, upd.unionByName(new),
                                ["franchise_id", "player_name", "acquisition_type", "status"],
                                ["player_name"], id_col="roster_id")


@query("case_folded_upsert", with_ctes(["case_folded_upsert"], "SELECT * FROM case_folded_upsert"))
def case_folded_upsert_q(spark, sf_dir):
    """How many rows were inserted and updated."""
    return _case_folded(spark, sf_dir)[1]


@query("case_folded_table", with_ctes(["roster", "cf_src"], """
  SELECT * FROM roster r WHERE NOT EXISTS (
    SELECT 1 FROM cf_src s WHERE r.franchise_id = s.franchise_id AND lower(r.player_name) = lower(s.player_name)
                             AND r.acquisition_type = s.acquisition_type AND r.status = s.status)
  UNION ALL
  SELECT r.roster_id, s.franchise_id, s.player_name, s.role, s.bowling_style, s.is_overseas, s.acquisition_type,
         s.price_cr, s.status
  FROM cf_src s LEFT JOIN roster r
    ON r.franchise_id = s.franchise_id AND lower(r.player_name) = lower(s.player_name)
   AND r.acquisition_type = s.acquisition_type AND r.status = s.status"""))
def case_folded_table_q(spark, sf_dir):
    """The table after the upsert."""
    return _case_folded(spark, sf_dir)[0]


@query("manifest_skip", with_ctes(["roster", "franchises"], """
  SELECT CAST(r.franchise_id AS VARCHAR) AS "group", NOT f.is_active AS rebuild
  FROM (SELECT DISTINCT franchise_id FROM roster) r JOIN franchises f ON f.franchise_id = r.franchise_id"""))
def manifest_skip_q(spark, sf_dir):
    """Squads landed a folder a team; after the inactive teams
    received more files, the stored manifest has exactly those rebuilt."""
    g = Gold(spark, sf_dir)
    landing, stored = _root(spark, "landing"), _root(spark, "manifest")
    files, pattern = f"{landing}/franchise_id=*/*.parquet", r"/franchise_id=([0-9]+)/"
    T.write_counted(g.roster, landing, partition_by=["franchise_id"])
    T.write_counted(T.file_manifest(spark, files, pattern), stored)
    inactive = g.franchises.where(~F.col("is_active")).select("franchise_id")
    T.write_counted(g.roster.join(inactive, "franchise_id", "left_semi"), landing, mode="append",
                    partition_by=["franchise_id"])
    cur = T.file_manifest(spark, files, pattern)
    todo = T.groups_to_rebuild(cur, spark.read.parquet(stored)).withColumn("rebuild", F.lit(True))
    return cur.join(todo, "group", "left").select("group", F.coalesce("rebuild", F.lit(False)).alias("rebuild"))


@query("partition_listing", with_ctes(["roster"], "SELECT DISTINCT franchise_id FROM roster"))
def partition_listing_q(spark, sf_dir):
    """The partitions of the squad table."""
    g = Gold(spark, sf_dir)
    path = _root(spark, "roster")
    T.write_counted(g.roster, path, partition_by=["franchise_id"])
    return T.partition_values(spark.read.schema(g.roster.schema).parquet(path), "franchise_id")


@query("articles_append", with_ctes(["articles"], """
  SELECT player_key, url, ingested_on, sha256(concat_ws('|', player_key, url)) AS article_id,
         md5(CASE WHEN ingested_on >= DATE '2024-01-15' AND score >= 0.5 AND length(trim(content)) > 0 THEN content
                  ELSE concat_ws(': ', player_key, url) END) AS body_md5
  FROM (SELECT *, row_number() OVER (PARTITION BY player_key, url ORDER BY ingested_on DESC, score DESC) AS rn
        FROM articles) t
  WHERE rn = 1"""))
def articles_append_q(spark, sf_dir):
    """S7 + P28: early articles were stored without a raw body; the later
    ones are appended with that column, each article once, and the body
    falls back to the summary where the raw one is blank or missing."""
    g = Gold(spark, sf_dir)
    a = news.with_article_id(fx.articles(g.table("pages"))).select(
        "player_key", "url", "ingested_on", "article_id", F.concat_ws(": ", "player_key", "url").alias("summary"),
        F.when(F.col("score") >= 0.5, F.col("content")).otherwise("  ").alias("raw_content"))
    path = _root(spark, "articles")
    T.write_counted(a.where(F.col("ingested_on") < F.lit("2024-01-15").cast("date")).drop("raw_content"), path)
    T.write_counted(T.append_new(spark.read.parquet(path), a, ["article_id"]), path, mode="append")
    table = spark.read.schema(a.schema).parquet(path)
    return table.select("player_key", "url", "ingested_on", "article_id",
                        F.md5(news.article_text("raw_content", "summary")).alias("body_md5"))


@query("column_backfill", with_ctes(["roster", "franchises"], """
  SELECT r.*, f.home_venue FROM roster r
  LEFT JOIN franchises f ON f.franchise_id = r.franchise_id AND f.is_active"""))
def column_backfill_q(spark, sf_dir):
    """The squad table gains a column, filled from a keyed mapping."""
    g = Gold(spark, sf_dir)
    venues = g.franchises.where("is_active").select("franchise_id", "home_venue")
    return T.add_column_backfill(g.roster, "home_venue", venues, "franchise_id")
