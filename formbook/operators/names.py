"""Name resolution against profile tables.

``resolve_names``  (match_gold_row): exact case-folded name, else the only
    row with that surname, else the only row with that surname + first
    initial, else NULL (ambiguity never guesses).
``search_names``   (search_players): substring hits (first k), else
    surname + initial candidates, else all surname candidates (first k).

All tiers are equi-joins against per-key indexes (at most one row per
key, or at most k rows per key), so a hot surname never multiplies rows;
the index joins are salted, so it never lands in one task either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.functions.exprs import first_initial, lower_trim, surname
from formbook.operators.textsearch import substring_join, top_k


def _index(profiles: DataFrame, name_col: str, key_col: str) -> dict[str, DataFrame]:
    p = profiles.select(F.col(key_col).alias("_k"), F.col(name_col).alias("_pname"))
    exact = p.groupBy(F.lower(F.col("_pname")).alias("_lname")).agg(F.min("_k").alias("_exact_key"))
    sur = (p.withColumn("_sur", surname("_pname"))
           .groupBy("_sur").agg(F.count("*").alias("_n_sur"), F.min("_k").alias("_sur_key")))
    si = (p.withColumn("_sur", surname("_pname")).withColumn("_ini", first_initial("_pname"))
          .groupBy("_sur", "_ini").agg(F.count("*").alias("_n_si"), F.min("_k").alias("_si_key")))
    return {"exact": exact, "sur": sur, "si": si}


SALTS = 16


def salted(rows: DataFrame) -> DataFrame:
    """``rows`` plus a ``_salt`` by the hash of the whole row."""
    hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))


def salted_lookup(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of :func:`salted` rows with an index of one row a key. The
    index is repeated for each salt, so the rows of a key that a third of
    them share are dealt over ``SALTS`` tasks. It grows with the players and
    its size is guessed from compressed files, before it is repeated, so it
    is merged and never sent whole through the driver."""
    every = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(every.hint("merge"), [*keys, "_salt"], "left")


def resolve_names(names: DataFrame, name_col: str, profiles: DataFrame, *,
                  profile_name_col: str = "player_name", key_col: str = "batter_key",
                  out_key: str = "matched_key", out_tier: str | None = "match_tier") -> DataFrame:
    """Add ``out_key`` (NULL when no unique match) and the tier used."""
    idx = _index(profiles, profile_name_col, key_col)
    n = salted(names.withColumn("_lname", lower_trim(name_col))
               .withColumn("_sur", surname(name_col))
               .withColumn("_ini", first_initial(name_col)))
    n = salted_lookup(n, idx["exact"], ["_lname"])
    n = salted_lookup(n, idx["sur"], ["_sur"])
    n = salted_lookup(n, idx["si"], ["_sur", "_ini"])
    blank = F.col(name_col).isNull() | (F.length(F.trim(F.col(name_col))) == 0)
    key = (F.when(blank, F.lit(None))
           .when(F.col("_exact_key").isNotNull(), F.col("_exact_key"))
           .when(F.col("_n_sur") == 1, F.col("_sur_key"))
           .when(F.col("_n_si") == 1, F.col("_si_key")))
    tier = (F.when(blank, F.lit(None))
            .when(F.col("_exact_key").isNotNull(), F.lit("exact"))
            .when(F.col("_n_sur") == 1, F.lit("surname"))
            .when(F.col("_n_si") == 1, F.lit("surname_initial")))
    out = n.withColumn(out_key, key)
    if out_tier:
        out = out.withColumn(out_tier, tier)
    return out.drop("_salt", "_lname", "_sur", "_ini", "_exact_key", "_n_sur", "_sur_key", "_n_si", "_si_key")


def resolve_and_attach(names: DataFrame, name_col: str, profiles: DataFrame, key_col: str,
                       columns: dict[str, str], prefix: str = "") -> DataFrame:
    """J20/J21 building block: resolve, then left-join selected profile
    columns (renamed ``prefix + alias``) on the matched key. The join is
    salted: names without a match share the null key."""
    out_key = f"_{prefix}key"
    r = resolve_names(names, name_col, profiles, profile_name_col="player_name", key_col=key_col,
                      out_key=out_key, out_tier=None)
    cols = profiles.select(F.col(key_col).alias(out_key),
                           *[F.col(src).alias(prefix + alias) for alias, src in columns.items()])
    return salted_lookup(salted(r), cols, [out_key]).drop(out_key, "_salt")


def search_names(terms: DataFrame, term_col: str, term_id: str, profiles: DataFrame, *,
                 key_col: str, profile_name_col: str = "player_name", max_matches: int = 8) -> DataFrame:
    """(term_id, key, player_name, tier, rank) for up to ``max_matches``
    hits per term, in (player_name, key) order."""
    t = (terms.select(F.col(term_id).alias("_tid"), lower_trim(term_col).alias("_term"))
         .where(F.col("_term").isNotNull() & (F.length("_term") > 0)))
    p = profiles.select(F.col(key_col).alias("_k"), F.col(profile_name_col).alias("_pname"))
    hits = (substring_join(t, "_term", ["_tid"], p, "_pname", ["_k"], first=max_matches)
            .join(p, "_k").withColumn("_tier", F.lit("substring")))
    no_hit = t.join(hits.select("_tid").distinct(), "_tid", "left_anti")
    words = F.split(F.col("_term"), r"\s+")
    nh = no_hit.withColumn("_sur", F.element_at(words, -1)).withColumn("_ini", F.substring(words[0], 1, 1))
    pk = p.withColumn("_sur", surname("_pname")).withColumn("_ini", first_initial("_pname"))
    order = ["_pname", "_k"]
    si_top = top_k(pk, ["_sur", "_ini"], order, max_matches)
    sur_top = top_k(pk.drop("_ini"), ["_sur"], order, max_matches)
    si_hits = nh.join(si_top, ["_sur", "_ini"]).select("_tid", "_k", "_pname").withColumn("_tier",
                                                                                       F.lit("surname_initial"))
    rest = nh.join(si_hits.select("_tid").distinct(), "_tid", "left_anti")
    sur_hits = rest.join(sur_top, ["_sur"]).select("_tid", "_k", "_pname").withColumn("_tier", F.lit("surname"))
    allh = hits.select("_tid", "_k", "_pname", "_tier").unionByName(si_hits).unionByName(sur_hits)
    ranked = top_k(allh, ["_tid"], order, max_matches, rank_col="match_rank")
    return ranked.select(F.col("_tid").alias(term_id), F.col("_k").alias(key_col),
                         F.col("_pname").alias("player_name"), F.col("_tier").alias("match_tier"),
                         F.col("match_rank").cast("bigint").alias("match_rank"))


def player_lookup(terms: DataFrame, term_col: str, term_id: str, batter_profile: DataFrame,
                  bowler_profile: DataFrame, max_matches: int = 3) -> DataFrame:
    """B1 + J16: search both disciplines, merge hits per player key
    (full outer), count matches per query and flag ambiguity."""
    bat = search_names(terms, term_col, term_id, batter_profile, key_col="batter_key",
                       max_matches=max_matches)
    bowl = search_names(terms, term_col, term_id, bowler_profile, key_col="bowler_key",
                        max_matches=max_matches)
    b = bat.join(batter_profile.select("batter_key", "recent_innings", "recent_strike_rate",
                                       "regressed_strike_rate"), "batter_key", "left") \
        .select(term_id, F.col("batter_key").alias("player_key"), F.col("player_name").alias("bat_name"),
                F.struct("recent_innings", "recent_strike_rate", "regressed_strike_rate").alias("batting"))
    w = bowl.join(bowler_profile.select("bowler_key", "recent_innings", "recent_economy", "recent_wickets",
                                        "bowler_type"), "bowler_key", "left") \
        .select(term_id, F.col("bowler_key").alias("player_key"), F.col("player_name").alias("bowl_name"),
                F.struct("recent_innings", "recent_economy", "recent_wickets", "bowler_type").alias("bowling"))
    merged = (b.join(w, [term_id, "player_key"], "full_outer")
              .withColumn("player_name", F.coalesce("bat_name", "bowl_name")).drop("bat_name", "bowl_name"))
    counts = merged.groupBy(term_id).agg(F.count("*").alias("match_count"))
    return (merged.join(counts, term_id)
            .withColumn("is_ambiguous", F.col("match_count") > 1))
