"""News / vector side (B19-B22, T3, A34, URL extraction)."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.search import build_index, search
from formbook.operators.textsearch import top_k
from formbook.schema import QUALITY_MIN_BALLS, REFRESH_WINDOW_DAYS, TOP_N_BY_ACTIVITY, TOP_N_BY_QUALITY
from formbook.session import checkpoint_dir

# Link pattern of the reference UI (a bare http(s) url, not already inside
# "(" or 'href="'); the guard is captured as group 1 instead of a
# look-behind so both Java and RE2 engines agree.
URL_PATTERN = r'(href="|\()?(https?://[^\s<>")\]]+)'
# Tags, and what stands inside scripts, styles and the title.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<[^>]*>"


def news_shortlist(batter_profile: DataFrame, bowler_profile: DataFrame,
                   top_activity: int = TOP_N_BY_ACTIVITY, top_quality: int = TOP_N_BY_QUALITY,
                   min_balls: int = QUALITY_MIN_BALLS) -> DataFrame:
    """B19 + U1: most active and best regressed performers of both
    disciplines, union, one row per player key. Top-N orders break ties
    on the key so the list is deterministic."""
    def pick(df, key, order, n, where=None):
        d = df if where is None else df.where(where)
        return d.orderBy(*order, key).limit(n).select(F.col(key).alias("player_key"), "player_name")
    parts = [
        pick(batter_profile, "batter_key", [F.desc("recent_innings")], top_activity),
        pick(batter_profile, "batter_key", [F.desc("regressed_strike_rate")], top_quality,
             F.col("recent_balls_faced") >= min_balls),
        pick(bowler_profile, "bowler_key", [F.desc("recent_innings")], top_activity),
        pick(bowler_profile, "bowler_key", [F.asc("regressed_economy")], top_quality,
             F.col("recent_balls_bowled") >= min_balls),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("player_key").agg(F.min("player_name").alias("player_name"))


def article_text(raw_col: str, content_col: str):
    """The raw body when it has any non-blank text, else the summary."""
    return F.coalesce(F.when(F.length(F.trim(F.col(raw_col))) > 0, F.col(raw_col)), F.col(content_col))


def with_article_id(articles: DataFrame) -> DataFrame:
    """Deterministic key sha256(player_key|url); one row per key
    (latest ingestion, then highest score)."""
    a = articles.withColumn("article_id", F.sha2(F.concat_ws("|", "player_key", "url"), 256))
    from pyspark.sql import Window
    w = Window.partitionBy("article_id").orderBy(F.desc("ingested_on"), F.desc("score"))
    return a.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def recently_covered(articles: DataFrame, as_of: dt.date | str, window_days: int = REFRESH_WINDOW_DAYS) -> DataFrame:
    """Player keys with an article ingested in the last ``window_days``
    before ``as_of`` (a parameter, never the wall clock)."""
    start = F.date_sub(F.lit(str(as_of)).cast("date"), window_days)
    return articles.where(F.col("ingested_on") >= start).select("player_key").distinct()


def refresh_targets(shortlist: DataFrame, articles: DataFrame, as_of: dt.date | str,
                    window_days: int = REFRESH_WINDOW_DAYS) -> DataFrame:
    """Shortlist minus recently covered players (left anti)."""
    return shortlist.join(recently_covered(articles, as_of, window_days), "player_key", "left_anti")


def article_freshness(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Articles and last ingestion per player, newest first."""
    return (articles.groupBy("player_key").agg(F.count("*").alias("articles"),
                                               F.max("ingested_on").alias("last_fetched"))
            .orderBy(F.desc("last_fetched"), F.desc("articles"), "player_key").limit(limit))


def extract_urls(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Bare links in a text column: (id, pos, url), links already wrapped
    in '(' or 'href="' skipped."""
    guards = F.regexp_extract_all(F.col(text_col), F.lit(URL_PATTERN), 1)
    urls = F.regexp_extract_all(F.col(text_col), F.lit(URL_PATTERN), 2)
    z = df.select(id_col, F.posexplode(F.arrays_zip(guards.alias("g"), urls.alias("u"))).alias("pos", "m"))
    return z.where(F.length(F.col("m.g")) == 0).select(id_col, "pos", F.col("m.u").alias("url"))


def label_centroids(vectors: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Mean vector per label (dimension-wise), computed with a keyed
    aggregation over (label, dimension)."""
    dims = (vectors.select(label_col, F.posexplode(vec_col).alias("dim", "x"))
            .groupBy(label_col, "dim").agg(F.avg("x").alias("x")))
    return dims.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def cosine_topk(corpus: DataFrame, queries: DataFrame, *, corpus_id: str, corpus_vec: str,
                query_id: str, query_vec: str, k: int = 5, block: int = 1024, rows: int = 4096,
                digits: int = 6) -> DataFrame:
    """Exact cosine top-k of every query over the whole corpus.

    Queries and rows are dealt into blocks of about ``block`` and ``rows`` by
    a hash of their ids; each pair of blocks meets in one task, is scored as
    a matrix product and gives at most k rows a query, which ``top_k``
    merges. Scores are compared at 12 decimals, ties by corpus id. Null
    vectors take no part."""
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("v")).where("v IS NOT NULL")
    c = corpus.select(F.col(corpus_id).alias("cid"), F.col(corpus_vec).cast("array<double>").alias("v")).where("v IS NOT NULL")

    def blocks(df, size):
        return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("n")).scalar()

    nq, nc = blocks(q, block), blocks(c, rows)
    left = q.withColumn("qb", F.pmod(F.xxhash64("qid"), nq).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), nc - 1)))
    right = c.withColumn("cb", F.pmod(F.xxhash64("cid"), nc).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), nq - 1)))

    def unit(vectors):
        x = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
        norm = np.linalg.norm(x, axis=1)
        return x / np.where(norm == 0, 1.0, norm)[:, None]

    def meet(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(stored):
            stored = stored.sort_values("cid", kind="stable", ignore_index=True)  # ties: the smaller id first
            score = np.round(unit(asked["v"]) @ unit(stored["v"]).T, 12) + 0.0
            take = min(k, score.shape[1])
            least = -np.partition(-score, take - 1, axis=1)[:, take - 1]
            for i, (qid, row) in enumerate(zip(asked["qid"], score)):
                reach = np.flatnonzero(row >= least[i])
                out += [(qid, stored["cid"][j], row[j]) for j in reach[np.argsort(-row[reach], kind="stable")][:take]]
        return pd.DataFrame(out, columns=["qid", "cid", "score"])

    schema = (f"qid {queries.schema[query_id].dataType.simpleString()}, "
              f"cid {corpus.schema[corpus_id].dataType.simpleString()}, score double")
    local = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, schema)
    best = top_k(local, ["qid"], [F.desc("score"), F.col("cid")], k, rank_col="rank")
    return best.select(F.col("qid").alias(query_id), F.col("cid").alias(corpus_id),
                       F.round("score", digits).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def text_embed_topk(docs: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, query_id: str,
                    query_text: str, k: int = 5, path: str | None = None) -> DataFrame:
    """B21 over B22 embeddings: for each query text, the k most similar
    documents of the whole corpus, from an inverted index written to ``path``."""
    path = path or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/text-index-{uuid.uuid4().hex}"
    return search(build_index(docs, doc_id, doc_text, path), queries, query_id, query_text, k, doc_id)


def article_bodies(articles: DataFrame) -> DataFrame:
    """(article_id, player_key, title, url, body), one row an article id; the
    body is the player, the title and the text without tags."""
    # texts are cut out first: what picks the row of an id moves them and not the markup
    title = F.coalesce(F.regexp_extract("content", r"(?is)<title>(.*?)</title>", 1), F.lit(""))
    plain = F.regexp_replace("content", MARKUP, " ")
    a = articles.withColumn("title", title).withColumn("body", F.concat_ws(" ", "player_key", "title", plain)).drop("content")
    return with_article_id(a).select("article_id", "player_key", "title", "url", "body")


def search_articles(articles: DataFrame, questions: DataFrame, query_id: str, query_text: str, k: int = 5,
                    path: str | None = None) -> DataFrame:
    """The ``k`` articles (player_key, title, url) of the whole index
    nearest to each question, usually "player: what to know"."""
    path = path or f"{checkpoint_dir(articles.sparkSession).rstrip('/')}/articles-{uuid.uuid4().hex}"
    article_bodies(articles).write.parquet(f"{path}/bodies")
    bodies = articles.sparkSession.read.parquet(f"{path}/bodies")
    best = text_embed_topk(bodies, "article_id", "body", questions, query_id, query_text, k, f"{path}/index")
    return best.join(bodies.drop("body"), "article_id").select(query_id, "rank", "score", "player_key", "title", "url")
