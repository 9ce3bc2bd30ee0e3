"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from formbook.llm import (bestfit, bfd, filters, knn, licenses, mixing, periodic, sharding, simhash, substring, suffix,
                          toxicity, winnow)
from formbook.llm.common import table


def op1_histogram_shards(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


def op2_toxic_passages(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op4_voronoi_topk(spark, sf_dir):
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op5_bfd_packing(spark, sf_dir):
    return bfd.packed(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_bestfit_packing(spark, sf_dir):
    return bestfit.digest(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring.digest(table(spark, sf_dir, "documents"))


def op9_winnowing(spark, sf_dir):
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix.digest(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_toxic_passages": op2_toxic_passages,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_voronoi_topk": op4_voronoi_topk,
    "op5_bfd_packing": op5_bfd_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_bestfit_packing": op7_bestfit_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_winnowing": op9_winnowing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op4_voronoi_topk": r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20""",
    "op6_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
t AS (SELECT sum(source_size) AS total FROM s),
-- sources by how soon they are full; k of them are, the first k whose share leaves the next one room
r AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(3 * source_size) OVER p, 0) AS full_before,
         sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS left_from
  FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source), p AS (ORDER BY 3.0 * source_size / w, source
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min(k) AS k FROM r, t WHERE w * (total - full_before) <= 3 * source_size * left_from),
g AS (
  SELECT r.source, r.source_size, CASE WHEN r.k < c.k THEN CAST(3 * r.source_size AS DOUBLE)
         ELSE CAST(r.w * (total - e.full_before) AS DOUBLE) / CAST(e.left_from AS DOUBLE) END AS target
  FROM r, t, c JOIN r e ON e.k = c.k),
q AS (
  SELECT d.*, g.source_size, g.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (SELECT *, unnest([0, 1, 2]) AS epoch FROM q),
m AS (
  SELECT *, sum(size) OVER (ORDER BY CASE WHEN target > 0 THEN CAST(before + source_size * epoch AS DOUBLE) / target ELSE 0 END,
                            u, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(sum(CASE WHEN upto <= (SELECT total FROM t) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM m GROUP BY doc_id, size, source_size, target""",
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g WHERE o < doc_id),
r AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws
              ELSE list_filter(ws, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""",
    "op11_filter_audit": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
l AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON doc_id = id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM range(5) t(i)),
p AS (
  SELECT '' AS prefix, 0 AS applied, '' AS letter, 0 AS bit, 0 AS before
  UNION ALL
  SELECT p.prefix || f.letter, p.applied | f.bit, f.letter, f.bit, p.applied FROM p JOIN f ON p.applied & f.bit = 0),
s AS (
  SELECT part, prefix, letter, length(prefix) AS step,
         sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM p, c WHERE prefix <> '' GROUP BY part, prefix, letter),
o AS (SELECT part, prefix AS filter_order, unnest(range(1, 6)) AS step FROM s WHERE step = 5),
r AS (SELECT o.part, o.filter_order, s.* EXCLUDE (part, prefix)
      FROM o JOIN s ON o.part = s.part AND s.prefix = substr(o.filter_order, 1, o.step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""}
