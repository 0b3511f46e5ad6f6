"""Queries of §C and the observations they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cooccurrence as C
from tessera.plans.catalog import register
from tessera.sources.tables import ITEMS_SQL, POSTS_SQL, items, posts

OBS = f"""WITH {ITEMS_SQL}, {POSTS_SQL}, obs AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY post, category ORDER BY confidence DESC, ix, code) k FROM items WHERE confidence >= 0.1) WHERE k = 1),
 n AS (SELECT category, count(*) n_c FROM obs GROUP BY 1), t AS (SELECT count(DISTINCT post) posts FROM obs),
 pc AS (SELECT x.category a, y.category b, count(*) n FROM obs x JOIN obs y ON x.post = y.post AND x.category < y.category GROUP BY 1, 2),
 pairs AS (SELECT a, b, n, n / na.n_c AS p_b_given_a, n / nb.n_c AS p_a_given_b, (n / posts) / ((na.n_c / posts) * (nb.n_c / posts)) AS lift,
   CASE WHEN n = posts THEN 0 ELSE ln((n / posts) / ((na.n_c / posts) * (nb.n_c / posts))) / -ln(n / posts) END AS npmi
   FROM pc JOIN n na ON na.category = a JOIN n nb ON nb.category = b CROSS JOIN t WHERE n >= 3)"""


def _obs(s, d):
    return C.best_observations(items(s, d), 0.1)


def _pairs(s, d):
    return C.pair_table(_obs(s, d))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


register("A1_best_observations", lambda s, d: _obs(s, d).select("post", "category", "ix", "colour", "confidence"), OBS + " SELECT post, category, ix, colour, confidence FROM obs")
register("A10_items_per_post", lambda s, d: _obs(s, d).groupBy("post").agg(F.count(F.lit(1)).alias("n_items")).groupBy("n_items").agg(F.count(F.lit(1)).alias("n_posts")), OBS + " SELECT n_items, count(*) n_posts FROM (SELECT post, count(*) n_items FROM obs GROUP BY 1) GROUP BY 1")
register("C1_cooccurrence", lambda s, d: _rounded(_pairs(s, d), "p_b_given_a", "p_a_given_b", "lift", "npmi"), OBS + " SELECT a, b, n, round(p_b_given_a, 6) p_b_given_a, round(p_a_given_b, 6) p_a_given_b, round(lift, 6) lift, round(npmi, 6) npmi FROM pairs")
register("C1_examples", lambda s, d: C.examples(_obs(s, d)).select("a", "b", F.array_join(F.transform("posts", lambda p: p.cast("string")), ",").alias("posts")), OBS + " SELECT a, b, string_agg(post::VARCHAR, ',' ORDER BY post) posts FROM (SELECT x.category a, y.category b, x.post, row_number() OVER (PARTITION BY x.category, y.category ORDER BY x.post) k FROM obs x JOIN obs y ON x.post = y.post AND x.category < y.category) WHERE k <= 5 GROUP BY 1, 2")
register("C2_npmi", lambda s, d: _pairs(s, d).select("a", "b", F.round("npmi", 6).alias("npmi")), OBS + " SELECT a, b, round(npmi, 6) npmi FROM pairs")
register("C3_totals", lambda s, d: C.totals(_obs(s, d)), OBS + " SELECT posts FROM t")
register("C4_colour_pairs", lambda s, d: C.colour_pairs(_obs(s, d)).select(F.concat_ws("|", "category", "colour").alias("key"), F.concat_ws("|", "b", "b_colour").alias("other"), "n", "k"), OBS + " SELECT category || '|' || colour AS key, b || '|' || b_colour AS other, n, k FROM (SELECT *, row_number() OVER (PARTITION BY category, colour ORDER BY n DESC, b, b_colour) k FROM (SELECT x.category, x.colour, y.category b, y.colour b_colour, count(*) n FROM obs x JOIN obs y ON x.post = y.post AND x.category <> y.category GROUP BY ALL)) WHERE k <= 40 AND n >= 3")
_CTX = lambda s, d: _obs(s, d).join(posts(s, d), "post").withColumn("context", F.coalesce("section", "source"))
register("C5_by_context", lambda s, d: _rounded(C.by_context(_CTX(s, d)), "share"), OBS + ", o2 AS (SELECT obs.*, coalesce(section, source) context FROM obs JOIN posts USING (post)), tot AS (SELECT context, count(*) total FROM (SELECT context, post FROM o2 GROUP BY ALL HAVING count(*) > 1) GROUP BY 1 HAVING count(*) >= 20) SELECT context, a, b, n, round(n / total, 6) share FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, a, b) k FROM (SELECT x.context, x.category a, y.category b, count(*) n FROM o2 x JOIN o2 y ON x.post = y.post AND x.category < y.category GROUP BY ALL)) JOIN tot USING (context) WHERE k <= 15")
register("C6_profiles", lambda s, d: _rounded(C.profiles(_obs(s, d)), "share"), OBS + " SELECT category, n, round(n / posts, 6) share, grp, colours FROM (SELECT category, count(*) n, arg_max(grp, post * 100 + ix) grp FROM obs GROUP BY 1) CROSS JOIN t JOIN (SELECT category, string_agg(colour, ',' ORDER BY k) colours FROM (SELECT category, colour, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, colour) k FROM obs GROUP BY 1, 2) WHERE k <= 6 GROUP BY 1) USING (category)")
register("C7_diagnostics", lambda s, d: _rounded(C.diagnostics(_obs(s, d), _pairs(s, d)), "mean_items"), OBS + " SELECT round((SELECT avg(k) FROM (SELECT count(*) k FROM obs GROUP BY post)), 6) mean_items, count(*) n_pairs, count(*) FILTER (WHERE lift < 1) below_one, count(*) = 0 OR count(*) FILTER (WHERE lift < 1) > count(*) / 2 AS lift_is_unreliable FROM pairs")
register("C8_companions", lambda s, d: _rounded(C.companions(_pairs(s, d), "gear"), "share", "lift"), OBS + " SELECT 'gear' AS \"of\", companion, n, round(share, 6) share, round(lift, 6) lift FROM (SELECT b companion, n, p_b_given_a share, lift FROM pairs WHERE a = 'gear' UNION ALL SELECT a, n, p_a_given_b, lift FROM pairs WHERE b = 'gear') ORDER BY n DESC, share DESC, companion LIMIT 8")
register("C9_evidence", lambda s, d: C.evidence(_pairs(s, d), "widget", "bolt").select("a", "b", "n", "enough"), OBS + " SELECT a, b, n, n >= 5 AS enough FROM pairs WHERE a = 'bolt' AND b = 'widget'")
register("C10_companion_colours", lambda s, d: C.companion_colours(C.colour_pairs(_obs(s, d)), "gear", "red", "bolt"), OBS + " SELECT b_colour, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, b, b_colour) k FROM (SELECT y.category b, y.colour b_colour, count(*) n FROM obs x JOIN obs y ON x.post = y.post AND x.category <> y.category WHERE x.category = 'gear' AND x.colour = 'red' GROUP BY ALL)) WHERE k <= 40 AND n >= 3 AND b = 'bolt' ORDER BY n DESC, b_colour LIMIT 5")


def _rerank(s, d):
    obs = _obs(s, d)
    hits = obs.select(F.col("post").alias("query"), "code", F.col("ix").cast("long").alias("rank"), "colour")
    return C.rerank_by_colour(hits, obs.groupBy("colour").agg(F.count(F.lit(1)).alias("n")))


register("C11_rerank_by_colour", _rerank, OBS + ", sup AS (SELECT colour, count(*) n FROM obs GROUP BY 1) SELECT query, code, rank, support, row_number() OVER (PARTITION BY query ORDER BY support DESC, rank, code) new_rank FROM (SELECT post AS query, code, ix::BIGINT AS rank, max(n) support FROM obs JOIN sup USING (colour) GROUP BY ALL)")
register("C12_enough_evidence", lambda s, d: _pairs(s, d).select("a", "b", (F.col("n") >= 5).alias("enough")), OBS + " SELECT a, b, n >= 5 AS enough FROM pairs")
