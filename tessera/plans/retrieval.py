"""Queries of §V and §W.  Queries are the vectors whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, top_k
from tessera.operators import metrics as M
from tessera.operators import retrieval as V
from tessera.plans.catalog import register
from tessera.sources.tables import ITEMS_SQL, items, table

r6 = lambda c: F.round(c, 6)
SIM = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
PAIRS = f"p AS (SELECT a.vec_id AS query_id, b.vec_id AS code, b.label, {SIM} s FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)"
TOP = f"WITH {PAIRS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, code) k FROM p) WHERE k <= 25)"


def _queries(s, d):
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _gallery(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")


def _top(s, d, k=25):
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return top_k(_queries(s, d), _gallery(s, d), k).join(labels, "key").withColumnRenamed("key", "code")


register("V1_top_k", lambda s, d: top_k(_queries(s, d), _gallery(s, d), 15).select("query_id", "key", r6("score").alias("score"), "rank"), TOP + " SELECT query_id, code AS key, round(s, 6) score, k AS rank FROM top WHERE k <= 15")
register("V2_top_12", lambda s, d: top_k(_queries(s, d), _gallery(s, d), 12).where("key <> query_id").select("query_id", "key", "rank"), TOP + " SELECT query_id, code AS key, k AS rank FROM top WHERE k <= 12 AND code <> query_id")
register("V3_shortlist_identities", lambda s, d: V.members(_top(s, d).groupBy("query_id", "label").agg(F.max("score").alias("a")).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("a"), "label"))).where("k <= 3").select("query_id", "label", r6("a").alias("a")), table(s, d, "embeddings").select("label", F.col("vec_id").alias("code")), "label", "code").select("query_id", "label", "code", "a"), TOP + " SELECT query_id, label, vec_id AS code, round(a, 6) a FROM (SELECT query_id, label, max(s) a, row_number() OVER (PARTITION BY query_id ORDER BY max(s) DESC, label) k FROM top GROUP BY 1, 2) JOIN embeddings USING (label) WHERE k <= 3")
_AB = lambda s, d: _top(s, d).select("query_id", "code", F.col("score").alias("a"), (F.col("code") * 37 % 101 / 101).alias("b"), "label")
_AB_SQL = TOP + ", ab AS (SELECT query_id, code, s AS a, (code * 37 % 101) / 101 b, label FROM top)"
register("V4_rerank", lambda s, d: V.rerank(_AB(s, d)).withColumn("score", r6("score")), _AB_SQL + " SELECT query_id, code, round(b, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, code) rank FROM ab")
register("V4_fused", lambda s, d: V.rerank(_AB(s, d), (0.8, 0.2), 0.1 * (F.col("label") == 3).cast("double")).withColumn("score", r6("score")), _AB_SQL + " SELECT query_id, code, round(b, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, code) rank FROM (SELECT *, 0.8 * (b - avg(b) OVER w) / stddev_samp(b) OVER w + 0.2 * (a - avg(a) OVER w) / stddev_samp(a) OVER w + 0.1 * (label = 3)::INT z FROM ab WINDOW w AS (PARTITION BY query_id))")


def _patches(s, d):
    """A query is a hundred of vectors: those divisible by 20 are its patches, the others its shortlist's, by label."""
    v = table(s, d, "embeddings").withColumn("query_id", F.floor(F.col("vec_id") / 100))
    q = v.where("vec_id % 20 = 0").select("query_id", F.col("vec_id").alias("patch"), "embedding")
    c = v.where("vec_id % 20 <> 0").select("query_id", F.col("label").alias("code"), F.col("embedding").alias("other"))
    return V.max_sim(q, c)


register("V5_max_sim", lambda s, d: _patches(s, d).withColumn("score", r6("score")), f"SELECT query_id, code, round(avg(s), 6) score FROM (SELECT a.vec_id // 100 AS query_id, a.vec_id, b.label AS code, max({SIM}) s FROM embeddings a JOIN embeddings b ON a.vec_id // 100 = b.vec_id // 100 WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY ALL) GROUP BY 1, 2")
register("V6_window_merge", lambda s, d: V.window_rerank(_AB(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("a"), "code"))), "b").select("query_id", "code", "new_rank"), _AB_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, code) k FROM ab) SELECT query_id, code, row_number() OVER (PARTITION BY query_id ORDER BY k <= 10 DESC, CASE WHEN k <= 10 THEN b END DESC NULLS LAST, k) new_rank FROM r")
register("V7_softmax", lambda s, d: _top(s, d).withColumn("p", V.softmax(F.col("score"), 0.05, "query_id")).groupBy("query_id").agg(F.max_by("code", F.struct("p", -F.col("code"))).alias("code"), r6(F.max("p")).alias("p")), TOP + " SELECT query_id, arg_max(code, (p, -code)) code, round(max(p), 6) p FROM (SELECT query_id, code, exp((s - max(s) OVER w) / 0.05) / sum(exp((s - m) / 0.05)) OVER w p FROM (SELECT *, max(s) OVER (PARTITION BY query_id) m FROM top) WINDOW w AS (PARTITION BY query_id)) GROUP BY 1")
_PROTO_SQL = "WITH u AS (SELECT label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) i FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) k FROM embeddings) WHERE k <= 6), m AS (SELECT label, i, avg(x) x FROM u GROUP BY 1, 2), b AS (SELECT label, list(x / n ORDER BY i) embedding FROM m JOIN (SELECT label, sqrt(sum(x * x)) n FROM m GROUP BY 1) USING (label) GROUP BY 1)"
register("V8_group_prototype", lambda s, d: top_k(_queries(s, d), _protos(s, d).select(F.col("label").cast("long").alias("key"), F.col("prototype").alias("embedding")), 1).select("query_id", F.col("key").cast("int").alias("label"), r6("score").alias("sim")), f"{_PROTO_SQL} SELECT a.vec_id AS query_id, arg_max(b.label, {SIM}) AS label, round(max({SIM}), 6) sim FROM embeddings a CROSS JOIN b WHERE a.vec_id % 20 = 0 GROUP BY 1")


def _protos(s, d):
    from tessera.operators.relational import prototypes

    return prototypes(table(s, d, "embeddings"), "label", "vec_id")


register("J15_cross_dot", lambda s, d: top_k(_queries(s, d), _protos(s, d).select(F.col("label").cast("long").alias("key"), F.col("prototype").alias("embedding")), 10).select("query_id", F.col("key").alias("text_id"), r6("score").alias("score"), "rank"), f"{_PROTO_SQL} SELECT * FROM (SELECT a.vec_id AS query_id, b.label::BIGINT AS text_id, round({SIM}, 6) score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.label) rank FROM embeddings a CROSS JOIN b WHERE a.vec_id % 20 = 0) WHERE rank <= 10")
register("V9_top5_mean", lambda s, d: _top(s, d).withColumn("k", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "code"))).where("k <= 5").groupBy("query_id", "label").agg(r6(F.avg("score")).alias("score")), TOP + " SELECT query_id, label, round(avg(s), 6) score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, code) j FROM top) WHERE j <= 5 GROUP BY 1, 2")
register("V10_backfill", lambda s, d: V.fill_up(_top(s, d, 5).where("label < 5").select("query_id", "code", "rank"), _top(s, d, 25).select("query_id", "code", "rank"), 15).select("query_id", "code", "stage", "place"), TOP + ", r AS (SELECT query_id, code, k, 0 stage FROM top WHERE k <= 5 AND label < 5 UNION ALL SELECT query_id, code, k, 1 FROM top), o AS (SELECT query_id, code, min((stage, k)) m FROM r GROUP BY 1, 2) SELECT query_id, code, m[1] AS stage, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, code) place FROM o) WHERE place <= 15".replace("min((stage, k)) m", "min(stage * 1000 + k) m").replace("m[1] AS stage", "m // 1000 AS stage"))
register("V11_attribute_boost", lambda s, d: V.window_rerank(_top(s, d).withColumn("boosted", F.col("score") + 0.03 * (F.col("label") % 2)), "boosted").select("query_id", "code", "new_rank"), TOP + " SELECT query_id, code, row_number() OVER (PARTITION BY query_id ORDER BY k <= 10 DESC, CASE WHEN k <= 10 THEN s + 0.03 * (label % 2) END DESC NULLS LAST, k) new_rank FROM top")
register("V12_nearest_label", lambda s, d: _top(s, d, 2).where("code <> query_id").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("k = 1").join(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth")), "query_id").agg(r6(F.avg((F.col("label") == F.col("truth")).cast("int"))).alias("accuracy")), TOP + " SELECT round(avg((top.label = e.label)::INT), 6) accuracy FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) j FROM top WHERE code <> query_id) top JOIN embeddings e ON e.vec_id = query_id WHERE j = 1")
register("V13_V14_flags", lambda s, d: V.flags(_top(s, d).where("code <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("identity", F.col("label")), _queries(s, d), 0.4, 0.03), TOP + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) j FROM top WHERE code <> query_id) SELECT a.query_id, a.s < 0.4 rejected, a.label = b.label AND abs(a.s - b.s) < 0.03 ambiguous FROM r a JOIN r b USING (query_id) WHERE a.j = 1 AND b.j = 2")
register("V15_identify_or_fallback", lambda s, d: _top(s, d).where("code <> query_id").withColumn("rejected", F.max("score").over(Window.partitionBy("query_id")) < 0.4).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("(rejected AND label % 2 = 0) OR (NOT rejected AND k <= 5)").select("query_id", "code", "rejected"), TOP + " SELECT query_id, code, rejected FROM (SELECT *, max(s) OVER (PARTITION BY query_id) < 0.4 rejected, row_number() OVER (PARTITION BY query_id ORDER BY k) j FROM top WHERE code <> query_id) WHERE (rejected AND label % 2 = 0) OR (NOT rejected AND j <= 5)")


def _identify(s, d):
    """Shortlist, re-rank and flags of all queries at once."""
    from tessera.operators.relational import gate_or_all

    gated = gate_or_all(_AB(s, d), F.col("label") == F.col("query_id") % 10, "query_id").drop("filter_applied")
    ranked = V.rerank(gated.select("query_id", "code", "a", "b")).where("rank <= 5")
    return V.flags(ranked.join(table(s, d, "embeddings").select(F.col("vec_id").alias("code"), F.col("label").alias("identity")), "code"), _queries(s, d), 0.5).join(ranked.where("rank = 1").select("query_id", "code"), "query_id", "left")


register("V16_identify", _identify, _AB_SQL + ", g AS (SELECT * FROM (SELECT *, bool_or(label = query_id % 10) OVER (PARTITION BY query_id) f FROM ab) WHERE label = query_id % 10 OR NOT f), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, code) k FROM g) SELECT x.query_id, x.code, x.b < 0.5 rejected, coalesce(x.label = y.label AND abs(x.b - y.b) < 0.03, false) ambiguous FROM r x LEFT JOIN r y ON x.query_id = y.query_id AND y.k = 2 WHERE x.k = 1")
register("V18_hard_negatives", lambda s, d: V.nearest_of_group(table(s, d, "embeddings"), "vec_id", "label", 15).select("query_id", "code", "k"), f"SELECT query_id, code, k FROM (SELECT a.vec_id AS query_id, b.vec_id AS code, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.vec_id) k FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE k <= 15")


def _parts(s, d):
    """Two parts (a red gear, then a blue bolt) against every post's items."""
    it = items(s, d).withColumn("item", F.row_number().over(Window.partitionBy("post").orderBy("ix", "code", "confidence")).cast("long"))
    score = lambda c, k: 0.5 * F.col("confidence") + 0.05 * (F.col("category") == c).cast("double") + 0.1 * (F.col("colour") == k).cast("double")
    parts = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("part"), score("gear", "red").alias("score")), F.struct(F.lit(1).cast("long").alias("part"), score("bolt", "blue").alias("score")))).alias("p")
    scores = it.select(F.lit(0).cast("long").alias("query_id"), "post", "item", parts).select("query_id", "post", "item", "p.part", "p.score")
    whole = scores.groupBy("query_id", "post", "part").agg((F.avg("score") / 2).alias("score")).withColumn("weight", 1.0 + F.col("part"))
    return V.assign(scores, whole)


_PARTS_SQL = f"""WITH {ITEMS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY ix, code, confidence) item FROM items),
 x AS (SELECT post, item, 0.5 * confidence + 0.05 * (category = 'gear')::INT + 0.1 * (colour = 'red')::INT a, 0.5 * confidence + 0.05 * (category = 'bolt')::INT + 0.1 * (colour = 'blue')::INT b FROM i),
 h AS (SELECT post, max(a) ma, max(b) mb, avg(a) / 2 wa, avg(b) / 2 wb FROM x GROUP BY 1),
 f AS (SELECT post, CASE WHEN ma >= mb THEN arg_min(item, (-a, item)) ELSE arg_min(item, (-b, item)) END i1, ma >= mb a_first FROM x JOIN h USING (post) GROUP BY post, ma, mb),
 g AS (SELECT f.post, a_first, i1, arg_min(item, (CASE WHEN a_first THEN -b ELSE -a END, item)) FILTER (WHERE item <> i1) i2, max(CASE WHEN a_first THEN b ELSE a END) FILTER (WHERE item <> i1) s2 FROM f JOIN x USING (post) GROUP BY 1, 2, 3)
 SELECT 0 AS query_id, post, round(CASE WHEN a_first THEN (ma + 2 * coalesce(s2, wb)) / 3 ELSE (2 * mb + coalesce(s2, wa)) / 3 END, 6) total,
  CASE WHEN a_first THEN '0:' || i1 || ',1:' || coalesce(i2, -1) ELSE '0:' || coalesce(i2, -1) || ',1:' || i1 END picks FROM g JOIN h USING (post)"""
register("V19_multi_part_search", lambda s, d: _parts(s, d).withColumn("total", r6("total")), _PARTS_SQL)
register("V20_colour_bonus", lambda s, d: items(s, d).groupBy("category", "colour").agg(r6(F.sum(V.colour_bonus(F.col("colour"), F.element_at(F.split("grp", " "), -1), F.lit("red"), F.col("code") % 50))).alias("bonus")), f"WITH {ITEMS_SQL} SELECT category, colour, round(sum(greatest((colour = 'red')::INT, 0.5 * (split_part(grp, ' ', -1) = 'red')::INT, exp(-power((code % 50) / 25, 2)))), 6) bonus FROM items GROUP BY 1, 2")
register("V21_reference_bonus", lambda s, d: table(s, d, "embeddings").select("vec_id", r6(V.reference_bonus(F.col("embedding")[0].cast("double") * 50, F.col("embedding")[1].cast("double") * 50, F.col("embedding")[2].cast("double") * 50, (1.0, 2.0, 3.0))).alias("bonus")), "SELECT vec_id, round(exp(-power(sqrt(power((embedding[1]::DOUBLE * 50 - 1) * 0.4, 2) + power(embedding[2]::DOUBLE * 50 - 2, 2) + power(embedding[3]::DOUBLE * 50 - 3, 2)) / 12, 2)), 6) bonus FROM embeddings")
register("V22_top_posts", lambda s, d: _parts(s, d).withColumn("total", r6("total")).orderBy(F.desc("total"), "post").limit(24), _PARTS_SQL + " ORDER BY total DESC, post LIMIT 24")
register("V24_suppression", lambda s, d: V.suppress(items(s, d).groupBy(F.col("post").alias("photo"), F.col("code").alias("id"), "category").agg(F.max("confidence").alias("confidence")).withColumn("box", F.transform(F.array(F.col("id") % 7, F.col("id") % 5, F.col("id") % 7 + 4, F.col("id") % 5 + 6), lambda x: x.cast("double")))), f"""WITH RECURSIVE {ITEMS_SQL}, g AS (SELECT post AS photo, code AS id, category, max(confidence) confidence FROM items GROUP BY ALL),
 b AS (SELECT *, (id % 7)::DOUBLE x, (id % 5)::DOUBLE y, row_number() OVER (PARTITION BY photo ORDER BY confidence DESC, id, category) k FROM g),
 r AS (SELECT photo, k, [{{'k': k, 'x': x, 'y': y}}] AS kept FROM b WHERE k = 1
  UNION ALL SELECT r.photo, b.k, CASE WHEN len(list_filter(kept, lambda q: greatest(4 - abs(q.x - b.x), 0) * greatest(6 - abs(q.y - b.y), 0) / (48 - greatest(4 - abs(q.x - b.x), 0) * greatest(6 - abs(q.y - b.y), 0)) > 0.5)) > 0 THEN kept ELSE list_append(kept, {{'k': b.k, 'x': b.x, 'y': b.y}}) END FROM r JOIN b ON b.photo = r.photo AND b.k = r.k + 1),
 l AS (SELECT photo, unnest(arg_max(kept, k)).k k FROM r GROUP BY 1)
SELECT photo, arg_min(id, k) id, category, arg_min(confidence, k) confidence FROM l JOIN b USING (photo, k) GROUP BY photo, category""")
register("V25_best_crop", lambda s, d: V.best_crop(items(s, d), "category", "code", F.col("code") % 100), f"WITH {ITEMS_SQL} SELECT category, arg_max(code, (confidence, -code)) code FROM items WHERE confidence >= 0.4 AND code % 100 BETWEEN 2 AND 55 GROUP BY 1")

# Metrics.  A query's targets are the vectors of its label.
_SC = lambda s, d: _top(s, d).where("code <> query_id").select("query_id", F.col("code").alias("key"), "score", (F.col("label") == F.col("query_id") % 10).alias("is_target"))
_SC_SQL = TOP + ", sc AS (SELECT query_id, code, s, label = query_id % 10 AS t FROM top WHERE code <> query_id), rp AS (SELECT query_id, coalesce(min(k) FILTER (WHERE t), count(*) + 1) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, code) k FROM sc) GROUP BY 1)"
register("W1_rank_strict", lambda s, d: M.rank_strict(_SC(s, d)), _SC_SQL + " SELECT query_id, count(*) FILTER (WHERE s > m) + 1 AS rank FROM (SELECT *, max(s) FILTER (WHERE t) OVER (PARTITION BY query_id) m FROM sc) WHERE m IS NOT NULL GROUP BY 1")
register("W2_rank_positional", lambda s, d: M.rank_positional(_SC(s, d)), _SC_SQL + " SELECT query_id, rank FROM rp")
register("W3_scoped_rank", lambda s, d: M.rank_strict(_SC(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", F.col("key") % 3))).where("n >= 2 AND key % 3 = query_id % 3").select("query_id", "key", "score", "is_target")), _SC_SQL + " SELECT query_id, count(*) FILTER (WHERE s > m) + 1 AS rank FROM (SELECT *, max(s) FILTER (WHERE t) OVER (PARTITION BY query_id) m FROM (SELECT *, count(*) OVER (PARTITION BY query_id, code % 3) n FROM sc) WHERE n >= 2 AND code % 3 = query_id % 3) WHERE m IS NOT NULL GROUP BY 1")
_METRICS = "round(avg((rank <= 1)::INT), 6) r_at_1, round(avg((rank <= 5)::INT), 6) r_at_5, round(avg((rank <= 10)::INT), 6) r_at_10, round(avg(1 / rank), 6) mrr, median(rank) median, quantile_disc(rank, 0.5)::DOUBLE lower_median, round(avg(rank), 6) mean_rank"
register("W5_retrieval_metrics", lambda s, d: M.retrieval_metrics(M.rank_positional(_SC(s, d))).withColumns({c: r6(c) for c in ("r_at_1", "r_at_5", "r_at_10", "mrr", "mean_rank")}), _SC_SQL + f" SELECT {_METRICS} FROM rp")
register("W7_confusion_split", lambda s, d: M.top_one_split(M.first_of(_top(s, d).where("code <> query_id"), "rank"), F.col("label") == F.col("query_id") % 10).select(r6("same_model").alias("same_model"), r6("unrelated").alias("unrelated")), _SC_SQL + " SELECT round(avg(t::INT), 6) same_model, round(avg((NOT t)::INT), 6) unrelated FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, code) k FROM sc) WHERE k = 1")
register("W8_shortlist_miss", lambda s, d: M.miss_rate(_SC(s, d)).select(r6("miss_rate").alias("miss_rate")), _SC_SQL + " SELECT round(avg((NOT f)::INT), 6) miss_rate FROM (SELECT bool_or(t) f FROM sc GROUP BY query_id)")
_LAB = lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"), "lang", "toxic")
_LAB_SQL = "WITH l AS (SELECT n_chars::DOUBLE score, quality = 1 AS positive, lang, toxic FROM documents JOIN labels USING (doc_id))"
_AUC = "sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)"
register("W9_auroc", lambda s, d: M.auroc(_LAB(s, d)).select(r6("auroc").alias("auroc")), _LAB_SQL + f" SELECT round({_AUC}, 6) auroc FROM l a JOIN l b ON a.positive AND NOT b.positive")
register("W10_auroc_by_group", lambda s, d: M.auroc(_LAB(s, d), "lang").withColumn("auroc", r6("auroc")), _LAB_SQL + f" SELECT a.lang, round({_AUC}, 6) auroc FROM l a JOIN l b ON a.positive AND NOT b.positive AND a.lang = b.lang GROUP BY 1 UNION ALL SELECT lang, NULL FROM l GROUP BY 1 HAVING bool_and(positive) OR NOT bool_or(positive)")
register("W12_operating_table", lambda s, d: M.operating_table(_LAB(s, d)).withColumns({c: r6(c) for c in ("threshold", "false_reject", "false_accept")}), _LAB_SQL + ", q AS (SELECT unnest([1, 2, 5, 10, 20, 30, 50]) percentile, unnest((SELECT quantile_cont(score, [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]) FROM l WHERE positive)) threshold) SELECT percentile, round(threshold, 6) threshold, round(count(*) FILTER (WHERE positive AND score < threshold) / count(*) FILTER (WHERE positive), 6) false_reject, round(count(*) FILTER (WHERE NOT positive AND score >= threshold) / count(*) FILTER (WHERE NOT positive), 6) false_accept FROM l CROSS JOIN q GROUP BY percentile, threshold")
register("W12_best_threshold", lambda s, d: M.best_threshold(_LAB(s, d)).withColumn("cost", r6("cost")), _LAB_SQL + " SELECT t AS threshold, round(c, 6) cost FROM (SELECT x.score t, round(count(*) FILTER (WHERE positive AND l.score < x.score) / count(*) FILTER (WHERE positive) + count(*) FILTER (WHERE NOT positive AND l.score >= x.score) / count(*) FILTER (WHERE NOT positive), 12) c FROM l CROSS JOIN (SELECT DISTINCT score FROM l) x GROUP BY 1) ORDER BY c, t LIMIT 1")
register("W14_wilson", lambda s, d: items(s, d).groupBy("brand").agg(F.count_if(F.col("confidence") > 0.5).alias("h"), F.count(F.lit(1)).alias("n")).select("brand", *[r6(x).alias(c) for x, c in zip(M.wilson(F.col("h"), F.col("n")), ("low", "high"))]), f"WITH {ITEMS_SQL}, g AS (SELECT brand, count(*) FILTER (WHERE confidence > 0.5) / count(*) p, count(*) n FROM items GROUP BY 1) SELECT brand, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) high FROM g")
_CLS = lambda s, d: table(s, d, "labels").select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("predicted"))
register("W16_class_report", lambda s, d: M.class_report(_CLS(s, d)).withColumns({c: r6(c) for c in ("precision", "recall", "f1")}), "WITH c AS (SELECT x.cls, count(*) FILTER (WHERE quality = x.cls AND toxic = x.cls) tp, count(*) FILTER (WHERE toxic = x.cls) pn, count(*) FILTER (WHERE quality = x.cls) support FROM labels CROSS JOIN (SELECT unnest([0, 1]) cls) x GROUP BY 1), m AS (SELECT cls, support, tp / greatest(pn, 1) p, tp / greatest(support, 1) r FROM c) SELECT cls::VARCHAR cls, support, round(p, 6) AS precision, round(r, 6) recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) f1 FROM m")
register("W17_macro_f1", lambda s, d: M.macro_f1(_CLS(s, d)).select(r6("macro_f1").alias("macro_f1")), "WITH c AS (SELECT x.cls, count(*) FILTER (WHERE quality = x.cls AND toxic = x.cls) tp, count(*) FILTER (WHERE toxic = x.cls) pn, count(*) FILTER (WHERE quality = x.cls) support FROM labels CROSS JOIN (SELECT unnest([0, 1]) cls) x GROUP BY 1), m AS (SELECT tp / greatest(pn, 1) p, tp / greatest(support, 1) r FROM c WHERE support > 0) SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) macro_f1 FROM m")
register("W18_confusion", lambda s, d: table(s, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).select("quality", F.col("0").alias("clean"), F.col("1").alias("toxic")), "SELECT quality, count(*) FILTER (WHERE toxic = 0) clean, count(*) FILTER (WHERE toxic = 1) toxic FROM labels GROUP BY 1")
_SWEEP = lambda s, d: items(s, d).select(F.col("colour").alias("truth"), F.when(F.col("code") % 3 == 0, "red").otherwise(F.col("colour")).alias("predicted"), F.col("confidence").alias("score"))
register("W19_abstain_sweep", lambda s, d: M.abstain_sweep(_SWEEP(s, d), [0.0, 0.25, 0.5, 0.75, 1.0]).withColumns({c: r6(c) for c in ("fire_rate", "precision", "recall")}), f"WITH {ITEMS_SQL}, t AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE threshold), r AS (SELECT *, code % 3 <> 0 OR colour = 'red' AS ok FROM items) SELECT threshold, round(avg((confidence >= threshold)::INT), 6) fire_rate, round(count(*) FILTER (WHERE ok AND confidence >= threshold) / greatest(count(*) FILTER (WHERE confidence >= threshold), 1), 6) AS precision, round(count(*) FILTER (WHERE ok AND confidence >= threshold) / count(*), 6) recall FROM r CROSS JOIN t GROUP BY 1")
register("W22_overlap", lambda s, d: M.overlap(_LAB(s, d), "lang"), _LAB_SQL + " SELECT lang, count(*) FILTER (WHERE positive AND score < tn) pos_below, count(*) FILTER (WHERE NOT positive AND score > lp) neg_above FROM (SELECT *, max(score) FILTER (WHERE NOT positive) OVER (PARTITION BY lang) tn, min(score) FILTER (WHERE positive) OVER (PARTITION BY lang) lp FROM l) GROUP BY 1")
register("W23_precision_at_k", lambda s, d: M.precision_at(items(s, d).where("source <> 'N'"), "category", [F.desc("confidence"), "post", "ix", "code"], F.col("source") == "R").withColumn("precision", r6("precision")), f"WITH {ITEMS_SQL} SELECT category, round(avg((source = 'R')::INT), 6) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, post, ix, code) k FROM items WHERE source <> 'N') WHERE k <= 15 GROUP BY 1")
register("W24_quantile_recall", lambda s, d: M.positive_floor(_LAB(s, d)).select("lowest", r6("at_share").alias("q01")), _LAB_SQL + " SELECT min(score) lowest, round(quantile_cont(score, 0.01), 6) q01 FROM l WHERE positive")
register("W25_paired_agreement", lambda s, d: M.agreement(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "lang", "quality", "toxic").withColumn("agreement", r6("agreement")), "SELECT lang, round(avg((quality = toxic)::INT), 6) agreement, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
register("W26_enrollment_gap", lambda s, d: M.recall_by_cohort(M.rank_positional(_SC(s, d)), F.col("query_id") % 40 == 0).withColumn("r_at_1", r6("r_at_1")), _SC_SQL + " SELECT query_id % 40 = 0 AS unseen, round(avg((rank <= 1)::INT), 6) r_at_1, count(*) n FROM rp GROUP BY 1")
register("W27_deep_diff", lambda s, d: M.deep_diff(*[table(s, d, "events").select(F.col("event_id").alias("id"), F.explode(F.create_map(F.lit("type"), "event_type", F.lit("k"), F.get_json_object("props", "$.k") if i else F.when(F.col("event_id") % 50 == 0, "x").otherwise(F.get_json_object("props", "$.k")), F.lit("latency"), F.lit(str(i))))).toDF("id", "path", "value") for i in (0, 1)], ["latency"]), "SELECT event_id AS id, 'k' AS path, 'x' AS \"left\", json_extract_string(props, '$.k') AS \"right\" FROM events WHERE event_id % 50 = 0 AND 'x' IS DISTINCT FROM json_extract_string(props, '$.k')")
register("V17_fixed_gallery", lambda s, d: table(s, d, "embeddings").select("vec_id", "label").orderBy(F.sha1(F.concat_ws(":", F.lit("42"), F.col("vec_id").cast("string"))), "vec_id").limit(100), "SELECT vec_id, label FROM embeddings ORDER BY sha1('42:' || vec_id), vec_id LIMIT 100")
register("J16_within_category", lambda s, d: V.nearest_of_group(table(s, d, "embeddings"), "vec_id", "label", 1).select("query_id", F.col("code").alias("nearest")).join(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(table(s, d, "embeddings").groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")), "label").select("query_id", "nearest", "n"), f"SELECT a.vec_id AS query_id, arg_max(b.vec_id, ({SIM}, -b.vec_id)) nearest, count(*) n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
register("W4_multi_positive_rank", lambda s, d: M.rank_strict(_top(s, d).where("code <> query_id").select("query_id", F.col("code").alias("key"), "score", F.col("label").isin(1, 4, 7).alias("is_target"))), TOP + " SELECT query_id, count(*) FILTER (WHERE s > m) + 1 AS rank FROM (SELECT *, max(s) FILTER (WHERE label IN (1, 4, 7)) OVER (PARTITION BY query_id) m FROM top WHERE code <> query_id) WHERE m IS NOT NULL GROUP BY 1")
register("W6_lower_median", lambda s, d: M.retrieval_metrics(M.rank_positional(_SC(s, d)).withColumn("g", F.col("query_id") % 3), "g").select("g", "lower_median", "median"), _SC_SQL + " SELECT query_id % 3 g, quantile_disc(rank, 0.5)::DOUBLE lower_median, median(rank) median FROM rp GROUP BY 1")
register("W11_auroc_toxic", lambda s, d: M.auroc(_LAB(s, d).withColumn("positive", F.col("toxic") == 1)).select(r6("auroc").alias("auroc")), _LAB_SQL + f" SELECT round({_AUC}, 6) auroc FROM l a JOIN l b ON a.toxic = 1 AND b.toxic = 0")
register("W13_reject_sweep", lambda s, d: M.operating_table(_LAB(s, d), (1, 5, 10, 15, 20)).select("percentile", r6("threshold").alias("threshold"), r6("false_reject").alias("false_reject")), _LAB_SQL + ", q AS (SELECT unnest([1, 5, 10, 15, 20]) percentile, unnest((SELECT quantile_cont(score, [0.01, 0.05, 0.1, 0.15, 0.2]) FROM l WHERE positive)) threshold) SELECT percentile, round(threshold, 6) threshold, round(count(*) FILTER (WHERE positive AND score < threshold) / count(*) FILTER (WHERE positive), 6) false_reject FROM l CROSS JOIN q GROUP BY percentile, threshold")


def _pair_score(s, d):
    verdicts = items(s, d).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "R").alias("correct"), F.count_if(F.col("source") == "A").alias("missed"))
    low, high = M.wilson(F.col("correct"), F.col("n"))
    return verdicts.select("brand", "n", "correct", "missed", r6(low).alias("low"), r6(high).alias("high"))


register("W15_pair_score", _pair_score, f"WITH {ITEMS_SQL}, g AS (SELECT brand, count(*) n, count(*) FILTER (WHERE source = 'R') correct, count(*) FILTER (WHERE source = 'A') missed FROM items GROUP BY 1) SELECT brand, n, correct, missed, round((correct / n + 3.8416 / (2 * n) - 1.96 * sqrt(correct / n * (1 - correct / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) low, round((correct / n + 3.8416 / (2 * n) + 1.96 * sqrt(correct / n * (1 - correct / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) high FROM g")
register("W20_fire_rates", lambda s, d: M.abstain_sweep(_SWEEP(s, d), [0.1, 0.3, 0.9]).select("threshold", r6("fire_rate").alias("fire_rate")), f"WITH {ITEMS_SQL}, t AS (SELECT unnest([0.1, 0.3, 0.9])::DOUBLE threshold) SELECT threshold, round(avg((confidence >= threshold)::INT), 6) fire_rate FROM items CROSS JOIN t GROUP BY 1")
register("W21_verdicts_by_brand", lambda s, d: M.class_report(items(s, d).select(F.col("colour").alias("truth"), F.when(F.col("code") % 3 == 0, "red").otherwise(F.col("colour")).alias("predicted"))).select("cls", "support", r6("precision").alias("precision"), r6("recall").alias("recall")), f"WITH {ITEMS_SQL}, p AS (SELECT colour t, CASE WHEN code % 3 = 0 THEN 'red' ELSE colour END p FROM items) SELECT x.c AS cls, count(*) FILTER (WHERE t = x.c) support, round(count(*) FILTER (WHERE t = x.c AND p = x.c) / greatest(count(*) FILTER (WHERE p = x.c), 1), 6) AS precision, round(count(*) FILTER (WHERE t = x.c AND p = x.c) / greatest(count(*) FILTER (WHERE t = x.c), 1), 6) recall FROM p CROSS JOIN (SELECT DISTINCT colour c FROM items) x GROUP BY 1")


# Judged items: the verdict and the rank of the right candidate follow from the item's keys, the first score is its confidence.
_JUDGED = lambda s, d: items(s, d).select(F.when(F.col("code") % 4 == 0, "absent").when(F.col("code") % 4 == 1, "missed").when(F.col("code") % 40 == 2, "skip").otherwise("correct").alias("verdict"), F.when((F.col("code") % 4 > 1) & (F.col("code") % 40 != 2), F.col("post") % 12 + 1).alias("rank"), F.when(F.col("ix") % 6 > 0, F.col("confidence") + F.when(F.col("code") % 4 > 1, 0.004).otherwise(0.0)).alias("top1"))
_JUDGED_SQL = f"WITH {ITEMS_SQL}, j AS (SELECT CASE WHEN code % 4 = 0 THEN 'absent' WHEN code % 4 = 1 THEN 'missed' WHEN code % 40 = 2 THEN 'skip' ELSE 'correct' END AS verdict, CASE WHEN code % 4 > 1 AND code % 40 <> 2 THEN post % 12 + 1 END AS rank, CASE WHEN ix % 6 > 0 THEN confidence + CASE WHEN code % 4 > 1 THEN 0.004 ELSE 0 END END AS top1 FROM items)"
register("W15_recall_at_k", lambda s, d: M.pair_recall(_JUDGED(s, d)).withColumns({c: r6(c) for c in ("recall", "low", "high")}), _JUDGED_SQL + ", n AS (SELECT k, count(*) FILTER (WHERE verdict = 'correct' AND rank <= k) AS hits, count(*) FILTER (WHERE verdict IN ('correct', 'missed')) AS n FROM j CROSS JOIN (SELECT unnest([1, 5, 10])::INT AS k) GROUP BY k) SELECT k, hits, n, round(hits / n, 6) AS recall, round((hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM n")
register("W15_open_set", lambda s, d: M.open_set_table(_JUDGED(s, d)).withColumns({c: r6(c) for c in ("false_reject", "false_accept")}), _JUDGED_SQL + ", c AS (SELECT top1 FROM j WHERE verdict = 'correct' AND rank = 1 AND top1 IS NOT NULL), a AS (SELECT top1 FROM j WHERE verdict = 'absent' AND top1 IS NOT NULL) SELECT threshold, round((SELECT avg((top1 < threshold)::INT) FROM c), 6) AS false_reject, round((SELECT avg((top1 >= threshold)::INT) FROM a), 6) AS false_accept FROM (SELECT DISTINCT round_even(top1, 2) AS threshold FROM (FROM c UNION ALL FROM a))")
_SAID_SQL = f"WITH {ITEMS_SQL}, r AS (SELECT colour AS truth, CASE WHEN confidence >= 0.05 THEN CASE WHEN code % 3 = 0 THEN 'red' ELSE colour END END AS said FROM items)"
register("W19_abstain_report", lambda s, d: M.abstain_report(_SWEEP(s, d), 0.05).withColumns({c: r6(c) for c in ("recall", "precision", "abstain")}), _SAID_SQL + ", e AS (SELECT c AS cls, count(*) FILTER (WHERE truth = c) AS support, count(*) FILTER (WHERE truth = c AND said IS NULL) AS abstained, count(*) FILTER (WHERE truth = c AND said = c) AS tp, count(*) FILTER (WHERE truth <> c AND said = c) AS fp FROM r CROSS JOIN (SELECT DISTINCT truth AS c FROM r) GROUP BY c UNION ALL SELECT 'OVERALL', count(*), count(*) FILTER (WHERE said IS NULL), count(*) FILTER (WHERE said = truth), count(*) FILTER (WHERE said <> truth) FROM r) SELECT cls, support, tp, fp, round(tp / support, 6) AS recall, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, round(abstained / support, 6) AS abstain FROM e")
register("W19_abstain_confusion", lambda s, d: M.abstain_confusion(_SWEEP(s, d), 0.05), _SAID_SQL + " SELECT truth, coalesce(said, '(abstain)') AS said, count(*) AS n FROM r GROUP BY ALL")
