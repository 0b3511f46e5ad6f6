"""Queries of §P, §J and §A."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import dot
from tessera.operators import metrics as M
from tessera.operators import relational as R
from tessera.operators import taxonomy as H
from tessera.plans.catalog import register
from tessera.sources.tables import ITEMS_SQL, POSTS_SQL, items, posts, table

W = f"WITH {ITEMS_SQL}, {POSTS_SQL} "
SIM = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
r6 = lambda c: F.round(c, 6)


register("P1_section_excluded", lambda s, d: posts(s, d).where(~R.section_excluded(F.col("status"), F.col("section"), ("P",), ("build", "house"))).select("post", "section", "status"), W + "SELECT post, section, status FROM posts WHERE NOT (status = 'P' OR contains(lower(section), 'build') OR contains(lower(section), 'house'))")
register("P2_matchable", lambda s, d: posts(s, d).where(~R.section_excluded(F.col("status"), F.col("section"), (), ("machinery",))).groupBy("section").agg(F.count(F.lit(1)).alias("n")), W + "SELECT section, count(*) n FROM posts WHERE NOT contains(lower(section), 'machinery') GROUP BY 1")
register("P3_matchable_sections", lambda s, d: posts(s, d).withColumn("ok", ~R.section_excluded(F.col("status"), F.col("section"), ("F",), ("auto",))).groupBy("ok").agg(F.count(F.lit(1)).alias("n")), W + "SELECT NOT (status = 'F' OR contains(lower(section), 'auto')) ok, count(*) n FROM posts GROUP BY 1")
register("P4_candidate_posts", lambda s, d: posts(s, d).where((F.col("price") >= 1000) & (F.col("status") != "P") & F.lower(F.trim("priority")).isin("1-urgent", "2-high")).select("post"), W + "SELECT post FROM posts WHERE price >= 1000 AND status <> 'P' AND lower(trim(priority)) IN ('1-urgent', '2-high')")
register("P5_facet_filter", lambda s, d: R.facet_filter(items(s, d), ["gear", "bolt"], ["red", "blue"]), W + "SELECT post FROM items GROUP BY 1 HAVING bool_or(category IN ('gear', 'bolt')) AND bool_or(colour IN ('red', 'blue'))")
register("P6_gate_or_all", lambda s, d: R.gate_or_all(items(s, d).select("post", "code", "category"), F.col("category") == "gear", "post"), W + "SELECT post, code, category, filter_applied FROM (SELECT post, code, category, bool_or(category = 'gear') OVER (PARTITION BY post) filter_applied FROM items) WHERE category = 'gear' OR NOT filter_applied")
register("P7_post_filter", lambda s, d: R.gate_or_all(items(s, d).select("post", "colour", "code"), F.col("colour") == "old", "post").groupBy("filter_applied").agg(F.count(F.lit(1)).alias("n")), W + "SELECT filter_applied, count(*) n FROM (SELECT colour, bool_or(colour = 'old') OVER (PARTITION BY post) filter_applied FROM items) WHERE colour = 'old' OR NOT filter_applied GROUP BY 1")
register("P8_in_vocabulary", lambda s, d: items(s, d).groupBy("post").agg(F.collect_set(F.struct("category", "colour")).alias("g")).select("post", F.size(F.filter("g", lambda g: g["category"].isin("gear", "rod", "ring") & g["colour"].isin("red", "old"))).cast("long").alias("n")), W + "SELECT post, count(DISTINCT (category, colour)) FILTER (WHERE category IN ('gear','rod','ring') AND colour IN ('red','old')) n FROM items GROUP BY 1")


def _margins(s, d):
    v = table(s, d, "embeddings")
    prompts = F.broadcast(v.where("vec_id < 8").select(F.col("embedding").alias("e2"), (F.col("vec_id") < 4).alias("positive")))
    return R.margin(v.crossJoin(prompts).select("vec_id", "positive", dot("embedding", "e2").alias("sim")), "vec_id", 0.010)


_MARGIN = f"SELECT a.vec_id, max({SIM}) FILTER (WHERE b.vec_id < 4) - max({SIM}) FILTER (WHERE b.vec_id >= 4) m FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 8) b GROUP BY 1"
register("P9_gate_margin", lambda s, d: _margins(s, d).withColumn("margin", r6("margin")), f"SELECT vec_id, round(m, 6) margin, m >= 0.010 passes FROM ({_MARGIN})")
register("P10_gate_rates", lambda s, d: _margins(s, d).agg(F.count_if("passes").alias("passed"), F.count(F.lit(1)).alias("n")), f"SELECT count(*) FILTER (WHERE m >= 0.010) passed, count(*) n FROM ({_MARGIN})")
register("P11_margin_ranking", lambda s, d: _margins(s, d).orderBy(F.desc("margin"), "vec_id").limit(20).select("vec_id", r6("margin").alias("margin")), f"SELECT vec_id, round(m, 6) margin FROM ({_MARGIN}) ORDER BY m DESC, vec_id LIMIT 20")
register("P12_accept_or_abstain", lambda s, d: items(s, d).groupBy(F.coalesce(R.accept(F.when(F.col("source") == "N", "match"), F.col("confidence"), F.col("brand"), 0.5), F.lit("(abstain)")).alias("predicted")).agg(F.count(F.lit(1)).alias("n")), W + "SELECT coalesce(CASE WHEN source = 'N' AND confidence >= 0.5 THEN brand END, '(abstain)') predicted, count(*) n FROM items GROUP BY 1")
register("P13_view_keep", lambda s, d: table(s, d, "embeddings").select("vec_id", F.array_position("embedding", F.array_max("embedding")).alias("label")).where(F.col("label") % 2 == 0), "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS label FROM embeddings WHERE list_position(embedding, list_max(embedding)) % 2 = 0")

# Joins
register("J1_backfill", lambda s, d: R.backfill(table(s, d, "orders").select(F.col("o_orderkey").alias("post"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("section")), posts(s, d), "post", "section"), W + "SELECT o_orderkey AS post, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, section) section FROM orders LEFT JOIN posts ON post = o_orderkey")
register("J2_composite_key", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(items(s, d).where("source = 'R'").groupBy(F.col("post").alias("l_orderkey"), F.col("ix").alias("l_linenumber")).agg(F.max("confidence").alias("rgb")), ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rgb", F.col("rgb").isNotNull().alias("has_rgb")), W + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rgb, rgb IS NOT NULL has_rgb FROM lineitem LEFT JOIN (SELECT post, ix, max(confidence) rgb FROM items WHERE source = 'R' GROUP BY 1, 2) ON post = l_orderkey AND ix = l_linenumber")
register("J3_group_index", lambda s, d: items(s, d).groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")), W + "SELECT post, count(*) n, string_agg(DISTINCT category, ',' ORDER BY category) categories FROM items GROUP BY 1")
_IDENT = lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("code"), F.concat_ws(" ", "p_brand", "p_name").alias("identity"))
register("J4_identity_to_codes", lambda s, d: _IDENT(s, d).groupBy("identity").agg(F.min("code").alias("score")).join(_IDENT(s, d), "identity"), "SELECT identity, score, p_partkey AS code FROM (SELECT concat_ws(' ', p_brand, p_name) AS identity, min(p_partkey) score FROM part GROUP BY 1) JOIN part ON identity = concat_ws(' ', p_brand, p_name)")
register("J5_shortlist_semi", lambda s, d: _IDENT(s, d).join(items(s, d).where("source = 'R'").select("code"), "code", "left_semi"), W + "SELECT p_partkey AS code, concat_ws(' ', p_brand, p_name) AS identity FROM part WHERE p_partkey IN (SELECT code FROM items WHERE source = 'R')")
register("J6_open_set_anti", lambda s, d: _IDENT(s, d).join(items(s, d).where("confidence > 0.98").select("code"), "code", "left_anti"), W + "SELECT p_partkey AS code, concat_ws(' ', p_brand, p_name) AS identity FROM part WHERE p_partkey NOT IN (SELECT code FROM items WHERE confidence > 0.98)")
_ONE = "one AS (SELECT post, category, count(DISTINCT colour) k, min(colour) colour, n_crops FROM items LEFT JOIN (SELECT post, category, count(*) n_crops FROM items WHERE confidence >= 0.5 GROUP BY 1, 2) USING (post, category) GROUP BY post, category, n_crops), two AS (SELECT *, CASE WHEN n_crops IS NULL THEN 'no crop' WHEN n_crops > 1 THEN 'several crops' WHEN k > 1 THEN 'several values' ELSE 'kept' END reason FROM one)"
_one = lambda s, d: R.exactly_one(items(s, d), items(s, d).where("confidence >= 0.5"), ["post", "category"], "colour")
register("J7_exactly_one", lambda s, d: _one(s, d).where("reason = 'kept'").select("post", "category", "colour"), W + f", {_ONE} SELECT post, category, colour FROM two WHERE reason = 'kept'")
register("J7_skip_reasons", lambda s, d: _one(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), W + f", {_ONE} SELECT reason, count(*) n FROM two GROUP BY 1")
register("J8_rare_class_drop", lambda s, d: _one(s, d).where("reason = 'kept'").groupBy("category", "colour").agg(F.count(F.lit(1)).alias("n")).where("n >= 12"), W + f", {_ONE} SELECT category, colour, count(*) n FROM two WHERE reason = 'kept' GROUP BY 1, 2 HAVING count(*) >= 12")
_BOX = lambda x: F.array((x % 7).cast("double"), (x % 5).cast("double"), (x % 7 + 4).cast("double"), (x % 5 + 6).cast("double"))
register("J9_box_equality", lambda s, d: items(s, d).select("post", "ix", _BOX(F.col("code")).alias("box")).join(items(s, d).select("post", F.col("ix").alias("ix2"), _BOX(F.col("code")).alias("box2")), "post").where("box = box2 AND ix < ix2").groupBy("post").agg(F.count(F.lit(1)).alias("n")), W + "SELECT a.post, count(*) n FROM items a JOIN items b ON a.post = b.post AND a.ix < b.ix AND a.code % 7 = b.code % 7 AND a.code % 5 = b.code % 5 GROUP BY 1")
register("J10_best_iou", lambda s, d: R.best_overlap(items(s, d).where("source = 'R'").select("post", F.col("code").alias("id"), _BOX(F.col("code")).alias("box")).distinct(), items(s, d).where("source = 'N'").select("post", F.col("code").alias("other"), _BOX(F.col("code")).alias("other_box")).distinct(), "post", 0.3).withColumn("iou", r6("iou")), W + ", l AS (SELECT DISTINCT post, code id, (code % 7)::DOUBLE x, (code % 5)::DOUBLE y FROM items WHERE source = 'R'), r AS (SELECT DISTINCT post, code other, (code % 7)::DOUBLE u, (code % 5)::DOUBLE v FROM items WHERE source = 'N'), p AS (SELECT post, id, other, greatest(least(x, u) + 4 - greatest(x, u), 0) * greatest(least(y, v) + 6 - greatest(y, v), 0) i FROM l JOIN r USING (post)) SELECT post, id, other, round(i / (48 - i), 6) iou FROM (SELECT *, row_number() OVER (PARTITION BY post, id ORDER BY i / (48 - i) DESC, other) k FROM p WHERE i / (48 - i) > 0.3) WHERE k = 1")
register("J11_substring_either_way", lambda s, d: R.substring_pairs(table(s, d, "part").select(F.split("p_name", " ")[1].alias("query")), table(s, d, "part").select(F.lower("p_name").alias("label"))).groupBy("query").agg(F.count(F.lit(1)).alias("n")), "SELECT query, count(*) n FROM (SELECT DISTINCT lower(p_name) AS label FROM part) JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) query FROM part) ON contains(label, query) OR contains(query, label) GROUP BY 1")
register("J14_alias_subtraction", lambda s, d: table(s, d, "part").select(F.lower("p_brand").alias("alias")).distinct().join(items(s, d).where("confidence >= 0.9 AND category = 'gear' AND colour = 'red'").select(F.lower("brand").alias("alias")), "alias", "left_anti"), W + "SELECT DISTINCT lower(p_brand) AS alias FROM part WHERE lower(p_brand) NOT IN (SELECT lower(brand) FROM items WHERE confidence >= 0.9 AND category = 'gear' AND colour = 'red')")
register("J18_judged_pool", lambda s, d: items(s, d).withColumn("judged", F.col("source") != "N").where("judged").withColumn("k", F.row_number().over(R.Window.partitionBy("category").orderBy(F.desc("confidence"), "post", "ix", "code"))).where("k <= 15").select("category", "post", "code", "k"), W + "SELECT category, post, code, k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, post, ix, code) k FROM items WHERE source <> 'N') WHERE k <= 15")
register("J19_manifest_labels", lambda s, d: table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n")), "SELECT lang, quality, toxic, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
register("J20_last_path_term", lambda s, d: R.last_of_path(table(s, d, "part").select(F.col("p_partkey").alias("code"), F.split("p_name", " ").alias("path")), table(s, d, "part").select(F.split("p_name", " ")[0].alias("term")).distinct().withColumn("category", F.upper("term")).union(table(s, d, "part").where("p_size > 25").select(F.split("p_name", " ")[1].alias("term"), F.upper(F.split("p_name", " ")[1])).distinct())), "WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) term FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_size > 25) SELECT p_partkey AS code, upper(coalesce((SELECT term FROM t WHERE term = split_part(p_name, ' ', 2)), split_part(p_name, ' ', 1))) category FROM part")
register("J21_groups_renormalised", lambda s, d: R.renormalised(items(s, d).select(F.col("post").alias("region"), F.col("category").alias("cls"), F.col("confidence").alias("p")), s.createDataFrame([("gear", "a"), ("bolt", "a"), ("ring", "b"), ("rod", "b"), ("plate", "c"), ("gear", "b")], "cls string, grp string")).withColumn("share", r6("share")), W + ", m AS (SELECT * FROM (VALUES ('gear','a'),('bolt','a'),('ring','b'),('rod','b'),('plate','c'),('gear','b')) x(cls, grp)), s AS (SELECT post AS region, grp, round(sum(p), 9) mass FROM (SELECT post, category cls, sum(confidence) p FROM items GROUP BY 1, 2) JOIN m USING (cls) GROUP BY 1, 2), q AS (SELECT region, grp, mass / round(sum(mass) OVER (PARTITION BY region), 9) \"share\" FROM s) SELECT region, grp, round(\"share\", 6) \"share\" FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY \"share\" DESC, grp DESC) k FROM q) WHERE k = 1")

# Aggregates
register("A2_prototypes", lambda s, d: R.prototypes(table(s, d, "embeddings"), "label", "vec_id").select("label", r6(F.element_at("prototype", 1)).alias("first"), r6(F.element_at("prototype", -1)).alias("last")), "WITH f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) k FROM embeddings), u AS (SELECT label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) i FROM f WHERE k <= 6), m AS (SELECT label, i, avg(x) x FROM u GROUP BY 1, 2) SELECT label, round(max(x) FILTER (WHERE i = 1) / sqrt(sum(x * x)), 6) AS first, round(max(x) FILTER (WHERE i = 64) / sqrt(sum(x * x)), 6) AS last FROM m GROUP BY 1")
_VIEWS = lambda s, d: items(s, d).select(F.col("category").alias("query"), F.col("code").alias("product"), F.col("post").alias("view"), F.col("confidence").alias("score"))
register("A3_score_by_product", lambda s, d: R.by_product(_VIEWS(s, d)), W + "SELECT category AS query, code AS product, max(confidence) score, arg_max(post, (confidence, -post)) best_view, count(*) matched_views FROM items GROUP BY 1, 2")
register("A3_mean_by_product", lambda s, d: R.by_product(_VIEWS(s, d), "mean").select("query", "product", r6("score").alias("score")), W + "SELECT category AS query, code AS product, round(avg(confidence), 6) score FROM items GROUP BY 1, 2")
register("A4_best_image", lambda s, d: R.by_product(_VIEWS(s, d)).withColumn("k", F.row_number().over(R.Window.partitionBy("query").orderBy(F.desc("score"), "product"))).where("k <= 10").select("query", "product", "k"), W + "SELECT query, product, k FROM (SELECT category AS query, code AS product, row_number() OVER (PARTITION BY category ORDER BY max(confidence) DESC, code) k FROM items GROUP BY 1, 2) WHERE k <= 10")
register("A5_vocabulary", lambda s, d: R.vocabulary(items(s, d), F.substring("colour", 1, 1), "colour", F.col("confidence") < 0.1).withColumn("raw", F.array_join("raw", ",")), W + "SELECT substr(colour, 1, 1) canonical, string_agg(DISTINCT colour, ',' ORDER BY colour) raw, count(*) FILTER (WHERE confidence < 0.1) unmapped FROM items GROUP BY 1")
register("A6_taxonomy_tree", lambda s, d: H.tree(items(s, d), "grp", "category", "colour").select("grp", "n_categories", F.array_join(F.transform("categories", lambda x: F.concat(x["category"], F.lit(":"), F.array_join(x["leaves"], ","))), ";").alias("tree")), W + "SELECT grp, count(*) n_categories, string_agg(category || ':' || leaves, ';' ORDER BY category) tree FROM (SELECT grp, category, string_agg(DISTINCT colour, ',' ORDER BY colour) leaves FROM items GROUP BY 1, 2) GROUP BY 1")
register("A7_token_index", lambda s, d: R.token_index(table(s, d, "part"), ["p_name", "p_brand", "p_type"], ("the", "and", "new")), r"SELECT token, field, value, count(*) n FROM (SELECT field, value, unnest(regexp_extract_all(lower(value), '[a-z][a-z\-'']+')) token FROM (SELECT 'p_name' field, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part)) WHERE length(token) >= 3 AND token NOT IN ('the', 'and', 'new') GROUP BY ALL")
_LABELS = lambda: [F.lower("p_name"), F.split("p_name", " ")[1], F.concat_ws(" ", F.lower("p_brand"), F.split("p_name", " ")[1]), F.concat_ws(" ", F.lower("p_brand"), F.lower("p_name"))]
register("A8_label_index", lambda s, d: R.label_index(table(s, d, "part").withColumn("code", F.col("p_partkey")), _LABELS()).groupBy("label").agg(F.count(F.lit(1)).alias("n_codes"), F.min("code").alias("first_code")), "SELECT label, count(*) n_codes, min(code) first_code FROM (SELECT DISTINCT p_partkey code, unnest([lower(p_name), split_part(p_name, ' ', 2), lower(p_brand) || ' ' || split_part(p_name, ' ', 2), lower(p_brand) || ' ' || lower(p_name)]) AS label FROM part) GROUP BY 1")
register("A9_training_labels", lambda s, d: R.training_labels(table(s, d, "part").withColumn("code", F.col("p_partkey")), [F.col("p_name"), F.split("p_name", " ")[1], F.col("p_brand"), F.split("p_name", " ")[1], F.col("p_type")]).groupBy("kind", "i").agg(F.countDistinct("label").alias("labels"), F.count(F.lit(1)).alias("n")), "SELECT kind, i, count(DISTINCT label) labels, count(*) n FROM (SELECT p_partkey, unnest([{'i': 0, 'kind': 'model', 'label': p_name}, {'i': 1, 'kind': 'attribute', 'label': split_part(p_name, ' ', 2)}, {'i': 2, 'kind': 'attribute', 'label': p_brand}, {'i': 4, 'kind': 'generic', 'label': p_type}], recursive := true) FROM part) GROUP BY 1, 2")
register("A11_query_support", lambda s, d: items(s, d).groupBy("category", "colour").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("post").alias("n_posts")).where("n_posts >= 900"), W + "SELECT category, colour, count(*) n_pairs, count(DISTINCT post) n_posts FROM items GROUP BY 1, 2 HAVING count(DISTINCT post) >= 900")
register("A12_score_stats", lambda s, d: M.score_stats(items(s, d), "category", "confidence", 0.9, 0.1).withColumnRenamed("at_share", "p90"), W + "SELECT category, count(*) n, median(confidence) median, list_sort(list(confidence))[greatest(floor(0.9 * count(*))::INT, 1)] p90, count(*) FILTER (WHERE confidence < 0.1) gate_fails FROM items GROUP BY 1")
_FOLD = W + ", f AS (SELECT category, brand, post FROM items), k AS (SELECT brand FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE post % 10 < 7) >= 1650)"
_fold = lambda s, d: R.fold_rare(items(s, d), "brand", F.col("post") % 10 < 7, 1650)
register("A13_fold_rare", lambda s, d: _fold(s, d).groupBy("folded").agg(F.count(F.lit(1)).alias("n")), _FOLD + " SELECT CASE WHEN brand IN (FROM k) THEN brand ELSE 'other' END folded, count(*) n FROM f GROUP BY 1")
register("A14_bucket_coverage", lambda s, d: R.bucket_coverage(_fold(s, d), "brand").withColumn("folded_share", r6("folded_share")), _FOLD + " SELECT count(DISTINCT brand) raw, count(DISTINCT CASE WHEN brand IN (FROM k) THEN brand ELSE 'other' END) kept, round(avg((brand NOT IN (FROM k))::INT), 6) folded_share FROM f")
_PROBS = lambda s, d: items(s, d).select(F.col("code"), F.col("source").alias("cls"), F.col("confidence").alias("p"))
for _pool, _fn in (("mean", "avg"), ("max", "max")):
    register(f"A{15 if _pool == 'mean' else 16}_pooled_{_pool}", lambda s, d, p=_pool: R.pooled_class(_PROBS(s, d), "code", p).withColumn("p", F.round("p", 9)), W + f", a AS (SELECT code, source cls, {_fn}(confidence) p FROM items GROUP BY 1, 2), b AS (SELECT code, cls, p / sum(p) OVER (PARTITION BY code) p FROM a) SELECT code, cls, round(p, 9) p FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p DESC, cls DESC) k FROM b) WHERE k = 1")
register("A17_reason_counters", lambda s, d: items(s, d).groupBy("source", F.when(F.col("confidence") < 0.1, "low").otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n")), W + "SELECT source, CASE WHEN confidence < 0.1 THEN 'low' ELSE 'kept' END reason, count(*) n FROM items GROUP BY 1, 2")
register("A18_ratios", lambda s, d: items(s, d).groupBy("grp").agg(r6(F.count_if(F.col("confidence") > 0.5) / F.greatest(F.count_if(F.col("source") == "X"), F.lit(1))).alias("ratio"), r6(F.count(F.lit(1)) / F.greatest(F.countDistinct("post"), F.lit(1))).alias("per_post")), W + "SELECT grp, round(count(*) FILTER (WHERE confidence > 0.5) / greatest(count(*) FILTER (WHERE source = 'X'), 1), 6) ratio, round(count(*) / greatest(count(DISTINCT post), 1), 6) per_post FROM items GROUP BY 1")
_HITS = lambda s, d: items(s, d).groupBy("source", "category").agg(F.count_if(F.col("confidence") > 0.5).alias("hits"), F.count(F.lit(1)).alias("judged"))
register("A19_micro_macro", lambda s, d: R.micro_macro(_HITS(s, d), "source").withColumns({"micro": r6("micro"), "macro": r6("macro")}), W + "SELECT source, round(sum(hits) / sum(judged), 6) micro, round(avg(hits / judged), 6) macro FROM (SELECT source, category, count(*) FILTER (WHERE confidence > 0.5) hits, count(*) judged FROM items GROUP BY 1, 2) GROUP BY 1")
register("A20_nested_counters", lambda s, d: R.nested_counts(items(s, d), "source", "category"), W + "SELECT source, sum(n)::BIGINT total, '{' || string_agg('\"' || category || '\":' || n, ',' ORDER BY category) || '}' counts FROM (SELECT source, category, count(*) n FROM items GROUP BY 1, 2) GROUP BY 1")
register("J11_substrings_of_names", lambda s, d: R.substring_pairs(table(s, d, "customer").select(F.substring(F.col("c_name"), -4, 4).alias("query")).unionByName(table(s, d, "part").select(F.substring_index("p_name", " ", 1).alias("query"))).unionByName(table(s, d, "nation").select(F.lower("n_name").alias("query"))), table(s, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.lpad((F.col("p_partkey") * 37 % 5000).cast("string"), 5, "0")).alias("label")).unionByName(table(s, d, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("label")))), "WITH q AS (SELECT DISTINCT right(c_name, 4) AS query FROM customer UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT lower(n_name) FROM nation), l AS (SELECT DISTINCT lower(p_name) || ' ' || lpad((p_partkey * 37 % 5000)::VARCHAR, 5, '0') AS label FROM part UNION SELECT lower(left(r_name, 2)) FROM region) SELECT query, label FROM q JOIN l ON contains(label, query) OR contains(query, label)")
