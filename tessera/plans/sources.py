"""Queries of §S and §F.  Documents are made from the tables: a part is a product page, an order a post."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions import constants as K_
from tessera.functions import text as T
from tessera.functions.vectors import embed_rows, encoder, l2
from tessera.operators import curation as K
from tessera.operators import relational as R
from tessera.operators.admission import admit
from tessera.operators.dominant import dominant_colours
from tessera.operators.phrases import match_terms, parse_fragments
from tessera.plans.catalog import register
from tessera.sources import extract as X
from tessera.sources.records import append_new, records
from tessera.sources.store import arrow_batches, saved, shared_folder
from tessera.sources.tables import ITEMS_SQL, items, table

W = f"WITH {ITEMS_SQL} "
r6 = lambda c: F.round(c, 6)


def _posts(s, d):
    """Posts with their detections: two images each; posts without items have an empty list."""
    x = items(s, d).select("post", F.struct("ix", F.concat(F.lit("i"), (F.col("ix") % 2).cast("string")).alias("source_image"), "category", "colour", F.when(F.col("code") % 10 > 0, F.array(F.col("code") % 7, F.col("code") % 5)).alias("bbox"), "code").alias("x"))
    lists = x.groupBy("post").agg(F.array_sort(F.collect_list("x")).alias("items"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("post"), F.array(F.lit("i0"), F.lit("i1")).alias("images")).join(lists, "post", "left")


def _product_pages(s, d):
    """A part as a page with a product group of two variants; one part in five has no image."""
    v = lambda i: F.struct(F.concat_ws("-", "p_partkey", F.lit(i)).alias("sku"), F.split("p_name", " ")[0].alias("color"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("img"), F.lit(i))).alias("image"), F.col("p_retailprice").cast("string").alias("price"))
    doc = F.to_json(F.struct(F.lit("ProductGroup").alias("@type"), F.col("p_name").alias("name"), F.array(v("a"), v("b")).alias("hasVariant")))
    return table(s, d, "part").select("p_partkey", F.concat(F.lit('<html><script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">'), doc, F.lit("</script></html>")).alias("html"))


register("S1_scan_catalog", lambda s, d: table(s, d, "part"), "SELECT * FROM part")
register("S2_scan_posts", lambda s, d: table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
register("S3_image_rows", lambda s, d: X.image_rows(_posts(s, d)).select("post", "image", F.array_join("categories", ",").alias("categories"), F.array_join("colours", ",").alias("colours")), W + "SELECT o_orderkey AS post, image, CASE WHEN n IS NULL THEN NULL ELSE coalesce(categories, '') END categories, CASE WHEN n IS NULL THEN NULL ELSE coalesce(colours, '') END colours FROM orders CROSS JOIN (SELECT unnest(['i0', 'i1']) image) LEFT JOIN (SELECT post, count(*) n FROM items GROUP BY 1) c ON c.post = o_orderkey LEFT JOIN (SELECT post, 'i' || (ix % 2) image, string_agg(DISTINCT category, ',' ORDER BY category) categories, string_agg(DISTINCT colour, ',' ORDER BY colour) colours FROM items GROUP BY 1, 2) x ON x.post = o_orderkey AND x.image = image".replace("x.image = image", "x.image = i.image").replace("(SELECT unnest(['i0', 'i1']) image)", "(SELECT unnest(['i0', 'i1']) image) i").replace("o_orderkey AS post, image,", "o_orderkey AS post, i.image,"))
register("S4_item_rows", lambda s, d: X.item_rows(_posts(s, d)).select("post", "detection_index", "category", "code"), W + "SELECT post, (k - 1)::INT detection_index, category, code FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY ix, 'i' || (ix % 2), category, colour, code % 10 > 0, code % 7, code % 5, code) k FROM items) WHERE code % 10 > 0")
register("S5_flagged_items", lambda s, d: X.item_rows(_posts(s, d)).join(table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("code"), F.lit(True).alias("f")), "code", "left").groupBy(F.coalesce("f", F.lit(False)).alias("on_disk")).agg(F.count(F.lit(1)).alias("n")), W + "SELECT p_size > 25 AS on_disk, count(*) n FROM items JOIN part ON code = p_partkey WHERE code % 10 > 0 GROUP BY 1")
register("S6_first_image", lambda s, d: X.variants(_product_pages(s, d)).groupBy("p_partkey").agg(F.min("image").alias("image")), "SELECT p_partkey, 'imga' image FROM part WHERE p_partkey % 5 > 0")
register("S7_first_found", lambda s, d: X.first_found(table(s, d, "part").select(F.col("p_partkey").alias("key"), F.array(F.concat(F.lit("a/"), "p_name"), F.concat(F.lit("b/"), "p_brand"), F.concat(F.lit("c/"), "p_type")).alias("paths")), table(s, d, "part").where("p_size < 5").select(F.concat(F.lit("a/"), "p_name").alias("path")).union(table(s, d, "part").where("p_size < 2").select(F.concat(F.lit("b/"), "p_brand")))), "SELECT * FROM (SELECT p_partkey AS key, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size < 5) THEN 'a/' || p_name WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size < 2) THEN 'b/' || p_brand END AS path FROM part) WHERE path IS NOT NULL")
register("S8_fingerprint", lambda s, d: table(s, d, "part").select("p_partkey", T.fingerprint("p_name", "p_brand", "p_size").alias("fingerprint")), "SELECT p_partkey, md5(concat_ws('|', p_name, p_brand, p_size)) fingerprint FROM part")
register("S9_cache_consistent", lambda s, d: K.cache_check(table(s, d, "embeddings"), "vec_id", "embedding", 64), "SELECT count(vec_id) AS keys, count(*) FILTER (WHERE len(embedding) = 64) vectors, count(vec_id) = count(*) FILTER (WHERE len(embedding) = 64) usable FROM embeddings")
register("S10_last_write_wins", lambda s, d: K.last_write_wins(table(s, d, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"]), "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k = 1")
register("S11_append_new", lambda s, d: table(s, d, "events").select("event_id").join(table(s, d, "events").where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti"), "SELECT event_id FROM events WHERE event_id % 3 <> 0")
register("S13_embedded_json", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")), "SELECT event_id, json_extract(props, '$.k')::INT k FROM events")
register("S14_variants", lambda s, d: X.variants(_product_pages(s, d)).select("p_partkey", "name", "sku", "color"), "SELECT p_partkey, p_name AS name, p_partkey || '-' || i AS sku, split_part(p_name, ' ', 1) color FROM part CROSS JOIN (SELECT unnest(['a', 'b']) i) WHERE p_partkey % 5 > 0")
register("S15_list_items", lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(X.list_items(F.col("html"))).alias("k", "item")), r"SELECT page_id, (k - 1)::INT k, item FROM (SELECT page_id, unnest(x) item, generate_subscripts(x, 1) k FROM (SELECT page_id, [y FOR y IN [trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) FOR t IN regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<li>(.*?)</li>', 1)] IF length(y) > 0] x FROM pages))")
register("S17_image_urls", lambda s, d: table(s, d, "pages").select("page_id", F.array_join(X.image_urls(F.when(F.col("page_id") % 3 == 0, F.array(F.lit("g1"), F.lit("g2"))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")), F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".jpg"))).otherwise(F.col("url")), F.when(F.col("page_id") % 5 == 0, F.lit("p"))), ",").alias("urls")), "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'g1,g2' WHEN page_id % 2 = 0 THEN url || '.jpg' WHEN page_id % 5 = 0 THEN 'p' ELSE '' END urls FROM pages")
_LINKED = lambda s, d: items(s, d).withColumn("link", F.coalesce(F.when(F.col("code") % 3 == 0, F.col("brand")), F.col("category")))
register("S18_group_by_link", lambda s, d: _LINKED(s, d).groupBy("link").agg(F.count(F.lit(1)).alias("n")).join(X.first_of_link(_LINKED(s, d), "link", ["post", "ix", "code"], 3).groupBy("link").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "code"))), lambda x: x["code"].cast("string")), ",").alias("first")), "link"), W + "SELECT link, count(*) n, (SELECT string_agg(code::VARCHAR, ',' ORDER BY post, ix, code) FROM (SELECT DISTINCT post, ix, code FROM items i WHERE coalesce(CASE WHEN i.code % 3 = 0 THEN i.brand END, i.category) = link ORDER BY ALL LIMIT 3)) AS first FROM (SELECT coalesce(CASE WHEN code % 3 = 0 THEN brand END, category) link FROM items) GROUP BY 1")
_HOST_ID = lambda: [c.alias(n) for c, n in zip(X.host_and_id(F.col("url"), (r"/item/(\d+)", r"/p/([a-z0-9]+)")), ("host", "id"))]
register("S19_host_and_id", lambda s, d: table(s, d, "pages").select("page_id", *_HOST_ID()), r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') host, coalesce(nullif(regexp_extract(url, '/item/(\d+)', 1), ''), nullif(regexp_extract(url, '/p/([a-z0-9]+)', 1), ''), substr(sha1(url), 1, 16)) id FROM pages")
register("S20_upgrades", lambda s, d: table(s, d, "pages").select("page_id", F.array_join(X.upgrades(F.col("url"), (("^http:", "https:"), (r"\d+$", "0"))), " ").alias("tries")), r"SELECT page_id, concat_ws(' ', a, CASE WHEN b <> a THEN b END, CASE WHEN url <> a AND url <> b THEN url END) tries FROM (SELECT *, regexp_replace(url, '^http:', 'https:', 'g') a, regexp_replace(url, '\d+$', '0', 'g') b FROM pages)")
register("S21_common_schema", lambda s, d: table(s, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("source_id"), "url").unionByName(table(s, d, "documents").select("source", F.col("doc_id").alias("source_id")), allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("urls")), "SELECT source, count(*) n, count(url) urls FROM (SELECT 'pages' AS source, url FROM pages UNION ALL SELECT source, NULL FROM documents) GROUP BY 1")
register("S22_quota", lambda s, d: X.quota(table(s, d, "documents").select("doc_id", "lang", F.md5("text").alias("h")), "lang", "h", "doc_id", 200, ("de",)).select("doc_id", "lang"), "WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, lang) k FROM documents) WHERE k = 1) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) j FROM o) WHERE j <= CASE WHEN lang = 'de' THEN 25 ELSE 50 END")
register("S23_bins", lambda s, d: X.bins(table(s, d, "documents").select(F.col("source").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("n_chars").alias("size")), 20_000).groupBy("folder").agg((F.max("bin") + 1).alias("n_bins"), F.count(F.lit(1)).alias("n")), "WITH RECURSIVE f AS (SELECT source AS folder, n_chars size, row_number() OVER (PARTITION BY source ORDER BY doc_id) k FROM documents), r AS (SELECT folder, k, 0 bin, size used FROM f WHERE k = 1 UNION ALL SELECT f.folder, f.k, CASE WHEN used > 0 AND used + size > 20000 THEN bin + 1 ELSE bin END, CASE WHEN used > 0 AND used + size > 20000 THEN size ELSE used + size END FROM r JOIN f ON f.folder = r.folder AND f.k = r.k + 1) SELECT folder, max(bin)::BIGINT + 1 n_bins, count(*) n FROM r GROUP BY 1")
register("S24_collection_record", lambda s, d: table(s, d, "pages").select("page_id", F.length(X.strip_tags(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))).alias("title_chars")), r"SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')))::INT title_chars FROM pages")
register("S25_nested_unnest", lambda s, d: items(s, d).groupBy("brand", "category").agg(F.collect_set("colour").alias("colours")).groupBy("brand").agg(F.collect_list(F.struct("category", "colours")).alias("styles")).select("brand", F.explode("styles").alias("st")).select("brand", F.col("st.category").alias("category"), F.explode("st.colours").alias("colour")).where("colour <> 'old'"), W + "SELECT DISTINCT brand, category, colour FROM items WHERE colour <> 'old'")
register("S26_best_per_position", lambda s, d: X.best_per_position(items(s, d).select(F.col("code").alias("product"), F.col("ix").alias("position"), (F.col("confidence") > 0.9).alias("zoom"), F.col("post").alias("ord"), F.col("post").cast("string").alias("url"))).select("product", F.array_join("urls", ",").alias("urls")), W + "SELECT code AS product, string_agg(post::VARCHAR, ',' ORDER BY ix) urls FROM (SELECT *, row_number() OVER (PARTITION BY code, ix ORDER BY confidence > 0.9 DESC, post) k FROM items) WHERE k = 1 GROUP BY 1")
register("S27_map_lookup", lambda s, d: items(s, d).groupBy("brand").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("colour", "colour")))).alias("m")).select("brand", F.element_at("m", F.lit("red")).alias("red"), F.try_element_at("m", F.lit("plaid")).alias("plaid")), W + "SELECT brand, max(colour) FILTER (WHERE colour = 'red') red, NULL plaid FROM items GROUP BY 1")
register("S28_details", lambda s, d: table(s, d, "documents").select("doc_id", F.length(X.details(F.col("source"), F.col("text"))).alias("chars")), "SELECT doc_id, length(CASE WHEN length(coalesce(source, '')) < 40 AND length(coalesce(text, '')) > length(coalesce(source, '')) THEN text ELSE coalesce(source, '') END)::INT chars FROM documents")
register("S31_same_shot", lambda s, d: table(s, d, "embeddings").alias("a").join(table(s, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id").select("vec_id", r6(X.mean_difference(F.transform("embedding", lambda x: x.cast("double")), F.transform("e2", lambda x: x.cast("double")))).alias("diff")), "SELECT a.vec_id, round(list_avg([abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) FOR i IN range(1, 65)]), 6) \"diff\" FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")

# Functions
register("F1_normalize_text", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("h")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ,.')) h FROM documents")
register("F2_normalize_label", lambda s, d: table(s, d, "part").select("p_partkey", T.normalize_label(F.concat(F.lit(" The  "), "p_name")).alias("label")), "SELECT p_partkey, lower(p_name) AS label FROM part")
register("F3_display_brand", lambda s, d: table(s, d, "part").select("p_partkey", T.display_brand(F.lower("p_name"), {"red ring": "RED Ring"}).alias("brand")), "SELECT p_partkey, CASE WHEN lower(p_name) = 'red ring' THEN 'RED Ring' ELSE upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) END brand FROM part")
register("F4_brand_key", lambda s, d: table(s, d, "part").select("p_partkey", T.brand_key(F.col("p_brand")).alias("k")), "SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') k FROM part")
_RGB = lambda: [(F.col("p_partkey") * k % 256).cast("double") for k in (7, 11, 13)]
_LAB = lambda: C.rgb_to_lab(*_RGB())
_F = lambda t: f"CASE WHEN {t} > power(6.0 / 29, 3) THEN cbrt({t}) ELSE {t} * power(29.0 / 6, 2) / 3 + 4.0 / 29 END"
_LINE = "line AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey * {k} % 256 / 255.0 > 0.04045 THEN power((p_partkey * {k} % 256 / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE p_partkey * {k} % 256 / 255.0::DOUBLE / 12.92 END {c}" for k, c in ((7, "r"), (11, "g"), (13, "b"))) + " FROM part)"


def _lab_sql(m):
    xyz = ", ".join(f"({row[0]}::DOUBLE * r + {row[1]}::DOUBLE * g + {row[2]}::DOUBLE * b) / {w} {c}" for row, w, c in zip(m, C.WHITE, "xyz"))
    return f"WITH {_LINE}, xyz AS (SELECT p_partkey, {xyz} FROM line), f AS (SELECT p_partkey, {_F('x')} fx, {_F('y')} fy, {_F('z')} fz FROM xyz), lab AS (SELECT p_partkey, 116 * fy - 16 L, 500 * (fx - fy) a, 200 * (fy - fz) b FROM f)"


for _n, _m in (("F6", C.SRGB_7), ("F7", C.SRGB_4)):
    register(f"{_n}_lab", lambda s, d, m=_m: table(s, d, "part").select("p_partkey", C.rgb_to_lab(*_RGB(), m).alias("x")).select("p_partkey", *[r6(f"x.{c}").alias(c) for c in "Lab"]), _lab_sql(_m) + " SELECT p_partkey, round(L, 6) \"L\", round(a, 6) a, round(b, 6) b FROM lab")
register("F9_colour_similarity", lambda s, d: table(s, d, "part").select("p_partkey", r6(C.similarity(_LAB(), F.struct(F.lit(50.0).alias("L"), F.lit(10.0).alias("a"), F.lit(-5.0).alias("b")))).alias("sim")), _lab_sql(C.SRGB_7) + " SELECT p_partkey, round(exp(-power(sqrt(power(L - 50, 2) + power(a - 10, 2) + power(b + 5, 2)) / 25, 2)), 6) sim FROM lab")
_DE_SQL = _lab_sql(C.SRGB_7) + """, q AS (SELECT p_partkey, L, a, b, 0.5 * (1 - sqrt(power((sqrt(a * a + b * b) + sqrt(125)) / 2, 7) / (power((sqrt(a * a + b * b) + sqrt(125)) / 2, 7) + power(25.0, 7)))) g FROM lab),
 c AS (SELECT *, sqrt(power((1 + g) * a, 2) + b * b) c1, sqrt(power((1 + g) * 10, 2) + 25) c2, CASE WHEN (1 + g) * a = 0 AND b = 0 THEN 0 ELSE (degrees(atan2(b, (1 + g) * a)) + 360) % 360 END h1, (degrees(atan2(-5, (1 + g) * 10)) + 360) % 360 h2 FROM q),
 t AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END hm, (L + 50) / 2 lm, (c1 + c2) / 2 cm FROM c),
 k AS (SELECT *, (50 - L) / (1 + 0.015 * power(lm - 50, 2) / sqrt(20 + power(lm - 50, 2))) kl, (c2 - c1) / (1 + 0.045 * cm) kc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * (1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)))) kh FROM t),
 de AS (SELECT p_partkey, L, a, b, sqrt(kl * kl + kc * kc + kh * kh - 2 * sqrt(power(cm, 7) / (power(cm, 7) + power(25.0, 7))) * sin(radians(60 * exp(-power((hm - 275) / 25, 2)))) * kc * kh) d FROM k)"""
register("F5_ciede2000", lambda s, d: table(s, d, "part").select("p_partkey", _LAB().alias("x")).select("p_partkey", r6(C.ciede2000(F.col("x"), F.struct(F.lit(50.0).alias("L"), F.lit(10.0).alias("a"), F.lit(-5.0).alias("b")))).alias("delta")), _DE_SQL + " SELECT p_partkey, round(d, 6) \"delta\" FROM de")
register("F8_hex", lambda s, d: table(s, d, "part").select("p_partkey", _LAB().alias("x")).select("p_partkey", C.lab_to_hex(F.col("x")).alias("hex")), "SELECT p_partkey, printf('#%02x%02x%02x', p_partkey * 7 % 256, p_partkey * 11 % 256, p_partkey * 13 % 256) hex FROM part")
_SWATCHES = "(VALUES " + ", ".join("({}, '{}', {!r}::DOUBLE, {!r}::DOUBLE, {!r}::DOUBLE)".format(k, n, *C._lab(rgb)) for k, (n, rgb) in enumerate(C.PALETTE.items())) + ") v(i, name, l, a, b)"
register("F10_nearest_swatch", lambda s, d: table(s, d, "part").select("p_partkey", _LAB().alias("x")).select("p_partkey", C.nearest_swatch(F.col("x")).alias("swatch")).groupBy("swatch").agg(F.count(F.lit(1)).alias("n")), _lab_sql(C.SRGB_7) + f", n AS (SELECT p_partkey, arg_min(name, {{'d': power(lab.L - v.l, 2) + power(lab.a - v.a, 2) + power(lab.b - v.b, 2), 'i': i}}) swatch FROM lab CROSS JOIN {_SWATCHES} GROUP BY 1) SELECT swatch, count(*) n FROM n GROUP BY 1")
register("V23_colour_search", lambda s, d: table(s, d, "part").select("p_partkey", _LAB().alias("x"), F.struct(F.lit(50.0).alias("L"), F.lit(10.0).alias("a"), F.lit(-5.0).alias("b")).alias("q")).orderBy(C.delta_76(F.col("x"), F.col("q")), "p_partkey").limit(50).select("p_partkey", r6(C.ciede2000(F.col("x"), F.col("q"))).alias("delta")).orderBy("delta", "p_partkey").limit(10), _DE_SQL + " SELECT p_partkey, round(d, 6) \"delta\" FROM (SELECT * FROM de ORDER BY sqrt(power(L - 50, 2) + power(a - 10, 2) + power(b + 5, 2)), p_partkey LIMIT 50) ORDER BY round(d, 6), p_partkey LIMIT 10")
register("F14_canonical_colour", lambda s, d: table(s, d, "part").select("p_partkey", T.canonical_colour(F.concat(F.lit("Dusty "), "p_name")).alias("colour")).groupBy("colour").agg(F.count(F.lit(1)).alias("n")), "SELECT colour, count(*) n FROM (SELECT CASE WHEN contains(p_name, 'blue') THEN 'blue' WHEN contains(p_name, 'red') THEN 'red' WHEN contains(lower(p_name), 'gold') THEN 'gold' END colour FROM part) GROUP BY 1")
_SHADES = ("Sail", " pearl grey", "TAUPE", "Wolf Grey", "off white", "tangerine heat", "tangerine", "plain")
register("F14_exact_names", lambda s, d: table(s, d, "part").select("p_partkey", T.canonical_colour(F.element_at(F.array(*map(F.lit, _SHADES)), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("colour")), "SELECT p_partkey, ['cream', 'gray', 'tan', 'gray', 'cream', 'orange', 'tan', NULL][p_partkey % 8 + 1] colour FROM part")
register("F15_canonical_taxonomy", lambda s, d: R.last_of_path(table(s, d, "part").select(F.col("p_partkey").alias("code"), F.array(F.lit("all"), F.upper(F.split("p_name", " ")[0]), F.concat(F.lit(" "), F.split("p_name", " ")[1])).alias("path")), table(s, d, "part").select(F.split("p_name", " ")[0].alias("term"), F.lit("by look").alias("root"), F.split("p_name", " ")[0].alias("category"), F.lit(None).cast("string").alias("leaf")).union(table(s, d, "part").where("p_name LIKE '%g%'").select(F.split("p_name", " ")[1], F.lit("by kind"), F.upper(F.split("p_name", " ")[1]), F.split("p_name", " ")[1])).distinct().where("term NOT IN ('bolt', 'rod', 'plate', 'anvil')")), "SELECT p_partkey AS code, CASE WHEN n IN ('bolt', 'rod', 'plate', 'anvil') THEN 'by look' ELSE 'by kind' END root, CASE WHEN n IN ('bolt', 'rod', 'plate', 'anvil') THEN split_part(p_name, ' ', 1) ELSE upper(n) END category, CASE WHEN n NOT IN ('bolt', 'rod', 'plate', 'anvil') THEN n END leaf FROM (SELECT *, split_part(p_name, ' ', 2) n FROM part)")
register("F32_strict_json", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(T.strict_json(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("Here: "), "props"))), "$.k").alias("k")), "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END k FROM events")
register("S29_first_graph", lambda s, d: table(s, d, "part").select("p_partkey", F.posexplode(X.first_graph(F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">{"@graph": [{"name": "'), "p_name", F.lit('"}, {"name": "'), "p_brand", F.lit('"}]}</script><script type="application/ld+json">{"@graph": [{"name": "later"}]}</script>')))).alias("pos", "entry")).select("p_partkey", "pos", F.get_json_object("entry", "$.name").alias("name")), "SELECT p_partkey, 0 pos, p_name AS name FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part")
register("F16_canonical_facet", lambda s, d: table(s, d, "part").select("p_partkey", T.canonical_facet(F.concat(F.col("p_size").cast("string"), F.lit(" inch inseam")), "length").alias("length")), "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'short inseam' ELSE 'full length' END AS length FROM part")
register("F17_primary", lambda s, d: table(s, d, "part").select("p_partkey", T.primary(F.split("p_name", " ")).alias("label")), "SELECT p_partkey, split_part(p_name, ' ', 1) AS label FROM part")


def _folded(s, d):
    """Digests of folded texts, which are long: Python gets them in batches of 8 MB."""
    with arrow_batches(s, 8 << 20):
        return saved(table(s, d, "documents").select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("md5")), "folded")


register("F18_fold_accents", _folded, "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) \"md5\" FROM documents")
register("F19_candidates", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(T.candidates(F.lower("p_name")), "|").alias("c")), "SELECT p_partkey, lower(p_name) || '|' || split_part(lower(p_name), ' ', 1) || CASE WHEN split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2) THEN '|' || split_part(lower(p_name), ' ', 2) ELSE '' END c FROM part")
_ALIAS = lambda s, d: table(s, d, "part").select(F.split("p_name", " ")[1].alias("alias")).distinct()
_WORDS = lambda s, d: table(s, d, "part").select(F.concat(F.split("p_name", " ")[1], F.when(F.col("p_size") % 2 == 0, "s").when(F.col("p_size") % 3 == 0, "et").otherwise("")).alias("word")).distinct()
_LCS_SQL = """WITH RECURSIVE w AS (SELECT DISTINCT split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN 's' WHEN p_size % 3 = 0 THEN 'et' ELSE '' END word FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS alias FROM part),
 r AS (SELECT word, alias, 0 i, [0 FOR x IN range(0, len(alias) + 1)] AS line FROM w CROSS JOIN a
  UNION ALL SELECT word, alias, i + 1, [list_max([CASE WHEN k = 0 THEN 0 WHEN alias[k] = word[i + 1] THEN line[k] + 1 ELSE line[k + 1] END FOR k IN range(0, j + 1)]) FOR j IN range(0, len(alias) + 1)] FROM r WHERE i < len(word))
 SELECT word, alias, round(200.0 * line[len(alias) + 1] / (len(word) + len(alias)), 6) ratio FROM r WHERE i = len(word) AND 200.0 * line[len(alias) + 1] / (len(word) + len(alias)) >= CASE WHEN len(alias) <= 5 THEN 90 ELSE 80 END"""
register("F20_J12_fuzzy_match", lambda s, d: R.fuzzy_match(_WORDS(s, d), _ALIAS(s, d)).withColumn("ratio", r6("ratio")), _LCS_SQL)
_NOUNS = lambda s, d: table(s, d, "part").select(F.split("p_name", " ")[1].alias("word")).distinct()
register("J13_two_vocabularies", lambda s, d: _NOUNS(s, d).join(R.fuzzy_match(_NOUNS(s, d), _ALIAS(s, d), floor=90).groupBy("word").agg(F.max(F.when(F.col("alias") < "h", F.col("ratio"))).alias("stocked"), F.max(F.when(F.col("alias") >= "h", F.col("ratio"))).alias("other")), "word", "left").select(F.col("word").alias("w"), F.when(F.col("stocked") >= 90, "stocked").when(F.col("other") >= 95, "off catalog").otherwise("none").alias("verdict")), "SELECT DISTINCT split_part(p_name, ' ', 2) w, CASE WHEN split_part(p_name, ' ', 2) < 'h' THEN 'stocked' ELSE 'off catalog' END verdict FROM part")
register("F21_tokens", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).alias("n")), r"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z][a-z\-'']+'))::INT n FROM conversations")
register("F22_has_term", lambda s, d: table(s, d, "part").groupBy(T.has_term(F.concat("p_name", F.lit("s")), "ring").alias("hit")).agg(F.count(F.lit(1)).alias("n")), "SELECT split_part(p_name, ' ', 2) = 'ring' hit, count(*) n FROM part GROUP BY 1")
register("F23_category_match", lambda s, d: match_terms(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), _ALIAS(s, d).select(F.col("alias").alias("term"), F.lit(None).cast("string").alias("leaf"), F.col("alias").alias("category"), F.lit("").alias("group"), F.lit(0).alias("place")), 1).select(F.col("id").alias("p_partkey"), "term"), "SELECT p_partkey, split_part(p_name, ' ', 2) term FROM part")
register("F24_F25_attribute_match", lambda s, d: table(s, d, "part").select("p_partkey", F.explode(T.tokens(F.col("p_name"))).alias("token")).join(R.token_index(table(s, d, "part"), ["p_name"]).groupBy("token").agg(F.sum("n").alias("evidence")), "token").withColumn("k", F.row_number().over(R.Window.partitionBy("p_partkey").orderBy(F.desc("evidence"), "token"))).where("k <= 5").select("p_partkey", "token", "k"), "WITH t AS (SELECT p_partkey, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) token FROM part), e AS (SELECT token, count(*) evidence FROM t GROUP BY 1) SELECT p_partkey, token, row_number() OVER (PARTITION BY p_partkey ORDER BY evidence DESC, token) k FROM t JOIN e USING (token) WHERE length(token) >= 3")
register("F26_clauses", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(T.clauses(F.concat_ws(" with ", F.concat_ws(" and ", "p_name", "p_type"), F.concat_ws(", ", "p_brand", "p_name"))), "|").alias("c")), "SELECT p_partkey, lower(concat_ws('|', p_name, p_type, p_brand, p_name)) c FROM part")
register("F27_text_attributes", lambda s, d: table(s, d, "part").select("p_partkey", T.first_rule(F.col("p_name"), [(w, w.upper()) for w in ("widget", "plate", "gizmo", "anvil", "gear", "bolt", "ring", "rod")]).alias("category"), T.canonical_colour(F.col("p_name")).alias("colour")), "SELECT p_partkey, upper(split_part(p_name, ' ', 2)) category, CASE WHEN contains(p_name, 'blue') THEN 'blue' WHEN contains(p_name, 'red') THEN 'red' WHEN contains(lower(p_name), 'gold') THEN 'gold' END colour FROM part")
_ASK = lambda: F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ["what brand is this", "pair this with", "this exact", "something like this", "a shirt with", ""])), (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 6 < 5, F.split("p_name", " ")[1]))
register("F29_router", lambda s, d: table(s, d, "part").select(T.route(F.col("p_partkey") % 7 > 0, _ASK(), ("gear", "bolt")).alias("r")).groupBy("r.intent").agg(F.count(F.lit(1)).alias("n"), F.count("r.exactness_cue").alias("exact"), F.count("r.similarity_cue").alias("similar")), "SELECT intent, count(*) n, count(*) FILTER (WHERE i AND k = 2) exact, count(*) FILTER (WHERE i AND k = 3) \"similar\" FROM (SELECT p_partkey % 7 > 0 i, p_partkey % 6 k, CASE WHEN NOT i AND k = 5 THEN 'unroutable' WHEN NOT i THEN 'search' WHEN k = 0 THEN 'brand' WHEN k = 1 THEN 'compose' WHEN k = 4 AND split_part(p_name, ' ', 2) IN ('gear', 'bolt') THEN 'compose' ELSE 'identify' END intent FROM part) GROUP BY 1")
register("F30_normal_query", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.md5(T.normal_query(F.col("text"))).alias("h")), r"SELECT conv_id, turn, md5(trim(regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g'), ' .!?,;:')) h FROM conversations")
register("F31_json_in", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(T.json_in(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))), "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') k FROM events")
register("F33_description", lambda s, d: table(s, d, "documents").select("doc_id", F.length(T.description("source", "lang", "text")).alias("n")), "SELECT doc_id, length(substr(concat_ws(chr(10), source, lang, text), 1, 2000))::INT n FROM documents")
register("F34_slug", lambda s, d: table(s, d, "part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_brand", "p_name")).alias("slug")), "SELECT p_partkey, substr(trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) slug FROM part")
register("F35_price", lambda s, d: table(s, d, "part").select("p_partkey", T.parse_price(F.concat(F.lit("from $1,"), F.format_string("%06.2f", "p_retailprice"))).cast("double").alias("price")), "SELECT p_partkey, regexp_extract(replace('1,' || printf('%06.2f', p_retailprice), ',', ''), '[0-9.]+')::DOUBLE price FROM part")
register("F36_stable_id", lambda s, d: table(s, d, "pages").select("page_id", T.stable_id(F.col("url")).alias("id")), "SELECT page_id, substr(sha1(url), 1, 16) id FROM pages")
register("F37_flair", lambda s, d: table(s, d, "customer").groupBy(T.flair(F.concat(F.lit("  "), "c_mktsegment")).alias("flair")).agg(F.count(F.lit(1)).alias("n")), "SELECT lower(trim(c_mktsegment)) flair, count(*) n FROM customer GROUP BY 1")
_B = lambda k: F.transform(F.array(F.col("p_partkey") % k, F.col("p_size") % k, F.col("p_partkey") % k + 5, F.col("p_size") % k + 5), lambda x: x.cast("double"))
register("F38_box_iou", lambda s, d: table(s, d, "part").select("p_partkey", r6(R.box_iou(_B(7), _B(5))).alias("iou")), "SELECT p_partkey, round(i / (50 - i), 6) iou FROM (SELECT p_partkey, greatest(least(p_partkey % 7, p_partkey % 5) + 5 - greatest(p_partkey % 7, p_partkey % 5), 0) * greatest(least(p_size % 7, p_size % 5) + 5 - greatest(p_size % 7, p_size % 5), 0) i FROM part)")
register("F39_l2", lambda s, d: table(s, d, "embeddings").select("vec_id", r6(F.aggregate(l2("embedding"), F.lit(0.0), lambda a, x: a + x)).alias("total")), "SELECT vec_id, round(list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) total FROM embeddings")
register("F40_shorten", lambda s, d: table(s, d, "part").select("p_partkey", T.shorten(F.split("p_name", " ")[0], F.concat_ws(" ", "p_name", "p_type"), 15).alias("label")), "SELECT p_partkey, CASE WHEN length(f) <= 15 THEN f ELSE regexp_replace(substr(f, 1, 15), '\\s+\\S*$', '') END AS label FROM (SELECT p_partkey, p_name || ' ' || p_type f FROM part)")
register("F41_decision_ladder", lambda s, d: items(s, d).groupBy(T.decision(F.col("confidence"), F.col("source") == "R").alias("said")).agg(F.count(F.lit(1)).alias("n")), W + "SELECT CASE WHEN confidence < 0.2 THEN 'rejected' WHEN source = 'R' THEN 'hedged' WHEN confidence >= 0.8 THEN 'sure' ELSE 'likely' END said, count(*) n FROM items GROUP BY 1")
register("F42_first_present", lambda s, d: table(s, d, "part").select("p_partkey", T.first_present(F.when(F.col("p_size") > 40, F.col("p_brand")), F.when(F.col("p_size") > 20, F.col("p_type")), default="none").alias("v")), "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_brand END, CASE WHEN p_size > 20 THEN p_type END, 'none') v FROM part")
register("F44_hash_halves", lambda s, d: table(s, d, "part").select("p_partkey", *[F.conv(F.substring(F.md5("p_name"), i, 8), 16, 10).cast("long").alias(n) for i, n in ((1, "high"), (9, "low"))]), "SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 8))::BIGINT high, ('0x' || substr(md5(p_name), 9, 8))::BIGINT low FROM part")
_PALETTE_SQL = "(VALUES " + ", ".join(f"('{n}', {i}, {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(C.PALETTE.items())) + ") pal(name, i, r, g, b)"


def _palette_vote(s, d):
    pixels = table(s, d, "part").select("p_brand", C.nearest_rgb(*_RGB()).alias("name")).groupBy("p_brand", "name").agg(F.count(F.lit(1)).alias("n"))
    return pixels.groupBy("p_brand").agg(F.max_by("name", F.struct("n", "name")).alias("name"), r6(F.max("n") / F.sum("n")).alias("share"))


register("F11_palette_vote", _palette_vote, f"WITH v AS (SELECT p_brand, arg_min(name, power(p_partkey * 7 % 256 - r, 2) + power(p_partkey * 11 % 256 - g, 2) + power(p_partkey * 13 % 256 - b, 2) + i * 1e-6) name FROM part CROSS JOIN {_PALETTE_SQL} GROUP BY p_brand, p_partkey), c AS (SELECT p_brand, name, count(*) n FROM v GROUP BY 1, 2) SELECT p_brand, arg_max(name, (n, name)) name, round(max(n) / sum(n), 6) \"share\" FROM c GROUP BY 1")


def _images(s, d):
    """Two images of 6 by 6 pixels of each part: the one a figure on a plain ground, the other a texture or, of every fifth part, a
    crop of few pixels."""
    key = F.col("p_partkey")
    pixel = lambda red, green, blue: (F.pmod(red, F.lit(256)) * 65536 + F.pmod(green, F.lit(256)) * 256 + F.pmod(blue, F.lit(256))).cast("int")
    cell = lambda i: (i % 6, F.floor(i / 6))

    def figure(i):
        x, y = cell(i)
        inside = x.between(1, 4) & y.between(1, 4)
        return F.when(inside, pixel(key * 7 + x * 40, key * 11 + y * 30, key * 13 + x * y)).otherwise(pixel(key * 3, key * 3, key * 3))

    def texture(i):
        x, y = cell(i)
        return pixel(key * 17 + x * x * 9, key * 19 + y * 50, key * 23 + x * 31 + y)

    rows = table(s, d, "part").select("p_partkey")
    first = rows.select("p_partkey", F.lit(0).alias("at"), F.lit(6).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(35)), figure).alias("pixels"), F.lit(False).alias("cropped"))
    few = F.when(key % 5 == 0, F.lit(3)).otherwise(F.lit(35))
    second = rows.where("p_partkey % 2 = 0").select("p_partkey", F.lit(1).alias("at"), F.lit(6).alias("width"), F.transform(F.sequence(F.lit(0), few), texture).alias("pixels"), (key % 5 == 0).alias("cropped"))
    return first.unionByName(second)


def _dominant(s, d):
    found = dominant_colours(_images(s, d), "p_partkey")
    return found.select("p_partkey", "rank", *[F.round(F.col("lab")[c], 4).alias(c.lower()) for c in ("L", "a", "b")], r6("share").alias("share"))


_DOMINANT_SQL = """WITH RECURSIVE px AS (
  SELECT p_partkey AS key, 0 AS img, i, i % 6 AS x, i // 6 AS y, CASE WHEN i % 6 BETWEEN 1 AND 4 AND i // 6 BETWEEN 1 AND 4 THEN [key * 7 + (i % 6) * 40, key * 11 + (i // 6) * 30, key * 13 + (i % 6) * (i // 6)] ELSE [key * 3, key * 3, key * 3] END AS c, false AS cropped
  FROM part CROSS JOIN (SELECT unnest(range(36)) AS i)
  UNION ALL SELECT p_partkey, 1, i, i % 6, i // 6, [p_partkey * 17 + (i % 6) * (i % 6) * 9, p_partkey * 19 + (i // 6) * 50, p_partkey * 23 + (i % 6) * 31 + i // 6], p_partkey % 5 = 0
  FROM part CROSS JOIN (SELECT unnest(range(36)) AS i) WHERE p_partkey % 2 = 0 AND (p_partkey % 5 > 0 OR i < 4)
), line AS (
  SELECT *, list_transform(c, lambda v: CASE WHEN (v % 256) / 255.0::DOUBLE > 0.04045 THEN power(((v % 256) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE (v % 256) / 255.0::DOUBLE / 12.92 END) AS l FROM px
), f AS (
  SELECT *, list_transform([(0.4124564 * l[1] + 0.3575761 * l[2] + 0.1804375 * l[3]) / 0.95047, 0.2126729 * l[1] + 0.7151522 * l[2] + 0.0721750 * l[3], (0.0193339 * l[1] + 0.1191920 * l[2] + 0.9503041 * l[3]) / 1.08883], lambda t: CASE WHEN t > power(6.0 / 29, 3) THEN cbrt(t) ELSE t * power(29.0 / 6, 2) / 3 + 4.0 / 29 END) AS g FROM line
), lab AS (
  SELECT key, img, i, x, y, cropped, 116 * g[2] - 16 AS "L", 500 * (g[1] - g[2]) AS a, 200 * (g[2] - g[3]) AS b FROM f
), ring AS (
  SELECT key, img, median("L") AS "L", median(a) AS a, median(b) AS b FROM (SELECT * FROM lab WHERE x = 0 UNION ALL SELECT * FROM lab WHERE x = 5 UNION ALL SELECT * FROM lab WHERE y = 0 UNION ALL SELECT * FROM lab WHERE y = 5) GROUP BY ALL
), far AS (
  SELECT lab.*, sqrt(power(lab."L" - ring."L", 2) + power(lab.a - ring.a, 2) + power(lab.b - ring.b, 2)) > 12 AS far FROM lab JOIN ring USING (key, img)
), kept AS (
  SELECT * FROM (SELECT *, avg(far::INT) OVER (PARTITION BY key, img) AS share FROM far) WHERE cropped OR share < 0.05 OR far
), pixels AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY img, i) - 1 AS p, count(*) OVER (PARTITION BY key) AS n, "L", a, b FROM kept
), chosen AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY sha1('0:' || p)) AS r FROM pixels
), rounds AS (
  SELECT key, 0 AS it, list([ "L", a, b ] ORDER BY r) AS c, NULL::DOUBLE[][] AS before, false AS done FROM chosen WHERE n > 5 AND r <= 5 GROUP BY key
  UNION ALL
  SELECT key, it + 1, moved, c, list_bool_and(list_transform(range(1, 6), lambda j: list_bool_and(list_transform(range(1, 4), lambda d: abs(moved[j][d] - c[j][d]) <= 1e-3 + 1e-5 * abs(c[j][d])))))
  FROM (
    SELECT key, it, c, list_transform(range(0, 5), lambda j: CASE WHEN len(list_filter(m, lambda e: e.near = j)) > 0 THEN [list_avg(list_transform(list_filter(m, lambda e: e.near = j), lambda e: e.v[1])), list_avg(list_transform(list_filter(m, lambda e: e.near = j), lambda e: e.v[2])), list_avg(list_transform(list_filter(m, lambda e: e.near = j), lambda e: e.v[3]))] ELSE c[j + 1] END) AS moved
    FROM (
      SELECT r.key, r.it, r.c, list({'v': [p."L", p.a, p.b], 'near': list_sort(list_transform(range(0, 5), lambda j: {'d': power(p."L" - r.c[j + 1][1], 2) + power(p.a - r.c[j + 1][2], 2) + power(p.b - r.c[j + 1][3], 2), 'j': j}))[1].j}) AS m
      FROM rounds AS r JOIN pixels AS p USING (key) WHERE NOT r.done AND r.it < 15 GROUP BY r.key, r.it, r.c
    )
  )
), final AS (
  SELECT * FROM rounds QUALIFY row_number() OVER (PARTITION BY key ORDER BY it DESC) = 1
), sized AS (
  SELECT key, j, any_value(c[j + 1]) AS v, count(*) / any_value(n) AS "share" FROM (
    SELECT f.key, f.c, p.n, list_sort(list_transform(range(0, 5), lambda j: {'d': power(p."L" - f.before[j + 1][1], 2) + power(p.a - f.before[j + 1][2], 2) + power(p.b - f.before[j + 1][3], 2), 'j': j}))[1].j AS j FROM final AS f JOIN pixels AS p USING (key)
  ) GROUP BY key, j
  UNION ALL SELECT key, p, ["L", a, b], 1.0 / n FROM pixels WHERE n <= 5
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY "share" DESC, j)::INT AS rank FROM sized WHERE "share" >= 0.03
)
SELECT key AS p_partkey, rank, round(v[1], 4) AS l, round(v[2], 4) AS a, round(v[3], 4) AS b, round("share", 6) AS "share" FROM ranked WHERE rank <= 3"""


register("F12_F13_dominant_colours", _dominant, _DOMINANT_SQL)
register("F28_filters_from_text", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.slice(F.filter(T.tokens(F.col("p_name")), lambda t: t.isin("red", "blue", "new")), 1, 2), ",").alias("colours"), F.element_at(T.tokens(F.col("p_name")), -1).alias("category")), "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue', 'new') THEN split_part(p_name, ' ', 1) ELSE '' END colours, split_part(p_name, ' ', 2) category FROM part")
register("F43_reference", lambda s, d: table(s, d, "pages").select("page_id", T.reference(F.col("url"), "https://base/").alias("link")), "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://base/' || url END link FROM pages")
register("S30_blob_by_marker", lambda s, d: _product_pages(s, d).select("p_partkey", F.get_json_object(F.get(F.filter(X.linked_data(F.col("html")), lambda b: F.contains(b, F.lit("ProductGroup"))), F.lit(0)), "$.name").alias("name")), "SELECT p_partkey, p_name AS name FROM part")


_VECTORS = lambda s, d: table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("label"))


def _head(mlp):
    """A head over vectors for a label that they tell; accuracy on rows that neither fit nor choice has seen."""

    def run(s, d):
        from tessera.operators import heads as H

        rows = _VECTORS(s, d)
        model, chosen = H.train_head(rows.where("vec_id % 5 > 1"), rows.where("vec_id % 5 = 1"), 2, mlp)
        test = rows.where("vec_id % 5 = 0").select(H.array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
        return model.transform(test).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy")).withColumn("chosen_at", F.lit(chosen))

    return run


register("X8_hidden_head", _head(True))
register("X9_X10_linear_head", _head(False))


def _letters(texts):
    return [[float(len(t)), float(t.count("e"))] for t in texts]


register("X3_encode_text", lambda s, d: table(s, d, "part").select("p_partkey", encoder(_letters)("p_name").alias("v")).select("p_partkey", F.get("v", F.lit(0)).cast("int").alias("chars"), F.get("v", F.lit(1)).cast("int").alias("es")), "SELECT p_partkey, len(p_name)::INT chars, (len(p_name) - len(replace(p_name, 'e', '')))::INT es FROM part")
register("X4_embed_readable", lambda s, d: embed_rows(table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).alias("image")), "p_partkey", "image", lambda xs: [None if x is None else _letters([x])[0] for x in xs]).select("p_partkey", F.get("embedding", F.lit(0)).cast("int").alias("chars")), "SELECT p_partkey, len(p_name)::INT chars FROM part WHERE p_partkey % 7 > 0")


def _csv(s, d):
    """Written as CSV with a header and read again."""
    path = f"{shared_folder(s)}/tables/csv-{uuid.uuid4().hex}"
    table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 9, F.concat(F.lit('a "quoted", '), "p_brand")).alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return s.read.schema("p_partkey long, p_name string, note string").option("header", True).option("escape", '"').csv(path)


register("S12_csv_sink", _csv, """SELECT p_partkey, p_name, CASE WHEN p_size > 9 THEN 'a "quoted", ' || p_brand END note FROM part""")


def _hourly(s, d):
    from tessera.streaming.incremental import windowed_counts

    rows = windowed_counts(table(s, d, "events"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


register("T1_windowed_counts", _hourly, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') \"hour\", event_type, count(*) n FROM events GROUP BY 1, 2")


# Texts that name garments: two phrases and a word between them, dealt by the part's key.
_GARMENTS = ["shirt", "red shirt", "Jacket", "blue t-shirt", "tank top", "shoes", "green hat", "denim jeans", "gold bag", "plain", "red", "off-white sneakers"]
_JOINS = [" with ", " and ", ", ", " over ", " ", " + ", " And ", " worn with ", "\\n&"]
_HUES = ["red", "blue", "gold", "green", "white", "off-white"]
_TEXT = lambda: F.concat(*[F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("p_partkey") / size) % len(words) + 1).cast("int")) for words, size in ((_GARMENTS, 1), ([x.replace("\\n", "\n") for x in _JOINS], 12), (_GARMENTS, 108))])
_SQL_LIST = lambda words: "[" + ", ".join("'" + w.replace("\\n", "' || chr(10) || '") + "'" for w in words) + "]"
_SQL_MAP = lambda words: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"
_LONGEST = lambda words: sorted(words, key=len, reverse=True)


def _attributes_sql(text: str) -> str:
    group = f"list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z][a-z-]*'), lambda w: {_SQL_MAP(K_.GROUP_WORDS)}[w]), lambda g: g IS NOT NULL)[1]"
    colour = f"list_filter({_SQL_LIST(_LONGEST(sorted(_HUES)))}, lambda c: contains(lower({text}), c))[1]"
    category = f"{_SQL_MAP(K_.CATEGORY_WORDS)}[list_filter({_SQL_LIST(_LONGEST(K_.CATEGORY_WORDS))}, lambda c: regexp_matches(lower({text}), '\\b' || c || '\\b'))[1]]"
    return "{'phrase': " + text + ", 'g': " + group + ", 'c': " + colour + ", 'k': " + category + "}"


register(
    "F26_F27_constraints",
    lambda s, d: table(s, d, "part").select("p_partkey", F.posexplode(T.constraints(_TEXT(), _HUES)).alias("k", "x")).select("p_partkey", "k", "x.phrase", F.col("x.attributes.group").alias("grp"), "x.attributes.colour", "x.attributes.category"),
    f"""WITH t AS (SELECT p_partkey, {_SQL_LIST(_GARMENTS)}[p_partkey % 12 + 1] || {_SQL_LIST(_JOINS)}[p_partkey // 12 % 9 + 1] || {_SQL_LIST(_GARMENTS)}[p_partkey // 108 % 12 + 1] AS text FROM part),
    p AS (SELECT p_partkey, text, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '{K_.CLAUSE_SPLIT}'), lambda f: trim(f, chr(10) || ' ')), lambda f: f <> ''), lambda f: {_attributes_sql("f")}), lambda x: x.g IS NOT NULL OR x.c IS NOT NULL) AS parsed FROM t),
    c AS (SELECT p_partkey, CASE WHEN len(parsed) > 1 AND len(list_distinct(list_filter(list_transform(parsed, lambda x: x.g), lambda g: g IS NOT NULL))) > 1 THEN parsed ELSE [{_attributes_sql("text")}] END AS found FROM p)
    SELECT p_partkey, (i - 1)::INT AS k, found[i].phrase AS phrase, found[i].g AS grp, found[i].c AS colour, found[i].k AS category FROM (SELECT p_partkey, found, unnest(range(1, len(found) + 1)) AS i FROM c)""",
)

# Fragments: a conversation's text and the words of a part; leaves are its names, categories their nouns, groups its types.
_FRAGMENTS = lambda s, d: table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("said"), (F.col("conv_id") * 7 + F.col("turn")).alias("n")).join(table(s, d, "part").select(F.col("p_partkey").alias("n"), "p_name", "p_type"), "n").select("id", F.concat_ws(" ", F.when(F.col("n") % 4 > 0, F.concat("p_name", F.when(F.col("n") % 3 == 0, "s!").otherwise(" of"))), F.lower("p_type"), F.when(F.col("n") % 5 == 0, "whatsits"), "said").alias("text"))


def _terms(s, d):
    p = table(s, d, "part").select("p_name", F.substring_index("p_name", " ", -1).alias("noun"), "p_type")
    leaves = p.where("p_name >= 'h'").groupBy(F.col("p_name").alias("term")).agg(F.min("noun").alias("category"), F.min("p_type").alias("group")).withColumns({"leaf": F.col("term"), "place": F.lit(1)})
    nouns = p.groupBy(F.col("noun").alias("term")).agg(F.min("p_type").alias("group")).withColumns({"leaf": F.lit(None).cast("string"), "category": F.col("term"), "place": F.lit(2)})
    synonym = nouns.where("term = 'gizmo'").withColumn("term", F.lit("whatsit")).withColumn("place", F.lit(3))
    return leaves.unionByName(nouns).unionByName(synonym)


def _token_index(s, d):
    cut = lambda c: table(s, d, "part").select(F.lit(c).alias("field"), F.lower(c).alias("value"), F.explode(T.tokens(F.col(c))).alias("token"))
    return cut("p_name").unionByName(cut("p_type")).groupBy("token", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def _fragments(s, d):
    found = parse_fragments(_FRAGMENTS(s, d), _terms(s, d), _token_index(s, d), 2)
    words = F.array_join(F.transform("attributes", lambda a: F.concat_ws(":", a["keyword"], F.array_join(a["fields"], "+"), F.array_join(a["example_values"], "+"), a["evidence"].cast("string"))), "|")
    return found.select("id", "term", "leaf", "category", F.col("group").alias("grp"), words.alias("attributes"))


register("F23_F25_fragments", _fragments, r"""WITH x AS (SELECT conv_id * 1000 + turn AS id, concat_ws(' ', CASE WHEN p_partkey % 4 > 0 THEN p_name || CASE WHEN p_partkey % 3 = 0 THEN 's!' ELSE ' of' END END, lower(p_type), CASE WHEN p_partkey % 5 = 0 THEN 'whatsits' END, text) AS text FROM conversations JOIN part ON p_partkey = conv_id * 7 + turn),
v AS (SELECT p_name AS term, p_name AS leaf, split_part(p_name, ' ', 2) AS category, min(p_type) AS grp, 1 AS place FROM part WHERE p_name >= 'h' GROUP BY ALL UNION ALL SELECT split_part(p_name, ' ', 2), NULL, split_part(p_name, ' ', 2), min(p_type), 2 FROM part GROUP BY 1, 3 UNION ALL SELECT 'whatsit', NULL, 'gizmo', min(p_type), 3 FROM part WHERE split_part(p_name, ' ', 2) = 'gizmo' HAVING count(*) > 0),
m AS (SELECT id, {'term': term, 'leaf': leaf, 'category': category, 'grp': grp} AS m FROM x JOIN v ON regexp_matches(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\b' || term || 's?\b') QUALIFY row_number() OVER (PARTITION BY id ORDER BY leaf IS NOT NULL DESC, len(string_split(term, ' ')) DESC, place, term DESC) = 1),
i AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z][a-z\-'']+')) AS token, 'p_name' AS field, lower(p_name) AS value FROM part UNION ALL SELECT unnest(regexp_extract_all(lower(p_type), '[a-z][a-z\-'']+')), 'p_type', lower(p_type) FROM part),
f AS (SELECT token, sum(n)::BIGINT AS evidence, string_agg(field, '+' ORDER BY n DESC, field) AS fields FROM (SELECT token, field, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1),
e AS (SELECT token, string_agg(value, '+' ORDER BY j) AS vals FROM (SELECT token, value, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, value) AS j FROM i GROUP BY token, value) WHERE j <= 3 GROUP BY 1),
w AS (SELECT id, token, min(pos) AS pos FROM (SELECT id, m.m.term AS term, unnest(regexp_extract_all(lower(text), '[a-z][a-z\-'']+')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z\-'']+'), 1) AS pos FROM x LEFT JOIN m USING (id)) WHERE NOT list_contains(regexp_extract_all(coalesce(term, ''), '[a-z][a-z\-'']+'), token) AND token NOT IN ('a', 'an', 'the', 'with', 'and', 'in', 'for', 'of', 'on', 'some', 'this', 'that', 'these', 'those', 'wearing', 'worn', 'plus', 'also') GROUP BY ALL),
a AS (SELECT id, string_agg(token || ':' || fields || ':' || vals || ':' || evidence, '|' ORDER BY k) AS attributes FROM (SELECT w.id, w.token, f.fields, e.vals, f.evidence, row_number() OVER (PARTITION BY id ORDER BY evidence DESC, pos) AS k FROM w JOIN f USING (token) JOIN e USING (token)) WHERE k <= 5 GROUP BY id)
SELECT x.id, m.m.term AS term, m.m.leaf AS leaf, m.m.category AS category, m.m.grp AS grp, a.attributes FROM x LEFT JOIN m USING (id) LEFT JOIN a USING (id)""")
for _facet, _words in (("material", ("cotton twill", "Faux-Leather", "recycled polyester", "merino wool", "unknown stuff")), ("closure", ("button-fly", "zip fly", "Lace up", "velcro strap", "slip-on"))):
    _want = {"material": ("twill", "leather", "polyester", "wool", "unknown stuff"), "closure": ("button fly", "zip fly", "lace-up", "adjustable strap", "none")}[_facet]
    register(f"F16_{_facet}", lambda s, d, words=_words, facet=_facet: table(s, d, "part").select("p_partkey", T.canonical_facet(F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % 5 + 1).cast("int")), facet).alias("value")), f"SELECT p_partkey, {_SQL_LIST(_want)}[p_partkey % 5 + 1] AS value FROM part")
register("F32_whole_answers", lambda s, d: table(s, d, "events").select("event_id", T.strict_json(F.concat(F.when(F.col("event_id") % 4 == 0, "```json\n").when(F.col("event_id") % 4 == 1, "```\n").otherwise(""), "props", F.when(F.col("event_id") % 4 < 2, "\n```").otherwise(""), F.when(F.col("event_id") % 3 == 0, " bye").otherwise(""))).isNotNull().alias("strict")), "SELECT event_id, props IS NOT NULL AND event_id % 3 > 0 AS strict FROM events")


def _states(s, d):
    """A page's embedded state: two variants in the chosen group, or one product alone, some without titles, images or state."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    image = lambda kind, side: F.concat(F.lit('{"cardType": "' + kind + '", "properties": {"' + side + '": {"url": "u/'), k, F.lit("/" + side + '"}}}'))
    images = F.when(F.col("p_partkey") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit("["), image("image", "portrait"), F.lit(", "), image("video", "portrait"), F.lit(", "), image("image", "squarish"), F.lit("]")))
    variant = lambda colour, title: F.concat(F.lit('{"productInfo": '), F.when(F.lit(title), F.concat(F.lit('{"title": "'), name, F.lit('"}'))).otherwise(F.lit("null")), F.lit(f', "colorDescription": "{colour}", "pdpUrl": {{"url": "/p/'), k, F.lit('"}, "contentImages": '), images, F.lit("}"))
    group = F.concat(F.lit('{"products": {"'), k, F.lit('-a": '), variant("red", True), F.lit(', "'), k, F.lit('-b": '), variant("blue", False), F.lit("}}"))
    chosen = F.concat(F.lit('{"groupIndex": 1, "styleColor": "'), k, F.lit('", "productInfo": {"title": "'), name, F.lit('"}}'))
    groups = F.when(F.col("p_partkey") % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"products": {"no": {}}}, '), group, F.lit("]")))
    state = F.concat(F.lit('{"props": {"pageProps": {"selectedProduct": '), chosen, F.lit(', "productGroups": '), groups, F.lit("}}}"))
    state = F.when(F.col("p_partkey") % 7 == 0, F.lit('{"props": {}}')).when(F.col("p_partkey") % 11 == 0, F.lit("{broken")).otherwise(state)
    return table(s, d, "part").select("p_partkey", F.concat(F.lit('<html><script>x</script><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>")).alias("html"))


register("S13_embedded_variants", lambda s, d: X.embedded_variants(_states(s, d), "p_partkey", "html").select("p_partkey", "code", "name", "colour", "url", F.array_join("images", "|").alias("images")), """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'u/' || p_partkey || '/portrait|u/' || p_partkey || '/squarish' END AS images FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0)
SELECT p_partkey, p_partkey || '-a' AS code, p_name AS name, 'red' AS colour, '/p/' || p_partkey AS url, images FROM p WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, p_partkey || '-b', '', 'blue', '/p/' || p_partkey, images FROM p WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, p_partkey::VARCHAR, p_name, NULL, NULL, '' FROM p WHERE p_partkey % 5 = 0""")


def _verdicts(s, d):
    lines = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 == 0, "SIZE 42").otherwise(F.concat(F.lit("The "), F.upper("p_name"), F.lit("!"))).alias("text"), (F.col("p_size") / 50).alias("conf"))
    nouns = table(s, d, "part").select(F.substring_index("p_name", " ", -1).alias("alias")).distinct().withColumn("brand", F.initcap("alias"))
    parents = s.createDataFrame([("Widget", "Gizmo Group"), ("Gizmo Group", "ANVIL"), ("Rod", "Nobody"), ("Ring", "Bolt")], "brand string, parent string")
    return R.two_vocabularies(lines, nouns.where("alias < 'h'"), nouns.where("alias >= 'h'"), parents).withColumn("score", F.round("score", 6))


register("J13_verdicts", _verdicts, """SELECT p_partkey AS id, CASE WHEN noun IS NULL OR veto THEN 'no_evidence' WHEN noun < 'h' THEN 'in_catalog' ELSE 'off_catalog' END AS verdict, CASE WHEN noun IS NOT NULL AND NOT veto THEN upper(noun[1]) || noun[2:] END AS brand, CASE WHEN noun IS NULL OR veto THEN 0 ELSE round(p_size / 50, 6) END AS score,
CASE WHEN p_size < 25 THEN 'no_text' WHEN noun IS NULL THEN 'text_but_no_brand' WHEN veto THEN 'sub_brand_of_stocked_parent' WHEN noun < 'h' THEN 'catalog_brand_read' ELSE 'known_brand_not_stocked' END AS reason
FROM (SELECT *, coalesce(noun IN ('widget', 'ring'), false) AS veto FROM (SELECT *, CASE WHEN p_size >= 25 AND p_partkey % 6 > 0 THEN split_part(p_name, ' ', 2) END AS noun FROM part))""")


def _resumed(s, d):
    """Records written in two runs, of which the second finds half of its keys there, and read back."""
    path = f"{shared_folder(s)}/tables/records-{uuid.uuid4().hex}"
    rows = table(s, d, "part").select("p_partkey", F.lower("p_brand").alias("view"), "p_name")
    append_new(rows.where("p_partkey % 3 = 0"), path, ["p_partkey", "view"])
    append_new(rows.where("p_partkey % 2 = 0").withColumn("p_name", F.lit("second")).unionByName(rows.where("p_partkey % 4 = 0").withColumn("p_name", F.lit("second"))), path, ["p_partkey", "view"])
    return records(s, path, "p_partkey long, view string, p_name string").unionByName(records(s, f"{path}/none", "p_partkey long, view string, p_name string"))


register("S1_S11_records", _resumed, "SELECT p_partkey, lower(p_brand) AS \"view\", CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'second' END AS p_name FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")


def _admitted(s, d):
    """Documents as pictures of their language's theme; hashes of one family differ in their last bits."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("place"), F.col("lang").alias("theme"), F.when(F.col("lang") == "de", 6).otherwise(12).alias("cap"), F.concat("source", F.lit(":"), (F.col("doc_id") % 50).cast("string")).alias("key"), F.when(F.col("doc_id") % 13 > 0, F.concat(F.substring(F.md5((F.col("doc_id") * 7 % 60).cast("string")), 1, 13), F.lpad(F.lower(F.hex(F.col("doc_id") * 2654435761 % 4096)), 3, "0"))).alias("hash"))
    return admit(rows)


register("S22_admission", _admitted, """WITH r AS (SELECT doc_id AS place, lang AS theme, CASE WHEN lang = 'de' THEN 6 ELSE 12 END AS cap, source || ':' || (doc_id % 50) AS key, ('0x' || substr(md5((doc_id * 7 % 60)::VARCHAR), 1, 13) || printf('%03x', doc_id * 2654435761 % 4096))::UBIGINT AS v, doc_id % 13 > 0 AS usable FROM documents),
w AS (SELECT list(list_value({'place': place, 'theme': theme, 'cap': cap, 'key': key, 'v': v, 'outcome': 'kept'}) ORDER BY place) AS rows FROM r WHERE usable),
g AS (SELECT list_reduce(rows, lambda acc, x: list_concat(acc, [struct_update(x[1], outcome := CASE WHEN len(list_filter(acc, lambda a: a.outcome = 'kept' AND a.theme = x[1].theme)) >= x[1].cap THEN 'full' WHEN len(list_filter(acc, lambda a: a.outcome = 'kept' AND (a.key = x[1].key OR bit_count(xor(a.v, x[1].v)) <= 6))) > 0 THEN 'near' ELSE 'kept' END)])) AS done FROM w)
SELECT x.place, x.outcome FROM (SELECT unnest(done) AS x FROM g) UNION ALL SELECT place, 'unusable' FROM r WHERE NOT usable""")
