"""Documents to rows: JSON and HTML that is already held."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image_rows(posts: DataFrame) -> DataFrame:
    """S3: a row for each image of (post, images, items), with that image's own detections rolled up; an image
    without detections has empty lists, a post whose items are null (never looked at) null ones."""
    own = F.filter("items", lambda x: x["source_image"] == F.col("image"))
    rows = posts.select("post", F.explode("images").alias("image"), "items")
    roll = lambda field: F.array_sort(F.array_distinct(F.transform(own, lambda x: x[field])))
    return rows.select("post", "image", roll("category").alias("categories"), roll("colour").alias("colours"))


def item_rows(posts: DataFrame) -> DataFrame:
    """A row for each detected item with its place; items without image or box go; rows of one image together."""
    rows = posts.select("post", F.posexplode("items").alias("detection_index", "x")).select("post", "detection_index", "x.*")
    return rows.where(F.col("source_image").isNotNull() & F.col("bbox").isNotNull())


def first_found(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of each key's candidate paths, in order, the first that the file manifest lists."""
    tries = candidates.select("key", F.posexplode("paths").alias("k", "path"))
    return tries.join(manifest.select("path").distinct(), "path", "left_semi").groupBy("key").agg(F.min_by("path", "k").alias("path"))


def linked_data(html: Column) -> Column:
    """All ld+json blocks of a page, as texts."""
    return F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))


VARIANT = "struct<`@type`:string,name:string,hasVariant:array<struct<sku:string,color:string,image:string,price:string>>>"


def variants(pages: DataFrame, html: str = "html") -> DataFrame:
    """Variants of product groups in ld+json; those without sku or image go."""
    blocks = pages.select(*[c for c in pages.columns if c != html], F.explode(linked_data(F.col(html))).alias("block"))
    group = blocks.withColumn("g", F.from_json("block", VARIANT)).where("g.`@type` = 'ProductGroup'")
    rows = group.select(*[c for c in pages.columns if c != html], F.col("g.name").alias("name"), F.explode("g.hasVariant").alias("v"))
    return rows.select(*[c for c in pages.columns if c != html], "name", "v.*").where("sku IS NOT NULL AND image IS NOT NULL")


def strip_tags(html: Column) -> Column:
    """Text without tags, the common entities resolved, white space collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def list_items(html: Column, list_pattern: str = r"(?s)<ul>(.*?)</ul>") -> Column:
    """Texts of the items of the first list that the pattern finds."""
    body = F.regexp_extract(html, list_pattern, 1)
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit("(?s)<li>(.*?)</li>"), F.lit(1)), strip_tags), lambda t: F.length(t) > 0)


def image_urls(gallery: Column, url: Column, preview: Column) -> Column:
    """A post's image addresses: its gallery, else its own address if that is an image, else its preview."""
    direct = url.rlike(r"(?i)\.(jpg|jpeg|png|webp)$")
    return F.when(F.size(gallery) > 0, gallery).when(direct, F.array(url)).when(preview.isNotNull(), F.array(preview)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def host_and_id(url: Column, patterns: tuple[str, ...]) -> tuple[Column, Column]:
    """Host without www, and an id from the first pattern that matches, else the address's hash."""
    host = F.regexp_replace(F.parse_url(url, F.lit("HOST")), r"^www\.", "")
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns]
    return host, F.coalesce(*found, F.substring(F.sha1(url), 1, 16))


def upgrades(url: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Larger versions of an image, then the image itself, each once."""
    return F.array_distinct(F.array(*[F.regexp_replace(url, a, b) for a, b in rules], url))


def quota(rows: DataFrame, theme: str, key: str, order: str, target: int, risky: tuple[str, ...] = ()) -> DataFrame:
    """Distinct keys, at most target / themes of each theme, half that of risky ones; themes are counted first."""
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order, theme))).where("_k = 1")
    n = rows.agg(F.countDistinct(theme).alias("_n"))
    share = F.floor(F.lit(target) / F.col("_n"))
    cap = F.when(F.col(theme).isin(*risky), F.floor(share / 2)).otherwise(share) if risky else share
    ranked = once.withColumn("_k", F.row_number().over(Window.partitionBy(theme).orderBy(order, key))).crossJoin(F.broadcast(n))
    return ranked.where(F.col("_k") <= cap).drop("_k", "_n")


def bins(files: DataFrame, budget: int, group: str = "folder") -> DataFrame:
    """Files of a folder in order, a new bin where the next one would pass the budget.  The rule looks at one file
    after another, so a folder streams through its task, which holds a batch of it; (group, name, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, begun, at, used = None, False, 0, 0
        for batch in batches:
            out = []
            for g, size in zip(batch.column(group).to_pylist(), batch.column("size").to_pylist()):
                size = size or 0
                if not begun or g != folder:
                    folder, begun, at, used = g, True, 0, 0
                elif used > 0 and used + size > budget:
                    at, used = at + 1, 0
                used += size
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("name"), pa.array(out, pa.int64())], [group, "name", "bin"])

    rows = files.select(group, "name", F.col("size").cast("long").alias("size")).repartition(group).sortWithinPartitions(group, "name", "size")
    return rows.mapInArrow(run, f"`{group}` {files.schema[group].dataType.simpleString()}, name string, bin long")


def first_graph(html: Column) -> Column:
    """The entries, as JSON texts, of the first block of linked data that can be parsed and has a @graph."""
    graphs = F.filter(F.transform(linked_data(html), lambda b: F.get_json_object(b, "$['@graph']")), lambda g: g.isNotNull())
    return F.transform(F.coalesce(F.from_json(F.get(graphs, F.lit(0)), "array<variant>"), F.expr("CAST(array() AS ARRAY<VARIANT>)")), lambda v: F.to_json(v))


def first_of_link(rows: DataFrame, link: str, order: list[str], k: int) -> DataFrame:
    """The first k distinct rows of each link; a hot link sends k rows a task."""
    w = Window.partitionBy(link).orderBy(*order)
    return rows.select(link, *order).distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)


def best_per_position(images: DataFrame) -> DataFrame:
    """Of each product's images one per position: the zoomed one if there is any, else the first; in order."""
    w = Window.partitionBy("product", "position").orderBy(F.desc("zoom"), "ord")
    one = images.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return one.groupBy("product").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("urls"))


def details(main: Column, other: Column, least: int = 40) -> Column:
    """A text, or the other where it is a stub and shorter."""
    a, b = F.coalesce(main, F.lit("")), F.coalesce(other, F.lit(""))
    return F.when((F.length(a) < least) & (F.length(b) > F.length(a)), b).otherwise(a)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel lists."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def embedded_variants(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, code, name, colour, url, images) of the variants in a page's embedded state: the products of the chosen
    group, whose codes are the keys of an object, or where there are no groups the chosen product alone.

    The state is held as a variant, so that objects of unknown keys can be walked; a page without state, with one that isn't
    JSON or lacks a branch has no variants, and a variant's missing fields are null.  An image is a card's portrait, else its
    square one."""
    blob = F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    props = F.try_variant_get(F.try_parse_json(blob), "$.props.pageProps", "variant")
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    # A page's products are one list that is exploded once, so that a page is read and its state parsed once.
    variant = "variant"
    found = F.transform(F.array(props), lambda v: F.struct(get(v, "$.selectedProduct", variant).alias("chosen"), get(v, "$.productGroups", "array<variant>").alias("groups")))

    def products(s: Column) -> Column:
        index = F.coalesce(get(s["chosen"], "$.groupIndex", "int"), F.lit(0))
        of = lambda group: F.transform(F.map_entries(get(group, "$.products", "map<string, variant>")), lambda x: F.struct(x["key"].alias("code"), x["value"].alias("p")))
        code = get(s["chosen"], "$.styleColor", "string")
        alone = F.when(code.isNotNull(), F.array(F.struct(code.alias("code"), s["chosen"].alias("p"))))
        return F.when(s["chosen"].isNull(), None).when(F.coalesce(F.size(s["groups"]), F.lit(0)) > 0, of(F.get(s["groups"], index))).otherwise(alone)

    each = pages.select(F.col(key).alias("key"), F.explode(F.flatten(F.transform(found, products))).alias("x")).select("key", "x.code", "x.p")
    cards = get("p", "$.contentImages", "array<struct<cardType: string, properties: struct<portrait: struct<url: string>, squarish: struct<url: string>>>>")
    shown = F.filter(F.transform(F.filter(cards, lambda c: c["cardType"] == "image"), lambda c: F.coalesce(F.nullif(c["properties"]["portrait"]["url"], F.lit("")), F.nullif(c["properties"]["squarish"]["url"], F.lit("")))), F.isnotnull)
    return each.select(F.col("key").alias(key), "code", F.coalesce(get("p", "$.productInfo.title", "string"), F.lit("")).alias("name"), get("p", "$.colorDescription", "string").alias("colour"), get("p", "$.pdpUrl.url", "string").alias("url"), F.coalesce(shown, F.array().cast("array<string>")).alias("images"))
