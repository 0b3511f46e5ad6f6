"""What a query's words name in a catalog: its most specific term, and attributes for the words that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import STOPWORDS
from tessera.functions.text import tokens


def grams(text: Column, most: int) -> Column:
    """A text's distinct runs of up to `most` words, lower case and with blanks for marks, as they stand between single
    blanks; a run doesn't cross a line."""
    words = lambda line: F.split(line, " ")

    def runs(line: Column) -> Column:
        w = words(line)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))

    lines = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"[\t\n\x0B\f\r]")
    return F.filter(F.array_distinct(F.flatten(F.transform(lines, runs))), lambda g: g.rlike("^[a-z0-9]") & g.rlike("[a-z0-9]$"))


def match_terms(texts: DataFrame, terms: DataFrame, longest: int = 4) -> DataFrame:
    """(id, term, leaf, category, group) of the most specific term that each text (id, text) names, if any: leaves before
    categories, then terms of most words, then the first by `place`.

    terms: (term, leaf or null, category, group, place), synonyms being terms of their own with the leaf and category of what
    they stand for; `longest`: the most words of a term.  A term counts as a phrase of whole words, also with a plural s, so
    texts and terms meet by equality of such phrases and no text is compared with every term."""
    named = terms.where(F.col("term").isNotNull()).select("term", "leaf", "category", "group", "place", F.explode(F.array(F.lower("term"), F.concat(F.lower("term"), F.lit("s")))).alias("gram"))
    found = texts.select("id", F.explode(grams(F.col("text"), longest)).alias("gram")).join(named, "gram")
    best = F.struct(F.col("leaf").isNotNull().alias("is_leaf"), F.size(F.split("term", " ")).alias("words"), (-F.col("place")).alias("first"), "term", "leaf", "category", "group")
    return found.groupBy("id").agg(F.max(best).alias("x")).select("id", "x.term", "x.leaf", "x.category", "x.group")


def match_attributes(texts: DataFrame, matched: DataFrame, index: DataFrame, most: int = 5, values: int = 3) -> DataFrame:
    """(id, keyword, fields, example_values, evidence, k): for the words of each text that its term leaves, fields and
    commonest values of the catalog's token index (token, field, value, n), the words of most evidence first (of equals the
    first in the text), at most `most`."""
    by_field = index.groupBy("token", "field").agg(F.sum("n").alias("n")).groupBy("token").agg(F.sum("n").alias("evidence"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "field"))).alias("fields"))
    # Values of a token may be many: only the commonest are gathered.
    w = Window.partitionBy("token").orderBy(F.desc("n"), "value")
    by_value = index.groupBy("token", "value").agg(F.sum("n").alias("n")).withColumn("j", F.row_number().over(w)).where(F.col("j") <= values).groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: x["value"]).alias("example_values"))
    words = texts.join(matched.select("id", "term"), "id", "left").withColumn("words", F.array_except(tokens(F.col("text")), F.concat(tokens(F.coalesce("term", F.lit(""))), F.array(*map(F.lit, STOPWORDS)))))
    left = words.select("id", F.posexplode("words").alias("at", "token"))
    known = left.join(by_field.join(by_value, "token"), "token")
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("evidence"), "at"))
    return known.withColumn("k", k).where(F.col("k") <= most).select("id", F.col("token").alias("keyword"), F.transform("fields", lambda x: x["field"]).alias("fields"), "example_values", "evidence", "k")


def parse_fragments(texts: DataFrame, terms: DataFrame, index: DataFrame, longest: int = 4) -> DataFrame:
    """(id, term, leaf, category, group, attributes) of every text: its term and what its other words name, in order."""
    matched = match_terms(texts, terms, longest)
    attributes = match_attributes(texts, matched, index).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "keyword", "fields", "example_values", "evidence"))).alias("attributes"))
    return texts.select("id").join(matched, "id", "left").join(attributes, "id", "left")
