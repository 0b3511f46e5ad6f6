"""Text columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import constants as K


def normalize_text(c: Column) -> Column:
    """white space collapsed, blanks, commas and stops trimmed."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,."))


def normalize_label(c: Column) -> Column:
    """lower case, collapsed, without a leading article."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"^(a|an|the)\s+", ""))


def display_brand(c: Column, names: dict[str, str]) -> Column:
    """a listed name, else title case, where every letter after a non-letter is a capital."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")
    out = titled
    for key, name in reversed(list(names.items())):
        out = F.when(F.lower(c) == key, F.lit(name)).otherwise(out)
    return out


def brand_key(c: Column) -> Column:
    """F4."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def first_rule(c: Column, rules: Sequence[tuple[str, str]], regex: bool = False) -> Column:
    """The target of the first rule, in order, that the text contains or matches."""
    return F.coalesce(*[F.when(c.rlike(p) if regex else F.contains(c, F.lit(p)), F.lit(t)) for p, t in rules])


def canonical_colour(c: Column, exact: dict[str, str] | None = None) -> Column:
    """exact names first (by default those that the words don't tell), then words in order."""
    key = F.lower(F.trim(c))
    names = K.EXACT_COLOURS if exact is None else exact
    listed = [F.when(key.isin(*(k for k, v in names.items() if v == target)), F.lit(target)) for target in dict.fromkeys(names.values())]
    return F.coalesce(*listed, first_rule(key, K.COLOUR_RULES))


def canonical_facet(c: Column, facet: str) -> Column:
    """F16: the facet's rules; a length in inches is short up to 20; what no rule knows stays."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-/]", " "), r"\s+", " "))
    out = first_rule(text, K.FACET_RULES[facet], regex=True)
    if facet == "length":
        inches = F.regexp_extract(text, K.INCHES, 1)
        out = F.coalesce(out, F.when(inches != "", F.when(inches.cast("double") <= 20, "short inseam").otherwise("full length")))
    return F.when(text != "", F.coalesce(out, text))


def primary(values: Column) -> Column:
    """the first of a list, null of an empty one."""
    return F.get(values, F.lit(0))


#: Every combining mark, to nothing.
_MARKS = dict.fromkeys(i for i in range(0x110000) if unicodedata.combining(chr(i)))
_OTHERS = re.compile("[^a-z0-9]+")


@F.pandas_udf(StringType())
def fold_accents(c: pd.Series) -> pd.Series:
    """compatibility decomposition without marks, lower case, other characters than letters and digits as blanks."""
    # One text at a time, so that a batch isn't there in several forms.
    return pd.Series([None if x is None else _OTHERS.sub(" ", unicodedata.normalize("NFKD", x).translate(_MARKS).lower()).strip(" ") for x in c], dtype=object)


def candidates(line: Column) -> Column:
    """a line, its words and its neighbouring pairs, in order, each once."""
    words = F.split(line, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(F.array(line), words, pairs))


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """200 * longest common subsequence / both lengths; 100 for two empty texts.  One row of the table at a time is
    folded over the first text's characters."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    other = chars(y)

    def step(row: Column, ch: Column) -> Column:
        # row[j]: longest for the first j characters; the new row grows from the left.
        return F.aggregate(
            F.sequence(F.lit(1), F.size(row) - 1), F.array(F.lit(0)),
            lambda new, j: F.concat(new, F.array(F.when(F.get(other, j - 1) == ch, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(new, -1))))),
        )

    start = F.transform(F.concat(F.array(F.lit("")), other), lambda _: F.lit(0))
    longest = F.when(F.size(other) == 0, 0).otherwise(F.element_at(F.aggregate(chars(x), start, step), -1))
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(200.0 * longest / total)


def tokens(c: Column) -> Column:
    """F21."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z\-']+"), F.lit(0))


def has_term(c: Column, term: str) -> Column:
    """the term as a word of its own, also with a plural s."""
    return c.rlike(r"\b" + term + r"s?\b")


def clauses(c: Column) -> Column:
    """parts between joining words and marks, trimmed, none empty."""
    parts = F.split(F.lower(c), r"\s+(?:paired with|worn with|with|and|plus|over|under)\s+|\s*[,+&/]\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def text_attributes(c: Column, colours: Sequence[str], groups: dict[str, str] = K.GROUP_WORDS, categories: dict[str, str] = K.CATEGORY_WORDS) -> Column:
    """struct of group (of the first word, in reading order, that names one), colour (the longest that the text contains)
    and category (of the longest word that names one); null where there is none."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    named = F.filter(F.transform(F.regexp_extract_all(lower, F.lit("[a-z][a-z-]*"), F.lit(0)), lambda w: F.try_element_at(table, w)), F.isnotnull)
    longest = lambda words: sorted(words, key=len, reverse=True)
    category = first_rule(lower, [(rf"\b{re.escape(w)}\b", categories[w]) for w in longest(categories)], regex=True)
    colour = first_rule(lower, [(w, w) for w in longest(sorted(filter(None, colours)))])
    return F.struct(F.get(named, F.lit(0)).alias("group"), colour.alias("colour"), category.alias("category"))


def constraints(c: Column, colours: Sequence[str], groups: dict[str, str] = K.GROUP_WORDS, categories: dict[str, str] = K.CATEGORY_WORDS) -> Column:
    """structs of phrase and attributes, one for each clause that names a group or a colour if two of them at least name
    different groups, else one for the whole text: `a black and white jacket` is one garment."""
    of = lambda x: F.struct(x.alias("phrase"), text_attributes(x, colours, groups, categories).alias("attributes"))
    whole = F.coalesce(c, F.lit(""))
    parts = F.filter(F.transform(F.split(whole, K.CLAUSE_SPLIT), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r"))), lambda p: p != "")
    telling = F.filter(F.transform(parts, of), lambda x: x["attributes"]["group"].isNotNull() | x["attributes"]["colour"].isNotNull())

    def choose(x: Column) -> Column:
        named = F.array_distinct(F.filter(F.transform(x, lambda y: y["attributes"]["group"]), F.isnotnull))
        return F.when((F.size(x) > 1) & (F.size(named) > 1), x).otherwise(F.array(of(whole)))

    return F.get(F.transform(F.array(telling), choose), F.lit(0))


def normal_query(c: Column) -> Column:
    """lower case, white space collapsed, marks trimmed at both ends."""
    return F.btrim(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "), F.lit(" .!?,;:"))


def _first_match(c: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, f"({p})", 1), F.lit("")) for p in patterns])


def _first_cue(c: Column, cues: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(x)), F.lit(x)) for x in cues])


def route(has_image: Column, text: Column, terms: Sequence[str] = ()) -> Column:
    """struct of intent and signals.  A bare `with` names a companion only if a category term follows it; terms
    stand in for the catalog's parser (X1)."""
    # A lambda's variable is computed once, however often the rules look at it.
    def decide(x: Column) -> Column:
        q, has_image = x["q"], x["image"]
        question, phrase = _first_match(q, K.PROPERTY_PATTERNS), _first_match(q, K.COMPANION_PATTERNS)
        after = F.regexp_extract(q, r"\bwith\b(.*)$", 1)
        term = F.coalesce(*[F.when(has_term(after, t), F.lit(t)) for t in terms]) if terms else F.lit(None).cast("string")
        with_text = has_image & (q != "")
        intent = (
            F.when(~has_image & (q == ""), "unroutable").when(~has_image, "search").when(q == "", "identify").when(question.isNotNull(), "brand")
            .when(phrase.isNotNull() | term.isNotNull(), "compose").otherwise("identify")
        )
        signal = lambda c: F.when(with_text, c)
        return F.struct(intent.alias("intent"), signal(question).alias("property_question"), signal(F.coalesce(phrase, F.when(term.isNotNull(), "with"))).alias("companion_cue"), signal(_first_cue(q, K.EXACTNESS_CUES)).alias("exactness_cue"), signal(_first_cue(q, K.SIMILARITY_CUES)).alias("similarity_cue"))

    return F.get(F.transform(F.array(F.struct(normal_query(text).alias("q"), has_image.alias("image"))), decide), F.lit(0))


def json_in(c: Column) -> Column:
    """the object inside an answer, without code fences; null where there is none."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def strict_json(c: Column) -> Column:
    """F32: an answer that is JSON as a whole, in code fences or not; null for anything else around it."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    # The parser stops behind the first value; only one whole value fits both into a list and behind a key.
    whole = [F.try_parse_json(F.concat(F.lit(a), bare, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.when(whole[0] & whole[1], bare)


def slugify(c: Column, most: int = 60) -> Column:
    """F34."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def parse_price(c: Column) -> Column:
    """the first number of a price text."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9,]*\.?[0-9]*)", 1), ",", ""), F.lit("")).cast("decimal(10,2)")


def stable_id(c: Column, length: int = 16) -> Column:
    """F36."""
    return F.substring(F.sha1(c), 1, length)


def shorten(brand: Column, name: Column, limit: int = 52) -> Column:
    """brand and name without the brand twice, cut at a word's end."""
    rest = F.when(F.startswith(F.lower(name), F.lower(brand)), F.trim(F.substr(name, F.length(brand) + 1))).otherwise(name)
    full = F.trim(F.concat_ws(" ", brand, rest))
    return F.when(F.length(full) <= limit, full).otherwise(F.regexp_replace(F.substring(full, 1, limit), r"\s+\S*$", ""))


def fingerprint(*columns: Column | str) -> Column:
    """What tells whether a row's metadata changed; nulls are passed over."""
    return F.md5(F.concat_ws("|", *columns))


def description(*columns: Column | str, most: int = 2000) -> Column:
    """the texts that are there, a line each, cut at `most` characters as the format has it."""
    return F.substring(F.concat_ws("\n", *columns), 1, most)


def flair(c: Column) -> Column:
    """F37."""
    return F.lower(F.trim(c))


def decision(confidence: Column, hedge: Column, reject: float = 0.2, sure: float = 0.8) -> Column:
    """what is said of an answer: the first rule that holds."""
    return F.when(confidence < reject, "rejected").when(hedge, "hedged").when(confidence >= sure, "sure").otherwise("likely")


def first_present(*columns: Column, default: str | None = None) -> Column:
    """the first value that is there."""
    return F.coalesce(*columns, F.lit(default))


def reference(address: Column, base: str) -> Column:
    """an address as it is, anything else below `base`."""
    return F.when(address.rlike("^https?://"), address).otherwise(F.concat(F.lit(base), address))
