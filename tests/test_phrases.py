"""What texts name: terms, attributes and constraints, against loops and by cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.constants import STOPWORDS
from tessera.operators import phrases as P

TERMS = [("denim shorts", "denim shorts", "shorts", "bottoms"), ("shorts", None, "shorts", "bottoms"), ("loafer", None, "loafer", "footwear"), ("running shoe", "running shoe", "shoe", "footwear"), ("shoe", None, "shoe", "footwear"), ("jorts", "denim shorts", "shorts", "bottoms"), ("red shoe store", None, "store", "other")]


def frames(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return rows, spark.createDataFrame([(*t, k) for k, t in enumerate(TERMS)], "term string, leaf string, category string, group string, place int")


def brute_term(text):
    plain = re.sub(r"[^a-z0-9\s]", " ", (text or "").lower())
    found = [(leaf is not None, len(term.split()), -k, term) for k, (term, leaf, _, _) in enumerate(TERMS) if re.search(rf"\b{re.escape(term)}s?\b", plain)]
    return max(found)[-1] if found else None


def test_terms_against_loops(spark):
    rng = random.Random(23)
    words = ["denim", "shorts", "short", "loafer", "loafers", "running", "shoe", "shoes", "jorts", "red", "store", "Denim", "shoess"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "-", ", ", "'"]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, ""]
    rows, terms = frames(spark, texts)
    got = {r.id: r.term for r in P.match_terms(rows, terms, 3).collect()}
    assert {i: got.get(i) for i in range(len(texts))} == {i: brute_term(t) for i, t in enumerate(texts)}


def test_fragments(spark):
    rows, terms = frames(spark, ["with red cargo jorts and red trim", "nothing known", None, "the red red shoe"])
    index = spark.createDataFrame([("red", "colour", "red", 5), ("red", "colour", "dark red", 5), ("red", "name", "red one", 7), ("red", "name", "zebra", 1), ("cargo", "pockets", "cargo", 2), ("trim", "detail", "trim", 9), ("jorts", "name", "jorts", 99), ("the", "name", "the", 99)], "token string, field string, value string, n long")
    got = {r.id: r for r in P.parse_fragments(rows, terms, index, 3).collect()}
    assert (got[0].term, got[0].leaf, got[0].group) == ("jorts", "denim shorts", "bottoms") and got[3].category == "shoe" and got[1].term is None and got[2].attributes is None
    assert [(a.keyword, a.fields, a.example_values, a.evidence) for a in got[0].attributes] == [("red", ["colour", "name"], ["red one", "dark red", "red"], 18), ("trim", ["detail"], ["trim"], 9), ("cargo", ["pockets"], ["cargo"], 2)]
    assert [a.keyword for a in got[3].attributes] == ["red"] and "the" in STOPWORDS


def test_only_five_words_of_most_evidence(spark):
    rows, terms = frames(spark, ["one two three four five six seven"])
    index = spark.createDataFrame([(w, "f", w, n) for w, n in (("one", 1), ("two", 9), ("three", 9), ("four", 3), ("five", 4), ("six", 5), ("seven", 6))], "token string, field string, value string, n long")
    assert [(r.keyword, r.k) for r in P.match_attributes(rows, P.match_terms(rows, terms), index).orderBy("k").collect()] == [("two", 1), ("three", 2), ("seven", 3), ("six", 4), ("five", 5)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("shirt and jacket", [("shirt", "tops", None, "shirt"), ("jacket", "outerwear", None, "jacket")]),
        ("red and blue shirt", [("red and blue shirt", "tops", "blue", "shirt")]),
        ("a black and white jacket", [("a black and white jacket", "outerwear", "black", "jacket")]),
        ("jorts with red shoes", [("jorts with red shoes", "footwear", "red", "shorts")]),
        ("Blue T-Shirt, plain, red hat", [("Blue T-Shirt", "tops", "blue", "t-shirt"), ("red hat", "accessories", "red", "hat")]),
        ("jeans+shoes/", [("jeans", "bottoms", None, "pants"), ("shoes", "footwear", None, None)]),
        ("shirt and sweater", [("shirt and sweater", "tops", None, "sweater")]),
        ("navy blue pants", [("navy blue pants", "bottoms", "navy blue", "pants")]),
        ("", [("", None, None, None)]), (None, [("", None, None, None)]), ("with and", [("with and", None, None, None)]),
    ],
)
def test_constraints(spark, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(T.constraints(F.col("text"), ["red", "blue", "black", "white", "navy blue", ""]).alias("x")).first().x
    assert [(r.phrase, r.attributes.group, r.attributes.colour, r.attributes.category) for r in got] == want


@pytest.mark.parametrize(
    ("answer", "fine"),
    [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('```\n[1, 2]\n```', True), ('{"a": 1} trailing', False), ('```json\n{"a": 1}\n```, bye', False), ('{"a": 1}, {"b": 2}', False), ('{"a": 1}] x', False), ('{"a": 1}} x', False), ('1, "w": 2', False), ("", False), ("Here: {}", False), (None, False), ('{"a": ', False)],
)
def test_strict_json(spark, answer, fine):
    assert (spark.createDataFrame([(answer,)], "c string").select(T.strict_json(F.col("c")).alias("x")).first().x is not None) == fine
