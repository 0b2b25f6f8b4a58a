"""Scalar rules and parsers on small rows."""

import pytest
from pyspark.sql import functions as F

from evigraph.config import Config, profile
from evigraph.functions import parsing, text
from evigraph.operators import corpus, qa


def value(spark, expr, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("The U.S.A. -- a test, an (apple)!", "usa test apple"), ("the", ""), (None, ""), ("Ça  va\tTHE end", "ça va end")])
def test_normalize_answer(spark, raw, want):
    assert value(spark, text.normalize_answer, raw) == want


def test_occurrences(spark):
    assert value(spark, text.occurrences, "aaaa", "aa") == 2 and value(spark, text.occurrences, "abc", "") == 0


@pytest.mark.parametrize("question,want", [("When was Ada born?", ["Place", "City", "Country", "Location"]), ("Who runs the company?", ["Person", "Organization"]), ("How many are there?", ["Number", "Quantity"]), ("Describe it.", [])])
def test_answer_classes(spark, question, want):
    assert value(spark, text.answer_classes, question) == want


@pytest.mark.parametrize("name,want", [("capital CITY", "Capital CITY"), ("NASA center", "NASA center"), ("person", "Person"), ("", "")])
def test_capitalize(spark, name, want):
    assert value(spark, text.capitalize_class, name) == want == parsing.capital(name)


@pytest.mark.parametrize("texts,want", [(["a", "b"], ["0:a", "1:b"]), (["0:a", "7:b"], ["0:a", "7:b"]), (["0:a", "b"], ["0:0:a", "1:b"]), ([], [])])
def test_passages(spark, texts, want):
    got = corpus.passages(spark.createDataFrame(list(enumerate(texts)), "idx bigint, text string")).orderBy("idx").collect()
    assert [r["text"] for r in got] == want


def test_class_list():
    assert parsing.class_list('Answer: {"types":["city"]}') == ["City"]
    assert parsing.clean_classes(["person", "Person", " a b c d ", "because x", "City"]) == ["Person", "City"]
    assert parsing.class_list("Place; city\ncapital city") == ["Place", "City", "Capital city"]
    assert parsing.class_list("place city capital city", phrases=frozenset({"capital city"})) == ["Place", "City", "Capital city"]
    assert parsing.class_list("a b c d e f g") == [] and parsing.class_list(None) == []
    assert parsing.class_list('noise ["x1", "Y"] more') == ["X1", "Y"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("type of entity", []),
        ("organization brand fruit", ["Organization", "Brand", "Fruit"]),
        ("Classes: work of art unknown label", ["Work of art"]),
        ("place city capital city", ["Place", "City", "Capital city"]),
        ("ANSWER : ```json\n[\"person\"]\n```", ["Person"]),
        ("<think>[1]</think>Answer: city", ["City"]),
        ("The Answer: city, place", ["The Answer: city", "Place"]),
        ('{"types": "x"} ["Place"]', ["Place"]),
        ("b2 c-d", ["C-d"]),
    ],
)
def test_class_list_golden(raw, want):
    assert parsing.class_list(raw) == want


def test_query_class_list():
    assert parsing.query_class_list('Answer: [" Place ", "", 3]') == ["Place", "3"]
    assert parsing.query_class_list('so ["a"] it is') == ["a"] and parsing.query_class_list("Person, City,,") == ["Person", "City"]
    assert parsing.query_class_list("Person") == [] and parsing.query_class_list(None) == []


def test_relation():
    assert parsing.relation("I think a_parent_b")[:2] == ("A_PARENT_B", 0.5)
    assert parsing.relation('{"relation":"nope","confidence":0.9}')[:2] == ("UNCERTAIN", 0.9)
    assert parsing.relation("unrelated")[:2] == ("UNRELATED", 0.5)
    assert parsing.relation('{"relation":"RELATED","confidence":0.2, "reason": " r "}') == ("RELATED", 0.2, "r")
    assert parsing.relation('{"relation":"RELATED","confidence":"high"}')[:2] == ("RELATED", 0.5)  # unreadable: by the text
    assert parsing.relation('[1] {"relation":"EQUIVALENT","confidence":1}')[:2] == ("EQUIVALENT", 1.0)
    assert parsing.relation(None)[:2] == ("UNCERTAIN", 0.0) and parsing.relation("?")[:2] == ("UNCERTAIN", 0.0)


def test_paths():
    assert parsing.clean_paths([["Person", "person", "Scientist"]]) == [["Entity", "Person", "Scientist"]]
    assert parsing.class_paths('x {"paths": [["Entity","A"],["entity","a"],["B"]]} y') == [["Entity", "A"], ["Entity", "B"]]
    assert parsing.class_paths('["Person","Poet"]') == [["Entity", "Person", "Poet"]] and parsing.class_paths("none") == []
    assert parsing.class_paths('{"type_paths": [["Unknown", "Json thing", "Place"]]}') == [["Entity", "Place"]]
    assert parsing.class_paths('{"types": ["place", "city"]}') == [["Entity", "Place", "City"]]
    assert parsing.class_paths('[["a"], "b"]') == [["Entity", "A", "B"]]
    assert parsing.class_paths('[["N/A"], ["x", "entity"]]') == [["Entity", "X", "Entity"]]
    assert parsing.cut_at_repeat(["Entity", "Person", "Scientist", "Person", "X"]) == ["Entity", "Person", "Scientist"]


def test_containment(spark):
    assert value(spark, qa.contained, "It is Paris, France.", "paris") == 1
    assert value(spark, qa.contained, "It is Paris", "") == 0 and value(spark, qa.contained, "x", "the") == 1
    assert value(spark, lambda a, b: qa.contained(a, b, True), "x", "the") == 0


def test_config():
    assert profile("musique").max_iterations == 5 and profile("musique", damping=0.3).damping == 0.3
    with pytest.raises(ValueError):
        Config(damping=1.5)
