"""Scalar functions over text columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Words that make a question ask for an attribute.
ATTRIBUTE_WORDS = ("born", "birth", "where", "when", "located", "location", "founded", "founder", "died", "death", "nationality", "capital", "date", "year")
#: Characters cut from both ends of a class name.
CLASS_EDGES = " .。,:;；，[]{}()\"'"
#: Words of a question (all of a rule's groups must occur) and the answer classes; the first rule wins.
ANSWER_RULES = (
    ((("where", "located", "location", "place", "capital"),), ("Place", "City", "Country", "Location")),
    ((("born", "birthplace"),), ("Place", "City", "Country", "Location")),
    ((("when", "date", "year", "time"),), ("Date", "Time", "Year")),
    ((("who", "whom"),), ("Person", "Organization")),
    ((("company", "organization", "institution", "university"),), ("Organization", "Company", "Institution")),
    ((("how",), ("many",)), ("Number", "Quantity")),
    ((("number", "count", "population"),), ("Number", "Quantity")),
    ((("country",),), ("Country", "Place")),
    ((("city",),), ("City", "Place")),
    ((("language",),), ("Language",)),
)


def content_id(namespace: str, text: Column) -> Column:
    return F.concat(F.lit(namespace + "-"), F.md5(text))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null: empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a substring; none of an empty one."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def word_set(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def is_attribute_query(question: Column, words=ATTRIBUTE_WORDS) -> Column:
    return F.arrays_overlap(word_set(question), F.array(*map(F.lit, words)))


def attribute_overlap(question: Column, passage: Column, words=ATTRIBUTE_WORDS) -> Column:
    q, p = F.lower(question), F.lower(passage)
    return sum((F.contains(q, F.lit(w)) & F.contains(p, F.lit(w))).cast("int") for w in words)


def answer_classes(question: Column) -> Column:
    found = word_set(question)
    out = F.array().cast("array<string>")
    for groups, classes in reversed(ANSWER_RULES):
        fits = F.lit(True)
        for g in groups:
            fits = fits & F.arrays_overlap(found, F.array(*map(F.lit, g)))
        out = F.when(fits, F.array(*map(F.lit, classes))).otherwise(out)
    return out


def normalize_class(name: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " ")
    return F.btrim(squeezed, F.lit(CLASS_EDGES))


def capitalize_class(name: Column) -> Column:
    """Upper first letter; the rest as it is where capitals occur inside, else lower."""
    rest = F.substring(name, 2, 1 << 30)
    return F.when(name.rlike(r"(?s)^.+[A-Z]"), F.concat(F.upper(F.substring(name, 1, 1)), rest)).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.lower(rest)))


def passage_number(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\d+):", 1).try_cast("bigint")


def last_answer(text: Column) -> Column:
    """What follows the last "Answer:", without thought and tool tags, trimmed; null: empty."""
    tail = F.element_at(F.split(F.coalesce(text, F.lit("")), "Answer:"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(tail, r"(?s)<think>.*?</think>", ""), r"(?s)</?tool[^>]*>", ""))
