"""Class annotations of entities and questions by rules and a language model; results are rows, so runs can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.text import answer_classes
from ..sources.seams import LanguageModel, answered
from ..sources.store import pending


def class_prompt(name):
    return F.concat(F.lit("Name the semantic classes of this entity as a JSON list: "), name)


def strict_prompt(name):
    return F.concat(F.lit('Reply with nothing but a JSON list of class names, such as ["Person"]. Entity: '), name)


def entity_classes(entities: DataFrame, model: LanguageModel, limit: int = 4) -> DataFrame:
    """hash_id, entity, classes, raw_output, status, error; entities without classes are asked once more, strictly."""
    parse = parsing.apply(lambda s: parsing.class_list(s, limit), "array<string>")

    def ask(rows: DataFrame, prompt) -> DataFrame:
        got = answered(rows.select("hash_id", prompt(F.col("entity")).alias("prompt")), "prompt", "hash_id", model)
        return rows.join(got, "hash_id").withColumn("classes", parse("raw_output"))

    first = ask(entities.select("hash_id", "entity"), class_prompt).cache()
    again = ask(first.filter((F.size("classes") == 0) & F.col("error").isNull()).select("hash_id", "entity"), strict_prompt)
    both = first.join(again.select("hash_id"), "hash_id", "left_anti").unionByName(again)
    return both.select("hash_id", "entity", "classes", "raw_output", F.when(F.col("status") == "failed", "failed").when(F.size("classes") > 0, "success").otherwise("empty").alias("status"), "error")


def annotate(entities: DataFrame, cache: DataFrame, model: LanguageModel, overwrite: bool = False, limit: int = 4) -> DataFrame:
    """The annotations that are still missing."""
    return entity_classes(pending(entities, cache, "hash_id", overwrite), model, limit)


def class_paths(entities: DataFrame, model: LanguageModel, max_paths: int = 4, max_length: int = 4) -> DataFrame:
    """hash_id, entity, class_paths, classes (their distinct last names, sorted), status, error."""
    prompt = F.concat(F.lit('Give class paths from Entity down as {"class_paths": [["Entity", ...]]} for: '), "entity")
    got = answered(entities.select("hash_id", prompt.alias("prompt")), "prompt", "hash_id", model)
    parse = parsing.apply(lambda s: parsing.class_paths(s, max_paths=max_paths, max_length=max_length), "array<array<string>>")
    out = entities.join(got, "hash_id").withColumn("class_paths", parse("raw_output"))
    leaves = F.array_sort(F.array_distinct(F.transform("class_paths", lambda p: F.element_at(p, -1))))
    return out.select("hash_id", "entity", "class_paths", leaves.alias("classes"), F.when(F.col("error").isNotNull(), "failed").when(F.size("class_paths") > 0, "success").otherwise("empty").alias("status"), "error")


def question_types(questions: DataFrame, cache: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """question, types: from the cache as stored, else by rules, else, if a model is given, by asking it."""
    keyed = questions.select(F.trim("question").alias("question")).distinct()
    known = keyed.join(cache.select("question", "types"), "question")
    new = keyed.join(cache, "question", "left_anti").withColumn("types", answer_classes(F.col("question")))
    if model is None:
        return known.unionByName(new)
    open_ = new.filter(F.size("types") == 0).select("question")
    parse = parsing.apply(parsing.query_class_list, "array<string>")
    got = answered(open_.select("question", F.concat(F.lit("Which classes can the answer have? Reply with a JSON list. "), "question").alias("prompt")), "prompt", "question", model)
    return known.unionByName(new.filter(F.size("types") > 0)).unionByName(got.select("question", parse("raw_output").alias("types")))


def relation_prompt(a: str, b: str) -> str:
    return f'How do these classes relate? Reply with {{"relation": one of {", ".join(parsing.RELATIONS)}, "confidence": 0 to 1, "reason": ...}} only.\nA: {a}\nB: {b}'


def relation_judge(model: LanguageModel, retries: int = 2):
    """A judge for ontology.Schema that asks a model, and asks again up to `retries` times while it is UNCERTAIN."""

    def judge(a: str, b: str) -> tuple[str, float, str]:
        for _ in range(retries + 1):
            got = parsing.relation(model.answer([relation_prompt(a, b)])[0])
            if got[0] != "UNCERTAIN":
                break
        return got

    return judge
