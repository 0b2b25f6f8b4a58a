"""JSON artefacts: entity classes, schema state, hierarchies and caches, read into tables and written from them."""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, normalize_class

ANNOTATION = "map<string, struct<entity: string, classes: array<string>, class_paths: array<array<string>>, raw_output: string, status: string, error: string>>"
STATE = "struct<canonical_map: map<string, string>, subclass_edges: array<struct<parent: string, child: string>>, related_edges: array<struct<source: string, target: string>>>"


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """One row with the parsed file; None where the file is missing or no path is given."""
    if not path:
        return None
    try:
        return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


RECORD = "entity_id string, entity string, classes array<string>, class_paths array<array<string>>, raw_output string, status string, error string"


def entity_classes(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, entity, classes, class_paths, raw_output, status, error: of one JSON object of records by entity_id, or of
    what write_entity_classes() wrote (a record a line).  A missing file is an empty table."""
    got = _whole(spark, path, ANNOTATION)
    if got is None:
        return spark.createDataFrame([], RECORD)
    whole = got.filter("x is not null").select(F.explode("x").alias("entity_id", "r")).filter("r is not null").select("entity_id", "r.*")
    lines = spark.read.schema(RECORD).json(path).filter("entity_id is not null")
    return whole.unionByName(lines)


def write_entity_classes(annotations: DataFrame, path: str) -> None:
    """One JSON object a line, entity_id included; appended, so finished batches survive a stop."""
    annotations.write.mode("append").json(path)


def usable_classes(annotations: DataFrame, canonical: DataFrame) -> DataFrame:
    """entity_id, classes: cleaned, canonical, distinct but for case, in order; entities left without any are dropped.

    canonical: raw, canonical, pos.
    """
    from ..operators.ontology import canonicalize

    names = annotations.filter("classes is not null").select("entity_id", F.posexplode("classes").alias("pos", "name")).withColumn("name", normalize_class(F.col("name"))).filter("name <> ''")
    found = canonicalize(names, canonical)
    first = found.groupBy("entity_id", F.lower("canonical").alias("key")).agg(F.min(F.struct(found["pos"], "canonical")).alias("x"))
    return first.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["canonical"]).alias("classes"))


def schema_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """canonical (raw, canonical, pos), subclass (parent, child), related (source, target) with canonical names, no self edges.

    A missing file gives empty tables.
    """
    got = _whole(spark, path, STATE)
    if got is None:
        got = spark.createDataFrame([(None,)], f"x {STATE}")
    canonical = got.select(F.posexplode(F.map_entries("x.canonical_map")).alias("pos", "e")).select("e.key", "e.value", "pos").toDF("raw", "canonical", "pos")

    def mapped(kind: str, a: str, b: str) -> DataFrame:
        rows = got.select(F.explode(f"x.{kind}").alias("e")).select(F.col(f"e.{a}").alias(a), F.col(f"e.{b}").alias(b))
        for c in (a, b):
            names = canonical.select(F.col("raw").alias("_r"), F.col("canonical").alias("_c"))
            rows = rows.join(names, F.col(c) == F.col("_r"), "left").withColumn(c, F.coalesce("_c", c)).drop("_r", "_c")
        return rows.filter(F.col(a) != F.col(b)).distinct()

    related = mapped("related_edges", "source", "target")
    both = related.unionByName(related.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return canonical, mapped("subclass_edges", "parent", "child"), both


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file on any file system that Spark knows, put in place in one step."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(where, False)
    if not fs.rename(temp, where):
        raise OSError(f"could not write {path}")


def write_schema_state(spark: SparkSession, state: dict, path: str) -> None:
    """The export of the schema builder, with edges as named pairs."""
    named = state | {"subclass_edges": [{"parent": p, "child": c} for p, c in state["subclass_edges"]], "related_edges": [{"source": a, "target": b} for a, b in state["related_edges"]]}
    write_text(spark, path, json.dumps(named, ensure_ascii=False, indent=1))


def question_type_cache(spark: SparkSession, path: str) -> DataFrame:
    """question, types of a JSON object of class lists by question; a missing file is an empty table."""
    got = _whole(spark, path, "map<string, array<string>>")
    if got is None:
        return spark.createDataFrame([], "question string, types array<string>")
    return got.filter("x is not null").select(F.explode("x").alias("question", "types"))


def write_question_types(spark: SparkSession, types: DataFrame, path: str) -> None:
    """One JSON object; questions are a batch, so a driver's work."""
    write_text(spark, path, json.dumps({r["question"]: list(r["types"] or []) for r in types.orderBy("question").toLocalIterator()}, ensure_ascii=False, indent=1))


def entity_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(passage_id, entity) and (sentence, entity) of a recogniser's cache file: one JSON object with passage_hash_id_to_entities
    and sentence_to_entities.  A missing file gives empty tables."""
    kind = "map<string, array<string>>"
    got = _whole(spark, path, f"passage_hash_id_to_entities {kind}, sentence_to_entities {kind}")
    if got is None:
        got = spark.createDataFrame([(None,)], f"x struct<passage_hash_id_to_entities: {kind}, sentence_to_entities: {kind}>")
    pick = lambda c, key: got.filter("x is not null").select(F.explode(f"x.{c}").alias(key, "e")).select(key, F.explode("e").alias("entity"))
    return pick("passage_hash_id_to_entities", "passage_id"), pick("sentence_to_entities", "sentence")


def write_entity_cache(passage: DataFrame, sentence: DataFrame, path: str) -> None:
    """The same two tables as Parquet below `path`; at corpus size one JSON object is no format to write."""
    passage.select("passage_id", "entity").write.mode("overwrite").parquet(f"{path}/passage_entities")
    sentence.select("sentence", "entity").write.mode("overwrite").parquet(f"{path}/sentence_entities")


def entity_table(spark: SparkSession, path: str, hash_column: str = "hash_id", text_column: str = "text") -> DataFrame:
    """hash_id, entity of a Parquet entity store: trimmed, without blanks and repeats, in the order of neither."""
    rows = spark.read.parquet(path).select(F.trim(F.col(hash_column).cast("string")).alias("hash_id"), F.trim(F.col(text_column).cast("string")).alias("entity"))
    return rows.filter("hash_id <> '' and entity <> ''").groupBy("hash_id").agg(F.min("entity").alias("entity"))


def named_entities(spark: SparkSession, names: list[str]) -> DataFrame:
    """hash_id, entity of a few names given by hand; blank ones are left out."""
    rows = spark.createDataFrame([(n.strip(),) for n in dict.fromkeys(names) if n and n.strip()], "entity string")
    return rows.select(content_id("entity", F.col("entity")).alias("hash_id"), "entity")


def cycle_report(kept: list[tuple[str, str]], removed: list[tuple[str, str, str]], support: dict[tuple[str, str], int]) -> dict:
    """What making a hierarchy acyclic kept and removed: counts, and every removed edge with its support and reason."""
    why = Counter(r for _, _, r in removed)
    return {
        "num_candidate_edges": len(kept) + len(removed),
        "num_kept_edges": len(kept),
        "num_removed_edges": len(removed),
        "num_removed_by_reason": dict(sorted(why.items())),
        "removed_edges": [{"parent": p, "child": c, "reason": r, "support": support.get((p, c), 0)} for p, c, r in removed],
    }


def hierarchy_maps(paths: DataFrame) -> DataFrame:
    """kind, name, members: parent_to_children, child_to_parents, class_to_entities, leaf_class_to_entities, members sorted.

    paths: entity_id, path.  Member lists are the artefact; a class with very many entities is better kept as rows
    (entities_of_classes).
    """
    rows = paths.filter(F.size("path") >= 2)
    step = rows.select(F.explode(F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] as parent, path[i + 1] as child))")).alias("e")).select("e.*").distinct()
    members = entities_of_classes(paths)
    parts = [
        step.select(F.lit("parent_to_children").alias("kind"), F.col("parent").alias("name"), F.col("child").alias("m")),
        step.select(F.lit("child_to_parents").alias("kind"), F.col("child").alias("name"), F.col("parent").alias("m")),
        members.select(F.lit("class_to_entities").alias("kind"), F.col("class").alias("name"), F.col("entity_id").alias("m")),
        members.filter("is_leaf").select(F.lit("leaf_class_to_entities").alias("kind"), F.col("class").alias("name"), F.col("entity_id").alias("m")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kind", "name").agg(F.sort_array(F.collect_set("m")).alias("members"))


def entities_of_classes(paths: DataFrame) -> DataFrame:
    """class, entity_id, is_leaf: distinct; is_leaf where the class ends one of the entity's paths."""
    rows = paths.filter(F.size("path") >= 2).select("entity_id", F.posexplode("path").alias("i", "class"), F.size("path").alias("n"))
    return rows.groupBy("class", "entity_id").agg(F.max(F.col("i") == F.col("n") - 1).alias("is_leaf"))


def hierarchy_counts(paths: DataFrame) -> DataFrame:
    """num_entities, num_classes, num_parent_classes, num_child_classes."""
    rows = paths.filter(F.size("path") >= 2)
    classes = rows.select("entity_id", F.posexplode("path").alias("i", "class"), F.size("path").alias("n"))
    return classes.agg(
        F.countDistinct("entity_id").alias("num_entities"),
        F.countDistinct("class").alias("num_classes"),
        F.countDistinct(F.when(F.col("i") < F.col("n") - 1, F.col("class"))).alias("num_parent_classes"),
        F.countDistinct(F.when(F.col("i") > 0, F.col("class"))).alias("num_child_classes"),
    )


def write_hierarchy(spark: SparkSession, paths: DataFrame, path: str, kept: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """The hierarchy's maps as Parquet (kind, name, members) and its counts as JSON below `path`; kept and removed edges are
    counted where they are given.  paths: entity_id, path."""
    hierarchy_maps(paths).write.mode("overwrite").parquet(f"{path}/maps")
    counts = hierarchy_counts(paths).first().asDict()
    for name, edges in (("num_kept_edges", kept), ("num_removed_edges", removed)):
        if edges is not None:
            counts[name] = edges.count()
    write_text(spark, f"{path}/metadata.json", json.dumps(counts, indent=1))


def write_class_paths(annotations: DataFrame, path: str) -> None:
    """Class paths of entities (hash_id, entity, class_paths, classes, status, error) in the record format of entity_classes()."""
    write_entity_classes(annotations.withColumnRenamed("hash_id", "entity_id"), path)
