"""Command line: python -m evigraph.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import PROFILES, profile
from .functions.parsing import RELATIONS
from .functions.text import answer_classes
from .operators import annotate, corpus, ontology, qa
from .plans import retrieve
from .sources import artifacts, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evigraph")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="passages, sentences and graph tables of a JSON array of texts")
    a.add_argument("chunks")
    a.add_argument("out")
    a = sub.add_parser("evaluate", help="containment accuracy of a predictions file")
    a.add_argument("predictions")
    a = sub.add_parser("hierarchy", help="edges of class paths (entity, pos, path as Parquet) without cycles")
    a.add_argument("paths")
    a.add_argument("out")
    a = sub.add_parser("schema", help="incremental class schema from annotations (classes) and a table of relations")
    a.add_argument("annotations")
    a.add_argument("relations")
    a.add_argument("out")
    a.add_argument("--min-freq", type=int, default=1)
    a.add_argument("--max-classes", type=int, default=0)
    a.add_argument("--confidence", type=float, default=0.0)
    a.add_argument("--multi-parent", action="store_true")
    a = sub.add_parser("retrieve", help="the best passages of each question")
    a.add_argument("chunks", help="JSON array of texts")
    a.add_argument("questions", help="JSON array of objects with question and answer")
    a.add_argument("out", help="folder for qid, rank, idx, score, text as Parquet")
    a.add_argument("--profile", default="default", choices=sorted(PROFILES))
    a.add_argument("--embedder", default="evigraph.sources.seams:HashingEmbedder", help="module:name of an encoder")
    a.add_argument("--matrix", action="store_true", help="order-free propagation")
    a.add_argument("--classes", help="entity annotations (JSON); turns on class-aware search")
    a.add_argument("--schema-state", help="schema state (JSON), for canonical class names")
    a = sub.add_parser("qa", help="answers of a language model from retrieved passages")
    a.add_argument("ranked", help="folder written by retrieve")
    a.add_argument("questions")
    a.add_argument("out", help="folder for predictions as JSON lines")
    a.add_argument("--model", required=True, help="module:name of a language model")
    a = sub.add_parser("annotate", help="classes of entities (Parquet: hash_id, text) by a language model; finished ones are kept")
    a.add_argument("entities")
    a.add_argument("out", help="folder of JSON lines, appended")
    a.add_argument("--model", required=True)
    a.add_argument("--overwrite", action="store_true")
    return p


def plugin(name: str):
    """The object that module:name stands for; a class is made without arguments."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def run_retrieve(spark: SparkSession, args: argparse.Namespace) -> None:
    config = profile(args.profile, matrix_propagation=args.matrix, use_class_schema=bool(args.classes))
    questions = store.questions(spark, args.questions).select("qid", "question")
    p = corpus.passages(store.chunks(spark, args.chunks))
    classes = types = canonical = None
    if args.classes:
        canonical = artifacts.schema_state(spark, args.schema_state)[0] if args.schema_state else spark.createDataFrame([], "raw string, canonical string, pos int")
        rows = artifacts.entity_classes(spark, args.classes)
        names = rows.select("entity_id", "entity")
        classes = artifacts.usable_classes(rows, canonical).join(names, "entity_id").select("entity", "classes")
        types = questions.select("qid", answer_classes(F.col("question")).alias("types"))
    found = retrieve.retrieve(questions, p, plugin(args.embedder), config, classes, types, canonical)
    found.join(p.select("idx", "text"), "idx").select("qid", "rank", "idx", "score", "text").write.mode("overwrite").parquet(args.out)


def run_annotate(spark: SparkSession, args: argparse.Namespace) -> None:
    entities = artifacts.entity_table(spark, args.entities)
    done = artifacts.entity_classes(spark, args.out).filter("status = 'success'").select(F.col("entity_id").alias("hash_id")).distinct()
    got = annotate.annotate(entities, done, plugin(args.model), args.overwrite)
    artifacts.write_entity_classes(got.withColumnRenamed("hash_id", "entity_id"), args.out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("evigraph").getOrCreate()
    if args.command == "index":
        p = corpus.passages(store.chunks(spark, args.chunks))
        p.write.mode("overwrite").parquet(f"{args.out}/passages")
        corpus.sentence_entities(p, "passage_id").write.mode("overwrite").parquet(f"{args.out}/mentions")
        weights = corpus.entity_edges(corpus.passage_entities(p, "passage_id"), "passage_id")
        ids = p.select("idx", "passage_id")
        links = corpus.adjacent(p, "idx").join(ids.withColumnRenamed("passage_id", "src"), "idx").join(ids.withColumnsRenamed({"idx": "next", "passage_id": "dst"}), "next")
        corpus.edges(weights, links).write.mode("overwrite").parquet(f"{args.out}/edges")
    elif args.command == "evaluate":
        rows = spark.read.option("multiLine", True).json(args.predictions).withColumn("gold", F.col("gold_answer")).withColumn("qid", F.monotonically_increasing_id())
        logging.info("%s", qa.evaluate(rows)[1].first().asDict())
    elif args.command == "retrieve":
        run_retrieve(spark, args)
    elif args.command == "qa":
        questions = store.questions(spark, args.questions)
        answers = qa.read(questions, spark.read.parquet(args.ranked), plugin(args.model))
        store.write_predictions(questions.join(answers, "qid").select("qid", "question", F.col("answer").alias("gold_answer"), "pred_answer", "status"), args.out)
    elif args.command == "annotate":
        run_annotate(spark, args)
    elif args.command == "hierarchy":
        found = ontology.path_edges(spark.read.parquet(args.paths)).cache()
        edges = [(r["parent"], r["child"], r["support"], r["depth"]) for r in found.select("parent", "child", "support", "depth").collect()]  # one row a class pair
        kept, removed = ontology.acyclic(edges)
        marks = spark.createDataFrame([(*e, True, None) for e in kept] + [(p, c, False, why) for p, c, why in removed], "parent string, child string, kept boolean, reason string")
        found.join(marks, ["parent", "child"]).write.mode("overwrite").parquet(args.out)
        artifacts.write_text(spark, f"{args.out}-report.json", json.dumps(artifacts.cycle_report(kept, removed, {e[:2]: e[2] for e in edges}), ensure_ascii=False, indent=1))
    else:
        ordered = ontology.class_frequency(spark.read.parquet(args.annotations), args.min_freq, args.max_classes).collect()
        asked = {r["class"] for r in ordered}
        known = spark.createDataFrame([(c,) for c in sorted(asked)], "class string")
        relations = spark.read.parquet(args.relations)
        for side in ("class_a", "class_b"):
            relations = relations.join(known.withColumnRenamed("class", side), side, "left_semi")
        table = {(r["class_a"], r["class_b"]): (r["relation"], r["confidence"]) for r in relations.toLocalIterator()}  # pairs of the ordered classes

        def judge(a: str, b: str) -> tuple[str, float]:
            if (a, b) in table:
                return table[a, b]
            kind, sure = table.get((b, a), (RELATIONS[-1], 0.0))
            return ontology.INVERSE.get(kind, kind), sure

        schema = ontology.build_schema([(r["class"], r["freq"]) for r in ordered], judge, threshold=args.confidence, multi_parent=args.multi_parent)
        artifacts.write_schema_state(spark, schema.export(), args.out)


if __name__ == "__main__":
    main()
