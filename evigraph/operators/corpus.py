"""Passages, sentences, entities and the entity-passage graph."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id

SENTENCE = r"[^.!?\n]+[.!?]*"
ENTITY = "[A-Za-z]{8,}"
DROPPED_LABELS = ("ORDINAL", "CARDINAL")


def passages(chunks: DataFrame) -> DataFrame:
    """idx, text, passage_id.  Texts that all begin with a number and a colon stay; else all get their index in front."""
    numbered = F.broadcast(chunks.agg(F.coalesce(F.bool_and(F.trim("text").rlike(r"^\d+:")), F.lit(True)).alias("_all")))  # one row
    text = F.when(F.col("_all"), F.col("text")).otherwise(F.concat(F.col("idx").cast("string"), F.lit(":"), F.col("text")))
    return chunks.crossJoin(numbered).select("idx", text.alias("text")).withColumn("passage_id", content_id("passage", F.col("text")))


def sentences(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, sentence."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))).alias("pos", "sentence"))
    return found.select(key, "pos", F.trim("sentence").alias("sentence")).filter("sentence <> ''")


def entities_of(text: Column, pattern: str = ENTITY) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def labelled_entities(texts: DataFrame, key: str) -> DataFrame:
    """key, entity, label of the offline recogniser: numbers are CARDINAL, numbers with an ending ORDINAL, long words TERM."""
    found = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit("[0-9]+(?:st|nd|rd|th)?|[A-Za-z]{8,}"), F.lit(0))).alias("entity"))
    label = F.when(F.col("entity").rlike("^[0-9]+$"), "CARDINAL").when(F.col("entity").rlike("^[0-9]"), "ORDINAL").otherwise("TERM")
    return found.select(key, "entity", label.alias("label"))


def named(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("label").isin(*DROPPED_LABELS))


def question_entities(questions: DataFrame, pattern: str = ENTITY) -> DataFrame:
    """qid, mention: the distinct entities of each question, lower-cased."""
    found = F.array_distinct(F.transform(entities_of(F.col("question"), pattern), F.lower))
    return questions.select("qid", F.explode(found).alias("mention"))


def passage_entities(texts: DataFrame, key: str, pattern: str = ENTITY) -> DataFrame:
    """key, entity, n: the distinct entities of each text and how often each occurs in it as a substring.

    Counted in Arrow batches: a column expression would copy the text once for each of its entities.
    """
    kind = dict(texts.dtypes)[key]
    find = re.compile(pattern).findall

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, names, counts = [], [], []
                for i, t in enumerate(part.column(1)):
                    text = t.as_py() or ""
                    for e in dict.fromkeys(find(text)):
                        rows.append(i)
                        names.append(e)
                        counts.append(text.count(e))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], [key, "entity", "n"])

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, entity string, n bigint")


def sentence_entities(texts: DataFrame, key: str, pattern: str = ENTITY, distinct: bool = True) -> DataFrame:
    """sentence, entity: distinct over all texts; sentences without entities are absent.  Otherwise a row for each occurrence of a
    sentence: nothing is shuffled, and who takes a part of them makes that part distinct."""
    found = sentences(texts, key).select("sentence", F.explode(entities_of(F.col("sentence"), pattern)).alias("entity"))
    return found.distinct() if distinct else found


def entity_edges(counts: DataFrame, key: str) -> DataFrame:
    """Share of each entity in its passage's counts; 0 where they sum to 0."""
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.select(key, "entity", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("weight"))


def adjacent(rows: DataFrame, idx: str, bucket: int = 4096) -> DataFrame:
    """idx, next: each index and the next larger one (gaps allowed), without a window over all rows.

    Each bucket of indexes is ordered on its own; its last index meets the first of the next bucket that is not empty, found
    over one row a bucket.
    """
    part = rows.select(F.col(idx).cast("bigint").alias("idx")).distinct().withColumn("b", F.floor(F.col("idx") / bucket))
    inner = part.withColumn("next", F.lead("idx").over(Window.partitionBy("b").orderBy("idx")))
    if bucket < 1 << 40:
        firsts = part.groupBy("b").agg(F.min("idx").alias("idx"))
        links = adjacent(firsts, "idx", bucket * 4096)
        ahead = firsts.join(links.withColumnRenamed("idx", "i").withColumnRenamed("next", "first"), F.col("idx") == F.col("i")).select("b", "first")
        return inner.join(ahead, "b", "left").select("idx", F.coalesce("next", "first").alias("next")).filter("next is not null")
    return inner.filter("next is not null").select("idx", "next")


def nodes(entities: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """node_id, kind, content."""
    e = entities.select("entity").distinct().select(content_id("entity", F.col("entity")).alias("node_id"), F.lit("entity").alias("kind"), F.col("entity").alias("content"))
    p = passage_rows.select(F.col("passage_id").alias("node_id"), F.lit("passage").alias("kind"), F.col("text").alias("content")).dropDuplicates(["node_id"])
    return e.unionByName(p)


def edges(weights: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst, weight, kind stored once: entity-passage shares and neighbouring passages with weight 1; no self edges.

    weights: entity, passage_id, weight; links: src, dst.
    """
    a = weights.select(content_id("entity", F.col("entity")).alias("src"), F.col("passage_id").alias("dst"), "weight", F.lit("mention").alias("kind"))
    b = links.select("src", "dst", F.lit(1.0).alias("weight"), F.lit("adjacent").alias("kind"))
    return a.unionByName(b).filter("src <> dst")


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst"))
