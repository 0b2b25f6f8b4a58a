"""Datasets, content-addressed stores, caches and sinks.  Inputs and outputs go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from .seams import Embedder, encoded


def questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, answer of a JSON array; qid is the place in the array."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<question:string,answer:string>>")).alias("qid", "x"))
    return rows.select(F.col("qid").cast("bigint").alias("qid"), "x.question", "x.answer")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """idx, text of a JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "text")).select(F.col("idx").cast("bigint").alias("idx"), "text")


def missing(incoming: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows of `incoming` whose key isn't stored."""
    return incoming.join(store.select(key), key, "left_anti")


def distinct_texts(texts: DataFrame, namespace: str, text: str = "text", position: str = "pos") -> DataFrame:
    """hash_id, text, pos: one row for each text, at its first position."""
    return texts.groupBy(content_id(namespace, F.col(text)).alias("hash_id")).agg(F.min_by(text, position).alias("text"), F.min(position).alias("pos"))


def upsert(store: DataFrame, incoming: DataFrame, key: str = "hash_id") -> DataFrame:
    """The store and what it lacks; a key that is stored keeps its row."""
    return store.unionByName(missing(incoming, store, key))


def append_missing(spark: SparkSession, path: str, incoming: DataFrame, key: str = "hash_id") -> None:
    """Appends only the delta to a Parquet store."""
    try:
        store = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        incoming.write.parquet(path)
        return
    missing(incoming, store, key).write.mode("append").parquet(path)


def pending(requested: DataFrame, cache: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    return requested if overwrite else missing(requested, cache, key)


def merge_entities(old: DataFrame, new: DataFrame, keys: list[str], value: str, replace: bool = False) -> DataFrame:
    """Union of two (key, value) tables; with `replace`, keys of the new one lose their old values."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti") if replace else old
    return kept.select(*keys, value).unionByName(new.select(*keys, value)).distinct()


def append_encoded(spark: SparkSession, path: str, texts: DataFrame, embedder: Embedder, batch: int = 128) -> DataFrame:
    """Encodes the texts (hash_id, text) that a Parquet store lacks, appends them, and returns the store."""
    try:
        new = missing(texts.select("hash_id", "text").dropDuplicates(["hash_id"]), spark.read.parquet(path))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = texts.select("hash_id", "text").dropDuplicates(["hash_id"])
    encoded(new, embedder, batch).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_evaluation(rows: DataFrame, means: DataFrame, path: str) -> None:
    """Predictions with their scores, and the mean scores beside them."""
    rows.write.mode("overwrite").json(f"{path}/predictions")
    means.write.mode("overwrite").json(f"{path}/evaluation_results")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, value: the lines of a GraphML file of the graph, to be ordered by part: 0 head, 1 nodes with kind and content,
    2 edges, 3 foot."""
    spark = nodes.sparkSession
    clean = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keys = "".join(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{kind}"/>' for k, of, kind in (("kind", "node", "string"), ("content", "node", "string"), ("weight", "edge", "double")))
    ends = spark.createDataFrame([(0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'), (3, "</graph></graphml>")], "part int, value string")
    line = lambda c: F.regexp_replace(clean(c), "[\r\n]", " ")
    data = lambda k: F.concat(F.lit(f'<data key="{k}">'), line(k), F.lit("</data>")) if k in nodes.columns else F.lit("")
    a = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), line("node_id"), F.lit('">'), data("kind"), data("content"), F.lit("</node>")).alias("value"))
    b = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), line("src"), F.lit('" target="'), line("dst"), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    return ends.unionByName(a).unionByName(b)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes the lines as text files that give the GraphML file when joined in the order of their names."""
    graphml_lines(nodes, edges).repartitionByRange("part", F.xxhash64("value")).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)
