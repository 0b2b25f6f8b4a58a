"""Retrieval as one plan for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_id, is_attribute_query
from ..operators import annotate, corpus, ontology, retrieval
from ..sources import artifacts
from ..sources.seams import Embedder, LanguageModel, encoded


def graph(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity-passage shares idx, entity, weight; edges src, dst, weight with passages named p<idx>)."""
    shares = corpus.entity_edges(corpus.passage_entities(passages, "idx"), "idx")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    near = corpus.adjacent(passages, "idx").select(name("idx").alias("src"), name("next").alias("dst"), F.lit(1.0).alias("weight"))
    return shares, shares.select(F.col("entity").alias("src"), name("idx").alias("dst"), "weight").unionByName(near)


def node_weights(entity: DataFrame, scores: DataFrame) -> DataFrame:
    passage = scores.select("qid", F.concat(F.lit("p"), F.col("idx").cast("string")).alias("node"), "weight")
    return retrieval.reset_weights(entity.select("qid", F.col("entity").alias("node"), "weight"), passage)


def search(passages: DataFrame, dense: DataFrame, weights: DataFrame, activated: DataFrame, config: Config, compat: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """qid, idx, score of passages by PageRank from entity weights and passage scores.

    dense: qid, idx, sim; weights: qid, entity, weight; activated: qid, entity, score, tier; compat: qid, entity, compat
    turns on the class prior and, by the config, query-aware edges; texts (qid, idx, question, text) the attribute fallback.
    """
    shares, edges = graph(passages)
    scores = retrieval.passage_scores(dense, retrieval.entity_bonus(passages, activated), config, texts)
    changed = None
    if compat is not None:
        compat = compat.filter("compat > 0")
        weights = retrieval.class_prior(weights, activated, compat, config.class_prior)
        if config.edge_transition:
            bridges = activated.filter("tier <= 1").join(shares, "entity").select("qid", "idx").distinct()
            own = compat.join(activated.select("qid", "entity"), ["qid", "entity"], "left_semi")
            new = retrieval.reweighted(shares, own, bridges, activated, config)
            changed = new.select("qid", F.col("entity").alias("src"), F.concat(F.lit("p"), F.col("idx").cast("string")).alias("dst"), F.col("new_weight").alias("weight"))
    name = F.concat(F.lit("p"), F.col("idx").cast("string")).alias("node")
    ranks = retrieval.pagerank(edges, node_weights(weights, scores), config, changed, passages.select(name))
    return ranks.select("qid", F.substring("node", 2, 30).cast("bigint").alias("idx"), "score")


def propagate(seed: DataFrame, mention: DataFrame, sims: retrieval.Similarity, config: Config, compat: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights qid, entity, weight; activated qid, entity, score, tier), in the mode of the config; only the frontier mode
    knows the class boost."""
    if config.matrix_propagation:
        weights, activated = retrieval.propagate_matrix(seed, mention, sims, config)
        return retrieval.cut(weights), retrieval.cut(activated)
    found = retrieval.cut(retrieval.propagate_frontier(seed, mention, sims, config, compat))
    return found.select("qid", "entity", "weight"), found.select("qid", "entity", "score", "tier")


def vectors(texts: DataFrame, column: str, embedder: Embedder, batch: int, name: str) -> DataFrame:
    """`texts` with a vector of its column; equal texts are encoded once."""
    key = content_id("text", F.col(column))
    once = retrieval.cut(encoded(texts.select(key.alias("hash_id"), F.col(column).alias("text")).dropDuplicates(["hash_id"]), embedder, batch))
    return texts.withColumn("_key", key).join(once.select(F.col("hash_id").alias("_key"), F.col("embedding").alias(name)), "_key").drop("_key")


def retrieve(questions: DataFrame, passages: DataFrame, embedder: Embedder, config: Config, classes: DataFrame | None = None, types: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """qid, rank, idx, score: from question texts to passages.  questions: qid, question (a batch); passages: idx, text.

    Entities of a question are linked to those of the passages, propagate over sentences, and start a personalised PageRank;
    questions without an entity or a graph score are answered by dense similarity.  classes (entity, classes) and types (qid,
    types) serve class-aware search where the config asks for it.
    """
    passages = passages.select("idx", "text")
    batch = retrieval.cut(vectors(questions.select("qid", "question"), "question", embedder, config.encode_batch, "lv"))
    dense = retrieval.cut(retrieval.similarities(batch.select("qid", "lv"), vectors(passages, "text", embedder, config.encode_batch, "rv").select("idx", "rv")))
    mention = retrieval.cut(corpus.sentence_entities(passages, "idx"))
    asked = vectors(corpus.question_entities(questions), "mention", embedder, config.encode_batch, "lv")
    known = vectors(passages.select(F.explode(corpus.entities_of(F.col("text"))).alias("entity")).distinct(), "entity", embedder, config.encode_batch, "rv")
    seed = retrieval.cut(retrieval.seeds(asked, known))
    sims = retrieval.pair_similarity(batch, vectors(mention.select("sentence").distinct(), "sentence", embedder, config.encode_batch, "rv"))
    compatible = None
    if config.use_class_schema and classes is not None and types is not None:
        compatible = lambda found: ontology.entity_compatibility(found, classes, types, canonical, config.same_weight)
    everywhere = ontology.entity_compatibility(questions.select("qid").crossJoin(mention.select("entity").distinct().join(classes.select("entity"), "entity", "left_semi")), classes, types, canonical, config.same_weight) if compatible and not config.matrix_propagation else None
    weights, activated = propagate(seed, mention, sims, config, everywhere)
    texts = None
    if config.attribute_fallback:
        wanted = questions.filter(is_attribute_query(F.col("question"), config.attribute_words)).select("qid", "question")
        texts = dense.select("qid", "idx").join(F.broadcast(wanted), "qid").join(passages, "idx")  # a part of the question batch
    ranked = search(passages, dense, weights, activated, config, compatible(activated) if compatible else None, texts)
    return top_passages(ranked.join(seed.select("qid").distinct(), "qid", "left_semi"), dense, config.retrieval_top_k)


def class_tables(spark: SparkSession, config: Config, questions: DataFrame, model: LanguageModel | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, types, canonical) for retrieve(), from the files that the config names; missing files are empty tables.

    Types of questions (qid, question) come from the cache, else from rules, else from a model if one is given and wanted;
    the cache is written back.
    """
    canonical, _, _ = artifacts.schema_state(spark, config.schema_state_path)
    rows = artifacts.entity_classes(spark, config.entity_classes_path)
    classes = artifacts.usable_classes(rows, canonical).join(rows.select("entity_id", "entity"), "entity_id").select("entity", "classes")
    cache = artifacts.question_type_cache(spark, config.query_type_cache_path)
    known = retrieval.cut(annotate.question_types(questions, cache, model if config.llm_query_typing else None))
    if config.query_type_cache_path:
        artifacts.write_question_types(spark, cache.join(known, "question", "left_anti").select("question", "types").unionByName(known.select("question", "types")), config.query_type_cache_path)
    types = questions.select("qid", F.trim("question").alias("question")).join(known, "question").select("qid", "types")
    return classes, types, canonical


def top_passages(ranked: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """qid, rank, idx, score: by score, then index; questions without graph scores fall back to dense similarity."""
    order = [F.round("score", 9).desc(), F.col("idx")]
    ranked = retrieval.cut(ranked)  # read twice
    own = retrieval.top(ranked, "qid", order, k)
    rest = dense.join(ranked.select("qid").distinct(), "qid", "left_anti").select("qid", "idx", F.col("sim").alias("score"))
    return own.unionByName(retrieval.top(rest, "qid", order, k)).select("qid", "rank", "idx", "score")
