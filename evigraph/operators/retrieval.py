"""Dense scores, seeds, propagation, priors, passage scores, edge weights and personalised PageRank, all keyed by qid."""

from __future__ import annotations


import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.text import attribute_overlap, is_attribute_query
from .substring import occurrences_of


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the session's checkpoint folder and drop the lineage; survives the loss of executors.

    Where no folder is set: a temporary one on a single machine, an error on a cluster.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        where, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not where and master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="evigraph-"))
    return df.checkpoint(eager=True)


def few(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Rows that are already written, counted: up to about `limit` bytes are sent to every task, more are dealt by their key."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType) else 8 * F.coalesce(F.size(f.name), F.lit(0)) if isinstance(f.dataType, T.ArrayType) else 0)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def similarities(left: DataFrame, right: DataFrame, limit: int = 10_000, k: int | None = None, key: str = "idx") -> DataFrame:
    """Every row of `left` (a question batch: qid, other columns, vector lv) with every row of `right` (columns, vector rv):
    all columns but the vectors, and sim.  Rows without a vector, or with one of another length, are left out.

    The batch is counted and sent to every task; one above `limit` is a caller's error to be split.  A batch of rows takes
    one matrix product.  With `k`, only each question's k most similar rows (ties: smallest `key`) of every batch go on, of
    which top() then picks.
    """
    batch = left.limit(limit + 1).toArrow()
    if batch.num_rows > limit:
        raise ValueError("split the question batch")
    vectors = [None if v is None else np.asarray(v, np.float64) for v in batch["lv"].to_pylist()]
    size = max((len(v) for v in vectors if v is not None), default=0)
    rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
    lcols, rcols = [c for c in left.columns if c != "lv"], [c for c in right.columns if c != "rv"]
    matrix = np.stack([vectors[i] for i in rows]) if rows else np.zeros((0, max(1, size)))
    shared = right.sparkSession.sparkContext.broadcast((batch.select(lcols).take(pa.array(rows, pa.int64())).combine_chunks(), matrix))
    kinds = {f.name: f.dataType for f in [*left.schema.fields, *right.schema.fields]}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*lcols, *rcols)] + [T.StructField("sim", T.DoubleType())])

    def run(batches):
        table, m = shared.value
        q = len(m)
        for every in batches:
            for at in range(0, every.num_rows, 1 << 12):
                part = every.slice(at, 1 << 12)
                v = part.column(len(rcols))
                fits = np.flatnonzero(np.asarray(v.is_valid()) & (np.asarray(v.value_lengths().fill_null(-1)) == m.shape[1]))
                if not len(fits) or not q:
                    continue
                part = part.take(pa.array(fits))
                x = part.column(len(rcols)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                sim = m @ x.T
                a, b = np.repeat(np.arange(q), len(fits)), np.tile(np.arange(len(fits)), q)
                if k is not None and k < len(fits):
                    ids = part.column(rcols.index(key)).to_numpy(zero_copy_only=False)
                    b = np.concatenate([np.lexsort((ids, -np.round(row, 9)))[:k] for row in sim])
                    a = np.repeat(np.arange(q), k)
                left_side = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.take(pa.array(a)).columns]
                yield pa.RecordBatch.from_arrays([*left_side, *part.select(list(range(len(rcols)))).take(pa.array(b)).columns, pa.array(sim[a, b])], [*lcols, *rcols, "sim"])

    return right.select(*rcols, "rv").mapInArrow(run, schema)


def top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each `by`, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def minmax(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(x - min) / (max - min) within each `by`; constants become 1."""
    ends = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, by).withColumn(name, F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def seeds(question_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """qid, entity, score: the most similar entity of each question entity (ties: the smallest), best score per entity.

    question_entities: qid, mention, lv; entities: entity, rv.  Entities that share a vector are compared once.
    """
    groups = entities.groupBy("rv").agg(F.min("entity").alias("entity"))
    sims = similarities(question_entities, groups)
    best = sims.groupBy("qid", "mention").agg(F.min_by(F.struct("entity", "sim"), F.struct(-F.round("sim", 9), "entity")).alias("x"))
    return best.groupBy("qid", F.col("x.entity").alias("entity")).agg(F.max("x.sim").alias("score"))


def entity_bonus(passages: DataFrame, activated: DataFrame) -> DataFrame:
    """qid, idx, bonus: the sum of score * ln(1 + occurrences) / max(tier, 1) over activated entities in the passage, any case.

    Activated entities (qid, entity, score, tier) are few against passages; each distinct one is searched once a passage.
    """
    words = activated.select(F.lower("entity").alias("word")).distinct()
    found = occurrences_of(passages.select("idx", F.lower("text").alias("text")), words, "idx")
    hit = found.join(activated.withColumn("word", F.lower("entity")), "word")
    return hit.groupBy("qid", "idx").agg(F.sum(F.col("score") * F.log1p("n") / F.greatest(F.col("tier"), F.lit(1))).alias("bonus"))


def passage_scores(dense: DataFrame, bonus: DataFrame, config: Config, texts: DataFrame | None = None) -> DataFrame:
    """qid, idx, weight of every passage: (ratio * minmax(dense) + ln(1 + bonus)) * node weight.  dense: qid, idx, sim.

    With the attribute fallback and `texts` (qid, question; joined to passages idx, text by the caller) adds its term.
    """
    joined = minmax(dense, "qid", "sim", "scaled").join(bonus, ["qid", "idx"], "left")
    b = F.coalesce("bonus", F.lit(0.0))
    score = config.passage_ratio * F.col("scaled") + F.when(b > -1, F.log1p(b)).otherwise(0.0)
    if texts is not None and config.attribute_fallback:
        joined = joined.join(texts, ["qid", "idx"], "left")
        score = score + F.when(is_attribute_query(F.col("question"), config.attribute_words), config.attribute_boost * F.log1p(attribute_overlap(F.col("question"), F.col("text"), config.attribute_words))).otherwise(0.0)
    return joined.select("qid", "idx", (score * config.passage_node_weight).alias("weight"))


#: Adds sim to rows of qid, sentence and other columns; or a table of all of them (qid, sentence, sim).
Similarity = Callable[[DataFrame], DataFrame] | DataFrame


def pair_similarity(questions: DataFrame, sentences: DataFrame | Callable[[DataFrame], DataFrame], limit: int = 10_000) -> Callable[[DataFrame], DataFrame]:
    """Similarity of the pairs that are asked for.  questions: qid, lv (a batch, counted and sent to every task); sentences:
    sentence, rv, or what adds rv to rows that have a sentence.  Rows without a vector, or with one of another length, are left out."""
    batch = questions.select("qid", "lv").filter("lv is not null").limit(limit + 1).toArrow()
    if batch.num_rows > limit:
        raise ValueError("split the question batch")
    matrix = np.array(batch["lv"].to_pylist(), np.float64).reshape(batch.num_rows, -1)
    ids = batch["qid"].to_numpy()
    order = np.argsort(ids, kind="stable")
    shared = questions.sparkSession.sparkContext.broadcast((ids[order], matrix[order]))

    def of(rows: DataFrame) -> DataFrame:
        names = rows.columns
        at, last = names.index("qid"), len(names)
        schema = T.StructType([*rows.schema.fields, T.StructField("sim", T.DoubleType())])

        def run(batches):
            ids, matrix = shared.value
            for every in batches:
                for i in range(0, every.num_rows, 1 << 13):
                    part = every.slice(i, 1 << 13)
                    v, q = part.column(last), part.column(at).to_numpy(zero_copy_only=False)
                    place = np.minimum(np.searchsorted(ids, q), max(0, len(ids) - 1))
                    ok = np.asarray(v.is_valid()) & (np.asarray(v.value_lengths().fill_null(-1)) == matrix.shape[1])
                    fits = np.flatnonzero(ok & (ids[place] == q)) if len(ids) else np.zeros(0, np.int64)
                    if len(fits):
                        part = part.take(pa.array(fits))
                        x = part.column(last).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                        yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(np.einsum("ij,ij->i", matrix[place[fits]], x))], [*names, "sim"])

        found = sentences(rows) if callable(sentences) else rows.join(sentences.select("sentence", "rv"), "sentence")
        return found.select(*names, "rv").mapInArrow(run, schema)

    return of


def _with_sim(reach: DataFrame, sims: Similarity) -> DataFrame:
    """Adds sim to rows of qid and sentence; only pairs that were reached are compared."""
    return reach.join(sims, ["qid", "sentence"]) if isinstance(sims, DataFrame) else sims(reach)


def mentions_of(mention: DataFrame, some: DataFrame, on: str) -> DataFrame:
    """The distinct rows of `mention` whose `on` is one of those of `some` (already written).

    `mention` is read, and of it only this part is shuffled and kept; it may hold a row more than once.  Tasks get 64-bit
    hashes of the names asked for; a row let in by a collision goes in the joins that follow.
    """
    asked = few(cut(some.select(F.xxhash64(on).alias("_h")).distinct()))
    return cut(mention.select("sentence", "entity").join(asked, F.xxhash64(on) == F.col("_h"), "left_semi").distinct())


def matrix_round(frontier: DataFrame, mention: DataFrame, sims: Similarity, used: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """One order-free propagation round: (next scores qid, entity, score; sentences it used qid, sentence).

    A sentence's activation is the sum of its frontier entities' scores; each frontier entity picks its k most similar unused
    sentences; a picked sentence passes activation * similarity on to all its entities.  `mention` is read twice, and only
    sentences of the frontier and picked ones are kept of it.
    """
    frontier = cut(frontier.select("qid", "entity", "score"))
    reach = mentions_of(mention, frontier, "entity").join(few(frontier.select("qid", "entity")), "entity").select("qid", "entity", "sentence")
    if used is not None:
        reach = reach.join(few(used), ["qid", "sentence"], "left_anti")
    order = Window.partitionBy("qid", "entity").orderBy(F.round("sim", 9).desc(), "sentence")
    near = _with_sim(reach, sims).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    picked = cut(near.groupBy("qid", "sentence").agg(F.first("sim").alias("sim")))
    own = mentions_of(mention, picked, "sentence")
    active = own.join(picked, "sentence").join(frontier, ["qid", "entity"]).groupBy("qid", "sentence").agg((F.sum("score") * F.first("sim")).alias("w")).filter("w > 0")
    after = active.join(own, "sentence").groupBy("qid", "entity").agg(F.sum("w").alias("score"))
    return cut(after), picked.select("qid", "sentence")


def propagate_matrix(seed: DataFrame, mention: DataFrame, sims: Similarity, config: Config) -> tuple[DataFrame, DataFrame]:
    """(weights qid, entity, weight; activated qid, entity, score, tier) after max_iterations - 1 rounds; seeds have tier 0."""
    weights = seed.select("qid", "entity", F.col("score").alias("weight"))
    activated = seed.select("qid", "entity", "score", F.lit(0).alias("tier"))
    frontier, used = seed.filter((F.col("score") >= config.iteration_threshold) & (F.col("score") > 0)), None
    for tier in range(1, config.max_iterations):
        after, picked = matrix_round(frontier, mention, sims, used, config.top_k_sentence)
        used = picked if used is None else used.unionByName(picked)
        weights = weights.unionByName(after.select("qid", "entity", F.col("score").alias("weight")))
        activated = activated.unionByName(after.filter(F.col("score") >= config.iteration_threshold).withColumn("tier", F.lit(tier)))
        frontier = after.filter((F.col("score") >= config.iteration_threshold) & (F.col("score") > 0))
        if tier + 1 < config.max_iterations and frontier.isEmpty():
            break
    last = activated.groupBy("qid", "entity").agg(F.max_by(F.struct("score", "tier"), "tier").alias("x"))
    return weights.groupBy("qid", "entity").agg(F.sum("weight").alias("weight")).filter("weight > 0"), last.select("qid", "entity", "x.score", "x.tier")


def frontier_search(seed: list[tuple[str, float]], sentences_of: dict[str, list[str]], entities_of: dict[str, list[str]], sim: dict[str, float], config: Config, compat: dict[str, float] | None = None) -> tuple[dict[str, float], dict[str, tuple[float, int]]]:
    """Order-dependent propagation for one question: (weights, activated -> (score, tier)); seeds have tier 1.

    Frontier entities act in order; each takes its k most similar sentences that nobody used; every entity of such a sentence,
    the origin too, gets score * sim * (1 + boost * compatibility) if that reaches the threshold.  The last contribution of a
    round is the entity's new score, all are added to its weight.
    """
    weights = dict(seed)
    activated = {e: (s, 1) for e, s in seed}
    frontier, used = dict(seed), set()
    for tier in range(2, config.max_iterations + 1):
        fresh: dict[str, tuple[float, int]] = {}
        for entity, score in frontier.items():
            if score < config.iteration_threshold:
                continue
            open_ = sorted((s for s in sentences_of.get(entity, ()) if s not in used), key=lambda s: (-sim.get(s, 0.0), s))
            for s in open_[: config.top_k_sentence]:
                used.add(s)
                for e in entities_of.get(s, ()):
                    c = score * sim.get(s, 0.0) * (1 + (config.class_boost * compat.get(e, 0.0) if compat else 0.0))
                    if c >= config.iteration_threshold:
                        weights[e] = weights.get(e, 0.0) + c
                        fresh[e] = (c, tier)
        activated.update(fresh)
        frontier = {e: s for e, (s, _) in fresh.items()}
        if not frontier:
            break
    return weights, activated


def _picks(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """What the frontier entities of one question pick, in their order: each its k most similar sentences that are free."""
    used, out = set(), []
    for _, rows in pdf.sort_values(["ord", "r"]).groupby("ord", sort=True):
        free = [x for x in rows.itertuples(index=False) if x.sentence not in used][:k]
        used.update(x.sentence for x in free)
        out += [(x.qid, x.sentence, x.flow) for x in free]
    return pd.DataFrame({"qid": [x[0] for x in out], "sentence": [x[1] for x in out], "flow": [x[2] for x in out], "pick": range(len(out))}).astype({"qid": "int64", "flow": "float64", "pick": "int64"})


def propagate_frontier(seed: DataFrame, mention: DataFrame, sims: Similarity, config: Config, compat: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, entity, weight, score, tier as frontier_search() computes them, for all questions at once; compat: qid, entity, compat,
    or what gives these for rows of qid and entity that are reached.  `mention` as in matrix_round().

    Seeds stand in the order of their names.  A round is a few joins.  What must go in order, the picking of sentences, sees
    of each frontier entity only its k * n best unused sentences, n being its place in the frontier: those before it cannot
    take more, so a question's group grows with its frontier, not with the corpus.
    """
    k, low = config.top_k_sentence, config.iteration_threshold
    place = Window.partitionBy("qid").orderBy("first")
    frontier = cut(seed.select("qid", "entity", "score", F.struct(F.col("entity").alias("a"), F.lit("").alias("b")).alias("first")).withColumn("ord", F.row_number().over(place)).drop("first"))
    weights = seed.select("qid", "entity", F.col("score").alias("weight"))
    state = seed.select("qid", "entity", "score", F.lit(1).alias("tier"))
    used = None
    for tier in range(2, config.max_iterations + 1):
        acting = frontier.filter(F.col("score") >= low)
        reach = mentions_of(mention, acting, "entity").join(few(acting), "entity").select("qid", "ord", "score", "sentence")
        if used is not None:
            reach = reach.join(few(used), ["qid", "sentence"], "left_anti")
        most = acting.agg(F.max("ord")).first()[0] or 0  # a plain number: rows beyond it go before the shuffle
        order = Window.partitionBy("qid", "ord").orderBy(F.col("sim").desc(), "sentence")
        near = _with_sim(reach, sims).withColumn("r", F.row_number().over(order)).filter((F.col("r") <= F.col("ord") * k) & (F.col("r") <= most * k))
        picked = cut(near.select("qid", "ord", "r", "sentence", (F.col("score") * F.col("sim")).alias("flow")).groupBy("qid").applyInPandas(lambda pdf: _picks(pdf, k), "qid bigint, sentence string, flow double, pick bigint"))
        flow = picked.join(mentions_of(mention, picked, "sentence"), "sentence").select("qid", "entity", "flow", F.struct("pick", "entity").alias("at"))
        if compat is not None:
            known = compat(flow.select("qid", "entity").distinct()) if callable(compat) else compat
            flow = flow.join(known.groupBy("qid", "entity").agg(F.max("compat").alias("compat")), ["qid", "entity"], "left").withColumn("flow", F.col("flow") * (1 + config.class_boost * F.coalesce("compat", F.lit(0.0))))
        fresh = cut(flow.filter(F.col("flow") >= low).groupBy("qid", "entity").agg(F.max_by("flow", "at").alias("score"), F.sum("flow").alias("weight"), F.min("at").alias("first")))
        weights = weights.unionByName(fresh.select("qid", "entity", "weight"))
        state = state.unionByName(fresh.select("qid", "entity", "score", F.lit(tier).alias("tier")))
        used = picked.select("qid", "sentence") if used is None else used.unionByName(picked.select("qid", "sentence"))
        if tier == config.max_iterations or fresh.isEmpty():
            break
        frontier = cut(fresh.withColumn("ord", F.row_number().over(place)).select("qid", "entity", "score", "ord"))
    last = state.groupBy("qid", "entity").agg(F.max_by(F.struct("score", "tier"), "tier").alias("x"))
    return weights.groupBy("qid", "entity").agg(F.sum("weight").alias("weight")).join(last, ["qid", "entity"]).select("qid", "entity", "weight", "x.score", "x.tier")


def class_prior(weights: DataFrame, activated: DataFrame, compat: DataFrame, gamma: float) -> DataFrame:
    """Adds gamma * score * compat to the weight of activated entities with compat above 0.  compat: qid, entity, compat."""
    more = activated.join(compat.filter("compat > 0"), ["qid", "entity"]).select("qid", "entity", (gamma * F.col("score") * F.col("compat")).alias("weight"))
    return weights.unionByName(more).groupBy("qid", "entity").agg(F.sum("weight").alias("weight"))


def reset_weights(entity: DataFrame, passage: DataFrame) -> DataFrame:
    """qid, node, weight: entity and passage weights together; negative and NaN become 0."""
    both = entity.unionByName(passage).groupBy("qid", "node").agg(F.sum("weight").alias("w"))
    return both.select("qid", "node", F.when(F.isnan("w") | (F.col("w") < 0), 0.0).otherwise(F.col("w")).alias("weight"))


def reweighted(edges: DataFrame, compat: DataFrame, bridges: DataFrame, active: DataFrame, config: Config) -> DataFrame:
    """qid, entity, idx, weight, new_weight of the entity-passage edges that a question changes.

    edges: entity, idx, weight; compat: qid, entity, compat; bridges: qid, idx (passages beside a seed); active: qid, entity, tier.
    """
    tier = F.greatest(F.col("tier"), F.lit(1))
    rows = edges.join(compat.filter(F.col("compat") >= config.edge_min_compat), "entity")
    rows = rows.join(bridges.withColumn("bridge", F.lit(1.0)), ["qid", "idx"], "left").join(active.select("qid", "entity", "tier"), ["qid", "entity"], "left")
    lift = F.lit(config.edge_beta) + F.coalesce("bridge", F.lit(0.0)) * config.edge_seed + F.when(F.col("tier").isNotNull(), config.edge_active / tier + F.when(tier <= 2, config.edge_two_hop).otherwise(0.0)).otherwise(0.0)
    boost = F.least(F.col("compat") * lift, F.lit(config.edge_max_boost))
    return rows.withColumn("boost", boost).filter("boost > 0").select("qid", "entity", "idx", "weight", (F.col("weight") * (1 + F.col("boost"))).alias("new_weight"))


def pagerank(edges: DataFrame, reset: DataFrame, config: Config, changed: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """qid, node, score (above 0): personalised PageRank on an undirected weighted graph (src, dst, weight stored once).

    reset: qid, node, weight; a question without positive weight has no rows.  changed: qid, src, dst, weight replaces
    edges for a question; edges that the graph lacks are ignored, as are self edges.  targets (node): only these are returned.

    Nodes are 64-bit hashes of their names.  A graph of at most `broadcast_limit` edges (counted; 24 bytes each) is sent to
    the tasks and iterated question by question; a larger one is iterated by joins.
    """
    name = lambda c: F.xxhash64(c)
    ends = lambda df, w: df.select(*[c for c in df.columns if c == "qid"], F.least(name("src"), name("dst")).alias("a"), F.greatest(name("src"), name("dst")).alias("b"), F.col("weight").cast("double").alias(w)).filter("a <> b")
    graph = cut(ends(edges, "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
    every = targets.select("node") if targets is not None else edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(reset.select("node"))
    named = every.distinct().select(name("node").alias("a"), "node")
    start = reset.groupBy("qid", name("node").alias("a")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    more = None if changed is None else ends(changed, "new").groupBy("qid", "a", "b").agg(F.max("new").alias("new"))
    if graph.count() <= config.broadcast_limit:
        found = _pagerank_local(graph, start, config, more, None if targets is None else named.select("a"))
    else:
        found = _pagerank_joins(graph, start, config, more)
    return found.join(named, "a").select("qid", "node", "score")


def _pagerank_local(graph: DataFrame, start: DataFrame, config: Config, changed: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    """(qid, a, score) with the whole graph in every task.  graph: a, b, w; start: qid, a, weight; changed: qid, a, b, new."""
    table = graph.toArrow()
    a, b, w = (table[c].to_numpy() for c in ("a", "b", "w"))
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    tail, head = codes.astype(np.int32), np.concatenate([codes[len(a) :], codes[: len(a)]]).astype(np.int32)
    order = np.lexsort((tail, head))  # both directions of every edge, by the node that receives
    tail, head, both = tail[order], head[order], np.concatenate([w, w])[order]
    edge = np.searchsorted(head, np.arange(len(nodes) + 1))
    wanted = None
    if targets is not None:  # only targets in the graph are sent; others are known from the rows of a question
        have = set_of(targets, graph)
        wanted = np.isin(nodes, have)
    shared = graph.sparkSession.sparkContext.broadcast((nodes, tail, both, edge, wanted))
    d, rounds = config.damping, config.ppr_iterations
    none = F.lit(0).cast("bigint")
    rows = start.select("qid", "a", none.alias("b"), "weight", F.lit(False).alias("edge"))
    if targets is not None:
        marked = targets.select(F.col("a").alias("_t"))
        rows = rows.join(marked, rows["a"] == marked["_t"], "left").select("qid", "a", "b", "weight", "edge", F.col("_t").isNotNull().alias("wanted"))
    else:
        rows = rows.withColumn("wanted", F.lit(True))
    if changed is not None:
        rows = rows.unionByName(changed.select("qid", "a", "b", F.col("new").alias("weight"), F.lit(True).alias("edge"), F.lit(False).alias("wanted")))

    def locate(ordered: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ordered):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)
        return at, ordered[at] == asked

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, tail, weight, edge, wanted = shared.value
        extra, begin = pdf[pdf["edge"]], pdf[~pdf["edge"]]
        ids, size = begin["a"].to_numpy(np.int64), len(nodes)
        place, known = locate(nodes, ids)
        place[~known] = size + np.arange((~known).sum())  # nodes without edges
        n = size + int((~known).sum())
        r = np.bincount(place, begin["weight"], n)
        if not r.sum() > 0:
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "score": np.zeros(0)})
        r = r / r.sum()
        if len(extra):
            s, ok_s = locate(nodes, extra["a"].to_numpy(np.int64))
            t, ok_t = locate(nodes, extra["b"].to_numpy(np.int64))
            s, t, new = s[ok_s & ok_t], t[ok_s & ok_t], extra["weight"].to_numpy()[ok_s & ok_t]
            weight = weight.copy()
            for x, y in ((s, t), (t, s)):
                for i, j, v in zip(x, y, new, strict=True):  # within the sorted tails of one receiver
                    at = edge[j] + np.searchsorted(tail[edge[j] : edge[j + 1]], i)
                    if at < edge[j + 1] and tail[at] == i:
                        weight[at] = v
        strength = np.bincount(tail, weight, n) if size else np.zeros(n)
        inv = np.divide(1.0, strength, out=np.zeros(n), where=strength > 0)
        x = r
        for _ in range(rounds):
            flow = np.zeros(n)
            if size:
                flow[:size] = np.add.reduceat(weight * (x * inv)[tail], edge[:-1])
            x = (1 - d) * r + d * (flow + x[strength <= 0].sum() * r)
        show = np.ones(n, bool) if wanted is None else np.concatenate([wanted, np.zeros(n - size, bool)])
        show[place] = begin["wanted"].to_numpy(bool)
        every, keep = np.concatenate([nodes, ids[~known]]), (x > 0) & show
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "a": every[keep], "score": x[keep]})

    return rows.groupBy("qid").applyInPandas(run, "qid bigint, a bigint, score double")


def set_of(targets: DataFrame, graph: DataFrame) -> np.ndarray:
    """Hashes of the targets that are nodes of a graph, which was counted."""
    inside = graph.select("a").unionByName(graph.select(F.col("b").alias("a"))).distinct()
    return targets.join(inside, "a", "left_semi").toArrow()["a"].to_numpy()


def _pagerank_joins(graph: DataFrame, start: DataFrame, config: Config, changed: DataFrame | None) -> DataFrame:
    """The same by joins.  All questions share the graph's edges; what a question changes travels beside them as differences."""
    d = config.damping
    total = start.groupBy("qid").agg(F.sum("weight").alias("t")).filter("t > 0")
    r = cut(start.filter("weight > 0").join(total, "qid").select("qid", "a", (F.col("weight") / F.col("t")).alias("r")))
    turned = lambda df, *cols: df.unionByName(df.select(*cols, F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in df.columns if c not in (*cols, "a", "b")]))
    two = cut(turned(graph))
    strength = cut(two.groupBy("a").agg(F.sum("w").alias("s")))
    if changed is not None:
        delta = changed.join(graph, ["a", "b"]).select("qid", "a", "b", (F.col("new") - F.col("w")).alias("dw"))
        delta = cut(turned(delta, "qid"))
        lift = cut(delta.groupBy("qid", "a").agg(F.sum("dw").alias("ds")))
    x = r.select("qid", "a", F.col("r").alias("x"))
    for _ in range(config.ppr_iterations):
        at = x.join(strength, "a", "left")
        if changed is not None:
            at = at.join(lift, ["qid", "a"], "left").withColumn("s", F.col("s") + F.coalesce("ds", F.lit(0.0)))
        at = at.select("qid", "a", "x", F.when(F.col("s") > 0, F.col("x") / F.col("s")).alias("y"))
        flow = at.filter("y is not null").join(two, "a").select("qid", F.col("b").alias("a"), (F.col("y") * F.col("w")).alias("g"))
        if changed is not None:
            flow = flow.unionByName(at.filter("y is not null").join(delta, ["qid", "a"]).select("qid", F.col("b").alias("a"), (F.col("y") * F.col("dw")).alias("g")))
        lost = at.filter("y is null").groupBy("qid").agg(F.sum("x").alias("lost"))
        base = r.join(lost, "qid", "left").select("qid", "a", ((1 - d) * F.col("r") + d * F.col("r") * F.coalesce("lost", F.lit(0.0))).alias("g"))
        x = cut(flow.groupBy("qid", "a").agg((d * F.sum("g")).alias("g")).unionByName(base).groupBy("qid", "a").agg(F.sum("g").alias("x")))
    return x.filter("x > 0").select("qid", "a", F.col("x").alias("score"))
