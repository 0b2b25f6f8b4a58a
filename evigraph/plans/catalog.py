"""The query catalogue: each operator over whole test tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import parsing, text
from ..operators import corpus, ontology, qa, retrieval
from ..operators.substring import occurrences_of
from ..sources import artifacts, store
from ..streaming import index
from . import bindings as B
from . import retrieve

FLAGSHIP = "retrieve_dense_graph"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CONFIG = Config()
PPR = Config(ppr_iterations=30)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---------------------------------------------------------------- corpus and store


@query("passage_index", "SELECT doc_id AS idx, 'passage-' || md5(CASE WHEN every THEN text ELSE doc_id || ':' || text END) AS passage_id FROM documents, (SELECT bool_and(regexp_matches(trim(text), '^\\d+:')) AS every FROM documents)")
def passage_index(spark, sf) -> DataFrame:
    return corpus.passages(B.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")).select("idx", "passage_id")


@query("passage_dedup", "SELECT 'passage-' || md5(text) AS hash_id, min(doc_id) AS pos FROM documents GROUP BY text")
def passage_dedup(spark, sf) -> DataFrame:
    return store.distinct_texts(B.table(spark, sf, "documents").withColumnRenamed("doc_id", "pos"), "passage").select("hash_id", "pos")


def _stored(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = B.table(spark, sf, "documents").withColumnRenamed("doc_id", "pos")
    held = store.distinct_texts(docs.filter("pos % 2 = 0"), "passage")
    return held.select("hash_id", "pos"), store.distinct_texts(docs, "passage").select("hash_id", "pos")


@query("store_missing", "SELECT 'passage-' || md5(text) AS hash_id, min(doc_id) AS pos FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def store_missing(spark, sf) -> DataFrame:
    held, incoming = _stored(spark, sf)
    return store.missing(incoming, held)


@query("store_upsert_result", "SELECT 'passage-' || md5(text) AS hash_id, coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS pos FROM documents GROUP BY text")
def store_upsert_result(spark, sf) -> DataFrame:
    return store.upsert(*_stored(spark, sf))


@query("sentence_split", "SELECT idx, pos, sentence FROM (SELECT doc_id AS idx, generate_subscripts(s, 1) - 1 AS pos, trim(unnest(s)) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]+[.!?]*') AS s FROM documents)) WHERE sentence <> ''")
def sentence_split(spark, sf) -> DataFrame:
    return corpus.sentences(B.passages(spark, sf), "idx").select("idx", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query("entity_mentions", B.with_sql("SELECT idx, entity, n FROM mn"))
def entity_mentions(spark, sf) -> DataFrame:
    return corpus.passage_entities(B.passages(spark, sf), "idx")


@query("sentence_entity_edges", B.with_sql("SELECT 'sentence-' || md5(sentence) AS sentence_id, 'entity-' || md5(entity) AS entity_id FROM mention"))
def sentence_entity_edges(spark, sf) -> DataFrame:
    return B.mentions(spark, sf).select(text.content_id("sentence", F.col("sentence")).alias("sentence_id"), text.content_id("entity", F.col("entity")).alias("entity_id"))


@query("ner_label_filter", "SELECT doc_id AS idx, count(*) AS kept FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:st|nd|rd|th)?|[A-Za-z]{8,}')) AS e FROM documents) WHERE NOT regexp_matches(e, '^[0-9]') GROUP BY doc_id")
def ner_label_filter(spark, sf) -> DataFrame:
    return corpus.named(corpus.labelled_entities(B.passages(spark, sf), "idx")).groupBy("idx").agg(F.count("*").alias("kept"))


# ---------------------------------------------------------------- graph


@query("passage_entity_weights", B.with_sql("SELECT idx, entity, round(weight, 6) AS weight FROM pw"))
def passage_entity_weights(spark, sf) -> DataFrame:
    return corpus.entity_edges(corpus.passage_entities(B.passages(spark, sf), "idx"), "idx").select("idx", "entity", r6("weight", "weight"))


@query("adjacent_passages", B.with_sql("SELECT idx, next, 1.0::DOUBLE AS weight FROM adj"))
def adjacent_passages(spark, sf) -> DataFrame:
    return corpus.adjacent(B.passages(spark, sf), "idx").withColumn("weight", F.lit(1.0))


@query("graph_nodes", B.with_sql("SELECT 'entity-' || md5(entity) AS node_id, 'entity' AS kind FROM ent UNION ALL SELECT DISTINCT passage_id, 'passage' FROM p"))
def graph_nodes(spark, sf) -> DataFrame:
    p = B.passages(spark, sf)
    entities = p.select(F.explode(corpus.entities_of(F.col("text"))).alias("entity"))
    return corpus.nodes(entities, p).select("node_id", "kind")


@query("graph_edges", B.with_sql("SELECT node, count(*) AS degree, round(sum(weight), 6) AS strength FROM (SELECT 'entity-' || md5(entity) AS node, weight FROM pw UNION ALL SELECT passage_id, weight FROM pw JOIN p USING (idx) UNION ALL SELECT a.passage_id, 1.0 FROM adj JOIN p a USING (idx) UNION ALL SELECT b.passage_id, 1.0 FROM adj JOIN p b ON b.idx = next) GROUP BY node"))
def graph_edges(spark, sf) -> DataFrame:
    p = B.passages(spark, sf)
    ids = p.select("idx", "passage_id")
    weights = corpus.entity_edges(corpus.passage_entities(p, "idx"), "idx").join(ids, "idx").select("entity", "passage_id", "weight")
    links = corpus.adjacent(p, "idx").join(ids.withColumnRenamed("passage_id", "src"), "idx").join(ids.withColumnsRenamed({"idx": "next", "passage_id": "dst"}), "next").select("src", "dst")
    return corpus.both_ways(corpus.edges(weights, links)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), r6(F.sum("weight"), "strength"))


# ---------------------------------------------------------------- dense, seeds, scores


@query("dense_topk", B.with_sql("SELECT qid, rank, idx, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, idx)::INT AS rank FROM dense) WHERE rank <= 5"))
def dense_topk(spark, sf) -> DataFrame:
    near = retrieval.similarities(B.question_vectors(spark, sf), B.passage_vectors(spark, sf), k=CONFIG.retrieval_top_k)
    return retrieval.top(near, "qid", [F.round("sim", 9).desc(), F.col("idx")], CONFIG.retrieval_top_k).select("qid", "rank", "idx", r6("sim", "sim"))


@query("seed_argmax", B.with_sql("SELECT qid, entity, round(score, 6) AS score FROM seed"))
def seed_argmax(spark, sf) -> DataFrame:
    return B.seeds(spark, sf).select("qid", "entity", r6("score", "score"))


@query("minmax_scores", B.with_sql("SELECT qid, idx, round(scaled, 6) AS scaled FROM mm"))
def minmax_scores(spark, sf) -> DataFrame:
    return retrieval.minmax(B.dense(spark, sf), "qid", "sim", "scaled").select("qid", "idx", r6("scaled", "scaled"))


_WORDS = ", ".join(f"'{w}'" for w in text.ATTRIBUTE_WORDS)


@query("attribute_flags", f"SELECT doc_id AS idx, list_has_any(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '\\w+'), [{_WORDS}]) AS is_attribute, len(list_filter([{_WORDS}], lambda w: contains(lower(text), w)))::INT AS overlap FROM documents")
def attribute_flags(spark, sf) -> DataFrame:
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return B.passages(spark, sf).select("idx", text.is_attribute_query(plain).alias("is_attribute"), text.attribute_overlap(F.col("text"), F.col("text")).alias("overlap"))


@query("entity_bonus", B.with_sql("SELECT qid, idx, round(bonus, 6) AS bonus FROM bonus"))
def entity_bonus(spark, sf) -> DataFrame:
    return retrieval.entity_bonus(B.passages(spark, sf), B.seeds(spark, sf).withColumn("tier", F.lit(1))).select("qid", "idx", r6("bonus", "bonus"))


def _scores(spark, sf) -> DataFrame:
    bonus = retrieval.entity_bonus(B.passages(spark, sf), B.seeds(spark, sf).withColumn("tier", F.lit(1)))
    return retrieval.passage_scores(B.dense(spark, sf), bonus, CONFIG)


@query("passage_scores", B.with_sql("SELECT qid, idx, round(weight, 6) AS weight FROM pscore"))
def passage_scores(spark, sf) -> DataFrame:
    return _scores(spark, sf).select("qid", "idx", r6("weight", "weight"))


@query("dense_fallback", B.with_sql("SELECT qid, rank, idx, round(sim, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, idx)::INT AS rank FROM dense WHERE qid NOT IN (SELECT qid FROM seed WHERE qid % 2 = 0)) WHERE rank <= 5"))
def dense_fallback(spark, sf) -> DataFrame:
    """Questions of odd number lose their seeds and fall back to dense similarity."""
    dense, ranked = B.dense(spark, sf), B.seeds(spark, sf).filter("qid % 2 = 0").select("qid", F.lit(-1).cast("bigint").alias("idx"), F.lit(0.0).alias("score"))
    return retrieve.top_passages(ranked, dense, 5).filter("idx >= 0").select("qid", "rank", "idx", r6("score", "score"))


# ---------------------------------------------------------------- propagation

MATRIX = Config(max_iterations=3, iteration_threshold=0.1, top_k_sentence=2)


def _round_sql(k: int, top: int) -> str:
    used = "" if k == 1 else f" AND (qid, sentence) NOT IN (SELECT qid, sentence FROM u{k - 1})"
    return (
        f"q{k} AS MATERIALIZED (SELECT f.qid, f.entity, sentence, f.score, sim FROM f{k - 1} f JOIN mention USING (entity) JOIN ssim USING (qid, sentence) WHERE true{used}),"
        f"c{k} AS MATERIALIZED (SELECT DISTINCT qid, sentence FROM (SELECT *, row_number() OVER (PARTITION BY qid, entity ORDER BY round(sim, 9) DESC, sentence) AS r FROM q{k}) WHERE r <= {top}),"
        f"u{k} AS MATERIALIZED (SELECT qid, sentence FROM c{k}{'' if k == 1 else f' UNION SELECT qid, sentence FROM u{k - 1}'}),"
        f"n{k} AS MATERIALIZED (SELECT a.qid, entity, sum(w) AS score FROM (SELECT qid, sentence, sum(score) * any_value(sim) AS w FROM q{k} GROUP BY ALL) a JOIN c{k} USING (qid, sentence) JOIN mention USING (sentence) WHERE w > 0 GROUP BY ALL),"
        f"f{k} AS MATERIALIZED (SELECT * FROM n{k} WHERE score >= 0.1 AND score > 0)"
    )


_ROUND1 = "f0 AS MATERIALIZED (SELECT * FROM seed WHERE score >= 0.1 AND score > 0)," + _round_sql(1, 2)


@query("propagation_round1", B.with_sql("SELECT qid, entity, round(score, 6) AS score FROM n1", _ROUND1))
def propagation_round1(spark, sf) -> DataFrame:
    mention = B.mentions(spark, sf, distinct=False)
    frontier = B.seeds(spark, sf).filter("score >= 0.1")
    after, _ = retrieval.matrix_round(frontier, mention, B.sentence_sims(spark, sf), None, MATRIX.top_k_sentence)
    return after.select("qid", "entity", r6("score", "score"))


_MATRIX_SQL = "SELECT qid, entity, round(w.weight, 6) AS weight, round(coalesce(score, 0), 6) AS score, coalesce(tier, -1)::INT AS tier FROM (SELECT qid, entity, sum(score) AS weight FROM (FROM seed UNION ALL FROM n1 UNION ALL FROM n2) GROUP BY ALL HAVING sum(score) > 0) w LEFT JOIN (SELECT qid, entity, score, tier FROM (SELECT *, 0 AS tier FROM seed UNION ALL SELECT *, 1 FROM n1 WHERE score >= 0.1 UNION ALL SELECT *, 2 FROM n2 WHERE score >= 0.1) QUALIFY row_number() OVER (PARTITION BY qid, entity ORDER BY tier DESC) = 1) a USING (qid, entity)"


@query("propagation_matrix", B.with_sql(_MATRIX_SQL, _ROUND1 + "," + _round_sql(2, 2)))
def propagation_matrix(spark, sf) -> DataFrame:
    mention = B.mentions(spark, sf, distinct=False)
    weights, activated = retrieval.propagate_matrix(B.seeds(spark, sf), mention, B.sentence_sims(spark, sf), MATRIX)
    return weights.join(activated, ["qid", "entity"], "left").select("qid", "entity", r6("weight", "weight"), r6(F.coalesce("score", F.lit(0.0)), "score"), F.coalesce("tier", F.lit(-1)).alias("tier"))


@query("propagation_frontier")
def propagation_frontier(spark, sf) -> DataFrame:
    """The order-dependent mode with the class boost."""
    seed, mention = B.seeds(spark, sf), B.mentions(spark, sf, distinct=False)
    out = retrieval.propagate_frontier(seed, mention, B.sentence_sims(spark, sf), MATRIX, B.own_compat)
    return out.select("qid", "entity", r6("weight", "weight"), r6("score", "score"), "tier")


@query("class_prior", B.with_sql("SELECT qid, entity, round(score * (1 + CASE WHEN length(entity) % 4 = qid % 4 THEN 0.3 ELSE 0 END), 6) AS weight FROM seed"))
def class_prior(spark, sf) -> DataFrame:
    seed = B.seeds(spark, sf)
    out = retrieval.class_prior(seed.withColumnRenamed("score", "weight"), seed, B.compat(seed, seed), CONFIG.class_prior)
    return out.select("qid", "entity", r6("weight", "weight"))


@query("node_reset", B.with_sql("SELECT qid, node, round(weight, 6) AS weight FROM reset"))
def node_reset(spark, sf) -> DataFrame:
    return retrieve.node_weights(B.seeds(spark, sf).withColumnRenamed("score", "weight"), _scores(spark, sf)).select("qid", "node", r6("weight", "weight"))


def _ranked(spark, sf) -> tuple[DataFrame, DataFrame]:
    seed, dense = B.seeds(spark, sf), B.dense(spark, sf)
    return retrieve.search(B.passages(spark, sf), dense, seed.withColumnRenamed("score", "weight"), seed.withColumn("tier", F.lit(1)), PPR), dense


_RANKED = B.pagerank_sql(PPR.ppr_iterations) + f", ranked AS MATERIALIZED (SELECT qid, substring(node, 2)::BIGINT AS idx, x AS score FROM x{PPR.ppr_iterations} WHERE regexp_matches(node, '^p[0-9]+$'))"


@query("ppr_static", B.with_sql("SELECT qid, idx, round(score, 6) AS score FROM ranked", _RANKED))
def ppr_static(spark, sf) -> DataFrame:
    return _ranked(spark, sf)[0].select("qid", "idx", r6("score", "score"))


_TOP = "SELECT qid, rank, idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx)::INT AS rank FROM ranked) WHERE rank <= 5"


@query("ppr_topk", B.with_sql(_TOP, _RANKED))
def ppr_topk(spark, sf) -> DataFrame:
    return retrieval.top(_ranked(spark, sf)[0], "qid", [F.round("score", 9).desc(), F.col("idx")], 5).select("qid", "rank", "idx", r6("score", "score"))


@query("edge_reweight", B.with_sql("SELECT qid, entity, idx, round(weight, 6) AS weight, round(weight * (1 + 0.8 + CASE WHEN (qid, idx) IN (SELECT s.qid, w.idx FROM seed s JOIN pw w USING (entity)) THEN 0.6 ELSE 0 END + 0.4 + 0.4), 6) AS new_weight FROM seed JOIN pw USING (entity) WHERE length(entity) % 4 = qid % 4"))
def edge_reweight(spark, sf) -> DataFrame:
    seed = B.seeds(spark, sf).withColumn("tier", F.lit(1))
    shares = corpus.entity_edges(corpus.passage_entities(B.passages(spark, sf), "idx"), "idx")
    bridges = seed.join(shares, "entity").select("qid", "idx").distinct()
    own = B.compat(seed, seed).join(seed.select("qid", "entity"), ["qid", "entity"], "left_semi")
    return retrieval.reweighted(shares, own, bridges, seed, CONFIG).select("qid", "entity", "idx", r6("weight", "weight"), r6("new_weight", "new_weight"))


@query(FLAGSHIP, B.with_sql(_TOP, _RANKED))
def retrieve_dense_graph(spark, sf) -> DataFrame:
    ranked, dense = _ranked(spark, sf)
    return retrieve.top_passages(ranked, dense, 5).select("qid", "rank", "idx", r6("score", "score"))


@query("retrieve_class_aware")
def retrieve_class_aware(spark, sf) -> DataFrame:
    """Propagation with the class boost, class prior, query-aware edges, PageRank."""
    seed, dense = B.seeds(spark, sf), B.dense(spark, sf)
    mention = B.mentions(spark, sf, distinct=False)
    weights, activated = retrieve.propagate(seed, mention, B.sentence_sims(spark, sf), MATRIX, B.own_compat)
    ranked = retrieve.search(B.passages(spark, sf), dense, weights, activated, PPR, B.compat(activated, seed))
    return retrieve.top_passages(ranked, dense, 5).select("qid", "rank", "idx", r6("score", "score"))


# ---------------------------------------------------------------- ontology

ASKED = ("Where was it founded?", "When was Ada born?", "In which year and date?", "Who runs the company?", "Which company is it?", "How many are there?", "What population has it?", "Which country?", "Which city?", "What language?", "Describe it.", "")
NAMES = ("  capital   CITY. ", "NASA center", "person", "[Place],", "", "river (large)", "a", "Ab")
CANONICAL = (("Place", "Place", 0), ("Location", "Place", 1), ("person", "Person", 2), ("PERSON", "Human", 3), ("City", "City", 4))


def _values(rows) -> str:
    q = lambda x: str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(q, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def _types_sql() -> str:
    out = "''"
    for groups, classes in reversed(text.ANSWER_RULES):
        fits = " AND ".join(f"list_has_any(w, [{', '.join(repr(x) for x in g)}])" for g in groups)
        out = f"CASE WHEN {fits} THEN '{','.join(classes)}' ELSE {out} END"
    return out


@query("query_types", f"WITH q(question) AS ({_values(ASKED)} UNION ALL SELECT text FROM benchmark) SELECT question, {_types_sql()} AS types FROM (SELECT question, regexp_extract_all(lower(question), '[a-z0-9_]+') AS w FROM q)")
def query_types(spark, sf) -> DataFrame:
    q = spark.createDataFrame([(a,) for a in ASKED], "question string").unionByName(B.table(spark, sf, "benchmark").select(F.col("text").alias("question")))
    return q.select("question", F.array_join(text.answer_classes(F.col("question")), ",").alias("types"))


@query("class_normalize", f"""WITH n(name) AS ({_values(NAMES)} UNION ALL SELECT p_type FROM part UNION ALL SELECT c_mktsegment FROM customer),
t AS (SELECT name, trim(regexp_replace(trim(name), '\\s+', ' ', 'g'), ' .。,:;；，[]{{}}()"''') AS clean FROM n)
SELECT name, clean, CASE WHEN regexp_matches(clean, '(?s)^.+[A-Z]') THEN upper(substring(clean, 1, 1)) || substring(clean, 2) ELSE upper(substring(clean, 1, 1)) || lower(substring(clean, 2)) END AS shown FROM t""")
def class_normalize(spark, sf) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").unionByName(B.table(spark, sf, "part").select(F.col("p_type").alias("name"))).unionByName(B.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")))
    return rows.withColumn("clean", text.normalize_class(F.col("name"))).withColumn("shown", text.capitalize_class(F.col("clean")))


_MENTIONED = (("place",), ("Location",), ("Person",), ("PERSON",), ("city",), ("Other",))


@query("canonicalize", f"WITH n(name) AS ({_values(_MENTIONED)} UNION ALL SELECT p_type FROM part), c(raw, canonical, pos) AS ({_values(CANONICAL)}) SELECT name, coalesce((SELECT canonical FROM c WHERE raw = name), (SELECT canonical FROM c WHERE lower(raw) = lower(name) ORDER BY pos LIMIT 1), name) AS canonical FROM n")
def canonicalize(spark, sf) -> DataFrame:
    rows = spark.createDataFrame(list(_MENTIONED), "name string").unionByName(B.table(spark, sf, "part").select(F.col("p_type").alias("name")))
    return ontology.canonicalize(rows, spark.createDataFrame(list(CANONICAL), "raw string, canonical string, pos int"))


@query("compat_matrix", "SELECT p_partkey, CASE WHEN list_has_any([p_type, p_brand], ['Brand#11', 'Brand#12', 'STANDARD']) THEN 1.0 ELSE 0.0 END::DOUBLE AS compat FROM part")
def compat_matrix(spark, sf) -> DataFrame:
    target = F.array(*map(F.lit, ("Brand#11", "Brand#12", "STANDARD")))
    return B.table(spark, sf, "part").select("p_partkey", ontology.compatibility(F.array("p_type", "p_brand"), target).alias("compat"))


def _answers(spark, sf) -> DataFrame:
    """Model outputs made from the tables: JSON, objects, separated and spaced names."""
    p = B.table(spark, sf, "part")
    style = F.pmod("p_partkey", F.lit(5))
    raw = (
        F.when(style == 0, F.concat(F.lit('["'), "p_type", F.lit('", "'), "p_brand", F.lit('"]')))
        .when(style == 1, F.concat(F.lit('Answer: {"types": ["'), "p_type", F.lit('"]}')))
        .when(style == 2, F.concat("p_type", F.lit("; "), "p_brand"))
        .when(style == 3, F.concat(F.lit("<think>no</think> Answer: "), "p_type"))
        .otherwise(F.lit("one two three four five six seven"))
    )
    return p.select("p_partkey", raw.alias("raw"))


@query("parse_class_list")
def parse_class_list(spark, sf) -> DataFrame:
    return _answers(spark, sf).select("p_partkey", parsing.apply(parsing.class_list, "array<string>")("raw").alias("classes"))


RELATION_OUTPUTS = ('{"relation": "EQUIVALENT", "confidence": 0.9}', "I think a_parent_b", "unrelated", '{"relation":"nope","confidence":0.9}', "", 'so {"relation":"RELATED","confidence":"0.4"} it is')


@query("parse_relation")
def parse_relation(spark, sf) -> DataFrame:
    rows = B.table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, RELATION_OUTPUTS)), (F.pmod("o_orderkey", F.lit(len(RELATION_OUTPUTS))) + 1).cast("int")).alias("raw"))
    name = parsing.apply(lambda s: parsing.relation(s)[0], "string")
    sure = parsing.apply(lambda s: parsing.relation(s)[1], "double")
    return rows.select("o_orderkey", name("raw").alias("relation"), sure("raw").alias("confidence"))


@query("parse_class_paths")
def parse_class_paths(spark, sf) -> DataFrame:
    raw = F.concat(F.lit('{"class_paths": [["Entity", "'), "p_type", F.lit('", "'), "p_brand", F.lit('"], ["'), "p_brand", F.lit('"]]}'))
    return B.table(spark, sf, "part").select("p_partkey", parsing.apply(parsing.class_paths, "array<array<string>>")(raw).alias("paths"))


@query("llm_postprocess", """WITH a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '<think>' || c_name || '</think> Answer: The ' || c_mktsegment || '.' WHEN 1 THEN 'x Answer: ' || c_name WHEN 2 THEN 'Answer: a Answer: an ' || c_mktsegment ELSE NULL END AS raw FROM customer),
b AS (SELECT c_custkey, trim(regexp_replace(list_extract(string_split(coalesce(raw, ''), 'Answer:'), -1), '(?s)<think>.*?</think>', '', 'g')) AS answer FROM a)
SELECT c_custkey, answer, trim(regexp_replace(regexp_replace(regexp_replace(lower(answer), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM b""")
def llm_postprocess(spark, sf) -> DataFrame:
    c = B.table(spark, sf, "customer")
    kind = F.pmod("c_custkey", F.lit(4))
    raw = F.when(kind == 0, F.concat(F.lit("<think>"), "c_name", F.lit("</think> Answer: The "), "c_mktsegment", F.lit("."))).when(kind == 1, F.concat(F.lit("x Answer: "), "c_name")).when(kind == 2, F.concat(F.lit("Answer: a Answer: an "), "c_mktsegment"))
    return c.select("c_custkey", text.last_answer(raw).alias("answer")).withColumn("plain", text.normalize_answer(F.col("answer")))


@query("annotate_pending", B.with_sql("SELECT 'entity-' || md5(entity) AS hash_id FROM ent WHERE length(entity) % 2 = 1"))
def annotate_pending(spark, sf) -> DataFrame:
    entities = B.passages(spark, sf).select(F.explode(corpus.entities_of(F.col("text"))).alias("entity")).distinct().withColumn("hash_id", text.content_id("entity", F.col("entity")))
    return store.pending(entities, entities.filter("length(entity) % 2 = 0"), "hash_id").select("hash_id")


def _annotations(spark, sf) -> DataFrame:
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.array("p_type", "p_brand").alias("classes"))


@query("class_frequency", "SELECT class, count(*) AS freq FROM (SELECT unnest([p_type, p_brand]) AS class FROM part) GROUP BY class HAVING count(*) >= 2")
def class_frequency(spark, sf) -> DataFrame:
    return ontology.class_frequency(_annotations(spark, sf), 2)


def _same(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers of one nation and segment are chained by key steps of 50; frequency from the balance."""
    c = B.table(spark, sf, "customer")
    names = c.select(F.col("c_name").alias("name"), F.floor(F.abs("c_acctbal") / 1000).cast("bigint").alias("freq"))
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("s"))
    b = c.select((F.col("c_custkey") - 50).alias("k"), F.col("c_name").alias("b"), F.col("c_mktsegment").alias("s"))
    return names, a.join(b, ["k", "s"]).select("a", "b")


@query("equivalence_groups", """WITH RECURSIVE e AS (SELECT a.c_name AS a, b.c_name AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 50 AND a.c_mktsegment = b.c_mktsegment),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(name, other) AS (SELECT c_name, c_name FROM customer UNION SELECT name, b FROM r JOIN w ON other = a)
SELECT name, arg_min(other, (-floor(abs(c_acctbal) / 1000)::BIGINT, length(other), other)) AS representative FROM r JOIN customer ON c_name = other GROUP BY name""")
def equivalence_groups(spark, sf) -> DataFrame:
    return ontology.groups(*_same(spark, sf))


def _subclass(spark, sf) -> DataFrame:
    """Regions over nations over the segments of their customers, and regions over those segments too."""
    n, r, c = (B.table(spark, sf, t) for t in ("nation", "region", "customer"))
    rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    nc = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    seg = F.concat("n_name", F.lit("/"), "c_mktsegment")
    rs = nc.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), seg.alias("child"))
    return rn.unionByName(nc.select(F.col("n_name").alias("parent"), seg.alias("child"))).unionByName(rs).distinct()


_SUB = "e AS (SELECT DISTINCT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT r_name, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("class_closure", f"WITH RECURSIVE {_SUB}, c(ancestor, descendant) AS (SELECT parent, child FROM e UNION SELECT ancestor, child FROM c JOIN e ON descendant = parent) SELECT * FROM c")
def class_closure(spark, sf) -> DataFrame:
    return ontology.closure(_subclass(spark, sf))


@query("transitive_reduction", f"WITH RECURSIVE {_SUB}, c(ancestor, descendant) AS (SELECT parent, child FROM e UNION SELECT ancestor, child FROM c JOIN e ON descendant = parent) SELECT parent, child FROM e WHERE (parent, child) NOT IN (SELECT e2.parent, c.descendant FROM e e2 JOIN c ON c.ancestor = e2.child)")
def transitive_reduction(spark, sf) -> DataFrame:
    return ontology.reduction(_subclass(spark, sf))


def _judge(a: str, b: str) -> tuple[str, float]:
    """A table of relations: words of a type name contain one another, or share the first word."""
    x, y = set(a.split()), set(b.split())
    if a.lower() == b.lower():
        return "EQUIVALENT", 1.0
    if x < y:
        return "A_PARENT_B", 0.9
    if y < x:
        return "B_PARENT_A", 0.9
    return ("RELATED", 0.6) if x & y else ("UNRELATED", 0.7)


@query("schema_insert")
def schema_insert(spark, sf) -> DataFrame:
    """Classes counted by Spark, one row a class, inserted in order by the driver's state machine."""
    types = B.table(spark, sf, "part").select(F.array("p_type", F.element_at(F.split("p_type", " "), 1), "p_brand").alias("classes"))
    ordered = [(r["class"], r["freq"]) for r in ontology.class_frequency(types).collect()]
    schema = ontology.build_schema(ordered, _judge).export()
    rows = [("canonical", a, b) for a, b in schema["canonical_map"].items()] + [("subclass", a, b) for a, b in schema["subclass_edges"]] + [("related", a, b) for a, b in schema["related_edges"]] + [("root", a, None) for a in schema["roots"]]
    return spark.createDataFrame(rows, "kind string, a string, b string")


def _paths(spark, sf) -> DataFrame:
    c, n, r = (B.table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("entity"), F.array(F.lit("Entity"), "r_name", "n_name", "c_mktsegment").alias("path"))


@query("hierarchy_schema", """WITH e AS (SELECT c_custkey AS pos, c_name AS entity, unnest([0, 1, 2]) AS depth, unnest(['Entity', r_name, n_name]) AS parent, unnest([r_name, n_name, c_mktsegment]) AS child FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY pos, depth) AS r FROM e)
SELECT parent, child, count(*) AS support, min(depth)::INT AS depth, string_agg(entity, ',' ORDER BY r) FILTER (r <= 5) AS examples FROM k GROUP BY parent, child""")
def hierarchy_schema(spark, sf) -> DataFrame:
    return ontology.path_edges(_paths(spark, sf)).select("parent", "child", "support", "depth", F.array_join("examples", ",").alias("examples"))


def _entity_paths(spark, sf) -> DataFrame:
    return _paths(spark, sf).select(F.col("entity").alias("entity_id"), "path")


_PATHS = "pa AS (SELECT c_name AS entity_id, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), st AS (SELECT DISTINCT unnest(['Entity', r_name, n_name]) AS parent, unnest([r_name, n_name, c_mktsegment]) AS child FROM pa), cl AS (SELECT DISTINCT entity_id, unnest(['Entity', r_name, n_name, c_mktsegment]) AS class, unnest([false, false, false, true]) AS leaf FROM pa)"


@query("hierarchy_maps", f"WITH {_PATHS}, m AS (SELECT 'parent_to_children' AS kind, parent AS name, child AS m FROM st UNION SELECT 'child_to_parents', child, parent FROM st UNION SELECT 'class_to_entities', class, entity_id FROM cl UNION SELECT 'leaf_class_to_entities', class, entity_id FROM cl WHERE leaf) SELECT kind, name, count(*) AS n, md5(string_agg(m, ',' ORDER BY m)) AS members FROM m GROUP BY kind, name")
def hierarchy_maps(spark, sf) -> DataFrame:
    return artifacts.hierarchy_maps(_entity_paths(spark, sf)).select("kind", "name", F.size("members").cast("bigint").alias("n"), F.md5(F.array_join("members", ",")).alias("members"))


@query("hierarchy_counts", f"WITH {_PATHS} SELECT (SELECT count(DISTINCT entity_id) FROM pa) AS num_entities, (SELECT count(DISTINCT class) FROM cl) AS num_classes, (SELECT count(DISTINCT parent) FROM st) AS num_parent_classes, (SELECT count(DISTINCT child) FROM st) AS num_child_classes")
def hierarchy_counts(spark, sf) -> DataFrame:
    return artifacts.hierarchy_counts(_entity_paths(spark, sf))


@query("usable_classes", f"WITH c(raw, canonical, pos) AS ({_values(CANONICAL)}), n AS (SELECT p_partkey AS entity_id, unnest([0, 1, 2]) AS pos, unnest([' place. ', p_type, 'PLACE']) AS name FROM part), k AS (SELECT entity_id, pos, coalesce((SELECT canonical FROM c WHERE raw = t), (SELECT canonical FROM c WHERE lower(raw) = lower(t) ORDER BY c.pos LIMIT 1), t) AS canonical FROM (SELECT entity_id, pos, trim(name, ' .') AS t FROM n)), f AS (SELECT entity_id, lower(canonical) AS l, min(pos) AS pos, arg_min(canonical, pos) AS canonical FROM k GROUP BY ALL) SELECT entity_id, string_agg(canonical, ',' ORDER BY pos) AS classes FROM f GROUP BY entity_id")
def usable_classes(spark, sf) -> DataFrame:
    rows = B.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.array(F.lit(" place. "), "p_type", F.lit("PLACE")).alias("classes"))
    return artifacts.usable_classes(rows, spark.createDataFrame(list(CANONICAL), "raw string, canonical string, pos int")).select("entity_id", F.array_join("classes", ",").alias("classes"))


@query("dag_filter")
def dag_filter(spark, sf) -> DataFrame:
    """Paths of parts, reversed for even keys, so that cycles arise; edges are one a class pair."""
    path = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Entity"), "p_brand", "p_type")).otherwise(F.array(F.lit("Entity"), "p_type", "p_brand"))
    paths = B.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("entity"), path.alias("path"))
    edges = [(r["parent"], r["child"], r["support"], r["depth"]) for r in ontology.path_edges(paths).select("parent", "child", "support", "depth").collect()]
    kept, removed = ontology.acyclic(edges)
    return spark.createDataFrame([(p, c, True, None) for p, c in kept] + [(p, c, False, why) for p, c, why in removed], "parent string, child string, kept boolean, reason string")


# ---------------------------------------------------------------- answers and streams

_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', 'x', 'g')"


@query("normalize_answer", f"SELECT doc_id, md5({_NORMAL.format(_ASCII.format('text'))}) AS plain FROM documents")
def normalize_answer(spark, sf) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_answer(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).alias("plain"))


@query("answer_occurrences", f"""WITH d AS (SELECT doc_id, {_NORMAL.format(_ASCII.format('text'))} AS pred FROM documents), b AS (SELECT item_id, {_NORMAL.format(_ASCII.format('text'))} AS gold FROM benchmark)
SELECT item_id, count(*) FILTER (contains(pred, gold)) AS hits FROM d, b GROUP BY item_id""")
def answer_occurrences(spark, sf) -> DataFrame:
    """In how many documents each benchmark text occurs, both normalised."""
    plain = lambda df, key, name: df.select(key, text.normalize_answer(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).alias(name))
    pred = plain(B.table(spark, sf, "documents"), "doc_id", "pred")
    gold = plain(B.table(spark, sf, "benchmark"), "item_id", "gold")
    hits = occurrences_of(pred, gold, "doc_id", "pred", "gold").join(gold, F.col("word") == F.col("gold")).groupBy("item_id").agg(F.count("*").alias("hits"))
    return gold.join(hits, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


_PRED = "CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN '' ELSE " + _ASCII.format("text") + " END"
_GOLD = "CASE doc_id % 4 WHEN 0 THEN upper(" + _ASCII.format("substring(text, 40, 30)") + ") WHEN 1 THEN 'the' WHEN 2 THEN NULL ELSE lang || '!' END"


@query("evaluate_contain", f"""WITH r AS (SELECT doc_id, {_PRED} AS pred, {_GOLD} AS gold FROM documents),
h AS (SELECT doc_id % 7 AS grp, CASE WHEN trim(coalesce(pred, '')) = '' OR trim(coalesce(gold, '')) = '' THEN 0 WHEN contains({_NORMAL.format('pred')}, {_NORMAL.format('gold')}) THEN 1 ELSE 0 END AS hit FROM r)
SELECT grp, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS contain_accuracy FROM h GROUP BY grp""")
def evaluate_contain(spark, sf) -> DataFrame:
    """Every document is a prediction; its gold answer is a piece of it, an article, missing, or its language."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    key = F.col("doc_id")
    pred = F.when(key % 5 == 0, "  ").when(key % 5 == 1, "").otherwise(plain)
    gold = F.when(key % 4 == 0, F.upper(F.regexp_replace(F.substring("text", 40, 30), r"[^\x00-\x7F]", "x"))).when(key % 4 == 1, "the").when(key % 4 == 2, F.lit(None)).otherwise(F.concat("lang", F.lit("!")))
    rows, _ = qa.evaluate(B.table(spark, sf, "documents").select(key.alias("qid"), pred.alias("pred_answer"), gold.alias("gold")))
    return rows.groupBy((F.col("qid") % 7).alias("grp")).agg(F.count("*").alias("n"), F.sum("contain_accuracy").cast("bigint").alias("hits"), F.round(F.avg("contain_accuracy"), 6).alias("contain_accuracy"))


@query("stream_index", "SELECT DISTINCT 'passage-' || md5(text) AS hash_id, length(text)::INT AS n_chars FROM documents")
def stream_index(spark, sf) -> DataFrame:
    work = index.work_folder(spark)
    stream = index.passages(spark, f"{sf}/documents.parquet", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = index.run_available(stream, f"{work}/table", f"{work}/checkpoint")
    return out.select("hash_id", F.length("text").alias("n_chars"))


@query("entity_compatibility", "WITH s(cls, k) AS (VALUES ('Place', 0), ('Person', 1), ('Organization', 2), ('Date', 3)) SELECT c_custkey AS qid, c_nationkey::VARCHAR AS entity, 1.0::DOUBLE AS compat FROM customer WHERE c_nationkey % 4 = c_custkey % 4 OR (c_custkey % 4 = 0 AND c_nationkey % 3 = 0)")
def entity_compatibility(spark, sf) -> DataFrame:
    """Customers ask, nations are activated; a nation has a class by its key and some a second one; names come uncanonical."""
    names = F.array(*map(F.lit, B.CLASSES))
    c, n = B.table(spark, sf, "customer"), B.table(spark, sf, "nation")
    activated = c.select(F.col("c_custkey").alias("qid"), F.col("c_nationkey").cast("string").alias("entity"))
    own = F.element_at(names, (F.pmod("n_nationkey", F.lit(4)) + 1).cast("int"))
    classes = n.select(F.col("n_nationkey").cast("string").alias("entity"), F.when(F.col("n_nationkey") % 3 == 0, F.array(own, F.lit("Place"))).otherwise(F.array(own)).alias("classes"))
    asked = F.element_at(names, (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    types = c.select(F.col("c_custkey").alias("qid"), F.array(F.concat(F.lit(" "), F.when(asked == "Place", "location").otherwise(asked), F.lit("."))).alias("types"))
    canonical = spark.createDataFrame([(x, x, i) for i, x in enumerate(B.CLASSES)] + [("Location", "Place", 9)], "raw string, canonical string, pos int")
    return ontology.entity_compatibility(activated, classes, types, canonical)
