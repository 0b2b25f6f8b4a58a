"""Graph, propagation, ranking and ontology operators on small graphs, and their invariants."""

import glob
import http.server
import json
import math
import os
import random
import re
import threading
import xml.etree.ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph import cli
from evigraph.config import Config
from evigraph.operators import annotate, corpus, ontology, qa, retrieval, substring
from evigraph.plans import catalog, retrieve
from evigraph.sources import artifacts, seams, store
from evigraph.streaming import index


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_entity_shares(spark):
    docs = frame(spark, [(1, "alphabet alphabet alphabet betatest"), (2, "short"), (3, "")], "idx bigint, text string")
    got = {(r["idx"], r["entity"]): r["weight"] for r in corpus.entity_edges(corpus.passage_entities(docs, "idx"), "idx").collect()}
    assert got == {(1, "alphabet"): 0.75, (1, "betatest"): 0.25}


@pytest.mark.parametrize("bucket", [2, 4096])
def test_adjacent(spark, bucket):
    ids = sorted(random.Random(1).sample(range(1000), 80))
    got = sorted((r["idx"], r["next"]) for r in corpus.adjacent(frame(spark, [(i,) for i in ids], "idx bigint"), "idx", bucket).collect())
    assert got == list(zip(ids, ids[1:]))


def test_store(spark, tmp_path):
    held = frame(spark, [("a", 1)], "hash_id string, pos int")
    new = frame(spark, [("a", 9), ("b", 2)], "hash_id string, pos int")
    assert sorted(map(tuple, store.upsert(held, new).collect())) == [("a", 1), ("b", 2)]
    for _ in range(2):
        store.append_missing(spark, f"{tmp_path}/s", new)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2
    old, more = frame(spark, [("s", "x")], "sentence string, entity string"), frame(spark, [("s", "y")], "sentence string, entity string")
    assert store.merge_entities(old, more, ["sentence"], "entity").count() == 2
    assert store.merge_entities(old, more, ["sentence"], "entity", replace=True).count() == 1
    (tmp_path / "q.json").write_text('[{"question": "Who?", "answer": "me"}, {"question": "When?"}]')
    assert [tuple(r) for r in store.questions(spark, str(tmp_path / "q.json")).orderBy("qid").collect()] == [(0, "Who?", "me"), (1, "When?", None)]
    (tmp_path / "c.json").write_text('["one", "two"]')
    assert store.chunks(spark, str(tmp_path / "c.json")).count() == 2
    nodes, links = frame(spark, [("a<", "entity", 'x & "y"\nz'), ("b", "passage", None)], "node_id string, kind string, content string"), frame(spark, [("a<", "b", 1.5)], "src string, dst string, weight double")
    store.write_graphml(nodes, links, f"{tmp_path}/g")
    whole = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/g/part-*")))
    tree = xml.etree.ElementTree.fromstring(whole)
    assert [x.tag.rpartition("}")[2] for x in tree[-1]] == ["node", "node", "edge"] and tree[-1][-1].get("source") == "a<"
    assert {x.get("id"): [d.text for d in x] for x in tree[-1][:2]} == {"a<": ["entity", 'x & "y" z'], "b": ["passage", None]}
    texts = frame(spark, [("h1", "one two"), ("h2", "three"), ("h1", "one two")], "hash_id string, text string")
    asked = []

    class Counting(seams.HashingEmbedder):
        def encode(self, texts):
            asked.extend(texts)
            return super().encode(texts)

    for _ in range(2):
        got = store.append_encoded(spark, f"{tmp_path}/v", texts, Counting(8))
    assert sorted(r["hash_id"] for r in got.collect()) == ["h1", "h2"]
    store.write_evaluation(frame(spark, [(0, 1)], "qid bigint, contain_accuracy int"), frame(spark, [(1.0,)], "contain_accuracy double"), f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e/evaluation_results").first()[0] == 1.0


def test_substring_join(spark):
    texts = frame(spark, [(1, "aaaa b"), (2, "zzz"), (3, None)], "idx bigint, text string")
    words = frame(spark, [("aa",), ("b",), ("",), ("aa",)], "word string")
    for block in (1, 1 << 20):
        assert sorted(map(tuple, substring.occurrences_of(texts, words, "idx", block_bytes=block).collect())) == [(1, "aa", 2), (1, "b", 1)]


GOLD = Config(max_iterations=2, iteration_threshold=0.4, top_k_sentence=1)


def test_frontier_search():
    w, a = retrieval.frontier_search([("e1", 0.9)], {"e1": ["s1"]}, {"s1": ["e1", "e2"]}, {"s1": 0.8}, GOLD)
    assert w == pytest.approx({"e1": 1.62, "e2": 0.72}) and a["e1"] == pytest.approx((0.72, 2)) and a["e2"] == pytest.approx((0.72, 2))
    w, _ = retrieval.frontier_search([("e1", 0.9)], {"e1": ["s1"]}, {"s1": ["e1", "e2"]}, {"s1": 0.8}, GOLD, {"e2": 1.0})
    assert w["e2"] == pytest.approx(0.936)


def test_propagation_modes(spark):
    seed = frame(spark, [(0, "e1", 0.9), (1, "e9", 0.3)], "qid bigint, entity string, score double")
    mention = frame(spark, [("s1", "e1"), ("s1", "e2")], "sentence string, entity string")
    sims = frame(spark, [(0, "s1", 0.8), (1, "s1", 0.8)], "qid bigint, sentence string, sim double")
    weights, activated = retrieval.propagate_matrix(seed, mention, sims, GOLD)
    assert {(r["qid"], r["entity"]): round(r["weight"], 6) for r in weights.collect()} == {(0, "e1"): 1.62, (0, "e2"): 0.72, (1, "e9"): 0.3}
    assert {(r["qid"], r["entity"]): r["tier"] for r in activated.collect()} == {(0, "e1"): 1, (0, "e2"): 1, (1, "e9"): 0}
    got = {(r["qid"], r["entity"]): (round(r["weight"], 6), r["tier"]) for r in retrieval.propagate_frontier(seed, mention, sims, GOLD).collect()}
    assert got == {(0, "e1"): (1.62, 2), (0, "e2"): (0.72, 2), (1, "e9"): (0.3, 1)}


def test_frontier_equals_one_question_at_a_time(spark):
    """The joins against frontier_search, question by question, with and without the class boost."""
    rng = random.Random(11)
    entities, sentences = [f"e{i:02d}" for i in range(25)], [f"s{i:02d}" for i in range(40)]
    mention = [(s, e) for s in sentences for e in sorted(rng.sample(entities, rng.randrange(1, 5)))]
    seed = [(q, e, round(rng.uniform(0.3, 1.2), 3)) for q in range(8) for e in rng.sample(entities, rng.randrange(1, 4))]
    sims = [(q, s, round(rng.uniform(0.1, 1.0), 4)) for q in range(8) for s in sentences]
    compat = [(q, e, 1.0) for q in range(8) for e in entities if rng.random() < 0.3]
    m, sf, df = frame(spark, mention, "sentence string, entity string"), frame(spark, seed, "qid bigint, entity string, score double"), frame(spark, sims, "qid bigint, sentence string, sim double")
    for k, boost in ((1, None), (3, frame(spark, compat, "qid bigint, entity string, compat double"))):
        config = Config(max_iterations=4, iteration_threshold=0.3, top_k_sentence=k)
        got = {(r["qid"], r["entity"]): (r["weight"], r["score"], r["tier"]) for r in retrieval.propagate_frontier(sf, m, df, config, boost).collect()}
        want = {}
        for q in range(8):
            of, by = {}, {}
            for s, e in mention:
                of.setdefault(e, []).append(s)
                by.setdefault(s, []).append(e)
            w, a = retrieval.frontier_search(sorted((e, x) for p, e, x in seed if p == q), of, by, {s: x for p, s, x in sims if p == q}, config, {e: x for p, e, x in compat if p == q} if boost is not None else None)
            want |= {(q, e): (x, *a[e]) for e, x in w.items()}
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_propagation_of_repeated_mentions(spark):
    """Mentions come as a row for each occurrence, and compatibility is asked of what is reached only; results stay."""
    rng = random.Random(13)
    entities, sentences = [f"e{i:02d}" for i in range(25)], [f"s{i:02d}" for i in range(40)]
    rows = [(s, e) for s in sentences for e in sorted(rng.sample(entities, rng.randrange(1, 5)))]
    seed = frame(spark, [(q, e, round(rng.uniform(0.3, 1.2), 3)) for q in range(4) for e in rng.sample(entities, 2)], "qid bigint, entity string, score double")
    sims = frame(spark, [(q, s, round(rng.uniform(0.1, 1.0), 4)) for q in range(4) for s in sentences], "qid bigint, sentence string, sim double")
    once, often = (frame(spark, x, "sentence string, entity string") for x in (rows, rows + rows[::2] + rows))
    config, asked = Config(max_iterations=3, iteration_threshold=0.3, top_k_sentence=2), []
    compat = frame(spark, [(q, e, 1.0) for q in range(4) for e in entities[::3]], "qid bigint, entity string, compat double")

    def reached(found):
        asked.append(found.count())
        return found.join(compat, ["qid", "entity"])

    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for a, b in zip(retrieval.propagate_matrix(seed, once, sims, config), retrieval.propagate_matrix(seed, often, sims, config), strict=True):
        assert plain(a) == plain(b) != []
    assert plain(retrieval.propagate_frontier(seed, once, sims, config, compat)) == plain(retrieval.propagate_frontier(seed, often, sims, config, reached)) != []
    assert asked and max(asked) < 4 * len(entities)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("name", ["propagation_frontier", "propagation_matrix", "propagation_round1"])
def test_propagation_keeps_little(spark, name):
    """Sentences that no frontier reaches are neither checkpointed nor shuffled: both stay far below the size of the texts."""
    retrieval.cut(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    kept = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").agg({"n_chars": "sum"}).first()[0]
    before = kept()
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert kept() - before < texts / 4


def slow_pagerank(edges, reset, d, rounds):
    """Node by node, on dictionaries."""
    total = sum(reset.values())
    nodes = sorted({x for a, b in edges for x in (a, b)} | set(reset))
    near = {n: {} for n in nodes}
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    r = {n: reset.get(n, 0.0) / total for n in nodes}
    x = dict(r)
    for _ in range(rounds):
        lost = sum(x[n] for n in nodes if not sum(near[n].values()))
        x = {n: (1 - d) * r[n] + d * lost * r[n] + d * sum(x[o] * near[o][n] / sum(near[o].values()) for o in near[n]) for n in nodes}
    return {n: v for n, v in x.items() if v > 0}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_pagerank(spark, limit):
    """Both ways against a slow version: zero resets, nodes without edges, unreached parts, edges a question changes."""
    rng = random.Random(12)
    edges = {tuple(sorted(rng.sample([f"n{i}" for i in range(30)], 2))): rng.uniform(0.1, 2) for _ in range(45)} | {("iso1", "iso2"): 1.0}
    reset = {0: {"n1": 2.0, "n2": 0.0, "alone": 1.0, "iso1": 0.0}, 1: {f"n{i}": rng.random() for i in range(10)}, 2: {"n1": 0.0, "n3": 0.0}, 3: {"alone": 1.0}}
    changed = {0: {e: w * 3 for e, w in list(edges.items())[:12]}, 1: {("n0", "nowhere"): 5.0}}
    e = frame(spark, [(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    r = frame(spark, [(q, n, w) for q, x in reset.items() for n, w in x.items()], "qid bigint, node string, weight double")
    c = frame(spark, [(q, b, a, w) for q, x in changed.items() for (a, b), w in x.items()], "qid bigint, src string, dst string, weight double")
    config = Config(ppr_iterations=5, broadcast_limit=limit)
    for change in (None, c):
        got = {(x["qid"], x["node"]): x["score"] for x in retrieval.pagerank(e, r, config, change).collect()}
        want = {}
        for q in (0, 1, 3):
            new = {k: (changed.get(q, {}).get(k, w) if change is not None else w) for k, w in edges.items()}
            want |= {(q, n): v for n, v in slow_pagerank(new, reset[q], config.damping, 5).items()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
        some = frame(spark, [("n1",), ("alone",), ("missing",)], "node string")
        few = {(x["qid"], x["node"]): x["score"] for x in retrieval.pagerank(e, r, config, change, some).collect()}
        assert few == pytest.approx({k: v for k, v in want.items() if k[1] in ("n1", "alone")})


def test_similarities(spark):
    left = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 2.0]), (2, None)], "qid bigint, lv array<float>")
    right = frame(spark, [(i, [i * 1.0, 1.0]) for i in range(6)] + [(6, None), (7, [1.0])], "idx bigint, rv array<float>")
    got = sorted((r["qid"], r["idx"], r["sim"]) for r in retrieval.similarities(left, right).collect())
    assert got == [(q, i, i * (1, 0.5)[q] + (0, 2)[q]) for q in (0, 1) for i in range(6)]
    best = retrieval.top(retrieval.similarities(left, right.coalesce(1), k=2), "qid", [F.col("sim").desc(), F.col("idx")], 2)
    assert sorted((r["qid"], r["idx"]) for r in best.collect()) == [(0, 4), (0, 5), (1, 4), (1, 5)]
    with pytest.raises(ValueError):
        retrieval.similarities(left, right, limit=2)
    assert retrieval.similarities(left.limit(0), right).count() == 0


def slow_retrieve(texts, question, e, config, compat):
    """One question on dictionaries, in the order-dependent mode, with the class prior and query-aware edges."""
    words = lambda t: list(dict.fromkeys(re.findall("[A-Za-z]{8,}", t)))
    dot = lambda a, b: float(np.dot(*e.encode([a, b]).astype(float)))
    every = sorted({w for t in texts for w in words(t)})
    seed = {}
    for m in {w.lower() for w in words(question)}:
        best = min(every, key=lambda w: (-round(dot(m, w), 9), w))
        seed[best] = max(seed.get(best, -1.0), dot(m, best))
    sentences = sorted({s.strip() for t in texts for s in re.findall(r"[^.!?\n]+[.!?]*", t) if s.strip()})
    by = {s: sorted(words(s)) for s in sentences if words(s)}
    of = {w: [s for s in by if w in by[s]] for w in every}
    weights, active = retrieval.frontier_search(sorted(seed.items()), of, by, {s: dot(question, s) for s in by}, config, compat)
    for w, (score, _) in active.items():
        weights[w] = weights.get(w, 0.0) + config.class_prior * score * compat.get(w, 0.0)
    dense = [dot(question, t) for t in texts]
    reset = dict(weights)
    for i, t in enumerate(texts):
        bonus = sum(s * math.log1p(t.lower().count(w.lower())) / max(tier, 1) for w, (s, tier) in active.items())
        reset[f"p{i}"] = config.passage_node_weight * (config.passage_ratio * (dense[i] - min(dense)) / (max(dense) - min(dense)) + math.log1p(bonus))
    edges = {(f"p{i}", f"p{i + 1}"): 1.0 for i in range(len(texts) - 1)}
    bridges = {i for i, t in enumerate(texts) if any(tier <= 1 and w in words(t) for w, (_, tier) in active.items())}
    for i, t in enumerate(texts):
        total = sum(t.count(w) for w in words(t))
        for w in words(t):
            tier = active[w][1] if w in active else None
            lift = config.edge_beta + config.edge_seed * (i in bridges) + (config.edge_active / tier + config.edge_two_hop * (tier <= 2) if tier else 0.0)
            boost = min(compat.get(w, 0.0) * lift, config.edge_max_boost) if w in active else 0.0
            edges[w, f"p{i}"] = t.count(w) / total * (1 + boost)
    ranked = slow_pagerank(edges, {n: max(0.0, x) for n, x in reset.items()}, config.damping, config.ppr_iterations)
    return {int(n[1:]): x for n, x in ranked.items() if re.fullmatch("p[0-9]+", n)}


def test_retrieve_from_question_to_passages(spark, tmp_path, monkeypatch):
    texts = ["Andersson founded the laboratory in Uppsala.", "The laboratory studied crystals for decades.", "Bergstrom painted harbours.", "Nothing here."]
    p = frame(spark, list(enumerate(texts)), "idx bigint, text string")
    q = frame(spark, [(0, "Where is the laboratory of Andersson?"), (1, "Who is it?")], "qid bigint, question string")
    e = seams.HashingEmbedder(64)
    for config in (Config(iteration_threshold=0.05), Config(iteration_threshold=0.05, matrix_propagation=True, attribute_fallback=True)):
        got = {(r["qid"], r["rank"]): (r["idx"], r["score"]) for r in retrieve.retrieve(q, p, e, config).collect()}
        assert got[0, 1][0] == 0 and {k for k in got if k[0] == 1} == {(1, r) for r in range(1, 5)}  # no entity: dense similarity
        plain = sorted(float(np.dot(*e.encode(["Who is it?", t]))) for t in texts)
        assert got[1, 1][1] == pytest.approx(plain[-1], abs=1e-6)
    classes = frame(spark, [("Bergstrom", ["Place"]), ("laboratory", ["Place"])], "entity string, classes array<string>")
    types = frame(spark, [(0, ["Place"])], "qid bigint, types array<string>")
    config = Config(iteration_threshold=0.05, retrieval_top_k=4, use_class_schema=True)
    aware = {r["idx"]: r["score"] for r in retrieve.retrieve(q, p, e, config, classes, types).filter("qid = 0").collect()}
    assert aware == pytest.approx(slow_retrieve(texts, "Where is the laboratory of Andersson?", e, config, {"laboratory": 1.0, "Bergstrom": 1.0}), abs=1e-6)
    (tmp_path / "chunks.json").write_text(json.dumps(texts))
    (tmp_path / "questions.json").write_text(json.dumps([{"question": "Where is the laboratory of Andersson?", "answer": "Uppsala"}]))
    cli.main(["retrieve", str(tmp_path / "chunks.json"), str(tmp_path / "questions.json"), str(tmp_path / "ranked")])
    assert spark.read.parquet(str(tmp_path / "ranked")).filter("rank = 1").first()["text"] == "0:" + texts[0]
    monkeypatch.setattr(seams, "MODEL", seams.ScriptedModel(lambda prompt: "Answer: Uppsala"), raising=False)
    cli.main(["qa", str(tmp_path / "ranked"), str(tmp_path / "questions.json"), str(tmp_path / "answers"), "--model", "evigraph.sources.seams:MODEL"])
    assert spark.read.json(str(tmp_path / "answers")).first()["pred_answer"] == "Uppsala"


def test_reweighting_and_scores(spark):
    edges = frame(spark, [("a", 1, 0.5), ("b", 1, 0.5), ("c", 1, 0.5)], "entity string, idx bigint, weight double")
    compat = frame(spark, [(0, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (0, "b", 0.001)], "qid bigint, entity string, compat double")
    bridges = frame(spark, [(0, 1)], "qid bigint, idx bigint")
    active = frame(spark, [(0, "a", 1), (2, "a", 3)], "qid bigint, entity string, tier int")
    got = {r["qid"]: r["new_weight"] for r in retrieval.reweighted(edges, compat, bridges, active, Config()).collect()}
    assert got == pytest.approx({0: 1.6, 1: 0.9, 2: 0.966667}, abs=1e-6)
    dense = frame(spark, [(0, 1, 0.2), (0, 2, 0.6), (0, 3, 0.4)], "qid bigint, idx bigint, sim double")
    bonus = retrieval.entity_bonus(frame(spark, [(3, "Eee eEe eee")], "idx bigint, text string"), frame(spark, [(0, "eee", 0.8, 2)], "qid bigint, entity string, score double, tier int"))
    scores = {r["idx"]: r["weight"] for r in retrieval.passage_scores(dense, bonus, Config(passage_ratio=2.0)).collect()}
    assert scores[3] == pytest.approx(0.072058, abs=1e-5)
    same = retrieval.minmax(frame(spark, [(0, 2.0), (0, 2.0)], "qid bigint, x double"), "qid", "x", "y")
    assert [r["y"] for r in same.collect()] == [1.0, 1.0]


def test_batching_changes_nothing(spark):
    passages = frame(spark, [(i, f"firstentity number{i} secondone thirdpart{i}") for i in range(6)], "idx bigint, text string")
    dense = frame(spark, [(q, i, (q + 1) * i / 10) for q in (0, 1) for i in range(6)], "qid bigint, idx bigint, sim double")
    seed = frame(spark, [(0, "firstentity", 0.9), (1, "secondone", 0.5)], "qid bigint, entity string, score double")
    run = lambda keep: sorted((r["qid"], r["rank"], r["idx"], round(r["score"], 9)) for r in retrieve.top_passages(retrieve.search(passages, dense.filter(keep), seed.filter(keep).withColumnRenamed("score", "weight"), seed.filter(keep).withColumn("tier", F.lit(1)), Config()), dense.filter(keep), 3).collect())
    assert run("true") == run("qid = 0") + run("qid = 1")


def test_groups_and_closure(spark):
    names = frame(spark, [("A", 3), ("B", 5), ("Place", 2), ("Location", 2), ("X", 1)], "name string, freq bigint")
    pairs = frame(spark, [("A", "B"), ("Place", "Location")], "a string, b string")
    assert {r["name"]: r["representative"] for r in ontology.groups(names, pairs).collect()} == {"A": "B", "B": "B", "Place": "Place", "Location": "Place", "X": "X"}
    e = frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "parent string, child string")
    assert ontology.closure(e).count() == 6
    assert sorted(map(tuple, ontology.reduction(e).collect())) == [("a", "b"), ("b", "c"), ("c", "d")]
    loop = frame(spark, [("a", "b"), ("b", "a")], "parent string, child string")
    assert ontology.closure(loop).count() == 4


def test_acyclic():
    kept, removed = ontology.acyclic([("A", "B", 2, 0), ("B", "A", 1, 0), ("C", "C", 9, 0), ("B", "C", 1, 1)])
    assert kept == [("A", "B"), ("B", "C")] and removed == [("C", "C", "self_loop"), ("B", "A", "cycle")]


def schema(table, order, **options):
    swap = {"A_PARENT_B": "B_PARENT_A", "B_PARENT_A": "A_PARENT_B"}

    def judge(a, b):
        if (a, b) in table:
            return table[a, b], 0.9
        return swap.get(table.get((b, a), "UNRELATED"), table.get((b, a), "UNRELATED")), 0.9

    return ontology.build_schema(order, judge, **options).export()


def test_schema_builder():
    out = schema({("Location", "Place"): "EQUIVALENT"}, [("Person", 9), ("Place", 8), ("Location", 7)])
    assert out["roots"] == ["Person", "Place"] and out["canonical_map"]["Location"] == "Place"
    out = schema({("Place", "City"): "A_PARENT_B", ("Place", "Settlement"): "A_PARENT_B", ("Settlement", "City"): "A_PARENT_B"}, [("Place", 9), ("City", 8), ("Settlement", 7)])
    assert out["subclass_edges"] == [("Place", "Settlement"), ("Settlement", "City")] and out["roots"] == ["Place"]
    out = schema({("A", "B"): "RELATED", ("C", "A"): "A_PARENT_B"}, [("A", 3), ("B", 2), ("C", 1)])
    assert out["related_edges"] == [("A", "B")] and out["roots"] == ["B", "C"]
    rng = random.Random(3)
    names = [f"n{i}" for i in range(25)]
    table = {(a, b): rng.choice(["A_PARENT_B", "B_PARENT_A", "EQUIVALENT", "RELATED", "UNRELATED"]) for a in names for b in names if a < b}
    for multi in (False, True):
        out = schema(table, [(n, 1) for n in names], multi_parent=multi)
        kept, removed = ontology.acyclic([(p, c, 1, 0) for p, c in out["subclass_edges"]])
        assert not removed and len(kept) == len(out["subclass_edges"])


def test_schema_export_and_records():
    out = schema({("Location", "Place"): "EQUIVALENT", ("Place", "City"): "A_PARENT_B", ("City", "Harbour"): "RELATED"}, [("Place", 9), ("Location", 8), ("City", 7), ("Harbour", 1)])
    assert sorted(out) == sorted("class_statistics runtime_statistics class_frequency roots canonical_classes canonical_map equivalence_groups subclass_edges related_edges unrelated_pairs uncertain_pairs conflict_records llm_relation_records insertion_records".split())
    assert out["equivalence_groups"] == [["Location", "Place"]] and out["canonical_classes"] == ["City", "Harbour", "Place"]
    assert out["class_statistics"]["num_raw_classes"] == 4 and out["class_statistics"]["num_roots"] == 2 == len(out["roots"])
    assert out["class_frequency"]["Place"] == 9 and len(out["llm_relation_records"]) == out["runtime_statistics"]["num_llm_calls"] == 3
    assert [r["class"] for r in out["insertion_records"]] == ["Place", "Location", "City", "Harbour"]
    assert [a["action"] for a in out["insertion_records"][2]["actions"]] == ["descend", "direct_child"]


def test_judge_asks_again_and_failures_stay_open():
    replies = iter(["?", '{"relation": "EQUIVALENT", "confidence": 0.8, "reason": "same"}'])
    assert annotate.relation_judge(seams.ScriptedModel(lambda p: next(replies)))("A", "B") == ("EQUIVALENT", 0.8, "same")
    asked = []
    assert annotate.relation_judge(seams.ScriptedModel(lambda p: asked.append(p) or ""), 2)("A", "B")[0] == "UNCERTAIN" and len(asked) == 3

    def broken(a, b):
        raise RuntimeError("no service")

    out = ontology.build_schema([("A", 2), ("B", 1)], broken).export()
    assert out["uncertain_pairs"] == [("A", "B")] and out["llm_relation_records"][0]["reason"] == "no service" and out["roots"] == ["A", "B"]


def slow_reduction(edges):
    """Edges that no longer path implies, by trying each."""
    keep = set(edges)
    for p, c in sorted(edges):
        down = {}
        for a, b in keep - {(p, c)}:
            down.setdefault(a, set()).add(b)
        if ontology.reaches(down, p, c):
            keep.discard((p, c))
    return keep


def test_subclass_edges_stay_reduced():
    rng = random.Random(4)
    for _ in range(20):
        s, every = ontology.Schema({}, lambda a, b: ("UNRELATED", 1.0)), set()
        for _ in range(60):
            p, c = rng.sample([f"n{i}" for i in range(12)], 2)
            if s.subclass(p, c):
                every.add((p, c))
        got = {(p, c) for p, cs in s.children.items() for c in cs}
        assert got == slow_reduction(every) and got == {(p, c) for c, ps in s.above.items() for p in ps}


def test_path_edges_cut_at_repeats(spark):
    rows = [(1, "e", [" Entity ", "Person", "", "person", "Poet"]), (2, "f", ["Entity", "entity", "X"])]
    got = [(r["parent"], r["child"], r["support"]) for r in ontology.path_edges(frame(spark, rows, "pos bigint, entity string, path array<string>")).collect()]
    assert got == [("Entity", "Person", 1)]


def test_path_edges(spark):
    rows = [(i, f"e{i}", ["Entity", "Person", "Poet"]) for i in range(7)] + [(9, "e9", ["Poet"]), (10, "e10", ["Poet", "Entity"])]
    got = {(r["parent"], r["child"]): r for r in ontology.path_edges(frame(spark, rows, "pos bigint, entity string, path array<string>")).collect()}
    assert got["Entity", "Person"]["support"] == 7 and got["Entity", "Person"]["examples"] == [f"e{i}" for i in range(5)] and got["Person", "Poet"]["depth"] == 1
    assert ("Poet", "Entity") in got


def test_annotation_and_answers(spark):
    entities = frame(spark, [("h1", "Ada"), ("h2", "Oslo"), ("h3", "zzz")], "hash_id string, entity string")
    model = seams.ScriptedModel(lambda p: '["person"]' if "Ada" in p else ('["city"]' if "nothing but" in p and "Oslo" in p else "" if "zzz" not in p else "one two three four five six seven"))
    got = {r["entity"]: (r["classes"], r["status"]) for r in annotate.entity_classes(entities, model).collect()}
    assert got == {"Ada": (["Person"], "success"), "Oslo": (["City"], "success"), "zzz": ([], "empty")}
    assert annotate.annotate(entities, frame(spark, [("h1",)], "hash_id string"), model).count() == 2
    paths = annotate.class_paths(entities, seams.ScriptedModel(lambda p: '{"class_paths": [["Entity", "B"], ["A"]]}'))
    assert {tuple(r["classes"]) for r in paths.collect()} == {("A", "B")}

    def broken(p):
        raise RuntimeError("no service")

    assert {r["status"] for r in annotate.entity_classes(entities, seams.ScriptedModel(broken)).collect()} == {"failed"}
    q = frame(spark, [(0, "Who was Ada?", "a poet"), (1, "Odd", None)], "qid bigint, question string, gold string")
    ranked = frame(spark, [(0, 2, "second"), (0, 1, "first")], "qid bigint, rank int, text string")
    prompts = {r["qid"]: r["prompt"] for r in qa.reading_prompts(q, ranked).collect()}
    assert prompts[0].index("first") < prompts[0].index("second")
    answers = qa.read(q, ranked, seams.ScriptedModel(lambda p: "Hm. Answer: The Poet!"))
    rows, means = qa.evaluate(q.join(answers, "qid"), seams.ScriptedModel(lambda p: "Correct."))
    assert tuple(means.first()) == (1.0, 0.5) and rows.count() == 2
    assert tuple(qa.evaluate(q.join(answers, "qid").limit(0))[1].first()) == (None, None)
    types = annotate.question_types(q.select("question"), frame(spark, [("Odd", ["Kept"])], "question string, types array<string>"))
    assert {r["question"]: r["types"] for r in types.collect()} == {"Odd": ["Kept"], "Who was Ada?": ["Person", "Organization"]}


def test_recogniser_and_chat_model(spark):
    found = seams.recognised(frame(spark, [(1, "The 3rd committee met 12 delegates"), (2, None)], "idx bigint, text string"), "idx", seams.PatternRecogniser())
    assert sorted((r["entity"], r["label"]) for r in found.collect()) == [("12", "CARDINAL"), ("3rd", "ORDINAL"), ("committee", "TERM"), ("delegates", "TERM")]
    assert corpus.named(found).count() == 2
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "Answer: yes"}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert seams.ChatModel(f"http://127.0.0.1:{server.server_port}/v1", "m", "t", "be brief").answer(["Is it?"]) == ["Answer: yes"]
    finally:
        server.shutdown()
    assert asked[0]["temperature"] == 0.0 and asked[0]["max_tokens"] == 2000 and [m["role"] for m in asked[0]["messages"]] == ["system", "user"]


def test_class_tables(spark, tmp_path):
    (tmp_path / "classes.json").write_text('{"e1": {"entity": "Oslo", "classes": ["location", "City"]}, "e2": {"entity": "X", "classes": []}}')
    (tmp_path / "state.json").write_text('{"canonical_map": {"Location": "Place", "City": "City"}, "subclass_edges": [], "related_edges": []}')
    (tmp_path / "types.json").write_text('{"Odd one": ["Kept"]}')
    q = frame(spark, [(0, "Odd one"), (1, "Where was it founded?"), (2, "Hm")], "qid bigint, question string")
    config = Config(entity_classes_path=str(tmp_path / "classes.json"), schema_state_path=str(tmp_path / "state.json"), query_type_cache_path=str(tmp_path / "types.json"))
    classes, types, canonical = retrieve.class_tables(spark, config, q, seams.ScriptedModel(lambda p: '["Thing"]'))
    assert [tuple(r) for r in classes.collect()] == [("Oslo", ["Place", "City"])]
    assert {r["qid"]: r["types"] for r in types.collect()}.items() >= {0: ["Kept"], 2: ["Thing"]}.items()
    assert set(json.loads((tmp_path / "types.json").read_text())) == {"Odd one", "Where was it founded?", "Hm"}
    found = ontology.entity_compatibility(frame(spark, [(1, "Oslo"), (2, "Oslo")], "qid bigint, entity string"), classes, frame(spark, [(1, [" location."]), (2, ["Thing"])], "qid bigint, types array<string>"), canonical)
    assert [tuple(r) for r in found.collect()] == [(1, "Oslo", 1.0)]
    none = retrieve.class_tables(spark, Config(), q)
    assert none[0].count() == 0 and none[1].count() == 3


def test_embedder(spark):
    e = seams.HashingEmbedder(8)
    got = seams.encoded(frame(spark, [("h", "some words"), ("i", "")], "hash_id string, text string"), e).collect()
    assert sum(x * x for x in got[0]["embedding"]) == pytest.approx(1) and sum(got[1]["embedding"]) == 0


def test_stream(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, "a")]
    frame(spark, rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    for extra in ([], [(4, "b"), (5, "c")]):
        if extra:
            frame(spark, extra, "doc_id bigint, text string").write.mode("append").parquet(f"{tmp_path}/in")
        out = index.run_available(index.passages(spark, f"{tmp_path}/in", "doc_id bigint, text string"), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert sorted(r["text"] for r in out.collect()) == sorted({t for _, t in rows + extra})


def test_artifacts(spark, tmp_path):
    (tmp_path / "classes.json").write_text('{"e1": {"entity": "Ada", "classes": ["person", "Person.", ""]}, "e2": {"entity": "X", "classes": []}, "e3": {"entity": "Y", "classes": null}}')
    rows = artifacts.entity_classes(spark, str(tmp_path / "classes.json"))
    assert rows.count() == 3 and artifacts.entity_classes(spark, str(tmp_path / "none.json")).count() == 0
    state = schema({("Location", "Place"): "EQUIVALENT", ("Place", "City"): "A_PARENT_B", ("A", "B"): "RELATED"}, [("Place", 9), ("Location", 8), ("City", 7), ("A", 3), ("B", 2)])
    artifacts.write_schema_state(spark, state, str(tmp_path / "state.json"))
    canonical, subclass, related = artifacts.schema_state(spark, str(tmp_path / "state.json"))
    assert {r["raw"]: r["canonical"] for r in canonical.collect()}["Location"] == "Place"
    assert [tuple(r) for r in subclass.collect()] == [("Place", "City")] and sorted(map(tuple, related.collect())) == [("A", "B"), ("B", "A")]
    assert all(t.count() == 0 for t in artifacts.schema_state(spark, str(tmp_path / "none.json")))
    names = frame(spark, [("person", "Person", 0)], "raw string, canonical string, pos int")
    assert [tuple(r) for r in artifacts.usable_classes(rows, names).collect()] == [("e1", ["Person"])]
    artifacts.write_entity_classes(rows, str(tmp_path / "out"))
    again = artifacts.entity_classes(spark, str(tmp_path / "out"))
    assert again.columns == rows.columns and sorted(map(str, again.collect())) == sorted(map(str, rows.collect())) and again.count() == 3
    types = frame(spark, [("Who?", ["Person"]), ("Odd \"one\"", [])], "question string, types array<string>")
    artifacts.write_question_types(spark, types, str(tmp_path / "types.json"))
    assert sorted(map(str, artifacts.question_type_cache(spark, str(tmp_path / "types.json")).collect())) == sorted(map(str, types.collect()))
    assert artifacts.question_type_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "ner.json").write_text('{"passage_hash_id_to_entities": {"p1": ["Ada", "Oslo"]}, "sentence_to_entities": {"Ada ran.": ["Ada"]}}')
    a, b = artifacts.entity_cache(spark, str(tmp_path / "ner.json"))
    assert sorted(map(tuple, a.collect())) == [("p1", "Ada"), ("p1", "Oslo")] and [tuple(r) for r in b.collect()] == [("Ada ran.", "Ada")]
    artifacts.write_entity_cache(a, b, str(tmp_path / "ner"))
    assert spark.read.parquet(str(tmp_path / "ner" / "passage_entities")).count() == 2
    frame(spark, [(" h1 ", " Ada "), ("h1", "Ada"), ("h2", ""), (None, "x")], "hash_id string, text string").write.parquet(str(tmp_path / "ents"))
    assert [tuple(r) for r in artifacts.entity_table(spark, str(tmp_path / "ents")).collect()] == [("h1", "Ada")]
    assert artifacts.named_entities(spark, ["Ada", " ", "Ada"]).count() == 1
    assert artifacts.cycle_report([("a", "b")], [("b", "a", "cycle")], {("b", "a"): 2})["removed_edges"] == [{"parent": "b", "child": "a", "reason": "cycle", "support": 2}]
