"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evigraph.llm import bpe, decontaminate, imatch, language, linear, ngramlm, pii, quality, redirects, registry, simhash, toxicity
from evigraph.llm.common import SpanHasher, components, runs
from evigraph.llm.eliasfano import EliasFano, build
from evigraph.llm.linear import sigmoid

ODD = ["", None, " ", "a", "\x00", "é ñ ß İ 日本語 😀", "word " * 5000, "x" * 200_000, "1" * 5000, "@" * 3000, "a@b.c@d.e", "same text here", "same text here"]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def odd_docs(spark):
    """Nulls anywhere, empty and long texts, repeats, and columns whose names clash with results."""
    rows = [(i, t, None, float(i), 7, "f") for i, t in enumerate(ODD)] + [(None, "no id", "en", 0.0, 1, "g"), (3, "a", "en", None, None, None), (3, "a", "en", None, None, None)]
    return frame(spark, rows, "doc_id bigint, text string, lang string, score double, predicted int, fingerprint string")


def reach(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(100)]
    want = reach([e for e in edges if e[0] != e[1]])
    for few in (0, 1 << 17):
        got = {r["node"]: r["component"] for r in components(frame(spark, edges, "a bigint, b bigint"), few=few).collect()}
        assert got == want
        assert components(frame(spark, [], "a bigint, b bigint"), few=few).count() == 0


def test_span_hash_and_runs():
    data = np.frombuffer(b"ab cd  ab e", np.uint8)
    s, e, r = runs(data != 32, np.array([0, 5, 11]))
    assert s.tolist() == [0, 3, 7, 10] and e.tolist() == [2, 5, 9, 11] and r.tolist() == [0, 0, 1, 1]
    h = SpanHasher(data)(s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3


# ---------------------------------------------------------------- 1


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [t for t in ODD if t is None or len(t) < 30_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("size,hot", [(3, 2048), (3, 4), (4, 2048), (2, 2048), (5, 8)])
def test_links(spark, size, hot):
    rng = random.Random(size)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    near = [(sign(a), sign(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    df = frame(spark, [(sign(f),) for f in fps], "fp bigint")
    got = [(r["a"], r["b"]) for r in simhash.links(df, 3, size, hot).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in got)
    assert reach(got) == reach(near)
    if hot == 2048:
        assert sorted(tuple(sorted(x)) for x in got) == sorted(tuple(sorted(x)) for x in near)


def test_family_tallies_every_shared_byte():
    """Of any pair with five equal positions the lists it meets in report all of them, so the tally decides."""
    for size in (1, 2, 3, 4, 5):
        sets = simhash.family(3, size)
        for equal in (set(c) for n in range(5, 9) for c in combinations(range(8), n)):
            assert set().union(*[s for s in sets if set(s) <= equal]) == equal


def test_near_duplicates_edge_cases(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 3
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert {c for (d, f), c in by.items() if f == 0} == {0} and by[12, [f for d, f in by if d == 12][0]] == 11
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.deduplicate(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids.count((False, 3)) == 1 and (False, 12) not in ids and (True, 0) in ids


def test_deduplicate_takes_fingerprints(spark):
    """Without any band of a sketch, the index of fingerprints alone connects all near copies within three bits."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(1, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = frame(spark, list(enumerate(texts)))
    nodes = simhash.sketches(docs, 5)
    who = {r["doc_id"]: (r["node"], r["fp"] & (1 << 64) - 1) for r in nodes.collect()}
    sets = [found for _, found in simhash.shingle_sets(pa.array(texts), 5)]
    slow = lambda s: sum((2 * sum(int(x) >> b & 1 for x in s) > len(s)) << b for b in range(64))
    assert all(who[i][1] == slow(s) for i, s in enumerate(sets))
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    near = {frozenset((who[i][0], who[j][0])) for i in range(len(texts)) for j in range(i) if like(sets[i], sets[j]) >= 0.8 and (who[i][1] ^ who[j][1]).bit_count() <= 3}
    got = simhash.jaccard_links(nodes.withColumn("keys", F.array().cast("array<bigint>")), docs, 5, 0.8)
    assert near and {frozenset((r["a"], r["b"])) for r in got.collect()} == near


@pytest.mark.parametrize("search", [{}, {"rounds": 1, "block": 3}])
def test_deduplicate_jaccard(spark, search):
    """Edited copies against brute force over five-word shingles; with few rounds of leaders and small blocks as without."""
    rng, texts = random.Random(14), []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 300))]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for j in rng.sample(range(len(copy)), rng.randrange(1, max(2, len(copy) // 30))):
                copy[j] = "Edited"
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += ["a b", "A  b", "a b c", "", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3 for i, j in near) > len(near) // 4
    root = reach(near)
    want = {i for i in range(len(texts)) if root.get(i, i) == i}
    assert {r["doc_id"] for r in simhash.deduplicate(frame(spark, rows), **search).collect()} == want


# ---------------------------------------------------------------- 2, 5, 8


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.mark.parametrize("bad", [lambda a, b: a and b, lambda a, b: a != b])
def test_toxicity_learns_pairs_and_terms(spark, bad):
    """Both terms together, and either but not both, which no additive weights can tell."""
    rng = random.Random(5)
    filler = [f"w{i}" for i in range(400)]
    word = lambda k: " ".join(rng.choices(filler, k=k))
    rows = []
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, f"{word(12)} {'grumble' if a else ''} {word(9)} {'zorbians' if b else ''} {word(8)}", int(bad(a, b))))
    docs = frame(spark, [(i, t, y) for i, t, y in rows], "doc_id bigint, text string, y int")
    model = toxicity.fit(docs.filter("doc_id < 600"))
    right = lambda m: np.mean([r["predicted"] == rows[r["doc_id"]][2] for r in toxicity.score(docs.filter("doc_id >= 600").drop("y"), m).collect()])
    assert right(model) > 0.95 and right((*model[:4], model[4] * 0)) < 0.8


def test_machine_equals_slow_sums_and_gradients():
    """margins() against the double sum over pairs; a step of train() goes down the loss that finite differences give."""
    rng = np.random.default_rng(1)
    f, rank = 12, 3
    w, v, size = rng.normal(size=f), rng.normal(size=(f, rank)), rng.uniform(0.1, 1, f)
    rows = [sorted(rng.choice(f, k, replace=False).tolist()) for k in (0, 1, 4, 7, 0, 12)]
    edge, var = np.cumsum([0, *map(len, rows)]), np.array([k for r in rows for k in r], np.int64)
    slow = [0.3 + sum(w[i] * size[i] for i in r) + sum(v[i] @ v[j] * size[i] * size[j] for i, j in combinations(r, 2)) for r in rows]
    assert np.allclose(toxicity.margins(var, edge, 0.3, w, v, size), slow)
    y = np.array([0, 1, 1, 0, 1, 0.0])
    loss = lambda m: -np.mean(y * np.log(sigmoid(m)) + (1 - y) * np.log(1 - sigmoid(m)))
    got = toxicity.train(var, edge, size, y, np.ones(6), rank, steps=300)
    assert loss(toxicity.margins(var, edge, *got, size)) < 0.6 * loss(np.zeros(6))


def test_hinge_dual_equals_subgradient_descent():
    """The dual solution's primal loss against plain subgradient steps, dense and sparse rows alike."""
    rng = np.random.default_rng(2)
    x = (rng.random((80, 10)) < 0.4) * rng.normal(size=(80, 10))
    y = np.where(x @ rng.normal(size=10) + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    x = x.astype(np.float32)
    primal = lambda w: 0.5 * w @ w + 0.5 * np.maximum(0, 1 - y * (x @ w)).sum()
    idx, edge = [np.flatnonzero(r) for r in x], np.cumsum([0, *[np.count_nonzero(r) for r in x]])
    sparse = linear.Sparse(np.concatenate(idx), np.concatenate([r[k] for r, k in zip(x, idx)]), edge, 10)
    a, b = linear.hinge_dual(x, y, 0.5, epochs=200), linear.hinge_dual(sparse, y, 0.5, epochs=200)
    w, best = np.zeros(10), np.inf
    for t in range(1, 20000):
        w = w - (w - 0.5 * ((1 - y * (x @ w) > 0) * y) @ x) / t
        best = min(best, primal(w))
    assert primal(a) < best * 1.001 and np.allclose(a, b, atol=1e-4)
    half = np.arange(0, 80, 2)
    assert np.allclose(linear.hinge_dual(x, y[half], 0.5, rows=half), linear.hinge_dual(x[half], y[half], 0.5), atol=1e-4)


def test_platt_equals_grid_search():
    rng = np.random.default_rng(3)
    m = rng.normal(size=200) * 3
    y = (rng.random(200) < sigmoid(1.5 * m - 0.5)).astype(float)
    a, b = linear.platt(m, y)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: -np.sum(t * np.log(sigmoid(a * m + b)) + (1 - t) * np.log(1 - sigmoid(a * m + b)))
    assert loss(a, b) < min(loss(p, q) for p in np.linspace(0.2, 4, 60) for q in np.linspace(-2, 2, 60)) + 0.05


def slow_flags(text):
    """The n-grams of quality.indicators by plain Python, as sets per stream."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {("w", w) for w in words} | {("p", p) for p in zip(words, words[1:])} | {("c", low.encode()[i : i + 4]) for i in range(len(low.encode()) - 3)}


def test_quality_indicators_are_of_words_and_characters():
    texts = ["Good plain words here", "good plain words here", "here words plain good", "Zap zap zap!!", "", "é"]
    got = quality.indicators(pa.array(texts))[:, 1 << quality.BITS :]
    one = {}
    for row, t in zip(got, texts):
        for g in slow_flags(t):
            one.setdefault(g, set(np.flatnonzero(row).tolist()))
            one[g] &= set(np.flatnonzero(row).tolist())
    for row, t in zip(got, texts):
        assert row.sum() <= len(slow_flags(t)) and all(one[g] & set(np.flatnonzero(row).tolist()) for g in slow_flags(t))
    assert (got[0] == got[1]).all() and (got[0] != got[2]).any()


def test_quality_tells_wording(spark):
    """Texts alike in shape, apart in their words."""
    rng = random.Random(16)
    good, bad = [f"{a}{b}" for a in "bcdfg" for b in ("anal", "erin", "isol")], [f"{a}{b}" for a in "bcdfg" for b in ("upor", "ovex", "ylam")]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=30)), i % 2) for i in range(300)]
    docs = frame(spark, rows, "doc_id bigint, text string, y int")
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs.filter("doc_id >= 200").drop("y"), quality.fit(docs.filter("doc_id < 200"))).collect()}
    assert np.mean([got[i] == y for i, _, y in rows[200:]]) > 0.98


def test_quality_held_out(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + "." if i % 3 else " ".join([rng.choice(words)] * 20) + " !!! ", int(i % 3 > 0)) for i in range(600)]
    docs = frame(spark, rows, "doc_id bigint, text string, y int")
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs.filter("doc_id >= 400").drop("y"), quality.fit(docs.filter("doc_id < 400"))).collect()}
    assert np.mean([got[i] == y for i, _, y in rows[400:]]) > 0.98


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_edge_cases(spark, module):
    docs = odd_docs(spark)
    for model in (None, module.fit(frame(spark, [], "doc_id bigint, text string, y int")), module.fit(frame(spark, [(1, "x y", 1), (2, None, 1)], "doc_id bigint, text string, y int")), module.fit(frame(spark, [(1, "good word", 1), (2, "bad", 0), (3, None, 0), (3, "", None)], "doc_id bigint, text string, y int"))):
        got = module.score(docs, model)
        assert got.columns == ["doc_id", "lang", "fingerprint", "score", "predicted"]
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())
    assert module.score(frame(spark, []), None).count() == 0


def test_language(spark):
    rng = random.Random(7)
    parts = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "keit", "ü"], "fr": ["eau", "oi", "è", "le"], "es": ["ción", "ñ", "los", "ado"], "xx": ["qq", "zz", "kk"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(30)), k) for i, k in enumerate(list(parts) * 60)]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs.filter("doc_id < 200"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(docs.filter("doc_id >= 200").drop("lang"), model).collect()}
    assert np.mean([got[i] == k for i, _, k in rows[200:]]) > 0.97
    odd = language.classify(odd_docs(spark), model)
    assert odd.columns == ["doc_id", "lang", "predicted", "fingerprint", "lang_pred", "score"]
    und = {r["doc_id"] for r in odd.collect() if r["lang_pred"] == "und"}
    assert und == {i for i, t in enumerate(ODD) if not any(map(str.isalpha, t or ""))}
    kept = language.accept(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and kept.count() <= len(ODD) + 3 - len(und)
    clean = language.accept(docs.filter("doc_id >= 200"), model).count()
    assert clean >= 99  # the floor spares documents of the learnt languages
    other = frame(spark, [(i, " ".join("".join(rng.choices("абвгдежзиклмнопрст", k=7)) for _ in range(40)), None) for i in range(20)], "doc_id bigint, text string, lang string")
    assert language.accept(other, model).count() <= 2  # a script that was never learnt
    assert {r["lang"] for r in language.accept(docs, model, languages=("de",)).collect()} == {"de"}
    assert language.fit(docs.limit(0)) is None and language.accept(docs, None).count() == 0


# ---------------------------------------------------------------- 3


def test_redirects(spark):
    page = lambda canonical="", refresh="": "<html>" + (f'<link rel="canonical" href="{canonical}">' if canonical else "") + (f"<META HTTP-EQUIV='refresh' content='0; URL={refresh}'>" if refresh else "") + "</html>"
    rows = [
        (1, "http://a.example.org/en/1", page("https://b.example.net/es/2")),  # alias of a blocked url
        (2, "https://a.example.org/en/1#frag", page()),  # same node
        (3, "http://c.example.org/x", page(refresh="http://a.example.org/en/1")),  # two steps away
        (4, "http://www.example.com/en/z", page("http://b.example.net/es/2")),  # explicit allow
        (5, "http://www.example.com/en/y", page("http://d.example.org/q")),
        (6, "http://d.example.org/q", page()),  # linked with an allowed url only
        (7, "HTTP://M.Example.COM/en/1?x=1", page()),
        (8, "http://evilexample.com", page()),
        (9, None, page("/rel")),
        (10, "no scheme", None),
        (11, "http://a.example.org/en/9", None),
        (12, "http://x.net/fr", page("fr/1")),  # relative: http://x.net/fr/1 is blocked
        (12, "http://x.net/fr", page("fr/1")),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in redirects.judge(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/en/1", None, "block") and got[2][3] == "block" and got[3][3] == "block"
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5][3] == "allow" and got[6][3] == "allow"
    assert got[7] == ("m.example.com", "/en/1", "example.com/en/", "block")
    assert got[8] == ("evilexample.com", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11][3] == "allow" and got[12] == ("x.net", "/fr", None, "block")
    assert redirects.judge(frame(spark, [], "page_id bigint, url string, html string")).count() == 0
    df = frame(spark, rows, "page_id bigint, url string, html string").select("page_id", redirects.host_of(F.col("url")).alias("host"), redirects.path_of(F.col("url")).alias("path"))
    few, many = (sorted(map(str, redirects.ruled(df, redirects.RULES, n).select("page_id", "rule", "action").collect())) for n in (256, 0))
    assert few == many


LINKED = [
    (1, "http://a.org/1", '<link rel="canonical" href="http://b.org/x"><link href="http://n.net/es/1" rel="canonical">'),  # the second link is blocked
    (2, "http://a.org/2", "<LINK REL='alternate canonical' HREF='http://n.net/fr/2'>"),
    (3, "http://n.net/deep/er/3", '<meta http-equiv=refresh content="1;url=../../es/./9">'),  # http://n.net/es/9
    (4, "http://a.org/4", '<link rel="noncanonical" href="http://n.net/es/1"><link rel=stylesheet href="canonical.css">'),
    (5, "http://n.net/es/../5", "<p>canonical"),  # its own path is judged as it stands
    (6, "http://c.org/a/..", '<link rel=canonical href="/b">'),
    (7, "http://c.org/", '<link rel=canonical href="http://n.net/fr/7">'),  # the node of page 6
    (8, "http://c.org/b", None),
    (9, "http://c.org/own", '<link rel=canonical href="#x">'),
]


def test_every_link_counts(spark, tmp_path):
    import duckdb

    docs = frame(spark, LINKED, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in redirects.judge(docs).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow"}
    docs.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({redirects.OP3_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in redirects.op3_redirects(spark, str(tmp_path)).select(*columns).collect()) == want


# ---------------------------------------------------------------- 4


def test_imatch(spark):
    rows = [(i, " ".join(random.Random(i // 2).choices([f"t{k}" for k in range(3000)], k=40 + i // 2)) if i % 2 == 0 or i % 5 else "") for i in range(200)] + [(200, None), (201, "one"), (None, "a null id")]
    bitmap = imatch.lexicon(frame(spark, rows))
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(frame(spark, rows), bitmap).collect()}
    assert got[2] == got[3] and got[2] != got[4] and len(got[2]) == 4 * imatch.COLUMNS and got[200] == "0" * 4 * imatch.COLUMNS


def test_imatch_band_and_subsets(spark):
    """Band, subsets and likeness against a slow version: the same subsets of the lexicon for every text."""
    rng = random.Random(17)
    texts = [" ".join(rng.choices([f"t{k}" for k in range(400)], k=rng.choice((3, 60, 200)))) + " everywhere" for _ in range(120)] + [f"once{i}" for i in range(5)]
    df = frame(spark, list(enumerate(texts)))
    bitmap = imatch.lexicon(df, low=2, high=0.5)
    counts = Counter(w for t in texts for w in set(t.split()))
    key = {w: int(imatch.terms(pa.array([w]))[0][0]) for w in counts}
    inside = {w for w, n in counts.items() if 2 <= n <= 62.5}
    passed = {w for w in counts if imatch._in_band(np.array([key[w]], np.uint64), bitmap)[0]}
    assert inside <= passed and len(passed - inside) <= 3
    subsets = [passed] + [{w for w in passed if int(imatch.mix(np.array([key[w]], np.uint64) ^ s)[0]) & ((1 << level) - 1) == 0} for s in imatch._SEEDS for level in range(1, imatch.LEVELS + 1)]
    got = imatch.fingerprints(pa.array(texts), bitmap)
    for _ in range(300):
        i, j = rng.randrange(120), rng.randrange(120)
        for c, subset in enumerate(subsets):
            a, b = set(texts[i].split()) & subset, set(texts[j].split()) & subset
            assert (got[i, c] == 0) == (not a) and ((got[i, c] == got[j, c]) == (a == b))
    near = [imatch.likeness(got[[i]], imatch.fingerprints(pa.array([imatch.edit(texts[i], texts[i + 1])]), bitmap))[0] for i in range(119)]
    far = imatch.likeness(got[:118], got[1:119])
    assert np.mean(near) > 0.25 and np.mean(far) < 0.2 * np.mean(near)  # texts of 400 words share some
    assert imatch.likeness(got, got).tolist() == [1.0] * len(texts)


def test_imatch_query_edge_cases(spark, tmp_path):
    rows = [(7, "long words " * 30_000), (7, None), (None, "no id"), (7, "long words " * 30_000), (3, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = imatch.op4_imatch(spark, str(tmp_path)).collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 0, 5, 330_000, 330_000]
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 330_000}) == 1
    frame(spark, rows[:1]).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [r["near_next"] for r in imatch.op4_imatch(spark, f"{tmp_path}/one").collect()] == [1.0]


def test_imatch_query(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i * 3, "".join(rng.choices("abcd éß", k=rng.randrange(0, 400)))) for i in range(300)] + [(5000, None), (5001, ""), (5002, "😀" * 7)]
    rng.shuffle(docs)
    frame(spark, docs).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in imatch.op4_imatch(spark, str(tmp_path)).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        want = t[: len(t) - n] + after[:n]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and (got[k]["fingerprint"] == got[k]["edited_fingerprint"]) <= (got[k]["near_edited"] == 1)
    frame(spark, []).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert imatch.op4_imatch(spark, f"{tmp_path}/e").count() == 0


# ---------------------------------------------------------------- 6

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            s, d = m.group(), re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_random():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choices("12304 .@-+()aé\nB_", k=rng.randrange(60)))
        assert pii.base_spans(text) == slow_spans(text)
    for text in ["4539 1488 0343 6467", "a@b.c.d@e.f", "+1 (988) 555-2485", "1.2.3.4.5.6.7.8", "256.1.1.1 255.1.1.1", "a..b@-.-", "x@y", "0000000000000000000 00000000000000"]:
        assert pii.base_spans(text) == slow_spans(text)


def test_bootstrapping(spark):
    texts = [f"please call operator number +1 (55{i % 10}) 555-1{i:03d} today friend" for i in range(40)] + ["please call operator number +1-555-12 today friend", "the year 12345 was good"]
    texts += [f"badge id 77{i:04d} ok" for i in range(5)] + [f"server host 10.0.0.{i} down" for i in range(30)] + ["server host 10.0.0.999 down", "elsewhere 10.0.0.998 up"]
    docs = frame(spark, list(enumerate(texts)))
    rows = pii.find(docs, pii.learn(docs)).collect()
    found = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["found"]] for r in rows}
    assert found[77] == [(12, 22, "ip")]  # refused by the base pattern, found by its context
    assert found[78] == [] and all(found[i] == [] for i in range(41, 47))
    blocks = {r["doc_id"]: r["found"] for r in pii.find(docs, pii.learn(docs), block=1).collect()}
    assert blocks == {r["doc_id"]: r["found"] for r in rows}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.learn(docs)).collect()}
    assert clean[47] == "server host <IP> down" and clean[78] == texts[78]


def test_bootstrapping_two_hops_and_many_unknown(spark):
    """A context whose only seeds a learnt pattern found is learnt too; three seeds serve however many strings are unknown."""
    texts = [f"gateway node 10.1.0.{i} up" for i in range(3)] + [f"gateway node 10.1.0.{i} up" for i in range(900, 960)]  # m = 60, k = 3
    texts += [f"router spare 10.1.0.{i} idle" for i in range(900, 905)] + ["router spare 10.1.0.999 idle"]  # second hop
    texts += ["elsewhere 10.1.0.998 lies", "the year 12345 was good"]
    docs = frame(spark, list(enumerate(texts)))
    found = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["found"]] for r in pii.find(docs, pii.learn(docs)).collect()}
    assert all(found[i] == [(13, 23, "ip")] for i in range(3, 63))
    assert all(found[i] == [(13, 23, "ip")] for i in range(63, 69))
    assert found[69] == [] and found[70] == []


def test_adjacent_identifiers(spark):
    """A phone and the card after it are one base match, dropped for its digits; both are found by their shape."""
    rng, rows = random.Random(13), []
    for i in range(12):
        digits = f"45{rng.randrange(10**13):013d}"
        card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        rows += [f"w{i} +1 (2{i:02d}) 555-1{i:03d} and so", f"v{i} card {card} end", f"u{i} card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} end"]
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    rows += [f"x +1 (269) 555-3296 {card} y", f"x +1 (269) 555-3297 {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} y", f"x +1 (269) 555-3298 {wrong} y", "x +" + "1 " * 3000]
    docs = frame(spark, list(enumerate(rows)))
    got = {r["doc_id"]: (r["base"], [(s["start"], s["end"], s["kind"]) for s in r["found"]]) for r in pii.find(docs, pii.learn(docs)).collect()}
    assert got[36] == ([], [(2, 19, "phone"), (20, 36, "card")])
    assert got[37] == ([], [(2, 19, "phone"), (20, 39, "card")])
    assert got[38] == ([], [(2, 19, "phone")])


def test_long_identifiers_and_contexts_are_whole():
    """Neither an identifier of hundreds of characters nor a long word beside one is cut."""
    long = "x9" * 400
    text = f"see {long}, done"
    assert pii.candidates(text, pii.base_spans(text)) == [(4, 804, -1)]
    word = "w" * 90
    a, b = f"{word}q 12345 end", f"{word}r 12345 end"
    assert set(pii.patterns(a, 92, 97)) & set(pii.patterns(b, 92, 97)) == {pii._key("R|95|end")}
    mails = ",".join(f"m{i}@a.b" for i in range(40))
    spans = pii.base_spans(mails)
    assert len(spans) == 40 and pii.candidates(mails, spans) == spans  # overlaps with any of many spans count
    covered = pii.Covered([(0, 50, 0), (10, 12, 0), (60, 61, 0)])
    assert covered(13, 14) and not covered(50, 60) and covered(59, 61) and not covered(61, 70)


def test_graph_scores_equal_slow_rounds(spark):
    """learn() against rounds on dictionaries over random pattern-instance graphs."""
    rng = random.Random(19)
    texts = [f"{rng.choice('abc')} {rng.choice(['10.0.0.%d' % rng.randrange(300), '10.0.1.%d' % rng.randrange(300), 'id-%d' % rng.randrange(1000, 1020)])} {rng.choice('xyz')}" for _ in range(150)]
    edges = {}
    for t in texts:
        for a, b, kind in pii.candidates(t, pii.base_spans(t)):
            for p in pii.patterns(t, a, b):
                edges[p, t[a:b].lower()] = max(kind, edges.get((p, t[a:b].lower()), -1))
    known = {}
    for (_, i), k in edges.items():
        if k >= 0:
            known[i] = max(k, known.get(i, -1))
    while True:
        counts = Counter((p, known[i]) for p, i in edges if i in known)
        total = Counter()
        for (p, _), n in counts.items():
            total[p] += n
        score = {(p, k): n / (total[p] + 1) for (p, k), n in counts.items() if n >= 3 and n / (total[p] + 1) >= 0.75}
        new = {}
        for p, i in edges:
            for (q, k), c in score.items():
                if q == p and i not in known:
                    new[i] = max(new.get(i, (0.0, -1)), (c, k))
        if not new:
            break
        known |= {i: k for i, (_, k) in new.items()}
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.learn(frame(spark, list(enumerate(texts)))).collect()}
    assert got == pytest.approx(score) and len(got) > 3


def test_pii_edge_cases(spark):
    docs = odd_docs(spark).withColumnRenamed("fingerprint", "found")
    out = pii.redact(docs, pii.learn(docs))
    assert out.count() == len(ODD) + 3 and "text" in out.columns
    empty = frame(spark, [])
    assert pii.find(empty, pii.learn(empty)).count() == 0


# ---------------------------------------------------------------- 7


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe, n in ((1000, 50), (1 << 32, 3000), (1 << 58, 20000), (1 << 64, 5000), (1 << 64, 3), (50, 50), (7, 1), (1 << 32, 0), (64, 64)):
        v = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
        e = EliasFano(build(v, universe))
        assert (e.select(np.arange(n)) == v).all()
        x = np.concatenate([rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True), v])
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        assert (e.index(v) >= 0).all()


def test_language_model(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "gamma", "ñu", "delta-x"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "unseen words only"), (None, "beta beta")]
    train = [t for i, t in docs if (i or 0) % 4 and i is not None and i < 60]
    tok = lambda t: [*(w.lower() for w in (t or "").encode().split()), b"</s>"]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for t in train:
        s = tok(t)
        uni.update(s)
        bi.update(zip([b"<s>", *s], s))
        ctx.update([b"<s>", *s[:-1]])
    n, v, k = sum(uni.values()), len(uni), 2.0
    full = Counter(uni)
    full[b"<s>"] = ctx[b"<s>"]

    def p(u, w):
        one = (uni[w] + 1) / (n + v + 1)
        if not full[u]:
            return one
        return (bi[u, w] + k * one) / (full[u] + k)

    df = frame(spark, docs)
    model = ngramlm.train(df.filter("doc_id % 4 <> 0 and doc_id < 60").withColumn("score", df["doc_id"]))
    assert (model["n"], model["v"]) == (n, v)
    for (i, t), r in zip(docs, ngramlm.score(df.coalesce(1), model).collect(), strict=True):
        s = tok(t)
        assert r["doc_id"] == i and r["n_tokens"] == len(s) and r["n_known"] == sum(uni[w] > 0 for w in s)
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s), abs_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(u, w)) for u, w in zip([b"<s>", *s], s)), abs_tol=2e-4 * len(s))
    empty = ngramlm.train(frame(spark, []))
    assert ngramlm.score(df, empty).filter("n_known > 0").count() == 0


def test_language_model_keeps_single_pairs(spark, tmp_path):
    """Every pair below is seen once; scores follow from all of them."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    out = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, f"a{i} b{i} c{i}") for i in ids] + [(out, f"a{ids[0]} b{ids[0]} c{ids[1]}")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in ngramlm.op7_ngramlm(spark, str(tmp_path)).collect()}
    uni, bi = Counter(), Counter()
    for _, t in rows[:-1]:
        s = [*t.split(), "</s>"]
        uni.update(s)
        bi.update(zip(["<s>", *s], s))
    n, v, full = sum(uni.values()), len(uni), Counter(uni) + Counter({"<s>": len(ids)})

    def p(u, w):
        return (bi[u, w] + 2.0 * (uni[w] + 1) / (n + v + 1)) / (full[u] + 2.0)

    for i, t in rows:
        s = [*t.split(), "</s>"]
        assert math.isclose(got[i]["score"], sum(math.log10(p(u, w)) for u, w in zip(["<s>", *s], s)), abs_tol=2e-4 * len(s))


def test_language_model_of_many_words(spark):
    """More words than 32-bit halves keep apart, and a context that is spread over the shards."""
    rng = random.Random(31)
    docs = [(i, " ".join(f"the w{rng.randrange(60_000)}" for _ in range(400))) for i in range(300)]
    df = frame(spark, docs)
    model = ngramlm.train(df)
    assert len(model["hot"]) and model["n"] == 300 * 801
    uni, bi = Counter(), Counter()
    for _, t in docs:
        s = [*t.split(), "</s>"]
        uni.update(s)
        bi.update(zip(["<s>", *s], s))
    n, v, full = sum(uni.values()), len(uni), Counter(uni) + Counter({"<s>": 300})
    rows = [*docs[:20], (900, "the unseen the w1 w2")]
    for (_, t), r in zip(rows, ngramlm.score(frame(spark, rows).coalesce(1), model).collect(), strict=True):
        s = [*t.split(), "</s>"]
        want = sum(math.log10((bi[u, w] + 2.0 * (uni[w] + 1) / (n + v + 1)) / (full[u] + 2.0)) if full[u] else math.log10((uni[w] + 1) / (n + v + 1)) for u, w in zip(["<s>", *s], s))
        assert math.isclose(r["score"], want, abs_tol=1e-4 * len(s))


# ---------------------------------------------------------------- 9


def slow_align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_align():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        score, _ = decontaminate.align(np.array(a), np.array([b + [0] * 5]), np.array([len(b)]))
        assert score[0] == slow_align(a, b)


def test_contaminated(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(12, 50)))) for i in range(30)] + [(90, "v1 v2"), (91, None), (92, "")]
    docs, want = [], set()
    for d in range(200):
        body, k = rng.choices(vocab, k=rng.randrange(20, 200)), d % 40
        if k < 30:
            copy = items[k][1].split()
            if d >= 40:  # edited: a tenth of the words replaced, one dropped
                for j in rng.sample(range(len(copy)), len(copy) // 10):
                    copy[j] = "other"
                del copy[len(copy) // 2]
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + ("," if rng.random() < 0.2 else "") for w in copy]
            want.add((d, k))
        docs.append((d, " ".join(body)))
    docs += [(None, items[0][1]), (500, None), (501, ""), (0, docs[0][1])]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id bigint, text string"), block_bytes=2000).collect()} == want
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id bigint, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, []), frame(spark, items, "item_id bigint, text string")).count() == 0


def test_long_part_of_an_item_is_a_copy(spark):
    """60 words of a 400-word item are under half of it, but long enough by themselves."""
    rng = random.Random(21)
    words = [f"q{rng.randrange(4000)}" for _ in range(400)]
    docs = [(1, "intro " + " ".join(words[100:160]) + " outro"), (2, "intro " + " ".join(words[100:120]) + " outro"), (3, " ".join(words))]
    items = frame(spark, [(7, " ".join(words))], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(frame(spark, docs), items).collect()} == {1, 3}


def test_seeds_are_rare_before_windows(spark):
    """A trigram of common words seeds nothing where its item has rarer ones: brute force over the counted words."""
    rng = random.Random(22)
    common = ["the", "of", "and"]
    texts = [" ".join(rng.choices(common, k=400)) for _ in range(50)]
    item = "the of and rare1 rare2 rare3 rare4 rare5 the of and"
    h = decontaminate.word_hashes(pa.array([item]))[0]
    seeds = decontaminate.Seeds([(1, h)], 3)
    counts = Counter(w for t in texts for w in t.split())
    total = sum(counts.values())
    names = dict(zip(h.tolist(), item.split(), strict=True))
    logp = np.log([max(0.5, counts[names[int(w)]]) / total for w in seeds.words])
    rare = decontaminate._rare(seeds, logp, math.log(total), 0.0)
    words = item.split()
    chance = [total * math.prod(max(0.5, counts[w]) / total for w in words[i : i + 3]) for i in range(9)]
    half = sorted(chance)[4]
    assert {int(p) for p in seeds.place[rare]} == {i for i, c in enumerate(chance) if c <= 1 or c <= half * (1 + 1e-9)}
    assert 0 not in seeds.place[rare]  # "the of and"


# ---------------------------------------------------------------- 10


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_library(library):
    own = bpe.load()
    enc = own.encoder()
    rng = random.Random(10)
    texts = [t or "" for t in ODD] + ["a<|endoftext|>b", "İstanbul ΣΑΣ don't we'll I'd x's!!'s ½²³ ﬁ é _ __a \x85\xa0", "<|startoftext|>", "<|startoftext|> <", "'S 'T 'sS"]
    texts += ["".join(rng.choices("abcdefgh the'sre123!?ñÉß .,\n\t-日Ж😀", k=80)) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert enc(t) == want, t[:60]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_frames(spark, library, tmp_path):
    docs = odd_docs(spark).withColumnRenamed("predicted", "ids")
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in bpe.op10_bpe(spark, str(tmp_path)).filter("doc_id = 5").collect())
    ids = library.encode(ODD[5], add_special_tokens=False).ids
    assert got == [(5, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())]
    assert bpe.encode(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("the", "wor", "lan", "mis") for b in ("ing", "ter", "ado", "ung", "es", "al")]
    item = " ".join(rng.choices(vocab, k=30))
    rows = [(i, " ".join(rng.choices(vocab, k=80)), ("en", "fr")[i % 2], "s", 0) for i in range(40)]
    rows[5] = (5, rows[4][1], "en", "s", 0)
    rows[6] = (6, rows[6][1] + " " + item, "en", "s", 0)
    rows[7] = (7, "123 456 !!", None, None, None)
    rows[8] = (8, rows[8][1] + " mail me@example.com", "en", "s", 0)
    rows += [(None, None, None, None, None), (40, "", "en", "s", 0)]
    frame(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(40)) - {5, 6, 7}
    enc = bpe.load().encoder()
    for i, t, *_ in rows:
        if i in got:
            text = t.replace("me@example.com", "<EMAIL>")
            assert got[i]["ids"] == enc(text) and got[i]["n_chars"] == len(text) and got[i]["n_tokens"] == len(enc(text))
    assert pa.__version__


# ---------------------------------------------------------------- the queries themselves


def write_tables(spark, path, docs, labels=(), pages=(), items=()):
    frame(spark, docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    frame(spark, list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame(spark, list(pages), "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    frame(spark, list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries_on_odd_and_empty_tables(spark, tmp_path, name):
    """One row a document (or page) whatever its text, nulls and repeats included; empty tables give empty results."""
    rng = random.Random(23)
    docs = [(i, t, ("en", None, "de")[i % 3], None, None) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 1), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1)]
    docs += [(100 + i, " ".join(rng.choices(["the", "wort", "haus", "river", "gut"], k=30)), ("en", "de")[i % 2], "s", 5) for i in range(20)]
    labels = [(100 + i, i % 2, (i + 1) % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (101, 1, 0), (101, 1, 0)]
    write_tables(spark, f"{tmp_path}/a", docs, labels, LINKED + [(None, None, None), (1, *LINKED[0][1:])], [(1, docs[-1][1]), (2, None), (None, docs[-2][1])])
    got = registry.QUERIES[name](spark, f"{tmp_path}/a")
    n = len(got.collect())
    assert n == (len(LINKED) + 2 if name == "op3_redirects" else 2 if name == "op9_decontaminate" else len(docs)), n
    write_tables(spark, f"{tmp_path}/b", [])
    empty = registry.QUERIES[name](spark, f"{tmp_path}/b")
    assert empty.columns == got.columns and empty.count() == 0


def test_pipeline_of_an_empty_table_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    write_tables(spark, f"{tmp_path}/b", [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    rng = random.Random(24)
    vocab = [f"{a}{b}" for a in ("the", "wor", "lan") for b in ("ing", "ter", "ado", "ung")]
    text = lambda: " ".join(rng.choices(vocab, k=60))
    item = text()
    docs = [(i, text(), "en", "s", 0) for i in range(20)] + [(None, text() + " " + item, "en", "s", 0), (3, text() + " " + item, "en", "s", 0), (None, text(), "en", "s", 0)]
    write_tables(spark, f"{tmp_path}/a", docs, items=[(1, item)])
    kept = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect())
    assert kept == Counter({**{i: 1 for i in range(20)}, None: 1})  # the clean row 3 and the clean row without id stay
