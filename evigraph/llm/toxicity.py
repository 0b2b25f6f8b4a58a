"""Toxicity by a factorization machine over hashed terms: a linear part and learnt pairwise interactions.

Terms are lower-cased words and their beginnings of four and five bytes, hashed to slots.  Every slot that two documents of the
training sample have is a variable of the machine, scaled by how well it tells the labels apart, alone or together with another
term, so that a text's many uninformative terms weigh little; a term that the sample lacks adds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, SpanHasher, buffers, chunks, documents, lower_latin, remainder, runs, sample_by_class
from .linear import sigmoid
from .quality import labelled

BITS = 20
PER_CLASS = 4000
STEMS = (4, 5)
OFTEN = 1024  # slots, the most frequent ones, that are looked at in pairs before training; training itself pairs all


def terms(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, slots) of every term of some texts, repeats included."""
    data, offs = buffers(part)
    low = lower_latin(data)
    starts, ends, rows = runs(LETTER[data], offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span, shift = SpanHasher(low), np.uint64(64 - BITS)
    who, slot = [rows], [span(starts, ends) >> shift]
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        who.append(rows[long])
        slot.append((span(starts[long], starts[long] + k) ^ np.uint64(k << 60)) >> shift)
    return np.concatenate(who), np.concatenate(slot).astype(np.int64)


def term_sets(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, edge): the distinct slots of each text, one text after the other."""
    rows, slot = terms(part)
    key = np.unique((rows << BITS) | slot)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(part) + 1))


def _term_sets(batches):
    for batch in batches:
        for first, part in chunks(batch.column(1)):
            slots, edge = term_sets(part)
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(slots))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), batch.column(2).slice(first, len(part)), lists], ["doc_id", "y", "slots"])


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the values between edges, row by row."""
    out = np.zeros((len(edge) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        out[full] = np.add.reduceat(values, edge[full], axis=0)
    return out


def margins(var: np.ndarray, edge: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """w0 + sum of w x + sum over pairs of <v, v> x x of each row's variables; `size` is x."""
    x = size[var]
    vx = v[var] * x[:, None]
    s = _sums(vx, edge)
    return w0 + _sums(w[var] * x, edge) + 0.5 * ((s * s).sum(1) - _sums((vx * vx).sum(1), edge))


def train(var: np.ndarray, edge: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: int = 4, steps: int = 200, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> tuple:
    """Bias, linear weights and factors (variables x rank) by AdaGrad over small batches, on the weighted logistic loss.

    Linear weights start at zero: begun with the terms' log-odds, texts with many weak terms are flagged.
    """
    rng, f = np.random.default_rng(seed), len(size)
    w0, w, v = float(np.log((weight * y).sum() / (weight * (1 - y)).sum())), np.zeros(f), rng.normal(0, 0.05, (f, rank))
    seen0, seen_w, seen_v = 1e-8, np.full(f, 1e-8), np.full((f, rank), 1e-8)
    weight = weight / weight.mean()
    for _ in range(max(6, -(-steps // -(-len(y) // batch)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = edge[rows + 1] - edge[rows]
            cuts = np.concatenate([[0], np.cumsum(n)])
            k = var[np.repeat(edge[rows] - cuts[:-1], n) + np.arange(cuts[-1])]
            d = weight[rows] * (sigmoid(margins(k, cuts, w0, w, v, size)) - y[rows]) / len(rows)
            x = size[k]
            vx = v[k] * x[:, None]
            s = _sums(vx, cuts)
            dk = np.repeat(d, n) * x
            used, back = np.unique(k, return_inverse=True)
            gw = np.bincount(back, dk, len(used)) + decay * w[used]
            pull = dk[:, None] * (np.repeat(s, n, axis=0) - vx)
            gv = np.stack([np.bincount(back, pull[:, j], len(used)) for j in range(rank)], axis=1) + decay * v[used]
            seen0 += d.sum() ** 2
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            w0 -= rate * d.sum() / np.sqrt(seen0)
            w[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= rate * gv / np.sqrt(seen_v[used])
    return w0, w.astype(np.float32), v.astype(np.float32)


def fit(rows: DataFrame, counts: dict | None = None, per_class: int = PER_CLASS, rank: int = 4) -> tuple | None:
    """(slot -> variable or -1, sizes, bias, weights, factors) from at most about `per_class` whole documents of each label.

    `rows`: doc_id, text, y (0 or 1).  Label counts over all rows set the prior; given `counts`, `rows` is their sample.
    None when no label is there; with a single label the score is constant.
    """
    all_rows = counts is None
    count = {r[0]: r[1] for r in rows.groupBy("y").count().collect() if r[0] in (0, 1)} if all_rows else counts
    some = sample_by_class(rows, "y", per_class, "toxicity") if all_rows else rows
    got = some.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(_term_sets, "doc_id bigint, y int, slots array<int>").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y):
        return None
    table = np.full(1 << BITS, -1, np.int32)
    if y.min() == y.max():
        return table, np.zeros(1, np.float32), 6.0 if y[0] else -6.0, np.zeros(1, np.float32), np.zeros((1, rank), np.float32)
    lists = got["slots"].combine_chunks()
    slots, edge = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    del got, lists
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    of = np.repeat(y, np.diff(edge))
    df1, df0 = (np.bincount(slots[of == label], minlength=1 << BITS) for label in (1, 0))
    z = chance(df1, df0, n1, n0)
    chosen = np.flatnonzero(df1 + df0 >= 2)
    if not len(chosen):
        chosen = np.flatnonzero(df1 + df0)[:1]
    if not len(chosen):
        return table, np.zeros(1, np.float32), float(np.log(n1 / n0)), np.zeros(1, np.float32), np.zeros((1, rank), np.float32)
    table[chosen] = np.arange(len(chosen), dtype=np.int32)
    often = chosen[np.argsort(-(df1 + df0)[chosen], kind="stable")[:OFTEN]]
    pair = np.zeros(1 << BITS)
    pair[often] = together(slots, edge, y, z, often)
    size = scale(z[chosen], pair[chosen]).astype(np.float32)
    var = table[slots]
    edge = np.concatenate([[0], np.cumsum(var >= 0)])[edge]
    w0, w, v = train(var[var >= 0], edge, size, y, np.where(y > 0, count[1] / n1, count[0] / n0), rank)
    return table, size, w0, w, v


def chance(df1: np.ndarray, df0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """By how many standard deviations the shares of the two labels' documents that have something differ."""
    p1, p0, p = (df1 + 0.5) / (n1 + 1), (df0 + 0.5) / (n0 + 1), (df1 + df0 + 1.0) / (n1 + n0 + 2)
    return np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def together(slots: np.ndarray, edge: np.ndarray, y: np.ndarray, z: np.ndarray, often: np.ndarray) -> np.ndarray:
    """For each of the slots `often`, the most that its presence together with another of them tells beyond either alone."""
    place = np.full(len(z), -1, np.int32)
    place[often] = np.arange(len(often))
    pairs = []
    for label in (1, 0):
        x = np.zeros((int((y == label).sum()), len(often)), np.float32)
        for i, r in enumerate(np.flatnonzero(y == label)):
            k = place[slots[edge[r] : edge[r + 1]]]
            x[i, k[k >= 0]] = 1
        pairs.append(x.T @ x)
    both = chance(*pairs, float(y.sum()), float(len(y) - y.sum()))
    return np.where(both > np.maximum(z[often][:, None], z[often][None]) + 1, both, 0.0).max(1)


def scale(z: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """How much a variable counts: little while it differs between the labels no more than chance lets one of many do."""
    return np.clip((np.maximum(z, pair - 3) - 2) / 6, 0.02, 1.0)


def score(docs: DataFrame, model: tuple | None, threshold: float = 0.7) -> DataFrame:
    """All columns of `docs` but text, with score (probability of label 1) and predicted.

    Null and empty texts have no term and get the score of the bias.  Without a model: 0.5.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS variables: fixed size
    names = docs.columns
    keep = [c for c in names if c.lower() not in ("text", "score", "predicted")]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = names.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                table, size, w0, w, v = model
                for first, part in chunks(batch.column(at)):
                    slots, edge = term_sets(part)
                    var = table[slots]
                    edge = np.concatenate([[0], np.cumsum(var >= 0)])[edge]
                    out[first : first + len(part)] = sigmoid(margins(var[var >= 0], edge, w0, w, v, size))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of `documents` with the model of labelled rows not held out.  Null and empty texts get the bias's score; rows of
    equal doc_id are rows; a null doc_id counts as not held out and is never a labelled one; empty tables: 0.5 or no rows.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(*labelled(docs, labels, "toxic", 3, 1, PER_CLASS, "toxicity"))
    return score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), model)
