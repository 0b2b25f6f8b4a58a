"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss
model fitted by dual coordinate descent.

The n-grams of a whole text are those of its characters by kind (lower, upper, digit, anything else as it is), whether words
repeat the one before, and, in slots of their own, its lower-cased words, pairs of words and groups of four characters.
Indicators are hashed to slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, SpanHasher, buffers, chunks, documents, mix, remainder, runs, sample_by_class
from .linear import Sparse, hinge_dual, platt, sigmoid

BITS = 13  # of the slots of kinds
WORD_BITS = 15  # of those of words and characters
WIDTH = (1 << BITS) + (1 << WORD_BITS)
PER_CLASS = 1500
ORDERS = (2, 3, 4)
KIND = np.arange(256, dtype=np.uint8)
KIND[97:123] = 97
KIND[65:91] = 65
KIND[48:58] = 48
KIND[128:] = 97
_ODD = (0, 0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def indicators(part: pa.Array) -> np.ndarray:
    """(rows, WIDTH) 0/1: which n-grams occur in each text."""
    data, offs = buffers(part)
    flags = np.zeros((len(part), WIDTH), np.uint8)
    if not len(data):
        return flags
    flat = flags.reshape(-1)
    base = np.repeat(np.arange(len(part), dtype=np.int64) * WIDTH, np.diff(offs))
    low = LOWER[data]

    def characters(stream: np.ndarray, n: int, bits: int, at: int) -> None:
        code = stream.astype(np.uint32)
        for k in range(1, n):
            code[:-k] |= stream[k:].astype(np.uint32) << np.uint32(8 * k)
        with np.errstate(over="ignore"):
            s = (code * np.uint32(_ODD[n])) >> np.uint32(32 - bits)
        inside = np.ones(len(data), bool)
        for k in range(1, n):
            edge = offs[1:] - k
            inside[edge[edge >= offs[:-1]]] = False
        flat[(base + at + s)[inside]] = 1

    for n in ORDERS:
        characters(KIND[data], n, BITS, 0)
    characters(low, 4, WORD_BITS, 1 << BITS)
    starts, ends, rows = runs(~SPACE[data], offs)
    if len(starts):
        h = SpanHasher(low)(starts, ends)
        at = rows * WIDTH + (1 << BITS)
        flat[at + (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)] = 1
        near = np.zeros(len(h), bool)
        near[1:] = rows[1:] == rows[:-1]
        with np.errstate(over="ignore"):
            two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        flat[(at[1:] + (two >> np.uint64(64 - WORD_BITS)).astype(np.int64))[near[1:]]] = 1
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & near[1:]
        run = same.astype(np.int64)
        for length in (1, 2, 3, 4):  # that many repeats in a row
            k = np.flatnonzero(run)
            flat[rows[k] * WIDTH + (length * 2654435761 % (1 << BITS))] = 1
            run = run & np.concatenate([[0], run[:-1]])
    return flags


def _packed(batches):
    for batch in batches:
        out = []
        for _, part in chunks(batch.column(1), rows=64):
            out += [x.tobytes() for x in np.packbits(indicators(part), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "bits"])


def fit(rows: DataFrame, counts: dict | None = None, per_class: int = PER_CLASS, smooth: float = 1.0) -> tuple | None:
    """(weights, offset) from at most about `per_class` whole documents of each label of `rows` (doc_id, text, y: 0 or 1).

    The bound keeps the driver's share fixed (WIDTH bits a document).  Label counts over all rows set the prior; given
    `counts`, `rows` is their sample.  With only one label, the score is constant; without any, None.
    """
    all_rows = counts is None
    count = {r[0]: r[1] for r in rows.groupBy("y").count().collect() if r[0] in (0, 1)} if all_rows else counts
    some = sample_by_class(rows, "y", per_class, "quality") if all_rows else rows
    got = some.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(_packed, "doc_id bigint, y int, bits binary").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y):
        return None
    if y.min() == y.max():
        return np.zeros(WIDTH, np.float32), 6.0 if y[0] else -6.0
    idx = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).astype(np.int32) for b in got["bits"].to_pylist()]
    del got
    edge = np.concatenate([[0], np.cumsum([len(i) for i in idx])])
    idx = np.concatenate(idx)
    of = np.repeat(y, np.diff(edge))
    p, q = (smooth + np.bincount(idx[of == label], minlength=WIDTH) for label in (1, 0))
    ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    x = Sparse(idx, ratio[idx], edge, WIDTH)
    n1 = y.sum()
    w = hinge_dual(x, 2 * y - 1, np.where(y > 0, len(y) / 2 / n1, len(y) / 2 / (len(y) - n1)) * 0.01, epochs=20)
    prior = np.where(y > 0, count[1] / n1, count[0] / (len(y) - n1))
    a, b = platt(x @ w, y, prior / prior.mean())
    return (a * w * ratio).astype(np.float32), b


def score(docs: DataFrame, model: tuple | None, threshold: float = 0.7) -> DataFrame:
    """All columns of `docs` but text, with score (probability of label 1) and predicted.

    Null and empty texts have no indicator and get the score that the fitted offset gives.  Without a model: 0.5.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH floats
    names = docs.columns
    keep = [c for c in names if c.lower() not in ("text", "score", "predicted")]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = names.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for first, part in chunks(batch.column(at), rows=64):
                    out[first : first + len(part)] = sigmoid(indicators(part).astype(np.float32) @ model[0] + model[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int, salt: str) -> tuple[DataFrame, dict]:
    """Rows to learn from (doc_id, text, y: about `per_class` documents of each label) and the label counts of all of them.

    Equal ids in `labels` are one row (the largest label).  The sample is drawn from ids alone and, bounded by `per_class`,
    is broadcast: no text is shuffled.
    """
    y = labels.filter(remainder(F.col("doc_id"), mod) != held).filter(f"{label} in (0, 1)").groupBy("doc_id").agg(F.max(label).alias("y"))
    known = y.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    return docs.select("doc_id", "text").join(F.broadcast(sample_by_class(known, "y", per_class, salt, counts)), "doc_id"), counts


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of `documents` with the model of labelled rows not held out.  Null and empty texts get the offset's score; rows
    of equal doc_id are rows; a null doc_id counts as not held out and is never a labelled one; empty tables: 0.5 or no rows.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(*labelled(docs, labels, "quality", 4, 2, PER_CLASS, "quality"))
    return score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model)
