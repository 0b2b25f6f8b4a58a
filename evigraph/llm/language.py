"""Language identification in two steps: the family, then one-versus-one linear SVMs between its languages.

Features are relative frequencies of byte n-grams of the lower-cased text, hashed to slots; a document's score under each
machine is the mean weight over all its n-grams, so whole texts of any length take one pass and little memory.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, buffers, chunks, documents, lower_latin, remainder, sample_by_class
from .linear import Sparse, hinge_dual, sigmoid

#: Language families; a language that is not listed is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic"}

BITS = 14
ORDERS = (1, 2, 3)
_MULT = {1: 0x9E3779B1, 2: 0x85EBCA77, 3: 0xC2B2AE3D, 4: 0x27D4EB2F}


def slots(data: np.ndarray, offs: np.ndarray, bits: int = BITS, orders=ORDERS):
    """Slot of each n-gram start, for each order; 2**bits where the n-gram would leave its row."""
    clean = np.where(LETTER[data], lower_latin(data), np.uint8(32)).astype(np.uint32)
    for n in orders:
        code = clean.copy()
        for k in range(1, n):
            code[:-k] |= clean[k:] << np.uint32(8 * k)
        with np.errstate(over="ignore"):
            s = ((code + np.uint32(n)) * np.uint32(_MULT[n]) >> np.uint32(32 - bits)).astype(np.int32)
        for k in range(1, n):
            edge = offs[1:] - k
            s[edge[edge >= offs[:-1]]] = 1 << bits
        yield s


def _profiles(batches):
    for batch in batches:
        texts, idx, val = batch.column(1), [], []
        for _, part in chunks(texts):
            data, offs = buffers(part)
            every = list(slots(data, offs))
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                counts = sum(np.bincount(s[a:b], minlength=(1 << BITS) + 1) for s in every)[: 1 << BITS]
                at = np.flatnonzero(counts)
                idx.append(at.astype(np.int32))
                val.append((counts[at] / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["doc_id", "lang", "idx", "val"])


class Model:
    """Weights (slots + 1, machines + 1); machine names are ("family", f) or ("pair", a, b).  The last column is how usual an
    n-gram is in the learnt languages together; documents of these reach `floor` on average (see fit())."""

    def __init__(self, langs, family, machines, weights, scale, floor=0.0):
        self.langs, self.family, self.machines, self.weights, self.scale, self.floor = langs, family, machines, weights, scale, floor

    def predict(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a confidence for each row of machine margins."""
        n = len(margin)
        names = sorted(set(self.family.values()))
        strength = np.zeros((n, len(names)))
        for k, m in enumerate(self.machines):
            if m[0] == "family":
                strength[:, names.index(m[1])] = margin[:, k]
        if len(names) == 2:  # one machine tells two families apart
            strength[:, 1] = -strength[:, 0]
        group = strength.argmax(1)
        best, sure = np.zeros(n, np.int64), np.ones(n)
        rows = np.arange(n)
        if len(names) > 1:
            sure = sigmoid(self.scale * strength[rows, group])
        for g, name in enumerate(names):
            members = [i for i, x in enumerate(self.langs) if self.family[x] == name]
            votes, total, low = (np.zeros((n, len(members))) for _ in range(3))
            low += 1.0
            for k, m in enumerate(self.machines):
                if m[0] == "pair" and self.family[m[1]] == name:
                    a, b = members.index(self.langs.index(m[1])), members.index(self.langs.index(m[2]))
                    d = margin[:, k]
                    votes[:, a] += d > 0
                    votes[:, b] += d <= 0
                    total[:, a] += d
                    total[:, b] -= d
                    low[:, a] = np.minimum(low[:, a], sigmoid(self.scale * d))
                    low[:, b] = np.minimum(low[:, b], sigmoid(-self.scale * d))
            pick = (votes + 1e-6 * np.tanh(total)).argmax(1)
            mine = group == g
            best[mine] = np.array(members)[pick[mine]]
            sure[mine] = np.minimum(sure[mine], low[rows, pick][mine])
        return best, sure


def fit(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Fits on at most about `per_language` whole documents of each language of `docs` (doc_id, text, lang).

    The bound keeps the driver's share fixed: `per_language` times the number of languages, as sparse profiles.  Null texts
    and languages are left out; rows of equal doc_id are rows.  None without any label, so for an empty table.
    Model.floor is half of the least usualness that a document of the sample has.
    """
    some = sample_by_class(docs.filter("lang is not null and text is not null"), "lang", per_language, "language")
    got = some.select("doc_id", "text", "lang").mapInArrow(_profiles, "doc_id bigint, lang string, idx array<int>, val array<float>").toArrow().sort_by("doc_id")
    labels = np.array(got["lang"].to_pylist(), object)
    langs = sorted(set(labels))
    if not langs:
        return None
    width, idx = 1 << BITS, got["idx"].combine_chunks()
    x = Sparse(idx.flatten().to_numpy(), got["val"].combine_chunks().flatten().to_numpy(zero_copy_only=False).copy(), np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy())]), width)
    del got, idx
    mean = np.bincount(x.idx, x.val, minlength=width) / len(labels)
    usual, spread = np.sqrt(mean).astype(np.float32), (1.0 / np.sqrt(mean + 1e-6)).astype(np.float32)
    row = np.repeat(np.arange(len(labels)), np.diff(x.edge))
    known = np.bincount(row, x.val * usual[x.idx], minlength=len(labels))
    x.val *= spread[x.idx]
    size = np.maximum(np.sqrt(np.bincount(row, x.val * x.val, minlength=len(labels))), 1e-9)
    x.val /= size[row].astype(np.float32)
    del row
    family = {lang: FAMILIES.get(lang, lang) for lang in langs}
    kin = np.array([family[lang] for lang in labels], object)
    names = sorted(set(kin))
    machines, columns, gaps = [], [], []

    def machine(name, rows, y):
        count = np.array([(y < 0).sum(), (y > 0).sum()])
        w = hinge_dual(x, y, np.where(y > 0, len(y) / 2 / count[1], len(y) / 2 / count[0]), epochs=15, rows=rows)
        machines.append(name)
        columns.append(w)
        gaps.append(np.abs(x @ w)[rows] * size[rows])

    for f in names[:1] if len(names) == 2 else names if len(names) > 2 else []:
        machine(("family", f), np.arange(len(kin)), np.where(kin == f, 1.0, -1.0))
    for f in names:
        for a, b in combinations([lang for lang in langs if family[lang] == f], 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            machine(("pair", a, b), rows, np.where(labels[rows] == a, 1.0, -1.0))
    weights = np.zeros((width + 1, len(machines) + 1), np.float32)
    weights[:-1, -1] = usual
    for k, w in enumerate(columns):
        weights[:-1, k] = w * spread
    typical = np.median(np.concatenate(gaps)) if gaps else 1.0
    scale = 3.0 / max(float(typical), 1e-9)  # a typical margin scores 0.95
    return Model(langs, family, machines, weights, scale, float(known[known > 0].min(initial=np.inf)) / 2 if (known > 0).any() else 0.0)


def _judge(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language ("und" for nulls and texts without a letter), confidence and usualness of each text."""
    ascii_letter = LETTER.copy()
    ascii_letter[128:] = False
    lang, score, usual = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
    for first, part in chunks(texts):
        data, offs = buffers(part)
        n = len(part)
        if model is None or not len(data):
            continue
        sums = np.concatenate([[0], np.cumsum(ascii_letter[data])])
        has = sums[offs[1:]] > sums[offs[:-1]]
        for i in np.flatnonzero(~has & (offs[1:] > offs[:-1])):
            has[i] = any(map(str.isalpha, part[int(i)].as_py() or ""))
        margin, total = np.zeros((n, model.weights.shape[1])), np.zeros(n)
        full = np.flatnonzero(offs[1:] > offs[:-1])
        for order, s in zip(ORDERS, slots(data, offs), strict=True):
            margin[full] += np.add.reduceat(model.weights[s], offs[full], axis=0)
            total += np.maximum(0, np.diff(offs) - order + 1)
        margin /= np.maximum(total, 1)[:, None]
        best, sure = model.predict(margin[:, :-1])
        usual[first : first + n] = margin[:, -1]
        names = np.array(model.langs, object)[best]
        lang[first : first + n][has] = names[has]
        score[first : first + n][has] = sure[has]
    return lang, score, usual


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` but text, with lang_pred and score (columns of these names are replaced).

    Null texts and texts without a letter: "und", score 0.  Without a model every text is "und".
    """
    from pyspark.sql import types as T

    names = docs.columns
    keep = [c for c in names if c.lower() not in ("text", "lang_pred", "score")]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # slots x machines floats: fixed size
    at = names.index("text")

    def run(batches):
        model = shared.value and Model(**shared.value)
        for batch in batches:
            lang, score, _ = _judge(batch.column(at), model)
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model | None, languages: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of `docs`, unchanged, whose predicted language is one of `languages` (by default every learnt one) with a
    confidence of `least`.

    Nulls and texts without a letter are "und" and go; so do texts whose n-grams are strange to every learnt language
    (below the model's floor), such as another script.  Texts that mix learnt languages stay.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model and vars(model)), docs.columns.index("text")

    def run(batches):
        model = shared.value and Model(**shared.value)
        for batch in batches:
            lang, score, usual = _judge(batch.column(at), model)
            wanted = languages if languages is not None else model.langs if model else []
            keep = np.isin(lang.astype(str), list(wanted)) & (lang != "und") & (score >= least)
            yield batch.filter(pa.array(keep & (usual >= (model.floor if model else 0.0))))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() of `documents` with the model of those not held out; nulls, empties and repeats as stated there."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    model = fit(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return classify(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text"), model)
