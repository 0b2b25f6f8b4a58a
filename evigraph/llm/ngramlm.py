"""Language-model scores from an Elias-Fano n-gram trie.

Level one holds the words (64-bit hashes in order) with their counts, level two the pairs: its contexts, the monotone pointers
to each context's successors, the successors, and quantised smoothed log probabilities.  A pair is found by the context's
place in its list and a successor search relative to that context.  Both levels lie in files of the shared folder, cut into
shards by hash, memory-mapped by the workers, which share the pages.  Counts are taken over all training texts and nothing is
pruned.  All pairs of a context share a shard, but for the few words that make up a sizeable part of a shard by themselves:
their pairs are spread by the successor.

p(v | u) = (c(u,v) + k p1(v)) / (c(u) + k), with p1(v) = (c(v) + 1) / (N + V + 1): the mass k goes to the words that never
followed u.  An unknown u leaves p1(v).
"""

from __future__ import annotations

import io
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, SpanHasher, buffers, chunks, documents, mix, remainder, runs, shared_dir, stored
from .eliasfano import EliasFano, build

START, END = np.uint64(0x5BD1E995A5C9F3B1), np.uint64(0x27D4EB2F165667C5)
TOKENS = 1 << 20  # of a task's texts, counted or scored at once
LEAST, STEP = -12.0, 12.0 / 65535  # quantised log10 probabilities: two bytes


def sequence(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, tokens and rows: the words of each text in order, then one end; the first context is the start."""
    data, offs = buffers(part)
    starts, ends, rows = runs(~SPACE[data], offs)
    h = SpanHasher(LOWER[data])(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = len(part)
    last = np.searchsorted(rows, np.arange(n), "right")
    tokens = np.insert(h, last, END)
    rows = np.insert(rows, last, np.arange(n))
    before = np.empty_like(tokens)
    if n:
        before[0] = START
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], last[:-1] + np.arange(1, n)])] = START
    return before, tokens, rows


def _combined(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One 64-bit key of a pair, to find equal pairs of a batch."""
    with np.errstate(over="ignore"):
        return mix(u * np.uint64(0xA24BAED4963EE407) + v)


def _word_counts(batches):
    """(key, n) of the words of a task's texts, ends and starts included."""

    def flush(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    held, size = [], 0
    for batch in batches:
        for _, part in chunks(batch.column(0)):
            u, v, _ = sequence(part)
            held += [v, u[u == START]]
            size += len(v)
            if size >= TOKENS:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _pair_counts(bits: int, hot: np.ndarray):
    """(shard, u, v, n) of the pairs of a task's texts."""

    def flush(held):
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, n = np.unique(_combined(u, v), return_index=True, return_counts=True)
        u, v = u[first], v[first]
        return pa.RecordBatch.from_arrays([pa.array(shard_of(u, v, bits, hot).astype(np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["shard", "u", "v", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                u, v, _ = sequence(part)
                held.append((u, v))
                size += len(v)
                if size >= TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


# ------------------------------------------------------------ files


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, put in place in one step so that a task that runs twice does no harm."""
    head, body = io.BytesIO(), io.BytesIO()
    for key, a in arrays.items():
        pad = -body.tell() % 64
        body.write(b"\0" * pad)
        head.write(f"{key} {a.dtype.str} {len(a)} {body.tell()}\n".encode())
        body.write(a.tobytes())
    text = head.getvalue()
    raw = len(text).to_bytes(8, "little") + text
    raw += b"\0" * (-len(raw) % 64) + body.getvalue()
    if path := _local(folder):
        os.makedirs(path, exist_ok=True)
        temp = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(raw)
        os.replace(temp, f"{path}/{name}")
    else:
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(folder)
        with there.open_output_stream(f"{path}/{name}") as f:
            f.write(raw)


def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    if path := _local(folder):
        raw = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(folder)
        with there.open_input_file(f"{path}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = 8 + size + (-(8 + size) % 64)
    out = {}
    for line in raw[8 : 8 + size].tobytes().decode().splitlines():
        key, kind, n, at = line.split(" ")
        kind = np.dtype(kind)
        out[key] = np.asarray(raw[start + int(at) : start + int(at) + int(n) * kind.itemsize]).view(kind)
    return out


def _named(prefix: str, arrays: dict) -> dict:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def _taken(prefix: str, arrays: dict) -> EliasFano:
    return EliasFano({k.split(".", 1)[1]: v for k, v in arrays.items() if k.startswith(prefix + ".")})


# ------------------------------------------------------------ levels


class Words:
    """Level one."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.open = folder, bits, {}

    def shard(self, s: int):
        if s not in self.open:
            try:
                a = _read(self.folder, f"words-{s}")
                self.open[s] = (_taken("hash", a), a["count"])
            except FileNotFoundError:  # no word falls in it
                self.open[s] = None
        return self.open[s]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Counts (0: unknown) of words in ascending order of their hashes."""
        count = np.zeros(len(h), np.int64)
        cuts = np.searchsorted(h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if (opened := self.shard(s)) is None:
                continue
            ef, counts = opened
            rows = slice(cuts[s], cuts[s + 1])
            at = ef.index(h[rows] & np.uint64((1 << (64 - self.bits)) - 1))
            count[rows] = np.where(at >= 0, counts[np.maximum(at, 0)], 0)
        return count


def _code(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.round((logp - LEAST) / STEP), 0, 65535).astype(np.uint16)


NEXT = np.uint64(40)  # bits of a successor's hash that the trie keeps, within its context


class Pairs:
    """Level two."""

    def __init__(self, folder: str, bits: int, hot: np.ndarray):
        self.folder, self.bits, self.hot, self.open = folder, bits, hot, {}

    def shard(self, s: int):
        if s not in self.open:
            try:
                a = _read(self.folder, f"pairs-{s}")
                self.open[s] = (_taken("context", a), _taken("pointer", a), _taken("successor", a), a["code"])
            except FileNotFoundError:
                self.open[s] = None
        return self.open[s]

    def __call__(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log10 p(v | u) of known pairs, nan of others."""
        out = np.full(len(u), np.nan)
        shard = shard_of(u, v, self.bits, self.hot)
        order = np.lexsort((u, shard))
        cuts = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[s] : cuts[s + 1]]
            if (opened := self.shard(s)) is None:
                continue
            contexts, pointers, successors, code = opened
            mine = u[rows]
            start = np.concatenate([[True], mine[1:] != mine[:-1]])
            place = contexts.index(mine[start])  # each context once
            first, end = (pointers.select(np.maximum(place, 0) + k).astype(np.int64) for k in (0, 1))
            which = np.cumsum(start) - 1
            known = np.flatnonzero(place[which] >= 0)
            rows, which = rows[known], which[known]
            want = (place[which].astype(np.uint64) << NEXT) | (v[rows] >> (np.uint64(64) - NEXT))
            at = successors.successor(want)  # relative to the context: its successors lie from first to end
            inside = np.flatnonzero((at >= first[which]) & (at < end[which]))
            inside = inside[successors.select(at[inside]) == want[inside]]
            out[rows[inside]] = LEAST + STEP * code[at[inside]]
        return out


def shard_of(u: np.ndarray, v: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Shard of pairs: by the context, for the sorted `hot` contexts by the successor too."""
    at = np.minimum(np.searchsorted(hot, u), max(0, len(hot) - 1))
    wide = (hot[at] == u) if len(hot) else np.zeros(len(u), bool)
    return (mix(np.where(wide, _combined(u, v), u)) >> np.uint64(64 - bits)).astype(np.int64)


def _shards(rows: int) -> int:
    """Bits of the shard number: 64 shards at least, about a million rows each."""
    return max(6, (rows >> 20).bit_length())


def train(docs: DataFrame, prior: float = 2.0) -> dict:
    """Builds the trie over `docs` (text; null: empty) in the shared folder and returns what score() needs.

    Words go through one pre-aggregated shuffle, pairs through another, straight to the shard that a task then writes.  Rows
    of equal id are separate texts; an empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    words = stored(docs.select("text").mapInArrow(_word_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "words")
    start = int(START.view(np.int64))
    own = F.col("key") != start
    total = words.agg(F.sum(F.when(own, F.col("n"))).alias("n"), F.sum(own.cast("bigint")).alias("v"), F.count("*").alias("rows")).first()
    n, v = total["n"] or 0, total["v"] or 0
    wbits, pbits = _shards(total["rows"] or 0), _shards(n)
    floor = max(1, n >> (pbits + 3))  # an eighth of a shard: at most eight such words a shard
    hot = np.sort(np.array([r[0] for r in words.filter(F.col("n") > floor).select("key").collect()], np.int64).view(np.uint64))

    def write_words(t: pa.Table) -> pa.Table:
        key = t["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, c = key[order], t["n"].to_numpy()[order]
        name = int(t["shard"][0].as_py())
        _write(folder, f"words-{name}", _named("hash", build(key & np.uint64((1 << (64 - wbits)) - 1), 1 << (64 - wbits))) | {"count": c.astype(np.uint32) if c.max() < 1 << 32 else c})
        return pa.table({"rows": [len(key)]}, schema=pa.schema([("rows", pa.int64())]))

    words.select(F.shiftrightunsigned("key", 64 - wbits).cast("int").alias("shard"), "key", "n").groupBy("shard").applyInArrow(write_words, "rows bigint").agg(F.sum("rows")).collect()

    def write_shard(name: int, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        order = np.lexsort((w, u))
        u, w, c = u[order], w[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        u, w, c = u[first], w[first], np.add.reduceat(c, first)
        pointers = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]])).astype(np.uint64)
        context = u[pointers[:-1].astype(np.int64)]
        rank = np.repeat(np.arange(len(context)), np.diff(pointers.astype(np.int64)))
        level = Words(folder, wbits)
        cu = level(context)[rank]
        follow, back = np.unique(w, return_inverse=True)
        p = (c + prior * (level(follow)[back] + 1) / (n + v + 1)) / (cu + prior)
        keep = (rank.astype(np.uint64) << NEXT) | (w >> (np.uint64(64) - NEXT))
        arrays = _named("context", build(context, 1 << 64)) | _named("pointer", build(pointers, len(u) + 1)) | _named("successor", build(keep, max(1, len(context)) << int(NEXT))) | {"code": _code(np.log10(np.minimum(p, 1.0)))}
        _write(folder, f"pairs-{name}", arrays)

    def write_pairs(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            shard, u, w, c = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
            held.clear()
            order = np.argsort(shard, kind="stable")
            names, cuts = np.unique(shard[order], return_index=True)
            for name, rows in zip(names.tolist(), np.split(order, cuts[1:]), strict=True):
                write_shard(name, u[rows].view(np.uint64), w[rows].view(np.uint64), c[rows])
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], ["rows"])

    rows = docs.select("text").mapInArrow(_pair_counts(pbits, hot), "shard int, u bigint, v bigint, n bigint")
    rows.repartition(1 << pbits, "shard").mapInArrow(write_pairs, "rows bigint").agg(F.sum("rows")).collect()
    return {"folder": folder, "words": wbits, "pairs": pbits, "hot": hot, "n": n, "v": v, "prior": prior}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of `docs` but text, with n_tokens, n_known, base_score (add-one unigrams) and score (the trie).

    A null text counts as empty: one token, the end.  Without training tokens every word is unknown.
    """
    from pyspark.sql import types as T

    names = docs.columns
    keep = [c for c in names if c.lower() not in ("text", "n_tokens", "n_known", "base_score", "score")]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    at = names.index("text")

    def run(batches):
        words, pairs = Words(model["folder"], model["words"]), Pairs(model["folder"], model["pairs"], model["hot"])
        n, v, prior = model["n"], model["v"], model["prior"]

        def done(held, parts):
            u, w, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            total = sum(len(p) for p in parts)
            one, back = np.unique(np.concatenate([w, u[u == START][:1]]), return_inverse=True)
            count = words(one)
            base = np.log10((count + 1) / (n + v + 1))
            iw = back[: len(w)]
            _, first, pback = np.unique(_combined(u, w), return_index=True, return_inverse=True)
            iu = np.searchsorted(one, u[first])
            p = pairs(u[first], w[first])
            lift = np.log10(prior / (count[iu] + prior))  # the context's mass for words that never followed it
            p = np.where(np.isnan(p), lift + base[iw[first]], p)[pback]
            return [np.bincount(rows, minlength=total), np.bincount(rows, count[iw] > 0, minlength=total).astype(np.int64), np.bincount(rows, base[iw], minlength=total), np.bincount(rows, p, minlength=total)]

        for batch in batches:
            held, parts, out, size, offset = [], [], [], 0, 0

            for _, part in chunks(batch.column(at)):
                u, w, rows = sequence(part)
                held.append((u, w, rows + offset))
                parts.append(part)
                offset += len(part)
                size += len(w)
                if size >= TOKENS:
                    out.append(done(held, parts))
                    held, parts, size, offset = [], [], 0, 0
            if held:
                out.append(done(held, parts))
            if out:
                got = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(got[0].astype(np.int64)), pa.array(got[1]), pa.array(got[2]), pa.array(got[3])], [*keep, "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, schema)


def op7_ngramlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of `documents` with the trie of those not held out; nulls, empties, repeats and empty tables as stated there."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs.filter(remainder(F.col("doc_id"), 7) != 2))
    rows = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("bigint").alias("train_tokens"), "base_score", "score")
