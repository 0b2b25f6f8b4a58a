"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

A first pass over the texts counts the items' words; which seeds are rare follows from these counts: counting the n-grams
themselves would make a passage that leaked thousands of times look frequent and go unseen.  A second pass finds every
occurrence of the rare seeds and cuts the window of words around it; only these windows, as word hashes, go on to alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, SpanHasher, buffers, chunks, documents, lower_latin, mix, runs

_WORD = LETTER.copy()
_WORD[48:58] = True
MATCH, MISMATCH, GAP = 2, -1, -1


def word_hashes(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters and digits) of some texts and the text each belongs to."""
    data, offs = buffers(part)
    starts, ends, rows = runs(_WORD[data], offs)
    return (SpanHasher(lower_latin(data))(starts, ends) if len(starts) else np.zeros(0, np.uint64)), rows


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


class Seeds:
    """Seeds of one block of items: sorted n-gram hashes, each with its (item, place) pairs; `words` are the items' words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int):
        self.items, self.n = items, n
        gram, item, place = [], [], []
        for k, (_, words) in enumerate(items):
            g = ngrams(words, n)
            gram.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
        order = np.lexsort((place, item, gram))
        self.gram, self.item, self.place = gram.astype(np.uint64)[order], item.astype(np.int64)[order], place.astype(np.int64)[order]
        self.words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)

    def keep(self, rare: np.ndarray) -> None:
        self.gram, self.item, self.place = self.gram[rare], self.item[rare], self.place[rare]


def _word_counts(shared):
    """Rows (word, n) of the known words of a task's texts, by their place in the sorted list; word -1: all words."""

    def run(batches):
        words = shared.value
        counts, total = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                h, _ = word_hashes(part)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                counts += np.bincount(at[words[at] == h], minlength=len(counts))
                total += len(h)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], total))], ["word", "n"])

    return run


def _windows(shared):
    """Rows (doc_id, item, start, words): the words around every occurrence of a seed, near ones of an item together."""

    def run(batches):
        s = shared.value
        size = np.array([len(w) for _, w in s.items])
        for batch in batches:
            who = batch.column(0)
            out = [[], [], [], []]
            for first, part in chunks(batch.column(1)):
                h, rows = word_hashes(part)
                if len(h) < s.n:
                    continue
                g = ngrams(h, s.n)
                spots = np.flatnonzero(rows[: len(g)] == rows[s.n - 1 : len(g) + s.n - 1])  # within one text
                lo = np.searchsorted(s.gram, g[spots], "left")
                n = np.searchsorted(s.gram, g[spots], "right") - lo
                if not n.sum():
                    continue
                spot = np.repeat(spots, n)
                seed = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                item, row = s.item[seed], rows[spot]
                order = np.lexsort((spot, item, row))
                spot, seed, item, row = spot[order], seed[order], item[order], row[order]
                new = np.ones(len(spot), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (spot[1:] - spot[:-1] > 2 * size[item[1:]])
                edges = [*np.flatnonzero(new).tolist(), len(spot)]
                begin = np.searchsorted(rows, np.arange(len(part)))
                end = np.searchsorted(rows, np.arange(len(part)), "right")
                for a, b in zip(edges, edges[1:]):
                    k, r, place = item[a], row[a], s.place[seed[a:b]]
                    slack = size[k] // 4 + 4
                    left = max(begin[r], int((spot[a:b] - place).min()) - slack)
                    right = min(end[r], int((spot[a:b] - place).max()) + int(size[k]) + slack)
                    out[0].append(who[first + int(r)].as_py())
                    out[1].append(int(k))
                    out[2].append(int(left - begin[r]))
                    out[3].append(h[left:right].view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], ["doc_id", "item", "start", "words"])

    return run


def align(item: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of one item against each row of padded windows, and the column where it ends."""
    r, m = windows.shape
    inside = np.arange(m) < lengths[:, None]
    drift = (-GAP * np.arange(1, m + 1)).astype(np.int32)
    row, best, where = np.zeros((r, m + 1), np.int32), np.zeros(r, np.int32), np.zeros(r, np.int64)
    for w in item:
        step = np.where((windows == w) & inside, MATCH, MISMATCH)
        now = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        now = np.maximum(np.maximum.accumulate(now + drift, axis=1) - drift, 0)  # gaps along the window
        row = np.concatenate([np.zeros((r, 1), np.int32), now.astype(np.int32)], axis=1)
        top = np.where(inside, now, 0)
        col = top.argmax(1)
        high = top[np.arange(r), col]
        better = high > best
        best[better], where[better] = high[better], col[better]
    return best, where


def needed(n: int, share: float, short: int, long: int) -> float:
    """Score from which an item of n words counts as copied: `share` of the full score, the score of `short` words at
    least, that of `long` words at most, and of items with fewer than `short` words every word."""
    return min(MATCH * n, max(share * MATCH * n, MATCH * short), MATCH * max(long, short))


def _align_all(shared, share: float, short: int, long: int):
    def run(batches):
        items = shared.value.items
        for batch in batches:
            got = []
            item = batch.column(1).to_numpy()
            for k in np.unique(item):
                groups: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(item == k):
                    groups.setdefault(batch.column(3)[int(i)].values.to_numpy().tobytes(), []).append(int(i))  # equal windows are aligned once
                keys = sorted(groups, key=len)
                words = items[k][1].view(np.int64)
                for a in range(0, len(keys), 256):
                    some = [np.frombuffer(x, np.int64) for x in keys[a : a + 256]]
                    size = np.array([len(x) for x in some])
                    pad = np.zeros((len(some), size.max()), np.int64)
                    for i, x in enumerate(some):
                        pad[i, : len(x)] = x
                    score, end = align(words, pad, size)
                    for key, sc, e in zip(keys[a : a + 256], score.tolist(), end.tolist(), strict=True):
                        if sc >= needed(len(words), share, short, long):
                            got += [(i, items[k][0], sc, sc / (MATCH * len(words)), e) for i in groups[key]]
            if got:
                i, who, sc, norm, e = zip(*got)
                take = pa.array(i)
                start = batch.column(2).to_numpy()[list(i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(who, pa.int64()), pa.array(sc, pa.int32()), pa.array(norm), pa.array(start + np.array(e), pa.int32())], ["doc_id", "item_id", "score", "share", "end_word"])

    return run


SCHEMA = "doc_id bigint, item_id bigint, score int, share double, end_word int"


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, share: float = 0.5, short: int = 8, long: int = 50, expected: float = 1.0, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score, share (of the item's full score) and end_word (where the alignment ends) of every copied item.

    docs: doc_id, text; items: item_id, text.  A copy reaches `share` of an item's score, or the score of `long` words.  A
    seed is rare if its words' corpus frequencies let one expect at most `expected` occurrences, or if it is among the rarer
    half of its item's seeds, so every item keeps seeds.  Items are taken in blocks of at most `block_bytes` of text, two
    passes over the documents each: what is sent to the tasks is bounded however many items there are.  Items of fewer than n
    words have no seed and are left out: common phrases, not passages.  Nulls, empty texts and empty tables: no rows.  Of
    several places in one document, or rows of equal doc_id, the best is returned; a null doc_id is no document.
    """
    spark = docs.sparkSession
    rows = items.filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = spark.createDataFrame([], SCHEMA)
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect() if total else []
        sets = [(r["item_id"], word_hashes(pa.array([r["text"]]))[0]) for r in got]
        sets = [x for x in sets if len(x[1]) >= n]
        if not sets:
            continue
        seeds = Seeds(sets, n)
        words = spark.sparkContext.broadcast(seeds.words)
        counts = texts.select("text").mapInArrow(_word_counts(words), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word of the block
        words.unpersist()
        freq, tokens = np.full(len(seeds.words), 0.5), 1.0
        for r in counts:
            if r["word"] < 0:
                tokens = max(1.0, float(r["n"]))
            else:
                freq[r["word"]] = r["n"]
        seeds.keep(_rare(seeds, np.log(freq / tokens), np.log(tokens), np.log(expected)))
        shared = spark.sparkContext.broadcast(seeds)
        windows = texts.mapInArrow(_windows(shared), "doc_id bigint, item int, start int, words array<bigint>")
        hits = windows.repartition(max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_align_all(shared, share, short, long), SCHEMA)
        out = out.unionByName(hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "share", "end_word")).alias("x")).select("doc_id", "item_id", "x.*"))
    return out


def _rare(seeds: Seeds, logp: np.ndarray, log_tokens: float, log_expected: float) -> np.ndarray:
    chance = np.empty(len(seeds.gram))
    word = {int(w): p for w, p in zip(seeds.words, logp, strict=True)}
    per_item = [np.convolve([word[int(w)] for w in words], np.ones(seeds.n), "valid") for _, words in seeds.items]
    for i, (k, p) in enumerate(zip(seeds.item, seeds.place, strict=True)):
        chance[i] = per_item[k][p]
    middle = np.array([np.median(x) for x in per_item])
    return (chance + log_tokens <= log_expected) | (chance <= middle[seeds.item])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated() of `documents` and `benchmark`; nulls, empties, repeats and empty tables as stated there."""
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
