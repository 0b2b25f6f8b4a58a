"""I-Match fingerprints: of a text's terms those within an inverse-document-frequency band, distinct and sorted, hashed
once for each of several randomised lexicon subsets.

The subsets are the same for every text: DRAWS random orders of the lexicon, of which each keeps a half, a quarter and so on
down to 2**-LEVELS, and the whole lexicon.  A large subset tells equal texts, a small one holds few terms of a text and so
survives an edit elsewhere.  Document frequencies are counted by 64-bit term hashes; what is sent to the tasks is a bitmap of
the band, of bounded size, through which a stated share of other terms passes (see lexicon()).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, LOWER, SpanHasher, buffers, chunks, documents, mix, runs, stored

DRAWS, LEVELS = 8, 11
COLUMNS = 1 + DRAWS * LEVELS
COUNTED = 1 << 20  # terms of a task's texts, counted at once
_TERM = LETTER.copy()
_TERM[48:58] = True
LEAST = -(1 << 62)  # stands for a null doc_id
_SEEDS = mix(np.arange(1, DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def terms(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes of some texts, sorted within each text, with the offsets of each text."""
    data, offs = buffers(part)
    starts, ends, rows = runs(_TERM[data], offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
    h = SpanHasher(LOWER[data])(starts, ends)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, rows, np.searchsorted(rows, np.arange(len(part) + 1))


def _frequencies(batches):
    """(term, n): in how many texts of a task each term occurs."""

    def flush(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    held, size = [], 0
    for batch in batches:
        for _, part in chunks(batch.column(0)):
            held.append(terms(part)[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def lexicon(docs: DataFrame, low: int = 2, high: float = 0.05, most_bits: int = 26) -> np.ndarray:
    """Bitmap of the terms whose document frequency, over all rows, is `low` at least and at most `high` of the rows.

    Terms are counted in each task and summed in one shuffle.  The bitmap has eight bits a term of the band, 2**most_bits
    (8 MB) at most, so of terms outside the band a share of terms / bits passes: an eighth, and more above 8 million terms of
    the band.  It reaches the driver in blocks of 4 KB.
    """
    counts = docs.select("text").mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    band = stored(counts.filter((F.col("n") >= low) & (F.col("n") <= max(low, docs.count() * high))).select("term"), "band")
    bits = int(np.clip(int(band.count() * 8).bit_length(), 16, most_bits))

    def block(t: pa.Table) -> pa.Table:
        slot = t["slot"].to_numpy()
        raw = np.zeros(1 << 12, np.uint8)
        np.bitwise_or.at(raw, (slot >> 3) & 0xFFF, (1 << (slot & 7)).astype(np.uint8))
        return pa.table({"block": [int(slot[0] >> 15)], "raw": [raw.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("raw", pa.binary())]))

    slots = band.select(F.shiftrightunsigned("term", 64 - bits).alias("slot")).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in slots.groupBy(F.shiftright("slot", 15)).applyInArrow(lambda t: block(t), "block int, raw binary").collect():
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["raw"], np.uint8)
    return out


def _in_band(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - (len(bitmap) * 8 - 1).bit_length())).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _sequences(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have terms, and the hash (1 to 65535) of each one's sorted sequence."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    place = (np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first)
    return rows[first], np.maximum(mix(total) >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def fingerprints(part: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """(rows, COLUMNS) hashes.  A text without a term of the band uses all its terms; one without terms, zeros.

    0 marks a subset that holds none of the text's terms.
    """
    h, rows, _ = terms(part)
    out = np.zeros((len(part), COLUMNS), np.uint16)
    if not len(h):
        return out
    band = _in_band(h, bitmap)
    some = np.bincount(rows[band], minlength=len(part))
    use = band | (some[rows] == 0)
    h, rows = h[use], rows[use]
    r, x = _sequences(h, rows)
    out[r, 0] = x
    for k in range(DRAWS):
        m = mix(h ^ _SEEDS[k])
        own, who = m, rows
        for level in range(1, LEVELS + 1):
            inside = np.flatnonzero(own & np.uint64(1 << (level - 1)) == 0)  # half of the subset before
            if not len(inside):
                break
            own, who = own[inside], who[inside]
            r, x = _sequences(own, who)
            out[r, 1 + k * LEVELS + level - 1] = x
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets that hold a term of either text; 1 if neither text has any term.

    Levels all of whose subsets hold one are left out, as any edit changes them, unless every level is such: then
    the smallest subsets are compared.  Equal fingerprints are alike by 1.
    """
    either, same = (a != 0) | (b != 0), (a == b) & (a != 0)
    n, equal = (x[:, 1:].reshape(-1, DRAWS, LEVELS).sum(1) for x in (either, same))
    tells = (n < DRAWS).copy()
    tells[~tells.any(1), -1] = True
    n, equal = (n * tells).sum(1), (equal * tells).sum(1)
    return np.where((a == b).all(1), 1.0, np.where(n == 0, 0.0, equal / np.maximum(n, 1)))


def as_text(fp: np.ndarray) -> list[str]:
    raw = fp.astype(">u2").tobytes().hex()
    step = 4 * fp.shape[1]
    return [raw[i : i + step] for i in range(0, len(raw), step)]


def fingerprint(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """All columns of `docs` but text, with `fingerprint`.  A null text counts as empty."""
    from pyspark.sql import types as T

    shared, names = docs.sparkSession.sparkContext.broadcast(bitmap), docs.columns
    keep = [c for c in names if c.lower() not in ("text", "fingerprint")]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("fingerprint", T.StringType())])
    at = names.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for _, part in chunks(batch.column(at)):
                out += as_text(fingerprints(part, shared.value))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(out, pa.string())], [*keep, "fingerprint"])

    return docs.mapInArrow(run, schema)


def neighbours(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, doc_id, packed, edge): within a bucket, sorted by doc_id descending, each row is followed by the next.  packed: the
    text's UTF-8, compressed for the shuffle.

    Buckets are ranges of doc_id between approximate quantiles; the first row of a bucket is also given to the bucket before
    (edge = 1, last there), the first row of all to the last.  One shuffle of the texts; rows of equal doc_id are
    ordered by the hash of their text.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = buckets or 8 * n
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    cuts = sorted(set(known.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)), reverse=True)
    bounds = np.array(cuts, np.float64)

    def place(d: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = d.fill_null(LEAST).to_numpy()
        return (len(bounds) - np.searchsorted(bounds[::-1], x.astype(np.float64), "left")).astype(np.int32), x  # 0: the largest ids

    def tops(batches):
        for batch in batches:
            b, x = place(batch.column(0))
            which = np.unique(b)
            top = np.full(int(which.max(initial=0)) + 1, LEAST)
            np.maximum.at(top, b, x)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(top[which])], ["bucket", "head"])

    heads = known.mapInArrow(tops, "bucket int, head bigint").groupBy("bucket").agg(F.max("head").alias("head")).orderBy("bucket").collect()
    # a head goes to the bucket before its own that is not empty, the first to the last
    before = {heads[i]["bucket"]: heads[i - 1]["bucket"] for i in range(len(heads))}
    head_of = {r["bucket"]: r["head"] for r in heads}
    size = max(before, default=0) + 1
    prev = np.array([before.get(i, 0) for i in range(size)], np.int32)
    head_ids = np.array([head_of.get(i, LEAST) for i in range(size)], np.int64)

    def spread(batches):
        for batch in batches:
            b, x = place(batch.column(0))
            take = np.flatnonzero(x == head_ids[b])
            edge = np.concatenate([np.zeros(len(b), np.int8), np.ones(len(take), np.int8)])
            bucket = np.concatenate([b, prev[b[take]]]).astype(np.int32)
            pack = zstandard.ZstdCompressor(level=3).compress
            packed = pa.array([pack((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())
            who, packed, tie = (pa.concat_arrays([c, c.take(pa.array(take))]) if len(take) else c for c in (batch.column(0), packed, batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), who, packed, pa.array(edge), tie], ["bucket", "doc_id", "packed", "edge", "tie"])

    out = ids.mapInArrow(spread, "bucket int, doc_id bigint, packed binary, edge byte, tie bigint")
    return out.repartition(n, "bucket").sortWithinPartitions("bucket", "edge", F.desc_nulls_last("doc_id"), "tie").drop("tie")


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of another text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of `documents` and of its edited text.

    Null texts count as empty; a null doc_id comes last, rows of equal doc_id follow each other by the hash of their text; a
    table of one row follows itself; an empty table gives an empty result.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    shared = spark.sparkContext.broadcast(lexicon(docs))

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        unpack = zstandard.ZstdDecompressor().decompress
        held = None  # the last row of the batch before: (bucket, doc_id, text, fingerprint)

        def rows():
            nonlocal held
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    bucket, edge = part.column(0).to_pylist(), part.column(3).to_pylist()
                    ids, texts = part.column(1).to_pylist(), [unpack(z.as_py()).decode() for z in part.column(2)]
                    fps = fingerprints(pa.array(texts, pa.string()), shared.value)
                    if held:
                        bucket, edge, ids, texts, fps = [held[0], *bucket], [held[4], *edge], [held[1], *ids], [held[2], *texts], np.vstack([held[3][None], fps])
                    pick = [i for i in range(len(ids) - 1) if not edge[i] and bucket[i] == bucket[i + 1]]
                    held = (bucket[-1], ids[-1], texts[-1], fps[-1], edge[-1])
                    if not pick:
                        continue
                    edited = [edit(texts[i], texts[i + 1]) for i in pick]
                    after = fingerprints(pa.array(edited, pa.string()), shared.value)
                    own, following = fps[pick], fps[[i + 1 for i in pick]]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in pick], pa.int64()), pa.array([len(texts[i]) for i in pick], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(own)), pa.array(as_text(after)), pa.array(likeness(own, after)), pa.array(likeness(own, following))], names)

        yield from rows()

    return neighbours(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
