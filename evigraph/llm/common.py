"""Shared parts: shared-folder checkpoints, hold-out split, Arrow text buffers, hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # of text handled at once by the numpy kernels


# ---------------------------------------------------------------- Spark side


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset (single machine, tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evigraph-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as Parquet: columns that are not read later are not read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(spark: SparkSession, rows: int = 512) -> str:
    """From now on whole texts travel to Python in Arrow batches of at most `rows` rows: a task's buffers, here and there, are
    several times a batch.  Returns the setting before."""
    was = spark.conf.get(ARROW_ROWS)
    if int(was) <= 0 or int(was) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    return was


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """The same for what is executed within."""
    was = few_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, was)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sample_by_class(df: DataFrame, key: str, per_class: int, salt: str, counts: dict | None = None) -> DataFrame:
    """About per_class rows of each value of `key`, chosen by a hash of doc_id; all rows of smaller classes.

    One counting aggregate and one threshold test, so a class that holds most rows is neither sorted nor gathered.
    """
    counts = counts or {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    unit = (F.xxhash64(F.lit(salt), F.col("doc_id")).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    keep = F.lit(False)
    for value, n in counts.items():
        if value is not None:
            keep = keep | ((F.col(key) == F.lit(value)) & (unit < F.lit(min(1.0, per_class / n) if n > per_class else 2.0)))
    return df.filter(keep)


# ---------------------------------------------------------------- Arrow and numpy side


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array, without copying; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(arr) + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES, rows: int = 256):
    """Slices of a string array: at most `rows` rows and about `limit` bytes, one row at least.  Yields (first row, slice)."""
    _, offs = buffers(arr)
    i, n = 0, len(arr)
    while i < n:
        j = min(n, i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, arr.slice(i, j - i)
        i = j


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, _INV)):
                p = np.full(max(n, 2 * len(_POW[k])), base, np.uint64)
                p[0] = 1
                _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class SpanHasher:
    """Hashes of any byte spans of one buffer: a polynomial over Z/2^64 from prefix sums, then a finaliser."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of True; a row's edge ends a run."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:]
    ends = np.flatnonzero(inside & (~after | last)) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the letters of Latin-1 (two bytes in UTF-8); other letters stay."""
    out = LOWER[data]
    if len(out) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    return out


# ---------------------------------------------------------------- connected components


def _united(batches):
    """(node, component) of all edges of one task, by union and find; the smaller root stays."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    for i in range(len(up)):  # a root stands before its members
        up[i] = up[up[i]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(up)])], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = 1 << 17) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: bigint); component is the smallest node that can be reached.

    At most `few` edges, counted, are united by one task.  More go through alternating large-star and small-star rounds, each
    written to the shared folder; rounds grow with the logarithm of the longest chain.  The minimum of a node's
    neighbours is a pre-aggregated sum; neighbours meet it in a join that adaptive execution may split, so a hub is no single
    task's work.  Self-links and nulls are ignored.
    """
    e = cut(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = sign(e)
    if was[0] <= few:
        return e.coalesce(1).mapInArrow(_united, "node bigint, component bigint")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b").filter("a <> b")
        e = cut(small.distinct())
        now = sign(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components: no fixed point")
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(roots)
