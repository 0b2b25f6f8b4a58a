"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most d bits agree in at least 8-d byte positions.  An inverted list per
(position, byte) would hold a fixed share of the corpus and its pairs would grow with its square, so a posting holds the
bytes of three or four positions at once.  Each list a pair meets in reports its positions; their union, tallied per pair
over the index, is the number of shared positional bytes, since any 8-d positions are the union of the family's sets within
them (`family`).  Pairs with fewer than 8-d shared bytes go, and the rest are verified bit by bit.

Lists are built over distinct fingerprints; exact copies never meet.  The members of a list longer than `hot_list` are not
paired there but listed anew by all 8-d positions; a list that is still long is keyed with each choice of d of its remaining
bits blanked out, and every member of such a key is linked with the key's smallest member.  Members of a key differ in
at most d bits, and any two fingerprints within d bits share a key, so no link between components is lost and none is false.

deduplicate() looks for near copies by Jaccard similarity of five-word shingles.  It takes the same steps with fingerprints of
these shingles, and verifies by that similarity; for the pairs that three bits cannot tell, the index is then made of the
positional bytes of MinHash sketches too; see there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, SpanHasher, buffers, chunks, components, cut, documents, mix, runs, small_batches, stored


def fingerprint(text: str | bytes | None, width: int = 3) -> int:
    """SimHash of one text, as an unsigned number.  Null and blank texts: 0."""
    raw = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower()
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            out = np.empty(len(texts), np.uint64)
            for first, part in chunks(texts):
                data, offs = buffers(part)
                raw = data.tobytes()
                for i in range(len(part)):
                    out[first + i] = fingerprint(raw[offs[i] : offs[i + 1]], width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed bigint) of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_fingerprints(width), "doc_id bigint, text_hash bigint, fp bigint")


def family(distance: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any 8-distance positions are the union of the sets within them (greedy)."""
    need = 8 - distance
    size = min(size, need)
    every = list(combinations(range(8), size))
    open_ = {(whole, p) for whole in combinations(range(8), need) for p in whole}
    found = []
    while open_:
        best = max(every, key=lambda c: sum(p in c and set(c) <= set(whole) for whole, p in open_))
        found.append(best)
        open_ = {(whole, p) for whole, p in open_ if not (p in best and set(best) <= set(whole))}
    return sorted(found)


def _mask(positions) -> int:
    m = sum(255 << (56 - 8 * i) for i in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(fp, k, bytes, n): the bytes at the k-th positions, and the length of that list; lists of one are left out."""
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(s))) for s in sets])).alias("k", "bytes"))
    sizes = keyed.groupBy("k", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(keyed.join(sizes, ["k", "bytes"]))


def _tallied(short: DataFrame, sets: list[tuple[int, ...]], distance: int) -> DataFrame:
    """(a, b) of lists whose shared positional bytes, tallied over the lists, reach 8-distance, verified bit by bit."""
    left, right = short.select("k", "bytes", F.col("fp").alias("a")), short.select("k", "bytes", F.col("fp").alias("b"))
    places = F.element_at(F.array(*[F.lit(sum(1 << i for i in s)) for s in sets]), F.col("k") + 1)
    met = left.join(right, ["k", "bytes"]).filter("a < b").groupBy("a", "b").agg(F.bit_or(places).alias("places"))
    return met.filter(F.bit_count("places") >= 8 - distance).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")


def links(fps: DataFrame, distance: int = 3, size: int | None = None, hot_list: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` within `distance` bits.

    Every such pair is a link or lies in one connected component of links.  `size`: positions per posting, by default 3 up
    to 16 million fingerprints and 4 beyond, so that lists of unrelated fingerprints stay short.
    """
    if size is None:
        size = 3 if fps.count() <= 1 << 24 else 4
    sets = family(distance, size)
    listed = _postings(fps, sets)
    near = _tallied(listed.filter(F.col("n") <= hot_list), sets, distance)
    long = listed.filter(F.col("n") > hot_list)
    if long.isEmpty():
        return near
    whole = list(combinations(range(8), 8 - distance))  # a pair that meets in long lists only shares one of these
    again = _postings(cut(long.select("fp").distinct()), whole)
    near = near.unionByName(_tallied(again.filter(F.col("n") <= hot_list), whole, distance))
    longer = again.filter(F.col("n") > hot_list)
    return near if longer.isEmpty() else near.unionByName(_long_links(longer, whole, distance))


def _long_links(long: DataFrame, sets: list[tuple[int, ...]], distance: int) -> DataFrame:
    """Links within long lists: members of a key, of which `distance` bits are blanked, link with its smallest member."""

    def blank(batches):
        masks = []
        for s in sets:
            free = [b for i in range(8) if i not in s for b in range(56 - 8 * i, 64 - 8 * i)]
            masks.append(np.array([~sum(1 << b for b in c) & 0xFFFFFFFFFFFFFFFF for c in combinations(free, distance)], np.uint64))
        for batch in batches:
            for k, f in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), strict=True):
                n = len(masks[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * n, k * n + n, dtype=np.int32)), pa.array((f & masks[k]).view(np.int64)), pa.array(np.full(n, f).view(np.int64))], ["m", "key", "fp"])

    keyed = long.select("k", "fp").mapInArrow(blank, "m int, key bigint, fp bigint")
    star = keyed.groupBy("m", "key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("m", "key", "b")
    return keyed.join(star, ["m", "key"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _grouped(fps: DataFrame, distance: int, **index) -> DataFrame:
    """fp, first (smallest id, then text hash, of the rows that have it), root (one fp of its component) of each distinct fp."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = cut(fps.groupBy("fp").agg(first))
    found = components(links(nodes.select("fp"), distance, **index))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, **index) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) for every row of `docs`.

    Null and blank texts have fingerprint 0 and link like any other; equal fingerprints are one node.  Rows with equal
    doc_id stay separate rows.  A null doc_id never names a component unless no other id is there.  An empty table gives
    an empty result; other columns of `docs` are ignored.
    """
    fps = stored(fingerprints(docs, width), "simhash")
    group = _grouped(fps, distance, **index)
    lowest = group.groupBy("root").agg(F.min("first").alias("low"))
    named = group.join(lowest, "root").select("fp", F.col("low.doc_id").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies by Jaccard similarity

BANDS, ROWS = 32, 5  # of a pair at Jaccard 0.8 all 32 bands differ with probability 3e-6
MARKS, FIRST = 640, 160  # positional bytes of a sketch, and those of them that are tallied first
SIGMAS = 4.0  # a pair at the threshold falls short of the minimum tally with probability 3e-5


def shingle_sets(part: pa.Array, width: int):
    """For each text the hash of its lower-cased words, and the distinct hashes of every `width` of them in a row (fewer
    words: of all)."""
    data, offs = buffers(part)
    starts, ends, rows = runs(~SPACE[data], offs)
    h = SpanHasher(LOWER[data])(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    edge = np.searchsorted(rows, np.arange(len(part) + 1))
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]) if len(grams) else grams
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        node = xxhash.xxh64_intdigest(h[a:b].tobytes(), 42)
        yield node, np.unique(grams[a : b - width + 1]) if b - a > width else np.array([node], np.uint64)


def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _least(found: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of a set under each hash function."""
    factor, shift = hashes
    low, least = found.astype(np.uint32), np.full(len(factor), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 18) // len(factor))
    for i in range(0, len(low), step):
        least = np.minimum(least, (low[i : i + step, None] * factor + shift).min(0))
    return least


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles given by their hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 14):
        counts += np.unpackbits(found[i : i + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def _bands(found: np.ndarray, hashes) -> np.ndarray:
    raw = _least(found, hashes).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def _sketches(width: int):
    def run(batches):
        hashes = _hashes(BANDS * ROWS, 42)
        for batch in batches:
            texts = batch.column(1)
            node, size, fp, keys = np.empty(len(texts), np.uint64), np.empty(len(texts), np.int64), np.empty(len(texts), np.uint64), np.empty((len(texts), BANDS), np.uint64)
            for first, part in chunks(texts):
                for i, (who, found) in enumerate(shingle_sets(part, width), first):
                    node[i], size[i], fp[i], keys[i] = who, len(found), set_fingerprint(found), _bands(found, hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), lists], ["doc_id", "text_hash", "node", "n", "fp", "keys"])

    return run


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, node (hash of the words), n (shingles), fp (their fingerprint), keys (bands of the sketch) of every row."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(_sketches(width), "doc_id bigint, text_hash bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def _details(width: int):
    """node, n, keys (the bands), marks (positional bytes) and found (the set of shingles) of some texts."""

    def run(batches):
        hashes, more = _hashes(BANDS * ROWS, 42), _hashes(MARKS, 43)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                sets = list(shingle_sets(part, width))
                node = np.array([k for k, _ in sets], np.uint64).view(np.int64)
                columns = [[_bands(x, hashes).tobytes() for _, x in sets], [_least(x, more).astype(np.uint8).tobytes() for _, x in sets], [x.tobytes() for _, x in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([len(x) for _, x in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["node", "n", "keys", "marks", "found"])

    return run


def _similar(pairs: DataFrame, details: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingles have a Jaccard similarity of `threshold` at least, counted exactly."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    left, right = (details.select(F.col("node").alias(c), F.col("found").alias("f" + c)) for c in "ab")
    with small_batches(details.sparkSession):
        return cut(pairs.join(right, "b").join(left, "a").select("a", "b", "fa", "fb").mapInArrow(run, "a bigint, b bigint"))


def _fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes to be verified: of one fingerprint with its smallest node, and the smallest ones of linked fingerprints."""
    of = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("many")))
    same = nodes.select("node", "fp").join(of.filter("many > 1"), "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    left, right = (of.select(F.col("fp").alias(c), F.col("least").alias("least_" + c)) for c in "ab")
    near = links(of.select("fp"), distance).join(left, "a").join(right, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return stored(near.unionByName(same), "met")


def least_tally(threshold: float, n: int) -> int:
    """Shared positional bytes out of n that a pair at the threshold reaches (but for SIGMAS standard deviations)."""
    p = threshold + (1 - threshold) / 256
    return int(np.floor(n * p - SIGMAS * np.sqrt(n * p * (1 - p))))


def _counted(threshold: float):
    """Pairs of one block of a list (rows stand sorted by key, i, j) that reach the least tally, each in its first list only."""
    first, every = least_tally(threshold, FIRST), least_tally(threshold, MARKS)

    def block(key: int, i: int, j: int, node, n, of, part, keys, marks):
        keys, marks = np.frombuffer(b"".join(keys), np.int64).reshape(-1, BANDS), np.frombuffer(b"".join(marks), np.uint8).reshape(-1, MARKS)
        node, n, of, part = (np.array(x) for x in (node, n, of, part))
        some, rest = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for x in some:
            y = rest[rest > x] if i == j else rest
            y = y[(of[y] != of[x]) & (n[y] >= threshold * n[x] - 1e-9) & (n[x] >= threshold * n[y] - 1e-9)]
            y = y[(marks[y, :FIRST] == marks[x, :FIRST]).sum(1) >= first]
            y = y[(marks[y] == marks[x]).sum(1) >= every]
            if len(y):
                band = int(np.flatnonzero(keys[x] == key)[0])
                y = y[~(keys[y, :band] == keys[x, :band]).any(1)]
                yield np.full(len(y), node[x]), node[y]

    def run(batches):
        now, held = None, [[] for _ in range(6)]

        def flush():
            got = list(block(*now, *held)) if now and len(held[0]) > 1 else []
            if got:
                a, b = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for group, *row in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
                if group != now:
                    yield from flush()
                    now, held = group, [[] for _ in range(6)]
                for x, v in zip(held, row, strict=True):
                    x.append(v)
        yield from flush()

    return run


def jaccard_links(nodes: DataFrame, docs: DataFrame, width: int, threshold: float, rounds: int = 8, block: int = 2048, distance: int = 3) -> DataFrame | None:
    """Links (a, b) of nodes that connect the same components as all pairs of similar nodes that share a band or whose
    fingerprints are links().

    `nodes`: node, n, fp, keys and the doc_id and text_hash of one row of `docs` each.  First the pairs that the index of
    fingerprints finds within `distance` bits are verified; then every node is compared with the
    leader it shares most lists with, which connects a large group of near copies in few rounds; then, within every list that
    still holds more than one component, the pairs of different components are tallied byte by byte, in blocks of `block`
    nodes against each other, and those that reach the least tally are verified.
    """
    listed = nodes.select("node", "n", F.explode("keys").alias("key"))
    many = listed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    lists = stored(listed.join(many, "key"), "lists")
    met = _fingerprint_pairs(nodes, distance)
    members = lists.select("node").unionByName(met.select(F.col("a").alias("node"))).unionByName(met.select(F.col("b").alias("node"))).distinct()
    if members.isEmpty():
        return None
    chosen = nodes.select("node", F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).join(members, "node", "left_semi")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    with small_batches(docs.sparkSession):
        details = stored(keyed.join(chosen, _same_id(keyed["doc_id"], chosen["i"]) & (keyed["text_hash"] == chosen["h"])).select("text").mapInArrow(_details(width), "node bigint, n bigint, keys binary, marks binary, found binary"), "details")

    def still_open(found: DataFrame | None) -> DataFrame:
        """Rows (key, node, n, of) of the lists that hold more than one component."""
        if found is None:
            return lists.withColumn("of", F.col("node"))
        part = cut(components(found).withColumnRenamed("node", "_node"))
        now = lists.join(part, F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("of"))
        mixed = now.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low < high").select("key")
        return stored(now.join(mixed, "key", "left_semi"), "open")

    found = _similar(met, details, threshold)
    found, near = None if found.isEmpty() else found, (F.col("n") >= F.lit(threshold) * F.col("m") - 1e-9) & (F.col("m") >= F.lit(threshold) * F.col("n") - 1e-9)
    for turn in range(rounds):
        now = still_open(found)
        lead = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("of").alias("to"))).alias("l")).select("key", "l.*")
        met = now.join(lead, "key").filter("of <> to").filter(near).groupBy("node", "a").agg(F.count("*").alias("shared"))
        pairs = stored(met.groupBy("node").agg(F.max(F.struct("shared", "a")).alias("l")).select("l.a", F.col("node").alias("b")), "pairs")
        more = _similar(pairs, details, threshold)
        fresh = more.count()
        if fresh:
            found = more if found is None else found.unionByName(more)
        if fresh * 50 < pairs.count() or not fresh:
            break
    now = still_open(found)
    if now.isEmpty():
        return found
    parts = now.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = now.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = own.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "of", "part").join(details.drop("found"), "node")
    rows = rows.select("key", "i", "j", "node", "n", "of", "part", "keys", "marks").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    with small_batches(docs.sparkSession):
        pairs = stored(rows.mapInArrow(_counted(threshold), "a bigint, b bigint"), "pairs")
    more = _similar(pairs, details, threshold)
    return more if found is None else found.unionByName(more)


def _same_id(a, b):
    """Equality that holds for two nulls, as a plain equi-join key."""
    return F.coalesce(a, F.lit(-(1 << 62))) == F.coalesce(b, F.lit(-(1 << 62)))


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8, **search) -> DataFrame:
    """The rows of `docs` that represent their component: smallest doc_id, nulls last, then smallest text hash.

    Texts whose `width`-word shingles have a Jaccard similarity of `threshold` at least are linked.  Pairs whose SimHash
    fingerprints differ in at most three bits come from the index of links().  At that similarity fingerprints may differ in
    so many bits that no byte need agree; those pairs come from the positional bytes of MinHash sketches, of which such a pair
    shares a share of `threshold`: a posting holds five positions (a band), shared bytes are tallied, pairs that reach the
    least tally go on.  Both kinds are verified by their exact similarity.
    Of rows with equal doc_id and text one stays; null and empty texts are copies of each other; an empty table stays empty.
    All columns are kept.
    """
    with small_batches(docs.sparkSession):
        rows = stored(sketches(docs, width), "sketches")
    unique = rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    best = cut(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")))
    chosen = best.select(F.col("first.doc_id").alias("i"), F.col("first.text_hash").alias("h"))
    nodes = rows.join(chosen, _same_id(rows["doc_id"], chosen["i"]) & (rows["text_hash"] == chosen["h"]), "left_semi")
    nodes = stored(nodes if unique else nodes.dropDuplicates(["node"]), "nodes")
    found = jaccard_links(nodes, docs if unique else docs.dropDuplicates(["doc_id", "text"]), width, threshold, **search)
    if found is not None:
        part = components(found).withColumnRenamed("node", "_node")
        best = best.join(part, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first"))
    best = cut(best.select(F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash")))
    keyed = docs.withColumns({"__text_hash": F.xxhash64("text")})
    kept = keyed.join(best, _same_id(keyed["doc_id"].cast("bigint"), best["keep_id"]) & (keyed["__text_hash"] == best["keep_hash"]), "left_semi")
    return (kept if unique else kept.dropDuplicates(["doc_id", "__text_hash"])).drop("__text_hash")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of `documents`, the fingerprint as 16 hex digits; nulls, empties and repeats as stated there."""
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
