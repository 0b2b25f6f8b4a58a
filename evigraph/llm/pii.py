"""Personal data: base patterns, and contextual patterns bootstrapped from what those find.

Base matches are the seeds.  Every identifier-like string (seed or not) is an instance; the words beside it, together with
its shape, are its lexical patterns, and so is the shape alone where the string by itself is a base match (a base pattern
takes a phone and the card after it as one match, which its digit count then drops).  Spark scores the pattern-instance graph iteratively: a pattern's confidence is the
share of one kind among its known instances.  Patterns that several known instances support and whose confidence is high make
their other instances known, which support further patterns, until no new one appears; they mark instances in whole texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
IDENTIFIER = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[^ ]+")
BLANKS = " \t\n\r\x0b\x0c"
BLANK = re.compile(r"[ \t-\r]")
EDGES = ".,;:!?()[]{}\"'|<>"
STOPS = frozenset(EDGES + BLANKS + "\xa0")

Span = tuple[int, int, int]  # start, end, index of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


def shape(instance: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", instance)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}" if len(instance) == len(m.group()) else "9", s)


def parts_of_dropped(text: str) -> list[tuple[int, int]]:
    """Phone matches with too many digits: the shortest part up to a blank that is a phone, and the rest if it is a card."""
    out = []
    for m in PHONE.finditer(text) if "+" in text else ():
        if len(NOT_DIGIT.sub("", m.group())) <= 15:
            continue
        n = 0
        for word in WORD.finditer(text, m.start(), m.end()):
            n += len(NOT_DIGIT.sub("", word.group()))
            if n > 15:
                break
            end = word.end()
            if n >= 10 and text[end - 1] in "0123456789":
                out.append((m.start(), end))
                rest = m.end() - len(text[end : m.end()].lstrip())
                if base_spans(text[rest : m.end()]) == [(0, m.end() - rest, 2)]:
                    out.append((rest, m.end()))
                break
    return out


class Covered:
    """Spans in order, asked whether any overlaps a stretch."""

    def __init__(self, spans: list[Span]):
        self.starts, self.reach, top = [], [], 0
        for s in sorted(spans):
            top = max(top, s[1])
            self.starts.append(s[0])
            self.reach.append(top)

    def __call__(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.reach[i - 1] > a


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """Seeds and identifier-like strings beside them: (start, end, kind, or -1 where unknown).

    A string between blanks without its edge punctuation: an @ or three digits at least, five characters or more.
    """
    taken = Covered(spans)
    out = [*spans, *((a, b, -1) for a, b in parts_of_dropped(text) if not taken(a, b))]
    taken, last = Covered(out), 0
    out.sort()
    for m in IDENTIFIER.finditer(text):
        i = m.start()
        if i < last:
            continue
        left = max((text.rfind(c, last, i) for c in BLANKS), default=-1) + 1 or last
        end = BLANK.search(text, i)
        last = right = end.start() if end else len(text)
        while left < right and text[left] in EDGES:
            left += 1
        while right > left and text[right - 1] in EDGES:
            right -= 1
        token = text[left:right]
        if len(token) < 5 or ("@" not in token and sum(map(token.count, "0123456789")) < 3) or taken(left, right):
            continue
        out.append((left, right, -1))
    return out


def _words_beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The whole words before and after a span, lower-cased, digits as 9; ^ and $ at the text's ends.  Punctuation parts words."""
    j = start
    while j > 0 and text[j - 1] in STOPS:
        j -= 1
    i = j
    while i > 0 and text[i - 1] not in STOPS:
        i -= 1
    a = end
    while a < len(text) and text[a] in STOPS:
        a += 1
    b = a
    while b < len(text) and text[b] not in STOPS:
        b += 1
    plain = lambda s: re.sub(r"[0-9]+", "9", s.lower())
    return plain(text[i:j]) if i < j else "^", plain(text[a:b]) if a < b else "$"


def patterns(text: str, start: int, end: int) -> list[int]:
    """Keys of a span's lexical patterns: both words beside it, the word before, the word after, each with the span's shape;
    and the shape alone if the span by itself is a base match."""
    left, right = _words_beside(text, start, end)
    form, alone = shape(text[start:end]), text[start:end]
    whole = [_key(f"F|{form}|{KINDS[k]}") for a, b, k in base_spans(alone) if b - a == len(alone)]
    return [_key(f"B|{form}|{left}|{right}"), _key(f"L|{form}|{left}"), _key(f"R|{form}|{right}"), *whole]


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def _edges(batches):
    for batch in batches:
        seen: dict[tuple[int, int], int] = {}
        for t in batch.column(0):
            text = t.as_py() or ""
            if not IDENTIFIER.search(text):
                continue
            for a, b, kind in candidates(text, base_spans(text)):
                inst = _key(text[a:b].lower())
                for p in patterns(text, a, b):
                    seen[p, inst] = max(kind, seen.get((p, inst), -1))
        if seen:
            p, i = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(i, pa.int64()), pa.array(list(seen.values()), pa.int32())], ["pattern", "instance", "kind"])


def learn(docs: DataFrame, rounds: int | None = None, confidence: float = 0.75, support: int = 3) -> DataFrame:
    """(pattern, kind, confidence, seeds) of the patterns that `support` seeds back and that reach `confidence`.

    Instances that a learnt pattern finds are seeds of the next round, until a round finds none (or for `rounds` rounds).
    Confidence is k / (known + 1), for k of the pattern's known instances; what is still unknown does not count against it.
    """
    edges = cut(docs.select("text").mapInArrow(_edges, "pattern bigint, instance bigint, kind int").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    known = cut(edges.filter("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind")))
    edges, turn = edges.select("pattern", "instance"), 0
    while True:
        counts = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
        size = counts.groupBy("pattern").agg(F.sum("seeds").alias("n"))
        score = counts.filter(F.col("seeds") >= support).join(size, "pattern").withColumn("confidence", F.col("seeds") / (F.col("n") + 1))
        score = cut(score.filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence", "seeds"))
        turn += 1
        if rounds is not None and turn >= rounds:
            return score
        new = edges.join(score, "pattern").join(known, "instance", "left_anti").groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        new = cut(new)
        if new.isEmpty():
            return score
        known = cut(known.unionByName(new))


def find(docs: DataFrame, learnt: DataFrame | None = None, block: int = 1 << 18) -> DataFrame:
    """All columns of `docs` with base and found: array<struct<start, end, kind>> of code points, by start, then kind.

    `base`: base matches; `found`: base matches and what the learnt patterns add, without overlaps between the two.  A null
    text counts as empty.  Columns of these names are replaced.  Patterns travel in blocks of at most `block`, one pass
    over the texts each, so what a task holds is bounded however many patterns there are.
    """
    from pyspark.sql import types as T

    rows = None if learnt is None else cut(learnt.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))
    total = 0 if rows is None else rows.count()
    parts = max(1, -(-total // block))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    spans = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("base", "found")])
    for k in range(parts):
        some = [] if rows is None or not total else rows.filter(F.pmod(F.col("pattern"), F.lit(parts)) == k).orderBy("pattern").collect()
        keys, kinds = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int32)
        shared = spans.sparkSession.sparkContext.broadcast((keys, kinds))
        names, at = spans.columns, spans.columns.index("text")
        schema = T.StructType([f for f in spans.schema.fields if f.name not in ("base", "found")] + [T.StructField("base", span), T.StructField("found", span)])

        def run(batches, shared=shared, names=names, at=at):
            keys, kinds = shared.value
            table = dict(zip(keys.tolist(), kinds.tolist()))
            for batch in batches:
                base, found = [], []
                before = batch.column(names.index("found")).to_pylist() if "found" in names else None
                for row, t in enumerate(batch.column(at)):
                    text = t.as_py() or ""
                    own = base_spans(text) if IDENTIFIER.search(text) else []
                    more = []
                    if table and IDENTIFIER.search(text):
                        for a, b, kind in candidates(text, own):
                            if kind < 0 and (hit := [table[p] for p in patterns(text, a, b) if p in table]):
                                more.append((a, b, hit[0]))
                    every = set(own + more)
                    if before:
                        every |= {(s["start"], s["end"], KINDS.index(s["kind"])) for s in before[row]}
                    base.append([{"start": a, "end": b, "kind": KINDS[c]} for a, b, c in own])
                    found.append([{"start": a, "end": b, "kind": KINDS[c]} for a, b, c in sorted(every, key=lambda s: (s[0], s[2], s[1]))])
                kept = [i for i, c in enumerate(names) if c not in ("base", "found")]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(base, arrow), pa.array(found, arrow)], [*[names[i] for i in kept], "base", "found"])

        spans = spans.mapInArrow(run, schema)
    return spans


def redact(docs: DataFrame, learnt: DataFrame | None = None) -> DataFrame:
    """`docs` with every found span of `text` replaced by its kind in angle brackets; a null text stays null.

    Overlapping spans become one mask, named after the first.
    """
    from pyspark.sql import types as T

    names = docs.columns
    spans = find(docs, learnt).drop("base")
    at, last = spans.columns.index("text"), spans.columns.index("found")

    def run(batches):
        for batch in batches:
            out = []
            for t, found in zip(batch.column(at), batch.column(last), strict=True):
                text, done, parts = t.as_py(), 0, []
                for s in found.as_py() if text is not None else []:
                    if s["start"] >= done:
                        parts += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
                    done = max(done, s["end"])
                out.append(text if text is None else "".join(parts) + text[done:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(spans_names) if c != "found"], [c for c in spans_names if c != "found"])

    spans_names = spans.columns
    return spans.mapInArrow(run, T.StructType([f for f in spans.schema.fields if f.name != "found"])).select(*[f"`{c}`" for c in names if c.lower() not in ("base", "found")])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find() in every row of `documents` with the patterns learnt from all of them.  Null texts count as empty, rows of equal
    doc_id and null ids are rows like others, an empty table gives an empty result.
    """
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spans = find(docs, learn(docs)).drop("text")

    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
