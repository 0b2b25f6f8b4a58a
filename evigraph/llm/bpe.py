"""BPE by forced-boundary splitting.

A merge can join two neighbouring symbols only if some vocabulary token holds them side by side.  Neighbours that no token
holds are certain cuts: fragments between cuts are encoded on their own and their ids concatenated.  Fragments are short
and recur, so each is encoded once per worker and looked up afterwards; both tables are bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format, with word ends.

    encode(text) equals the library's encode(text, add_special_tokens=False) and decode(ids) its
    decode(ids, skip_special_tokens=False).  Texts within Latin-1 are split by a regular expression here; any other text is
    normalised and split by the library, whose tables define those steps.  Null: the empty text.
    """

    def __init__(self, spec: str, table_limit: int = 200_000):
        self.spec, self.table_limit = spec, table_limit
        self._setup()

    def __reduce__(self):
        return type(self), (self.spec, self.table_limit)

    def _setup(self) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(self.spec)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec.get("decoder") is not None:
            raise ValueError("a BPE file with word ends and without decoder is needed")
        library = Tokenizer.from_str(self.spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.joined: set[tuple[int, int]] = set()  # neighbouring symbols inside some token
        for token in self.ids:
            s = self.symbols(token[: -len(END)], True) if token.endswith(END) and token != END else list(token)
            s = [self.ids[x] for x in s]
            self.joined.update(zip(s, s[1:]))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special_at = re.compile("|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        self.inner, self.final = [self.ids[c] for c in alphabet], [self.ids[c + END] for c in alphabet]
        kind = {c: unicodedata.category(chr(c))[0] for c in range(256)}
        letters = "".join(re.escape(chr(c)) for c in kind if kind[c] == "L")
        digits = "".join(re.escape(chr(c)) for c in kind if kind[c] == "N")
        blank = "\\t-\\r \\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+").findall
        self.fragments: dict[tuple[int, ...], tuple[int, ...]] = {}

    @staticmethod
    def symbols(word: str, ends: bool) -> list[str]:
        s = list(word)
        if ends and s:
            s[-1] += END
        return s

    def _merge(self, parts: list[int]) -> list[int]:
        """Merges of one fragment: lowest rank first, then leftmost."""
        if len(parts) > 100:
            return self._merge_long(parts)
        rank, made, none = self.ranks.get, self.made, 1 << 60
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for very long fragments."""
        rank, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != x or parts[j] != y:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (q := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (q, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (q := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def fragments_of(self, word: bytes) -> list[list[int]]:
        """Symbol ids of a word, cut wherever no token holds both neighbours."""
        s = [self.inner[b] for b in word]
        s[-1] = self.final[word[-1]]
        pairs = list(zip(s, s[1:]))
        if self.joined.issuperset(pairs):
            return [s]
        cuts = [0, *(i for i, p in enumerate(pairs, 1) if p not in self.joined), len(s)]
        return [s[a:b] for a, b in zip(cuts, cuts[1:])]

    def word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        parts = self.fragments_of(word)
        return tuple(self._merge(parts[0])) if len(parts) == 1 else tuple(chain.from_iterable(map(self._fragment, parts)))

    def _fragment(self, s: list[int]) -> tuple[int, ...]:
        if (ids := self.fragments.get(key := tuple(s))) is None:
            if len(self.fragments) >= self.table_limit:
                self.fragments.clear()
            ids = tuple(self._merge(s))
            if len(key) <= 64:
                self.fragments[key] = ids
        return ids

    def encoder(self):
        """text -> ids, with its own bounded table of words."""
        words, word, limit, bytes_of = self.words, self.word, self.table_limit, self.bytes_of

        class Words(dict):
            def __missing__(self, w: str) -> tuple[int, ...]:
                if len(self) >= limit:
                    self.clear()
                ids = word(w.encode("utf-8"))
                if len(w) <= 64:
                    self[w] = ids
                return ids

        table = Words()

        def plain(text: str) -> list[int]:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return [i for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) for i in word(bytes(map(bytes_of.__getitem__, w)))]
            return list(chain.from_iterable(map(table.__getitem__, words(text.lower()))))

        def encode(text: str | None) -> list[int]:
            if not text:
                return []
            if self.special_at is None or "<" not in text:
                return plain(text)
            ids, at = [], 0
            for m in self.special_at.finditer(text):
                ids += plain(text[at : m.start()]) if m.start() > at else []
                ids.append(self.specials[m.group()])
                at = m.end()
            return ids + (plain(text[at:]) if at < len(text) else [])

        return encode

    def decode(self, ids) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def load(path: str | None = None) -> ForcedBoundaryBPE:
    """The encoder of a vocabulary file."""
    return ForcedBoundaryBPE(_spec(path))


def _spec(path: str | None) -> str:
    """A vocabulary file, read on the driver; its content travels with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """All columns of `docs` with ids array<int> and decoded string of its `text` (null: empty).

    Columns of these names are replaced.  Ids of special tokens are given where their strings occur in a text.  Every row is
    encoded by itself, so repeats and null ids are rows like others; an empty table stays empty.
    """
    return _run(docs, path, "full", ids, decoded)


def _run(docs: DataFrame, path: str | None, mode: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))  # one vocabulary file, some MB
    if mode == "full":
        rest = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
        docs = docs.select(*[f"`{c}`" for c in rest])
        fields = [*docs.schema.fields]
        from pyspark.sql import types as T

        schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text)
    else:
        schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    column = docs.columns.index("text")

    def run(batches):
        model = ForcedBoundaryBPE(shared.value)
        enc = model.encoder()
        digits = [str(i) for i in range(len(model.names))]
        for batch in batches:
            texts = batch.column(column)
            if mode == "full":
                for at in range(0, len(texts), 64):  # few texts at once: ids take several times the bytes
                    part = batch.slice(at, 64)
                    got = [enc(t.as_py()) for t in part.column(column)]
                    new = [pa.array(got, pa.list_(pa.int32()))] * with_ids + [pa.array([model.decode(i) for i in got], pa.string())] * with_text
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *["ids"] * with_ids, *["decoded"] * with_text])
                continue
            n, a, b = [], [], []
            for t in texts:
                got = enc(t.as_py())
                n.append(len(got))
                a.append(hashlib.sha256(" ".join(map(digits.__getitem__, got)).encode()).hexdigest())
                b.append(hashlib.sha256(model.decode(got).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of encode() for every row of `documents`; nulls, empties and repeats as stated there."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _run(docs, None, "digest")
