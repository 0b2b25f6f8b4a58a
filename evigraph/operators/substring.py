"""Which of a set of strings occur in which texts, without comparing every pair."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # slower, same result
    ahocorasick = None


def occurrences_of(texts: DataFrame, words: DataFrame, key: str, text: str = "text", word: str = "word", block_bytes: int = 4 << 20) -> DataFrame:
    """(key, word, n): non-overlapping occurrences, n > 0, of each distinct non-empty word in each text; exact characters.

    One pass over the texts per block of at most about `block_bytes` of words, each block one automaton in every task; so what
    is sent is bounded however many words there are.
    """
    spark = texts.sparkSession
    distinct = words.select(F.col(word).alias("word")).filter("word <> ''").distinct()
    total = distinct.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = dict(texts.dtypes)[key]
    out = spark.createDataFrame([], f"`{key}` {kind}, word string, n bigint")
    for b in range(blocks if total else 0):
        some = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(some)

        def run(batches, shared=shared):
            machine = None
            if ahocorasick is not None and shared.value:
                machine = ahocorasick.Automaton()
                for w in shared.value:
                    machine.add_word(w, w)
                machine.make_automaton()
            for batch in batches:
                rows, found, n = [], [], []
                for i, t in enumerate(batch.column(1)):
                    s = t.as_py() or ""
                    for w in sorted({w for _, w in machine.iter(s)} if machine else {w for w in shared.value if w in s}):
                        rows.append(i)
                        found.append(w)
                        n.append(s.count(w))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], [key, "word", "n"])

        out = out.unionByName(texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, word string, n bigint"))
    return out
