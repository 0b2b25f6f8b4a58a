"""What a deployment plugs in: encoder, recogniser, language model.  The offline ones are deterministic."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class Recogniser(Protocol):
    def entities(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """(text, label) of the named entities of each text, in order."""
        ...


class PatternRecogniser:
    """Long words, and numbers with and without an ordinal ending."""

    def __init__(self, pattern: str = r"([0-9]+(?:st|nd|rd|th)?)|[A-Za-z]{8,}"):
        self.pattern = re.compile(pattern)

    def entities(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        label = lambda m: "TERM" if not m.group(1) else "CARDINAL" if m.group().isdigit() else "ORDINAL"
        return [[(m.group(), label(m)) for m in self.pattern.finditer(t or "")] for t in texts]


def recognised(df: DataFrame, key: str, recogniser: Recogniser, text: str = "text", batch: int = 64) -> DataFrame:
    """(key, entity, label) of the entities of a text column, in batches; drop numbers with corpus.named()."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = recogniser.entities([t or "" for t in part.column(1).to_pylist()])
                rows = [i for i, x in enumerate(found) for _ in x]
                names, labels = ([e[k] for x in found for e in x] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(labels, pa.string())], [key, "entity", "label"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, entity string, label string")


class ChatModel:
    """A language model behind an HTTP service that speaks the common chat format."""

    def __init__(self, url: str, model: str, token: str = "", system: str = "", max_tokens: int = 2000, temperature: float = 0.0, timeout: float = 60.0):
        self.url, self.model, self.token, self.system = url, model, token, system
        self.max_tokens, self.temperature, self.timeout = max_tokens, temperature, timeout

    def answer(self, prompts: list[str]) -> list[str]:
        return [self._ask(p) for p in prompts]

    def _ask(self, prompt: str) -> str:
        said = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": said, "max_tokens": self.max_tokens, "temperature": self.temperature}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""


class HashingEmbedder:
    """Unit vectors of hashed words."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.size] += 1.0 if h >> 32 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class ScriptedModel:
    """Answers from a table of prompts, or a function."""

    def __init__(self, answers: dict[str, str] | Callable[[str], str]):
        self.answers = answers

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.answers(p) if callable(self.answers) else self.answers.get(p, "") for p in prompts]


def encoded(df: DataFrame, embedder: Embedder, batch: int = 128) -> DataFrame:
    """(hash_id, text) with embedding."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = embedder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], ["hash_id", "text", "embedding"])

    return df.select("hash_id", "text").mapInArrow(run, "hash_id string, text string, embedding array<float>")


def answered(df: DataFrame, prompt: str, key: str, model: LanguageModel, attempts: int = 1) -> DataFrame:
    """(key, raw_output, status, error): one row a prompt; a failure is a row, not a failed job."""

    def run(batches):
        for b in batches:
            keys, prompts, raw, status, error = b.column(0), b.column(1).to_pylist(), [], [], []
            for p in prompts:
                text, why = "", None
                for _ in range(attempts):
                    try:
                        text, why = model.answer([p])[0], None
                    except Exception as e:  # noqa: BLE001  any error of a remote model is recorded
                        text, why = "", str(e)
                    if text:
                        break
                raw.append(text)
                status.append("failed" if why else "success" if text else "empty")
                error.append(why)
            yield pa.RecordBatch.from_arrays([keys, pa.array(raw, pa.string()), pa.array(status, pa.string()), pa.array(error, pa.string())], [key, "raw_output", "status", "error"])

    kind = dict(df.dtypes)[key]
    return df.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, raw_output string, status string, error string")
