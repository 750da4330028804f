"""Slots for external models: a batch function becomes a pandas UDF; deterministic doubles stand in for models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def embedder_slot(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A pandas UDF text -> array<float>; ``load`` runs once per worker and returns the batch function."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(encode([t or "" for t in texts]).astype(np.float32)))

    return embed


def generator_slot(load: Callable[[], Callable[[list[str]], list[str]]]):
    """A pandas UDF prompt -> raw answer."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = load()
        for prompts in batches:
            yield pd.Series(answer([p or "" for p in prompts]), dtype=object)

    return generate


def hash_embedder(size: int = 16) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from a text's hash: equal texts get equal vectors."""

    def encode(texts: list[str]) -> np.ndarray:
        raw = np.array([np.frombuffer(hashlib.sha256(t.encode()).digest()[:size] + b"\1" * max(0, size - 32), np.uint8)[:size] for t in texts], np.float64) - 127.5
        return raw / np.linalg.norm(raw, axis=1, keepdims=True)

    return encode


def table_generator(answers: dict[str, str], default: str = "") -> Callable[[list[str]], list[str]]:
    """Answers looked up by prompt."""
    return lambda prompts: [answers.get(p, default) for p in prompts]
