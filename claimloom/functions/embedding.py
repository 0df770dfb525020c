"""Embedding adapters: injected functions from texts to vectors, run once per distinct text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Embedder:
    """``embed`` takes a list of texts and gives an array (texts, dim)."""

    name: str
    version: str
    dim: int
    embed: Callable[[list[str]], np.ndarray]


_registry: dict[str, Embedder] = {}


def register_embedder(e: Embedder) -> None:
    if _registry.get(e.name, e) is not e:
        raise ValueError(f"embedder {e.name!r} is registered with another implementation")
    _registry[e.name] = e


def embedder(name: str) -> Embedder:
    if name not in _registry:
        raise KeyError(f"no embedder {name!r}")
    return _registry[name]


def warm(texts: DataFrame, e: Embedder, batch: int = 256) -> DataFrame:
    """Rows (text, model, version, embedding) for the distinct texts of column ``text``; vectors are single precision.

    A vector of another length or with a number that is not finite raises.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame["text"].iloc[i : i + batch].tolist()
                vectors = np.asarray(e.embed(part), np.float32)
                if vectors.shape != (len(part), e.dim) or not np.isfinite(vectors).all():
                    raise ValueError(f"{e.name} gave vectors of shape {vectors.shape} or numbers that are not finite")
                yield pd.DataFrame({"text": part, "embedding": list(vectors)})

    return texts.select("text").where("text is not null").distinct().mapInPandas(run, "text string, embedding array<float>").select("text", F.lit(e.name).alias("model"), F.lit(e.version).alias("version"), "embedding")


def with_embeddings(claims: DataFrame, cache: DataFrame) -> DataFrame:
    """Claims with the column ``embedding`` from a table (text, embedding); null where the text is not in it."""
    return claims.join(cache.select(F.col("text").alias("value_text"), "embedding"), "value_text", "left")
