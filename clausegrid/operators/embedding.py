"""Vectors of child chunks from a function the user gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectorized import hashed_vector
from .chunking import embedding_input

BATCH, DIM = 64, 1536


def hashed_vectors(dim: int) -> Callable[[list[str]], list[np.ndarray]]:
    """Stand-in provider: equal texts get equal unit vectors."""
    return lambda texts: [hashed_vector(t, dim) for t in texts]


def embed_children(chunks: DataFrame, dim: int = DIM, embed: Callable[[list[str]], list] | None = None, batch: int = BATCH) -> DataFrame:
    """chunk_id, embedding (array<float>) of every child; a wrong number or length of vectors fails the job."""
    embed = embed or hashed_vectors(dim)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                vectors = embed(rows["input"].tolist())
                if len(vectors) != len(rows) or any(len(v) != dim for v in vectors):
                    raise ValueError("the provider must return one vector of the configured length for each text")
                yield pd.DataFrame({"chunk_id": rows["chunk_id"].to_numpy(), "embedding": [np.asarray(v, np.float32) for v in vectors]})

    rows = chunks.filter("NOT is_parent").select("chunk_id", embedding_input(F.col("section_path"), F.col("content")).alias("input"))
    return rows.mapInPandas(run, "chunk_id long, embedding array<float>")


def wrong_vectors(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks that break a rule: children without a vector of the right length, parents with one."""
    bad = (~F.col("is_parent") & (F.coalesce(F.size("embedding"), F.lit(-1)) != dim)) | (F.col("is_parent") & F.col("embedding").isNotNull())
    return chunks.filter(bad)
