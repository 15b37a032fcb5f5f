"""Vectors for texts by a model that is handed in: batches of texts, never one at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TextEmbedder(Protocol):
    """A model on the workers: ``embed`` maps texts to a matrix, a row a text."""

    model: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


def embedder(model: TextEmbedder) -> Callable[[Column], Column]:
    """text -> array<float>. A null text has no vector; a wrong shape or a value that is not finite is an error."""
    width = model.dimensions

    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        out = np.full(len(texts), None, dtype=object)
        if known.any():
            matrix = np.asarray(model.embed(texts[known].tolist()), dtype=np.float32)
            if matrix.shape != (int(known.sum()), width):
                raise ValueError(f"{model.model}: shape {matrix.shape}, not {(int(known.sum()), width)}")
            if not np.isfinite(matrix).all():
                raise ValueError(f"{model.model}: values that are not finite")
            for at, row in zip(np.flatnonzero(known), matrix):
                out[at] = row
        return pd.Series(out)

    return embedded


def check_embedder(model: TextEmbedder, manifest) -> None:
    """A model must be the one that an index was built with. ``manifest``: a row or dict of its manifest."""
    if model.model != manifest["embedding_model"]:
        raise ValueError(f"the index was built with {manifest['embedding_model']}, not {model.model}")
    if model.dimensions != manifest["embedding_dimensions"]:
        raise ValueError(f"the index has {manifest['embedding_dimensions']} dimensions, not {model.dimensions}")
