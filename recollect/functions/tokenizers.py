"""Token counts and windows by a byte-pair vocabulary, in Arrow batches.

What runs on workers needs tiktoken there, and nothing of this package.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encoder(ranks: str, pattern: str) -> Callable:
    """A function that gives the vocabulary of a rank file, read when first asked for in a task."""
    held: list = []

    def load():
        if not held:
            import base64

            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
            held.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
        return held[0]

    return load


def counter(ranks: str, pattern: str) -> Callable[[Column], Column]:
    """text -> number of tokens; null counts none."""
    load = encoder(ranks, pattern)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        own = load()
        return pd.Series([len(own.encode_ordinary(t or "")) for t in texts], dtype="int64")

    return counted


def windower(ranks: str, pattern: str, size: int) -> Callable[[Column], Column]:
    """text -> contiguous windows of at most ``size`` tokens; a short text is its own only window.

    Where a window ends inside a character, both halves show a replacement character.
    """
    load = encoder(ranks, pattern)

    @F.pandas_udf("array<string>")
    def windowed(texts: pd.Series) -> pd.Series:
        own, out = load(), []
        for text in texts:
            ids = own.encode_ordinary(text or "")
            out.append([text] if len(ids) <= size else [own.decode(ids[k : k + size]) for k in range(0, len(ids), size)])
        return pd.Series(out)

    return windowed
