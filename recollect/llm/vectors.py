"""Whole-number vectors: the rows that count, packed blocks, and exact distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut, settle

#: Vectors of a block.
ROWS = 4096
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` components each as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, size)


def packed(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """(block, kind): the vectors' components as bytes, ROWS vectors in each, in the type they
    have. Written to the shared folder, so that rounds read nothing but blocks."""
    kind = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            made = np.concatenate(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"block": pa.array([made.astype(kind).tobytes()], pa.binary()), "kind": [kind]})

        for batch in batches:
            held.append(matrix(batch.column(0), size))
            if sum(map(len, held)) >= ROWS:
                yield out()
        if held:
            yield out()
        settle()

    return cut(vectors.select(vector).mapInArrow(run, "block binary, kind string"), "blocks")


def unpacked(row, size: int) -> np.ndarray:
    return np.frombuffer(bytes(row.block), dtype=row.kind).astype(np.float64).reshape(-1, size)


class Whole:
    """floor(scale * x) of a block of vectors, ``scale`` a power of two: ``near`` holds the rows whose
    components do not pass ``reach`` as doubles (exact), ``far`` the others as Python integers."""

    def __init__(self, x: np.ndarray, scale: int, reach: int) -> None:
        with np.errstate(over="ignore"):
            scaled = np.floor(x * scale)
        small = np.abs(scaled).max(axis=1, initial=0) <= reach
        self.n = len(x)
        self.at, self.near = np.flatnonzero(small), scaled[small]
        self.far_at = np.flatnonzero(~small)
        self.far = [[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x[~small].tolist()]


def reach(size: int, bits: int) -> int:
    """Components up to this make squared distances of ``size`` components, and all that is added on the way, stay below 2**bits."""
    return math.isqrt(((1 << bits) - 1) // max(1, size)) // 2


def exact_distance(rows: np.ndarray, center: list[int]) -> list[int]:
    """Squared distances of rows of whole numbers to one centre, whatever their size."""
    if not len(rows):
        return []
    most = max(int(np.abs(rows).max(initial=0)), max(map(abs, center), default=0))
    kind = np.int64 if most <= reach(len(center), 63) else object
    rows = rows.astype(np.int64) if rows.dtype == np.float64 else rows
    gap = rows.astype(kind) - np.array(center, dtype=kind)[None, :]
    return (gap * gap).sum(axis=1).tolist()


def floor_means(centers: list[list[int]], counts: list[int], sums: list[list[int]]) -> list[list[int]]:
    """Componentwise floor(sum / count); what nothing was assigned to stays."""
    return [[s // n for s in total] if n else old for old, n, total in zip(centers, counts, sums)]


def long_or_null(x: int | None) -> int | None:
    return x if x is not None and x <= LONG else None


def summed(blocks: DataFrame, zero, add, merge) -> object:
    """treeAggregate over the rows of the blocks: what comes to the driver is one state of the size of ``zero``."""
    rdd: RDD = blocks.rdd
    return rdd.treeAggregate(zero, add, merge, depth=2)
