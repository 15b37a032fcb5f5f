"""Vector codes: product quantisation in exact whole numbers, screened in single precision.

Components become floor(SCALE * x); a vector is cut into PARTS equal parts, and
each part is coded by the nearest entry of its position's codebook. A block of parts meets a
codebook in one float32 matrix product, |c|^2 - 2 x.c. The error of each of these numbers is
bounded from the norms (rounding of the factors, of the sum in any order, and of the
difference), so that each stands for an interval. Entries whose interval reaches the
lowest upper end are evaluated again in 64-bit integers (Python's where those could
overflow), and the smallest index among equals wins. Mostly one entry is left, and nothing
is evaluated twice.

Each round sums parts by entry in integers and treeAggregate adds up the sums:
PARTS codebooks reach the driver, whatever the number of vectors.

Defined results: null vectors and those with null or non-finite components are left out. The
smallest id whose vector has a positive multiple of PARTS components sets the size;
vectors of another size keep a row with a null code and error. Repeated ids each get a row
and are ordered by their components; vectors with a null id are coded but start no entry.
With fewer vectors than entries each starts one; without any, codes are null. Errors
past a 64-bit integer are null and do not count in label_error; labels that are null are equal. An
empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .util import cut, drop, settle

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_UNIT = 2.0**-24


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rigorous lower and upper ends of |c|^2 - 2 x.c from a float32 product; x and c are whole numbers as doubles.

    Rounding the factors and summing m products of them in any order errs by at most
    g(m + 2) |x||c| with g(k) = k u / (1 - k u); |c|^2 and the difference are each rounded
    once more. (m + 8) u (|c|^2 + 2 |x||c|) with 1 % on top covers them and the doubles used here.
    """
    squares = (c * c).sum(axis=1)
    screen = squares.astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ c.astype(np.float32).T)
    norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
    error = 1.01 * (x.shape[1] + 8) * _UNIT * (squares[None, :] + 2 * norms)
    screen = screen.astype(np.float64)
    return screen - error, screen + error


class Coder:
    """Assigns parts to the nearest entries of codebooks[part][entry] (lists of Python integers)."""

    def __init__(self, books: list[list[list[int]]], size: int) -> None:
        self.books, self.width, self.size = books, size // len(books), size
        self.reach = V.reach(self.width, 63)
        self.fits = [max((abs(v) for entry in book for v in entry), default=0) <= self.reach for book in books]
        self.whole = [np.array(b, dtype=np.int64) if ok else None for b, ok in zip(books, self.fits)]

    def __call__(self, block: V.Whole) -> tuple[np.ndarray, list[int]]:
        """(entry numbers by vector and part, errors) of a block."""
        index, error = np.zeros((block.n, len(self.books)), dtype=np.int64), [0] * block.n
        for p, (book, fits) in enumerate(zip(self.books, self.fits)):
            span = slice(p * self.width, (p + 1) * self.width)
            x = block.near[:, span]
            if fits:
                best, distance = self._screened(x, self.whole[p])
            else:
                best, distance = self._exact(x.astype(np.int64).astype(object), book)
            index[block.at, p] = best
            for at, d in zip(block.at.tolist(), distance):
                error[at] += d
            if len(block.far):
                best, distance = self._exact(np.array([row[span] for row in block.far], dtype=object).reshape(len(block.far), -1), book)
                index[block.far_at, p] = best
                for at, d in zip(block.far_at.tolist(), distance):
                    error[at] += d
        return index, error

    @staticmethod
    def _screened(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int]]:
        if not len(x):
            return np.zeros(0, dtype=np.int64), []
        low, high = intervals(x, book.astype(np.float64))
        open_ = low <= high.min(axis=1)[:, None]
        best = open_.argmax(axis=1)
        several = np.flatnonzero(open_.sum(axis=1) > 1)
        whole = x.astype(np.int64)
        if len(several):
            row, entry = np.nonzero(open_[several])
            gap = whole[several[row]] - book[entry]
            again = np.full((len(several), len(book)), np.iinfo(np.int64).max)
            again[row, entry] = (gap * gap).sum(axis=1)
            best[several] = again.argmin(axis=1)  # the first of equals
        gap = whole - book[best]
        return best, (gap * gap).sum(axis=1).tolist()

    @staticmethod
    def _exact(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        found = [V.exact_distance(x, entry) for entry in book]
        best = [min((found[j][i], j) for j in range(len(book))) for i in range(len(x))]
        return np.array([j for _, j in best], dtype=np.int64), [d for d, _ in best]


def _pass(blocks: DataFrame, books: list, size: int, scale: int) -> tuple:
    """(counts, sums) by part and entry."""
    coder = Coder(books, size)
    parts, entries, width = len(books), len(books[0]), coder.width
    zero = ([[0] * entries for _ in range(parts)], [[[0] * width for _ in range(entries)] for _ in range(parts)])

    def add(state: tuple, row) -> tuple:
        counts, sums = state
        block = V.Whole(V.unpacked(row, size), scale, min(coder.reach, (1 << 62) // V.ROWS // 2))
        index, _ = coder(block)
        for p in range(parts):
            span = slice(p * width, (p + 1) * width)
            own = np.zeros((entries, width), dtype=np.int64)
            np.add.at(own, index[block.at, p], block.near[:, span].astype(np.int64))
            for e, n in enumerate(np.bincount(index[:, p], minlength=entries).tolist()):
                counts[p][e] += n
                if n:
                    sums[p][e] = [a + b for a, b in zip(sums[p][e], own[e].tolist())]
            for at, row_ in zip(block.far_at.tolist(), block.far):
                e = index[at, p]
                sums[p][e] = [a + b for a, b in zip(sums[p][e], row_[span])]
        return counts, sums

    def merge(a: tuple, b: tuple) -> tuple:
        return (
            [[x + y for x, y in zip(s, t)] for s, t in zip(a[0], b[0])],
            [[[x + y for x, y in zip(v, w)] for v, w in zip(s, t)] for s, t in zip(a[1], b[1])],
        )

    return V.summed(blocks, zero, add, merge)


def train(kept: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list, int]:
    """(codebooks, vector size) from all vectors of kept (vec_id, vector); no codebooks without a vector to start from."""
    able = kept.filter("vec_id is not null").filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    head = able.orderBy("vec_id", "vector").limit(1).select(F.size("vector").alias("size")).collect()
    if not head:
        return [], 0
    size = head[0]["size"]
    fitting = kept.filter(F.size("vector") == size)
    first = fitting.filter("vec_id is not null").orderBy("vec_id", "vector").limit(entries).select("vector").collect()
    whole = V.Whole(np.array([r.vector for r in first], dtype=np.float64), scale, 0)  # reach 0: Python integers, but for zero vectors
    far = dict(zip(whole.far_at.tolist(), whole.far))
    starts = [far.get(i, [0] * size) for i in range(len(first))]
    width = size // parts
    books = [[v[p * width : (p + 1) * width] for v in starts] for p in range(parts)]
    blocks = V.packed(fitting, "vector", size)
    for _ in range(rounds):
        counts, sums = _pass(blocks, books, size, scale)
        books = [V.floor_means(b, n, s) for b, n, s in zip(books, counts, sums)]
    drop(blocks)
    return books, size


def encode(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels) and codebooks_sha256 of every
    vector. ``scale`` is a power of two; at most 256 entries."""
    if scale < 1 or scale & (scale - 1) or not 1 <= entries <= 256:
        raise ValueError("scale must be a power of two and entries between 1 and 256")
    named = F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")
    kept = table.select(*named).filter(V.finite(F.col("vector")))
    books, size = train(kept, scale, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coder = Coder(books, size) if books else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            fits = np.flatnonzero(batch.column(1).value_lengths().to_numpy() == size) if coder else []
            if len(fits):
                index, errors = coder(V.Whole(V.matrix(batch.column(1).take(pa.array(fits)), size), scale, coder.reach))
                for at, own, e in zip(fits.tolist(), index.tolist(), errors):
                    code[at], error[at] = bytes(own).hex(), V.long_or_null(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )
        settle()

    label_type = table.schema[label].dataType.simpleString()
    coded = cut(kept.mapInArrow(run, f"vec_id long, label {label_type}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select("of", F.when(F.col("total") <= V.LONG, F.col("total").cast("long")).alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
