"""Document fingerprints: every shingle hash below a fixed threshold.

A text is read as code points with SHINGLE - 1 sentinels at either end; each
window of SHINGLE code points has a 64-bit hash (polynomial, then mixed), and
the sketch keeps every distinct hash in the first 1 of KEPT parts of the hash
space. Sketches grow with their texts, so that the sketch of a union is the
union of sketches, and the part of one sketch found in another estimates
containment however unequal the two documents are. The standard error of a
resemblance J over u joint shingles is sqrt(J * (1 - J) * KEPT / u); entries are
32 bits wide, and a fingerprint has about 8 / KEPT hex digits a character.

Defined results: a null text is empty; an empty text has an empty sketch; equal
texts have equal sketches; two empty sketches are alike (1.0) only if both texts
are equal, an empty and a filled one are unlike (0.0). Repeated rows and keys are
sketched each, in order of key, then text; an empty table gives no rows. Named columns
pass through, and one named fingerprint is refused with ValueError. Memory follows the
longest text of a task: about 100 bytes a code point while it is sketched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import free, partitions, settle, slices, unlike

SHINGLE = 16
#: 1 of KEPT hashes stays (a power of two); the top bits of what stays are zero, the next 32 are written.
KEPT = 4
#: Hex digits after which a batch of results is handed on.
BATCH_DIGITS = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
LEAST = -(1 << 63)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def sketch(points: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """Sorted 32-bit entries for an array of code points."""
    if not len(points):
        return np.empty(0, dtype=np.uint32)
    edge = SHINGLE - 1
    c = np.zeros(len(points) + 2 * edge, dtype=np.uint64)
    c[edge:-edge] = points
    c[edge:-edge] += np.uint64(1)
    up, down = _power(len(c))
    total = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum(c * down, out=total[1:])
    h = (total[SHINGLE:] - total[:-SHINGLE]) * up[: len(c) - edge]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    last, shift = np.uint64((1 << 64) // kept - 1), np.uint64(64 - (kept.bit_length() - 1) - 32)
    return np.unique((h[h <= last] >> shift).astype(np.uint32))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def packed(entries: np.ndarray) -> str:
    """Eight hex digits an entry, ascending."""
    return entries.astype(">u4").tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def merged(*fingerprints: str) -> str:
    """The fingerprint of the union of the documents' shingles."""
    return packed(np.unique(np.concatenate([unpacked(f) for f in fingerprints])))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def resemblance(a: np.ndarray, b: np.ndarray, equal: bool = False) -> float:
    """Estimated share of the joint shingles that both texts have."""
    if not len(a) or not len(b):
        return float(equal)
    both = _common(a, b)
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, equal: bool = False) -> float:
    """Estimated share of the first text's shingles that the second has."""
    if not len(a) or not len(b):
        return float(equal)
    return _common(a, b) / len(a)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, with fingerprint."""
    unlike(keep, ("fingerprint",))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            made = [packed(sketch(points_of(t.as_py() or ""))) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.string())], names=[*keep, "fingerprint"])
        settle()

    name = free("text", docs.select(*keep))
    return docs.select(*keep, F.col(text).alias(name)).mapInArrow(run, f"{fields}, fingerprint string")


def with_next(docs: DataFrame, each, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stream every document with the one that follows it by ``key`` (after the last: the first).

    Ranges of the key are dealt to tasks and sorted there; a range also gets the
    first row of the next range as a guest. Only range bounds and first keys, one
    of each a range, reach the driver. Ties follow in order of text; a null key
    is the smallest. ``each`` maps an iterator of (key, text, next text) to an
    iterator of Arrow batches.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key), F.lit(LEAST)).alias("o"), F.coalesce(text, F.lit("")).alias("t"))
    ids = rows.select("o")
    cuts = ids.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, o.to_numpy(), side="left").astype(np.int32))

    firsts = {r.b: r.o for r in ids.groupBy(range_of("o").alias("b")).agg(F.min("o").alias("o")).collect()}
    order = sorted(firsts)
    after = [(b, firsts[c]) for b, c in zip(order, order[1:] + order[:1])]
    following = spark.createDataFrame(after, "b int, o long")  # a row for each range
    guests = rows.select("o", "t").join(F.broadcast(following), "o").groupBy("b", "o").agg(F.min("t").alias("t"))
    guests = guests.select("b", F.lit(1).alias("guest"), F.lit(None).cast("long").alias("k"), "o", "t")
    dealt = rows.select(range_of("o").alias("b"), F.lit(0).alias("guest"), "k", "o", "t").unionByName(guests)
    dealt = dealt.repartition(n, "b").sortWithinPartitions("b", "guest", "o", "t").select("guest", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            held = None
            for batch in batches:
                for guest, k, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if held:
                        yield (*held, t)
                    held = None if guest else (k, t)

        yield from each(pairs())
        settle()

    return dealt.mapInArrow(run, schema)


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_edited double, contained_next double"
)


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text (the last quarter replaced from
    the next document) and compare it with that text and with the next document."""

    def each(pairs):
        known: tuple[str, np.ndarray] | None = None
        out: list[tuple] = []
        digits = 0
        for k, text, then in pairs:
            own = known[1] if known and known[0] is text else sketch(points_of(text))
            other = sketch(points_of(then))
            known = (then, other)
            cut = len(text) // 4
            changed = text[: len(text) - cut] + then[:cut]
            made = sketch(points_of(changed))
            same, alike = changed == text, then == text
            out.append(
                (k, len(text), hashlib.sha256(changed.encode()).hexdigest(), packed(own), packed(made))
                + (resemblance(own, made, same), resemblance(own, other, alike), containment(own, made, same), containment(own, other, alike))
            )
            digits += 8 * (len(own) + len(made))
            if len(out) == 500 or digits >= BATCH_DIGITS:
                yield _batch(out)
                out, digits = [], 0
        if out:
            yield _batch(out)

    return with_next(docs, each, EDITED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    names = [f.split()[0] for f in EDITED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
