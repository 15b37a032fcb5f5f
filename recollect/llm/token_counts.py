"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of little-endian 16- or 32-bit identifiers; every document
ends with the end-of-document identifier, and there is no index. Files are read
whole or in slices of a bounded length, cut into blocks, and each block is
searched for the separator with one vectorised comparison. A block reports the
documents that begin and end in it, and its open head and tail; a prefix scan
over the blocks of a file numbers the documents and stitches those that cross
block boundaries.

Writing uses Spark's text sink: the identifiers of a document are one value and
the separator's bytes are the line separator, so that files are committed whole
or not at all.

Defined results: an empty document counts 0 tokens; identifiers after the last
separator form a document that is marked unfinished; an empty file, or one
without documents, gives no row; a file whose length is no multiple of the
identifier's width raises an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import cut, drop, settle, slices

BLOCK = 1 << 16
#: Identifiers before a document's own that spell its key, in digits of KEY_BASE.
KEY_DIGITS = 5
KEY_BASE = 50_000
#: The number that spells a null key: past all signed 64-bit ones.
NO_KEY = 1 << 64
#: Bytes of a token file, as scans hold one whole; bytes of text that an identifier stands for, at least.
FILE_BYTES, CHARS = 16 << 20, 2.0
_encoders: dict[str, object] = {}


def encoder(ranks: str):
    """A tiktoken encoding of a rank file, built once a worker."""
    if ranks not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[ranks] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks]


def key_digits(key: int | None) -> list[int]:
    """KEY_DIGITS digits below KEY_BASE, least first; never a separator."""
    key = NO_KEY if key is None else (key << 1) if key >= 0 else (~key << 1) | 1  # the sign in the lowest bit
    out = []
    for _ in range(KEY_DIGITS):
        key, digit = divmod(key, KEY_BASE)
        out.append(digit)
    return out


def key_of(digits) -> int | None:
    key = 0
    for digit in reversed(list(digits)):
        key = key * KEY_BASE + int(digit)
    return None if key == NO_KEY else ~(key >> 1) if key & 1 else key >> 1


def write_tokens(
    docs: DataFrame,
    path: str,
    ranks: str,
    separator: int,
    key: str | None = None,
    text: str = "text",
    width: int = 2,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encode texts (null: empty) and write flat files under ``path``.

    With ``key`` each document is led by its key in KEY_DIGITS identifiers. A file holds as many
    documents of average length as fill ``file_bytes``.
    """
    kind = "<u2" if width == 2 else "<u4"
    if key is not None and separator < KEY_BASE:
        raise ValueError("the separator must not be a key digit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in slices(batches, "t"):
            keys = batch.column(0).to_pylist() if key is not None else None
            coded = [own.encode_ordinary(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            if keys is not None:
                coded = [key_digits(k) + ids for k, ids in zip(keys, coded)]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, dtype=kind).tobytes() for ids in coded], pa.binary())], names=["value"])
        settle()

    columns = ([F.col(key).cast("long").alias("k")] if key is not None else []) + [F.col(text).alias("t")]
    end = int(separator).to_bytes(width, "little").decode("latin-1")
    flat = docs.select(*columns).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    mean = docs.agg(F.avg(F.octet_length(text))).first()[0] or 0.0
    rows_per_file = max(1, int(file_bytes / (width * (mean / CHARS + KEY_DIGITS + 1))))
    flat.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rows_per_file).text(path)


def scan_block(ids: np.ndarray, separator: int, lead: int) -> dict:
    """What one block knows: documents inside it, and its open ends."""
    ends = np.flatnonzero(ids == separator)
    if not len(ends):
        return {"n_ends": 0, "head": len(ids), "tail": 0, "head_lead": ids[:lead].tolist(), "tail_lead": [], "sizes": [], "leads": []}
    starts = ends[:-1] + 1
    after = ids[ends[-1] + 1 :]
    return {
        "n_ends": len(ends),
        "head": int(ends[0]),
        "tail": len(after),
        "head_lead": ids[: min(lead, int(ends[0]))].tolist(),
        "tail_lead": after[:lead].tolist(),
        "sizes": np.diff(ends).astype(np.int64) - 1,
        "leads": [ids[a : min(a + lead, b)].tolist() for a, b in zip(starts, ends[1:])] if lead else None,
    }


_BLOCKS = "file string, block long, n_ends long, head long, tail long, head_lead array<int>, tail_lead array<int>, sizes array<long>, leads array<array<int>>"


def scan(spark: SparkSession, path: str, separator: int, width: int = 2, block: int = BLOCK, lead: int = 0) -> DataFrame:
    """One row a document: file, ordinal (from 0), n_ids, lead (its first ``lead`` identifiers), finished."""
    kind = "<u2" if width == 2 else "<u4"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content").filter("length > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("file", pa.string()),
                *[(n, pa.int64()) for n in ("block", "n_ends", "head", "tail")],
                *[(n, pa.list_(pa.int32())) for n in ("head_lead", "tail_lead")],
            ]
            + [("sizes", pa.list_(pa.int64())), ("leads", pa.list_(pa.list_(pa.int32())))]
        )
        for batch in batches:
            for k in range(batch.num_rows):
                name, raw = batch.column(0)[k].as_py(), batch.column(2)[k].as_buffer()
                if raw.size % width:
                    raise ValueError(f"{name}: {raw.size} bytes are no whole number of identifiers")
                ids = np.frombuffer(raw, dtype=kind)
                for at in range(0, len(ids), block):
                    found = scan_block(ids[at : at + block], separator, lead)
                    yield pa.RecordBatch.from_pylist([{"file": name, "block": at // block, **found, "sizes": list(found["sizes"])}], schema)
        settle()

    blocks = cut(files.mapInArrow(run, _BLOCKS), "scanned")  # files are read once; the rest works on what blocks know
    # The prefix scan: separators before each block of the file number its documents.
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    numbered = blocks.withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    inner = numbered.select(
        "file", F.posexplode(
            F.arrays_zip("sizes", F.coalesce("leads", F.transform("sizes", lambda x: F.array().cast("array<int>"))).alias("leads")),
        ).alias("i", "d"), "first"
    ).select("file", (F.col("first") + 1 + F.col("i")).alias("ordinal"), F.col("d.sizes").alias("n_ids"), F.col("d.leads").alias("lead"), F.lit(True).alias("finished"))
    heads = numbered.select(
        "file",
        F.col("first").alias("ordinal"),
        "block",
        F.lit(0).alias("side"),
        F.col("head").alias("n"),
        F.col("head_lead").alias("lead"),
        (F.col("n_ends") > 0).alias("ends"),
    )
    tails = numbered.filter("n_ends > 0").select(
        "file", (F.col("first") + F.col("n_ends")).alias("ordinal"), "block", F.lit(1).alias("side"), F.col("tail").alias("n"), F.col("tail_lead").alias("lead"), F.lit(False).alias("ends")
    )
    parts = heads.unionByName(tails)
    # Of a document's fragments only those that can hold part of its lead keep it.
    so_far = W.partitionBy("file", "ordinal").orderBy("block", "side").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("seen", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    stitched = parts.groupBy("file", "ordinal").agg(
        F.sum("n").alias("n_ids"),
        F.array_sort(F.collect_list(F.when((F.col("seen") < lead) & (F.col("n") > 0), F.struct("block", "side", "lead")))).alias("leads"),
        F.max("ends").alias("finished"),
    )
    stitched = stitched.filter("finished or n_ids > 0").select(
        "file", "ordinal", "n_ids", F.slice(
            F.flatten(F.transform("leads", lambda x: x["lead"])),
            1,
            max(lead, 1),
        ).alias("lead") if lead else F.array().cast("array<int>").alias("lead"), "finished"
    )
    found = inner.unionByName(stitched)
    found._recollect_path = blocks._recollect_path
    return found


def keyed_counts(spark: SparkSession, path: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of files written with a key, as a table of its own: the files may go."""
    found = scan(spark, path, separator, width, block, KEY_DIGITS)
    power, code = 1, F.lit(0).cast("decimal(38,0)")
    for k in range(KEY_DIGITS):
        code = code + F.element_at("lead", k + 1).cast("decimal(20,0)") * F.lit(power).cast("decimal(38,0)")
        power *= KEY_BASE
    half = F.floor(code / 2).cast("decimal(38,0)")
    key = F.when(code == F.lit(str(NO_KEY)).cast("decimal(38,0)"), None).when(code % 2 == 0, half).otherwise(-half - 1).cast("long")
    counted = cut(found.select(key.alias("doc_id"), (F.col("n_ids") - KEY_DIGITS).alias("n_tokens")), "counts")
    drop(found)
    return counted
