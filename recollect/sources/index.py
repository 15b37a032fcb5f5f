"""The frozen retrieval index: pages, chunks with vectors, links and a manifest."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate

SCHEMA_VERSION = 1
MATRIX_ROWS = 4096


@dataclass(frozen=True)
class MemoryIndex:
    pages: DataFrame
    chunks: DataFrame
    links: DataFrame
    manifest: DataFrame | None = None

    @property
    def documents(self) -> DataFrame:
        """(page_id, title, body)."""
        from ..operators.entities import bodies

        return self.pages.select("page_id", "title").join(bodies(self.chunks), "page_id", "left").select(
            "page_id",
            "title",
            F.coalesce("body", F.lit("")).alias("body"),
        )


def stable_pages(raw: DataFrame) -> DataFrame:
    """page_id is 'source:slug'."""
    return raw.withColumn("page_id", F.concat_ws(":", "source_id", "slug"))


def stable_chunks(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id is 'page:index'; raw chunks refer to raw page ids (column id of ``pages``)."""
    named = raw.join(pages.select(F.col("id").alias("raw_page"), "page_id"), raw["page_id"] == F.col("raw_page")).drop(raw["page_id"], "raw_page")
    return named.withColumn("chunk_id", F.concat_ws(":", "page_id", "chunk_index"))


def stable_links(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Both ends resolved to stable ids; an unresolved end stays null for validation."""
    ids = pages.select("id", "page_id")
    source = ids.select(F.col("id").alias("from_page_id"), F.col("page_id").alias("source_page_id"))
    target = ids.select(F.col("id").alias("to_page_id"), F.col("page_id").alias("target_page_id"))
    out = raw.join(source, "from_page_id", "left").join(target, "to_page_id", "left")
    return out.select("source_page_id", "target_page_id", F.coalesce("link_type", F.lit("")).alias("link_type"), F.col("link_source").alias("provenance")).orderBy(
        "source_page_id", "target_page_id", "link_type", F.coalesce("provenance", F.lit(""))
    )


# Server prefixes of model names.
MODEL_PREFIXES = ("llama-server:", "sentence-transformers:")


def canonical_model(model: Column) -> Column:
    out = F.coalesce(model, F.lit(""))
    for prefix in MODEL_PREFIXES:
        out = F.when(out.startswith(prefix), F.substring(out, F.lit(len(prefix) + 1), F.length(out))).otherwise(out)
    return out


def export_issues(pages: DataFrame, chunks: DataFrame, links: DataFrame, model: str, dimensions: int) -> DataFrame:
    """What keeps raw tables from export, as rows: chunks (id, page_id, model, embedding_signature, embedding)
    without page, of another signature (which goes before the model) or model, or of another width;
    links (from_page_id, to_page_id) to or from no page."""
    signed = F.col("embedding_signature").isNotNull()
    fits_signature = F.col("embedding_signature") == f"{model}:{dimensions}"
    parts = [
        validate.issue(chunks.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_anti"), "id", "chunk references missing page"),
        validate.issue(chunks.filter(signed & ~fits_signature), "id", "unexpected embedding signature"),
        validate.issue(chunks.filter(~signed & (canonical_model(F.col("model")) != model)), "id", "unexpected model"),
        validate.issue(chunks.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dimensions), "id", "unexpected vector width"),
    ]
    for end in ("from_page_id", "to_page_id"):
        parts.append(validate.issue(links.join(pages.select(F.col("id").alias(end)), end, "left_anti"), end, "link references a missing page"))
    return reduce(DataFrame.unionByName, parts)


def export(pages: DataFrame, chunks: DataFrame, links: DataFrame, path: str, corpus_id: str, model: str, dimensions: int) -> None:
    """Raw tables to a frozen index, refused with ValueError if anything is wrong with them."""
    wrong = export_issues(pages, chunks, links, model, dimensions).head(20)
    if wrong:
        raise ValueError("export refused: " + "; ".join(f"{r.id}: {r.message}" for r in wrong))
    named = stable_pages(pages)
    cut = stable_chunks(chunks, named).select("chunk_id", "page_id", "chunk_index", F.col("chunk_text").alias("text"), "embedding")
    kept = named.select("page_id", "source_id", "slug", "title", F.coalesce("perturbations", F.array().cast("array<string>")).alias("perturbations"))
    kept, cut = kept.orderBy("source_id", "slug"), cut.orderBy("page_id", "chunk_index", "chunk_id")
    write_index(MemoryIndex(kept, cut, stable_links(links, named)), path, corpus_id, model, dimensions)


def read_matrix(spark: SparkSession, path: str, rows: int, dimensions: int) -> DataFrame:
    """(row, vector) of a two-dimensional .npy file of floats; ValueError for another shape, type or what is not finite.

    The file is mapped, not read, on the driver, and handed on in slices.
    """
    matrix = np.load(path, mmap_mode="r", allow_pickle=False)
    if matrix.ndim != 2 or matrix.shape != (rows, dimensions):
        raise ValueError(f"matrix has shape {matrix.shape}, not {(rows, dimensions)}")
    if not np.issubdtype(matrix.dtype, np.floating):
        raise ValueError(f"matrix holds {matrix.dtype}, not floats")
    width, kind, start = matrix.shape[1] * matrix.dtype.itemsize, matrix.dtype.str, matrix.offset
    if not matrix.flags["C_CONTIGUOUS"]:
        raise ValueError("matrix is not stored row by row")
    blocks = spark.range(0, rows, MATRIX_ROWS, numPartitions=max(1, rows // MATRIX_ROWS))

    def read(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                with open(path, "rb") as file:
                    file.seek(start + first * width)
                    part = np.frombuffer(file.read(min(MATRIX_ROWS, rows - first) * width), dtype=kind).reshape(-1, dimensions)
                if not np.isfinite(part).all():
                    raise ValueError("matrix holds values that are not finite")
                ends = np.arange(0, part.size + 1, dimensions, dtype=np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), values], names=["row", "vector"])

    return blocks.mapInArrow(read, "row long, vector array<float>")


def content_digest(table: DataFrame) -> DataFrame:
    """An order-free digest of a table: rows are hashed where they are, sums meet."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(table.columns)])), 256)
    halves = [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k, x in enumerate(halves)]
    return table.agg(F.count("*").alias("n"), *sums).select(
        F.col("n").alias("rows"),
        F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3"), 256).alias("digest"),
    )


def write_index(index: MemoryIndex, path: str, corpus_id: str, model: str, dimensions: int) -> None:
    """Write once: an existing index is refused. All goes to a folder beside ``path`` that takes
    its name at the end, so that a run that fails leaves nothing in the way of the next."""
    spark = index.pages.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, made = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"))
    files = target.getFileSystem(conf)
    if files.exists(target):
        raise FileExistsError(f"{path} exists")
    tables = {"pages": index.pages, "chunks": index.chunks, "links": index.links}
    try:
        for name, table in tables.items():
            table.write.parquet(f"{made}/{name}")
        found = {name: content_digest(spark.read.parquet(f"{made}/{name}")).first() for name in tables}
        row = spark.range(1).select(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.lit(corpus_id).alias("corpus_id"),
            F.lit(whole_digest({n: r.digest for n, r in found.items()})).alias("content_hash"),
            F.lit(model).alias("embedding_model"),
            F.lit(dimensions).alias("embedding_dimensions"),
            F.create_map(*[F.lit(x) for n, r in found.items() for x in (n, r.rows)]).alias("counts"),
            F.create_map(*[F.lit(x) for n, r in found.items() for x in (n, r.digest)]).alias("artifact_hashes"),
        )
        row.write.json(f"{made}/manifest")
        if files.exists(target) or not files.rename(made, target):
            raise FileExistsError(f"{path} exists")
    finally:
        files.delete(made, True)


def whole_digest(digests: dict[str, str]) -> str:
    return hashlib.sha256("".join(digests[n] for n in sorted(digests)).encode()).hexdigest()


def read_index(spark: SparkSession, path: str, model: str | None = None, dimensions: int | None = None) -> MemoryIndex:
    """Read and verify an index; raises ValueError naming what is wrong."""
    from ..schemas import MANIFEST

    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    stated = manifest.first()
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("pages", "chunks", "links")}
    wrong = []
    if stated.schema_version != SCHEMA_VERSION:
        wrong.append("schema version")
    if model is not None and stated.embedding_model != model:
        wrong.append("embedding model")
    if dimensions is not None and stated.embedding_dimensions != dimensions:
        wrong.append("embedding dimensions")
    if stated.content_hash != whole_digest(stated.artifact_hashes or {}):
        wrong.append("content hash")
    for name, table in tables.items():
        real = content_digest(table).first()
        if stated.counts.get(name) != real.rows:
            wrong.append(f"count of {name}")
        elif stated.artifact_hashes.get(name) != real.digest:
            wrong.append(f"hash of {name}")
    if not wrong:
        wrong = [
            f"{r.id}: {r.message}" for r in validate.index_issues(tables["pages"], tables["chunks"], tables["links"], stated.embedding_dimensions).head(20)
        ]
    if wrong:
        raise ValueError("index is invalid: " + "; ".join(wrong))
    return MemoryIndex(tables["pages"], tables["chunks"], tables["links"], manifest)


def live_extract(pages: DataFrame, chunks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From live tables: pages not deleted; their text chunks that have a vector; links between them."""
    kept = pages.filter("deleted_at is null")
    ids = kept.select(F.col("id").alias("page_id"))
    text = chunks.filter("modality = 'text' and embedding is not null").join(ids, "page_id", "left_semi")
    both = links.join(ids.withColumnRenamed("page_id", "from_page_id"), "from_page_id", "left_semi").join(
        ids.withColumnRenamed("page_id", "to_page_id"),
        "to_page_id",
        "left_semi",
    )
    return kept, text, both
