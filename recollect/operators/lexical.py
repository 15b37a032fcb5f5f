"""Lexical search: term tables, and BM25 for many queries at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..session import settled
from .postings import TIE, Postings, all_scores, best, build, once, query_terms, rank_once, top_k, unique

__all__ = ["TIE", "bm25", "bm25_rank", "corpus_stats", "document_frequency", "first_documents", "postings", "query_terms", "term_places", "tokenized", "top_k", "unique"]

#: Bytes of texts, about, that are cut into terms at a time.
STRETCH = 4 << 20
#: Which bytes belong to a term; all others, those of other letters too, separate.
OF_TERMS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, terms): one pass over the texts."""
    return docs.select(F.col(key).alias("doc"), T.tokens(F.col(text)).alias("terms"))


def _places(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, term, tf, place) of the terms of folded texts, each once a text, by text and first place (from 1)."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    held = OF_TERMS[letters]
    goes_on = np.r_[False, held][: len(held)]
    goes_on[ends[:-1][ends[:-1] < len(held)]] = False  # no term crosses texts
    starts = np.flatnonzero(held & ~goes_on)
    before = np.cumsum(held, dtype=np.int32)
    offsets = np.r_[before[starts] - 1, before[-1:] if len(held) else 0].astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[held])).dictionary_encode()
    row = np.searchsorted(ends, starts, "right") - 1
    first, tf = once(row, terms)
    row = row[first]
    began = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    place = np.arange(len(row)) - np.repeat(began, np.diff(np.r_[began, len(row)])) + 1
    return row, terms.take(pa.array(first)).dictionary_decode(), tf, place


def term_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, tf, place) of each text's terms, each once: how often it occurs, and its place among the text's terms in order of
    first appearance, from 1. Nothing is shuffled; the texts of one key in several rows are told apart."""
    schema = StructType([StructField("doc", docs.schema[key].dataType), StructField("term", StringType()), StructField("tf", LongType()), StructField("place", IntegerType())])
    folded = docs.select(F.col(key).alias("doc"), T.folded_for_tokens(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH, "right")))
                row, terms, tf, place = _places(texts.slice(at, end - at))
                ids = batch.column(0).take(pa.array(row + at))
                made = pa.RecordBatch.from_arrays([ids, terms, pa.array(tf.astype(np.int64)), pa.array(place.astype(np.int32))], names=schema.names)
                for n in range(0, made.num_rows, 50_000):
                    yield made.slice(n, 50_000)
                at = end

    return folded.mapInArrow(run, schema)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, tf), counted where the texts lie; only where rows share an id their counts meet."""
    rows = term_places(docs, key, text).select("doc", "term", "tf")
    return rows if unique(docs, key) else rows.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """posted: (doc, term), each once. A null is no document."""
    return posted.groupBy("term").agg(F.count("doc").alias("df"))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: documents and mean length, empty documents included."""
    return toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, doc, score) of every document that shares a term with the query, from one scan of the texts."""
    index = build(docs, key, text, only=query_terms(queries))
    scores = settled(all_scores(queries, index))
    index.erase()
    return scores


def first_documents(docs: DataFrame, key: str, k: int) -> DataFrame:
    """The k smallest ids with ranks: what a query without tokens gets."""
    least = docs.select(F.col(key).alias("doc")).orderBy("doc").limit(k)
    return least.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("doc")))


def bm25_rank(queries: DataFrame, docs: DataFrame, k: int, key: str, text: str, index: Postings | None = None) -> DataFrame:
    """Ranked BM25; a query without any token falls back to the first ids, one whose
    tokens match nothing gets nothing.

    The texts are scanned once; with a written ``index`` of the same texts not at all.
    """
    ranked = best(queries, index, k) if index else rank_once(queries, docs, key, text, k)
    bare = queries.filter(F.size(T.tokens(F.col("query_text"))) == 0).select("query_id")
    if bare.isEmpty():
        return ranked
    fallback = bare.join(settled(first_documents(docs, key, k))).select("query_id", "doc", F.lit(0.0).alias("score"), "rank")  # at most k rows a query
    return ranked.unionByName(fallback)
