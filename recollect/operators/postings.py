"""A stored, impact-ordered index of postings, and exact BM25 over it that skips what cannot rank.

One scan of the texts writes ``tokens``: a row a document with its length and terms. All
else is made from it: the statistics from its lengths; ``counts``, a row a document and term; ``blocks``,
the postings by term, and within a term by bands of impact (what a posting adds to a
score for each unit of the query term's weight, in fractions of an octave), each band in
blocks that a hash of the document splits, so that a term of all documents lies in many
rows and tasks; ``bands``, which sums up the blocks of a band and states its largest impact.

The best k of a query are found without scoring every document:

1. the postings that lead the query's best bands are summed, and the k documents that come out
   first are scored in full; the least of these scores is one that the result reaches at least (theta);
2. the largest level is taken such that postings which add less than it add up to at most a share
   of theta (the sum over terms of the smaller of level and the term's largest part). Bands below the level
   are not read for this query: as a rule those of the frequent words. What is read meets in cells of
   some thousand documents and some hundred queries, where sums are arrays; a cell hands on
   only documents whose bound (sum and what can be unread) reaches theta and its own k-th sum;
3. of these the ones whose bound reaches the k-th sum of all cells are scored in full from ``counts``.

Nothing is estimated: the result is that of scoring every posting. ``rank_once`` ranks without
a stored index: only postings of terms that some query asks for are gathered, in blocks of
documents, and the cells read all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..session import erase, settled, shared_dir, spread, temporary

K1, B = 1.5, 0.75
#: Scores that agree to so many decimals tie, so that the order of summation cannot change a rank.
TIE = 12
#: Parts of a score are split at the first of these fractions of one and cut at the second, so that their sums are exact: at some 280
#: a sum of doubles errs by more than the last of TIE decimals allows for, and copies of a text would not tie.
COARSE, FINE = float(1 << 20), float(1 << 62)
#: Documents, about, and queries of a cell.
SHARD, CHUNK = 4096, 512
#: Queries of a cell whose parts are made at a time: what a task holds besides a cell's sums is so many rows of a matrix.
STRIP = 64
#: Rows of queries' terms, about, that are broadcast at a time, and cells' worth of documents, about, that a task reads at most.
PAIRS, SHARDS = 1 << 20, 8
#: Terms, about, that are counted at a time.
STRETCH = 1 << 20
#: Bands of impact in an octave.
BANDS = 2
#: Postings that the first step unpacks for each wanted result.
LEADS = 64
#: Share of theta that postings which are never read may add up to: the less, the more
#: postings are read and the fewer documents are scored in full.
UNREAD = 0.25
#: Least share of a query's postings that has to stay unread to be worth scoring documents in full.
SAVED = 0.2
#: Bounds give way by this much, so that rounding cannot lose a document.
SLACK = 1e-9


@dataclass(frozen=True)
class Postings:
    """counts: doc, term, tf, len; blocks: term, band, salt, entries (doc, tf, len); bands: term, band, n, top."""

    counts: DataFrame
    blocks: DataFrame
    bands: DataFrame
    n_docs: int
    avg_len: float
    path: str

    def erase(self) -> None:
        erase(self.bands.sparkSession, self.path)

    def impact(self, tf: Column, length: Column) -> Column:
        return impact(tf, length, self.avg_len)


def impact(tf: Column, length: Column, avg_len: float) -> Column:
    ratio = length / F.lit(avg_len) if avg_len > 0 else F.lit(0.0)
    return tf / (tf + K1 * (1 - B + B * ratio))


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, len, terms): the one pass over the texts."""
    toks = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))).select("doc", T.tokens(F.col("text")).alias("terms"))
    return toks.select("doc", F.size("terms").alias("len"), "terms")


def statistics(tokens: DataFrame) -> tuple[int, float]:
    """(documents, mean length), empty documents included."""
    n, total = tokens.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return n, total / n if n else 0.0


def unique(rows: DataFrame, key: str) -> bool:
    """Whether no two rows share their key; of the rows the keys alone are shuffled."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def once(row: np.ndarray, terms: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(first, tf) of the terms of rows, each once a row, in order: where it is met first, and how often it occurs."""
    of_row = row * max(1, len(terms.dictionary)) + terms.indices.to_numpy()
    _, first, tf = np.unique(of_row, return_index=True, return_counts=True)
    order = np.argsort(first)
    return first[order], tf[order]


def count_rows(tokens: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, len) of all terms, or those of ``only`` (term). ``tokens`` is a written table: its terms are counted
    where they lie, row by row, and counts meet only where rows share a document."""
    schema = StructType([tokens.schema["doc"], StructField("term", StringType()), StructField("tf", IntegerType()), StructField("len", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
                terms = batch.column(2).slice(at, end - at).flatten().dictionary_encode()
                row = np.repeat(np.arange(at, end), sizes[at:end])
                first, tf = once(row, terms)
                of = pa.array(row[first])
                made = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), terms.take(pa.array(first)).dictionary_decode(), pa.array(tf.astype(np.int32)), batch.column(1).take(of)], names=schema.names
                )
                for n in range(0, made.num_rows, 50_000):
                    yield made.slice(n, 50_000)
                at = end

    rows = tokens.select("doc", "len", "terms").mapInArrow(run, schema)
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows if unique(tokens, "doc") else rows.groupBy("doc", "term").agg(F.sum("tf").cast("int").alias("tf"), F.max("len").alias("len"))


def shard(n_docs: int) -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-n_docs // SHARD)))).cast("int")


def block_rows(counts: DataFrame, n_docs: int, avg_len: float) -> DataFrame:
    rows = counts.withColumn("impact", impact(F.col("tf"), F.col("len"), avg_len))
    rows = rows.withColumn("band", F.floor(-F.log2("impact") * BANDS).cast("int"))
    rows = rows.withColumn("salt", shard(n_docs))
    entries = F.collect_list(F.struct("doc", "tf", "len")).alias("entries")
    return rows.groupBy("term", "band", "salt").agg(F.count("*").cast("int").alias("n"), F.max("impact").alias("top"), entries)


def build(docs: DataFrame, key: str, text: str, path: str | None = None, only: DataFrame | None = None) -> Postings:
    """Index the texts under ``path`` (without one: a folder of the shared one, to be erased by the
    caller), of the terms of ``only`` (term) if given."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/recollect-postings-{uuid.uuid4().hex}"
    token_rows(docs, key, text).write.parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    n_docs, avg_len = statistics(tokens)
    count_rows(tokens, only).write.parquet(f"{path}/counts")
    write_blocks(spark, path, n_docs, avg_len)
    return read(spark, path)


def write_blocks(spark: SparkSession, path: str, n_docs: int, avg_len: float) -> None:
    """Blocks sorted by term and band, so that a reader's filters skip row groups; their summary; the statistics."""
    blocks = block_rows(spark.read.parquet(f"{path}/counts"), n_docs, avg_len)
    blocks.sortWithinPartitions("term", "band").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("term", "band").agg(F.sum("n").alias("n"), F.max("top").alias("top")).write.parquet(f"{path}/bands")
    spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(avg_len).cast("double").alias("avg_len")).write.parquet(f"{path}/statistics")


def read(spark: SparkSession, path: str) -> Postings:
    """A written index."""
    stated = spark.read.parquet(f"{path}/statistics").first()
    return Postings(*(spark.read.parquet(f"{path}/{name}") for name in ("counts", "blocks", "bands")), stated.n_docs, stated.avg_len, path)


# -- scores ------------------------------------------------------------------------------


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, term, mult): repeated terms count repeatedly."""
    terms = queries.select(F.col(key).alias("query_id"), F.explode(T.tokens(F.col(text))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("mult"))


def numbered(queries: DataFrame) -> DataFrame:
    """(query_id, number, terms): a row for each query with terms, numbered; written, so that numbers stay."""
    terms = query_terms(queries).groupBy("query_id").agg(F.collect_list(F.struct("term", "mult")).alias("terms"))
    return settled(terms.withColumn("number", F.monotonically_increasing_id()))


def weights(asked: DataFrame, frequency: DataFrame, n_docs: int) -> DataFrame:
    """asked: (query_id, term, mult); frequency: (term, df) and more. With weight: what a posting's impact is multiplied by."""
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(frequency, "term").withColumn("weight", F.col("mult") * idf * (K1 + 1)).drop("mult", "df")


def _by_number(queries: DataFrame) -> DataFrame:
    """The terms of numbered queries, query_id being the number."""
    return queries.select(F.col("number").alias("query_id"), F.inline("terms"))


def scored(met: DataFrame, index: Postings) -> DataFrame:
    """Rows with weight, tf and len of each posting of a (query_id, doc) to its score."""
    part = F.col("weight") * index.impact(F.col("tf"), F.col("len"))
    return met.groupBy("query_id", "doc").agg(exact_sum(part).alias("score"))


def exact_sum(part: Column) -> Column:
    """The sum of numbers that are not negative, the same in whatever order they come: their leading and their further
    binary places are added as whole numbers."""
    lead = F.floor(part * COARSE)
    rest = F.floor((part - lead / COARSE) * FINE)
    return F.sum(lead) / COARSE + F.sum(rest) / FINE


def all_scores(queries: DataFrame, index: Postings) -> DataFrame:
    """(query_id, doc, score) of every document that shares a term with the query."""
    frequency = index.bands.groupBy("term").agg(F.sum("n").alias("df"))
    return scored(weights(query_terms(queries), frequency, index.n_docs).join(index.counts, "term"), index)


def scores_of(pairs: DataFrame, asked: DataFrame, index: Postings) -> DataFrame:
    """(query_id, doc, score) of stated pairs (query_id, doc), in full."""
    terms = pairs.select("query_id", "doc").join(asked.select("query_id", "term", "weight"), "query_id")
    return scored(terms.join(index.counts, ["doc", "term"]), index)


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "doc") -> DataFrame:
    """One-based ranks by score descending, then id ascending; rank <= k."""
    order = W.partitionBy(*by).orderBy(F.round(score, TIE).desc(), F.col(tie).asc())
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def banded(asked: DataFrame, index: Postings) -> DataFrame:
    """asked (query_id, term, mult) with weight, the largest part of a score that the term can give (most), and its bands: band,
    the postings of the band (n) and the largest part that they give (reach)."""
    of_term = index.bands.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("most"))
    rows = weights(asked, of_term, index.n_docs).join(index.bands, "term")
    return rows.select("query_id", "term", "weight", (F.col("weight") * F.col("most")).alias("most"), "band", "n", (F.col("weight") * F.col("top")).alias("reach"))


def reached(bands: DataFrame, index: Postings, k: int) -> DataFrame:
    """(query_id, theta): a sum that the score of the k-th best document reaches at least; queries with fewer leads are absent."""
    order = W.partitionBy("query_id").orderBy(F.desc("reach"), "term", "band").rowsBetween(W.unboundedPreceding, -1)
    lead = bands.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("before") < LEADS * k)
    met = lead.join(index.blocks.select("term", "band", "salt", "entries"), ["term", "band"]).filter((F.col("n") <= SHARD) | (F.col("salt") == 0))
    some = top_k(scored(met.select("query_id", "weight", F.inline("entries")), index), k)
    return some.filter(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))


def levels(bands: DataFrame, theta: DataFrame) -> DataFrame:
    """bands with theta, level (bands that add less are not read), least (what an unread posting of the term can
    add) and rest (the sum of least over the query's terms).

    Where less than SAVED of a query's postings would stay unread, all are read.
    """
    rows = bands.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)) * (1 - SLACK))
    of_query = W.partitionBy("query_id")
    first = F.row_number().over(W.partitionBy("query_id", "term").orderBy("band")) == 1
    rows = rows.withColumn("own", F.when(first, F.col("most")))  # each term counts once
    order = of_query.orderBy("most", "term", "band")
    rows = rows.withColumn("before", F.coalesce(F.sum("own").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("left", F.count("own").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = F.when(F.col("own").isNotNull(), (UNREAD * F.col("theta") - F.col("before")) / F.col("left"))
    rows = rows.withColumn("level", F.greatest(F.max(level).over(of_query), F.lit(0.0)) * (1 - SLACK))
    unread = F.sum(F.when(F.col("reach") < F.col("level"), F.col("n")).otherwise(0)).over(of_query)
    rows = rows.withColumn("level", F.when(unread >= SAVED * F.sum("n").over(of_query), F.col("level")).otherwise(0.0))
    rows = rows.withColumn("least", F.least("level", "most"))
    return rows.withColumn("rest", F.coalesce(F.sum(F.when(F.col("own").isNotNull(), F.col("least"))).over(of_query), F.lit(0.0))).drop("own", "before", "left")


def kth_best(tops: dict[int, np.ndarray], numbers: list[int], sums: np.ndarray, k: int) -> np.ndarray:
    """The k-th best sum of each query so far. ``tops`` holds the k best of each as an array of its own: a view would keep
    the matrix that it was cut from, for every strip of queries of a task."""
    nothing = np.zeros(k)
    top = np.hstack([np.stack([tops.get(n, nothing) for n in numbers]), sums])
    top.partition(top.shape[1] - k, axis=1)
    tops.update((n, best[-k:].copy()) for n, best in zip(numbers, top))
    return top[:, -k].copy()


def candidates(asked: DataFrame, blocks: DataFrame, by: list[str], avg_len: float, k: int, n_docs: int) -> DataFrame:
    """(query_id, doc, partial, bound, rest) of the documents that a task cannot rule out. Written to the shared folder.

    asked: query_id (a number), weight, least, rest, theta and the columns ``by`` at which it meets the blocks. Queries come in groups of
    some PAIRS rows; each is broadcast to the blocks, which are shuffled once a group and lie by documents.
    """
    asked = settled(asked.select("query_id", *by, "weight", "least", "rest", "theta"))
    n_groups = max(1, -(-asked.count() // PAIRS))
    group = F.pmod(F.xxhash64("query_id"), F.lit(n_groups))
    found = [settled(_candidates_of(asked.filter(group == g), blocks, by, avg_len, k, n_docs)) for g in range(n_groups)]
    return reduce(DataFrame.unionByName, found)


def _candidates_of(asked: DataFrame, blocks: DataFrame, by: list[str], avg_len: float, k: int, n_docs: int) -> DataFrame:
    listed = asked.groupBy(*by).agg(F.collect_list(F.struct("query_id", "weight", "least", "rest", "theta")).alias("asked"))
    n_parts = max(blocks.sparkSession.sparkContext.defaultParallelism * 2, -(-n_docs // (SHARD * SHARDS)))
    wanted = blocks.select(*by, "salt", "entries").join(F.broadcast(listed.select(*by)), by, "left_semi")  # at most about PAIRS rows
    met = wanted.repartition(n_parts, "salt").join(F.broadcast(listed), by).select("salt", "entries", "asked")
    dealt = met.sortWithinPartitions("salt")
    doc_type = blocks.schema["entries"].dataType.elementType["doc"].dataType
    schema = StructType(
        [
            StructField("query_id", LongType()),
            StructField("doc", doc_type),
            StructField("partial", DoubleType()),
            StructField("bound", DoubleType()),
            StructField("rest", DoubleType()),
        ]
    )

    def one(cell: pa.Table, tops: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The documents of a cell that can rank: rows hold postings of a term, and the queries that ask for it. ``tops``
        holds the k best sums of each query in the task's cells so far."""
        entries, asked = (cell.column(c).combine_chunks() for c in ("entries", "asked"))
        posted, wanted = entries.flatten(), asked.flatten()
        docs = posted.field("doc").dictionary_encode(null_encoding="encode")
        tf, length = (posted.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "len"))
        add = tf / (tf + K1 * (1 - B + B * (length / avg_len if avg_len > 0 else 0.0)))
        d = docs.indices.to_numpy()
        ends = np.r_[0, np.cumsum(entries.value_lengths().to_numpy())].tolist()
        term = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
        numbers, first, q = np.unique(wanted.field("query_id").to_numpy(), return_index=True, return_inverse=True)
        weight, least, rest, theta = (wanted.field(c).to_numpy() for c in ("weight", "least", "rest", "theta"))
        order = np.argsort(q // CHUNK, kind="stable")  # by queries of a cell, then by rows
        cuts = np.searchsorted(q[order] // CHUNK, np.arange(-(-len(numbers) // CHUNK) + 1))
        for c, (start, end) in enumerate(zip(cuts, cuts[1:])):
            mine, at_ = order[start:end], slice(c * CHUNK, (c + 1) * CHUNK)
            lead, unread = np.zeros((2, len(numbers[at_]), len(docs.dictionary)))
            further = np.zeros(lead.shape, np.int64)
            for x in np.split(mine, np.flatnonzero(np.diff(term[mine])) + 1):
                a, b = ends[term[x[0]]], ends[term[x[0]] + 1]
                for some in np.split(x, range(STRIP, len(x), STRIP)):
                    at = np.ix_(q[some] - c * CHUNK, d[a:b])
                    part = weight[some, None] * add[None, a:b]
                    whole = np.floor(part * COARSE)
                    lead[at] += whole
                    further[at] += np.floor((part - whole / COARSE) * FINE).astype(np.int64)
                    unread[at] += least[some, None]
            for strip in np.split(np.arange(len(lead)), range(STRIP, len(lead), STRIP)):
                asking, of = numbers[at_][strip], first[at_][strip]
                partial = lead[strip] / COARSE + further[strip] / FINE
                bound = partial + (rest[of, None] - unread[strip])
                least_ = np.maximum(theta[of], (1 - SLACK) * kth_best(tops, asking.tolist(), partial, k))
                row, column = np.nonzero((bound >= least_[:, None]) & (partial > 0))
                made = pa.RecordBatch.from_arrays(
                    [pa.array(asking[row]), docs.dictionary.take(pa.array(column)), pa.array(partial[row, column]), pa.array(bound[row, column]), pa.array(rest[of][row])],
                    names=[f.name for f in schema],
                )
                for n in range(0, made.num_rows, 10_000):
                    yield made.slice(n, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tops: dict[int, np.ndarray] = {}
        at = None
        for batch in batches:
            salt = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, salt[1:] != salt[:-1]]) if batch.num_rows else []
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                if held and salt[start] != at:
                    yield from one(pa.Table.from_batches(held), tops)
                    held = []
                at = salt[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield from one(pa.Table.from_batches(held), tops)

    return dealt.mapInArrow(run, schema)


def best(queries: DataFrame, index: Postings, k: int) -> DataFrame:
    """(query_id, doc, score, rank) of the k best documents of each query: those of ``all_scores``, from a part of its
    postings. Written to the shared folder."""
    with temporary(queries.sparkSession) as kept:
        names = numbered(queries)
        asked = _by_number(names)
        bands = settled(banded(asked, index))
        read_ = levels(bands, reached(bands, index, k)).filter("reach >= level")
        found = candidates(read_, index.blocks, ["term", "band"], index.avg_len, k, index.n_docs)
        kth = top_k(found, k, score="partial").filter(F.col("rank") == k).select("query_id", (F.col("partial") * (1 - SLACK)).alias("kth"))
        open_ = found.join(kth, "query_id", "left").filter("kth is null or bound >= kth")
        whole = open_.filter("rest = 0").select("query_id", "doc", F.col("partial").alias("score"))
        part = open_.filter("rest > 0")
        by_term = bands.select("query_id", "term", "weight").distinct()
        scores = whole if part.isEmpty() else whole.unionByName(scores_of(part, by_term, index))
        return kept(settled(_named(top_k(scores, k), names)))


def _named(ranked: DataFrame, names: DataFrame) -> DataFrame:
    return ranked.withColumnRenamed("query_id", "number").join(names, "number").select("query_id", "doc", "score", "rank")


def rank_once(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """As ``best``, for texts without an index: one scan of them, nothing kept. Written to the shared folder."""
    with temporary(queries.sparkSession) as kept:
        names = numbered(queries)
        asked = _by_number(names)
        tokens = settled(token_rows(docs, key, text))
        n_docs, avg_len = statistics(tokens)
        counted = count_rows(tokens, asked).withColumn("salt", shard(n_docs))
        entries = F.collect_list(F.struct("doc", "tf", "len")).alias("entries")
        blocks = settled(counted.groupBy("term", "salt").agg(F.count("*").alias("n"), entries))
        weighted = weights(asked, blocks.groupBy("term").agg(F.sum("n").alias("df")), n_docs)
        nothing = F.lit(0.0)
        weighted = weighted.select("query_id", "term", "weight", nothing.alias("least"), nothing.alias("rest"), nothing.alias("theta"))
        found = candidates(weighted, blocks, ["term"], avg_len, k, n_docs)
        return kept(settled(_named(top_k(found.withColumnRenamed("partial", "score"), k), names)))


def reading(queries: DataFrame, index: Postings, k: int) -> DataFrame:
    """(query_id, postings, unread): of the postings of a query's terms how many ``best`` leaves out in its second step."""
    bands = banded(query_terms(queries), index)
    rows = levels(bands, reached(bands, index, k))
    return rows.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("reach") < F.col("level"), F.col("n")).otherwise(0)).alias("unread"))
