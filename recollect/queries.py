"""Queries over the driver's tables, one an operator, with SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import tokenizers
from .operators import balls, caches, dedupe, dense, entities, fusion, lexical, postings, scoring, upkeep, validate
from .plans import retrieve as R
from .session import erase, settled, shared_dir
from .sources import corpus
from .streaming import admission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- SQL fragments ---------------------------------------------------------------


#: What lower() of the SQL engine leaves out of case folding, written down apart from the engine's own table.
SQL_FOLDS = [
    ("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("ẖ", "ẖ"), ("ẗ", "ẗ"), ("ẘ", "ẘ"), ("ẙ", "ẙ"), ("ẚ", "aʾ"),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("µ", "μ"), ("ϐ", "β"), ("ϑ", "θ"), ("ϕ", "φ"), ("ϖ", "π"),
]


def cf(x: str) -> str:
    out = f"lower({x})"
    for old, new in SQL_FOLDS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def toks(x: str) -> str:
    return f"regexp_extract_all({cf(f'coalesce({x}, chr(32))')}, '[a-z0-9]+')"


def surface(x: str) -> str:
    joined = f"trim(regexp_replace({cf(f'coalesce({x}, chr(32))')}, '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN length({joined}) >= 2 THEN {joined} ELSE '' END"


def choice(x: str) -> str:
    return rf"trim(regexp_replace({cf(x)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def bm25_sql(name: str, queries: str, docs: str, text: str) -> str:
    """CTEs name_t, name_p, name_q, name_s and name (query_id, doc, score)."""
    return f"""
{name}_t AS (SELECT doc, {toks(text)} AS w FROM {docs}),
{name}_p AS (SELECT doc, term, COUNT(*) AS tf, MAX(len) AS len FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM {name}_t) GROUP BY doc, term),
{name}_d AS (SELECT term, COUNT(*) AS df FROM {name}_p GROUP BY term),
{name}_n AS (SELECT COUNT(*) AS n_docs, AVG(len(w)) AS avg_len FROM {name}_t),
{name}_q AS (SELECT query_id, term, COUNT(*) AS mult FROM (SELECT query_id, unnest({toks("query_text")}) AS term FROM {queries}) GROUP BY query_id, term),
{name} AS (SELECT query_id, doc, SUM(mult * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))) AS score
  FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_d USING (term) CROSS JOIN {name}_n GROUP BY query_id, doc)"""


def ranked(source: str, k: int, score: str = "score", tie: str = "doc", by: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 12) DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k})"


ITEMS = "items AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
BODIES = "bodies AS (SELECT doc_id AS doc, text AS body, split_part(text, chr(10), 1) AS title FROM documents)"
COS = "coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)"


def items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def bodies(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("title"))


# -- lexical -----------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({cf('text')}) AS folded_sha256, length({cf('text')}) AS n FROM documents")
def case_folding(spark, sf):
    folded = table(spark, sf, "documents").select("doc_id", T.casefold(F.col("text")).alias("t"))
    return folded.select("doc_id", F.sha2("t", 256).alias("folded_sha256"), F.length("t").cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string({toks('text')}, ' ') AS terms FROM documents")
def tokenize_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("terms"))


@query(f"SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL")
def term_frequencies(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "term", "tf")


@query(f"SELECT term, COUNT(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY term")
def document_frequencies(spark, sf):
    return lexical.document_frequency(lexical.postings(table(spark, sf, "documents"), "doc_id", "text"))


@query(f"SELECT term, COUNT(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents WHERE doc_id % 11 <> 4) GROUP BY term")
def updated_frequencies(spark, sf):
    """The documents of every term after an update: some documents changed, some came, some were marked as deleted."""
    docs = table(spark, sf, "documents").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).select("doc_id", "text", "digest")
    old = F.when(F.col("doc_id") % 11 == 2, F.concat(F.lit("an older wording "), "text")).otherwise(F.col("text"))
    before = docs.filter("doc_id % 11 <> 3").withColumn("text", old).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    index = upkeep.Upkeep(spark, f"{shared_dir(spark)}/recollect-upkeep-{uuid.uuid4().hex}")
    index.update(before, "doc_id", "text", "digest")
    index.update(docs.withColumn("deleted_at", F.when(F.col("doc_id") % 11 == 4, "2026-01-01")), "doc_id", "text", "digest")
    out = settled(index.frequencies())
    erase(spark, index.path)
    return out


@query(f"SELECT COUNT(*) AS n_docs, round(AVG(len({toks('text')})), 6) AS avg_len FROM documents")
def corpus_stats(spark, sf):
    return lexical.corpus_stats(lexical.tokenized(table(spark, sf, "documents"), "doc_id", "text")).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def _bm25_top(spark, sf, asked, text):
    return lexical.bm25_rank(asked, bodies(spark, sf), 5, "doc", text).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def _bm25_top_sql(asked: str, text: str) -> str:
    return f"WITH {asked}, {BODIES}, {bm25_sql('s', 'items', 'bodies', text)} SELECT query_id, doc, round(score, 6) AS score, rank FROM {ranked('s', 5)}"


@query(_bm25_top_sql(ITEMS, "body"))
def bm25_body_topk(spark, sf):
    return _bm25_top(spark, sf, items(spark, sf), "body")


@query(_bm25_top_sql(ITEMS, "body"))
def bm25_index_topk(spark, sf):
    """The same search over a stored index of all terms, by bounds."""
    index = postings.build(bodies(spark, sf), "doc", "body")
    ranked = postings.best(items(spark, sf), index, 5)
    index.erase()
    return ranked.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(_bm25_top_sql(ITEMS, "title"))
def bm25_title_topk(spark, sf):
    return _bm25_top(spark, sf, items(spark, sf), "title")


@query(_bm25_top_sql("items AS (SELECT item_id AS query_id, text || ' ' || split_part(text, ' ', 1) || ' ' || text AS query_text FROM benchmark)", "body"))
def bm25_repeated_terms(spark, sf):
    twice = F.concat_ws(" ", "query_text", F.substring_index("query_text", " ", 1), "query_text")
    return _bm25_top(spark, sf, items(spark, sf).withColumn("query_text", twice), "body")


@query(
    _bm25_top_sql("items AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN '?! …' ELSE text END AS query_text FROM benchmark)", "body")
    + " UNION ALL SELECT item_id, doc_id, 0.0, rank FROM benchmark, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents) WHERE item_id % 2 = 0 AND rank <= 5"
)
def bm25_empty_query_fallback(spark, sf):
    some = F.when(F.col("query_id") % 2 == 0, F.lit("?! …")).otherwise(F.col("query_text"))
    return _bm25_top(spark, sf, items(spark, sf).withColumn("query_text", some), "body")


# -- dense ---------------------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page_id"), "embedding", "vec_id")


def _asked(spark, sf):
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(
    f"WITH c AS (SELECT b.vec_id AS query_id, a.vec_id AS page, {COS} AS cosine FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) SELECT query_id, page, round(cosine, 6) AS score, rank FROM {ranked('c', 5, 'cosine', 'page')}",
)
def dense_topk(spark, sf):
    chunks = _vectors(spark, sf).withColumn("page_id", F.col("vec_id"))
    return R.retrieve(_asked(spark, sf), None, chunks, mode="dense").select("query_id", "page", F.round("score", 6).alias("score"), "rank")


@query(ORACLES["dense_topk"])
def dense_ball_topk(spark, sf):
    """The same search, pairs of blocks pruned by their balls."""
    chunks = _vectors(spark, sf).select(F.col("vec_id").alias("page"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    best = balls.best_by_balls(_asked(spark, sf), chunks, 5, block=64)
    return dense.dense_rank(best, 5).select("query_id", "page", F.round("score", 6).alias("score"), "rank")


BEST = f"""c AS (SELECT b.query_id, b.win, a.label AS page, a.vec_id AS chunk, {COS.replace('b.embedding', 'b.v')} AS cosine FROM embeddings a, asked b),
best AS (SELECT query_id, win, page, chunk, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, win, page ORDER BY round(cosine, 12) DESC, chunk) AS k FROM c) WHERE k = 1)"""
ONE = "asked AS (SELECT vec_id AS query_id, 0 AS win, embedding AS v FROM embeddings WHERE vec_id % 100 = 0)"
TWO = "asked AS (SELECT q.vec_id AS query_id, e.vec_id - q.vec_id AS win, e.embedding AS v FROM embeddings q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id AND q.vec_id + 1 WHERE q.vec_id % 100 = 0)"


@query(f"WITH {ONE}, {BEST} SELECT query_id, page, chunk, round(cosine, 6) AS cosine FROM best")
def dense_best_chunk_per_page(spark, sf):
    return R.window_bests(_asked(spark, sf), _vectors(spark, sf)).select("query_id", "page", "chunk", F.round("cosine", 6).alias("cosine"))


def _windows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    q = _asked(spark, sf).select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("window"))
    return q.join(e, F.col("vec_id") == F.col("query_id") + F.col("window")).select("query_id", "window", "query_vector")


@query(
    f"WITH {TWO}, {BEST} SELECT query_id, page, win AS \"window\", chunk, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY round(cosine, 12) DESC, win) AS k2 FROM best) WHERE k2 = 1",
)
def dense_windowed_maxpool(spark, sf):
    pooled = dense.pool_windows(R.window_bests(_windows(spark, sf), _vectors(spark, sf)))
    return pooled.select("query_id", "page", F.col("window").cast("long").alias("window"), "chunk", F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH {TWO}, {BEST}, r AS (SELECT query_id, page, SUM(1.0 / (60 + rank)) AS score FROM {ranked("best", 20, "cosine", "page", "query_id, win")} GROUP BY ALL)
SELECT query_id, page, round(score, 6) AS score, rank FROM {ranked("r", 5, "score", "page")}"""
)
def dense_windowed_rrf(spark, sf):
    return R.retrieve(_windows(spark, sf), None, _vectors(spark, sf), mode="dense").select("query_id", "page", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: x * 0) ELSE embedding END AS e FROM embeddings),
q AS (SELECT e AS first FROM v WHERE vec_id = 1)
SELECT vec_id, round(coalesce(CASE WHEN vec_id % 7 <> 0 THEN list_cosine_similarity(e::DOUBLE[], first::DOUBLE[]) END, 0), 6) AS cosine FROM v, q"""
)
def zero_norm_cosine(spark, sf):
    """Every seventh vector is without length and has cosine 0."""
    vectors = table(spark, sf, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("e"),
    )
    first = vectors.filter("vec_id = 1").select(F.col("e").alias("first"))  # one row
    return vectors.join(F.broadcast(first)).select("vec_id", F.round(dense.cosine(F.col("e"), F.col("first")), 6).alias("cosine"))


# -- fusion --------------------------------------------------------------------------


def _corpus(spark, sf):
    """All documents, with the vector of those that have one: pages of at most one chunk."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select(F.col("doc_id").alias("page"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "embedding")


def _text_queries(spark, sf):
    rows = _corpus(spark, sf).filter("page % 100 = 0")
    return rows.select(F.col("page").alias("query_id"), F.col("title").alias("query_text"), F.col("embedding").alias("query_vector"))


def _expansions(spark, sf):
    """Frozen paraphrases: the titles and vectors of the three pages that follow."""
    rows = _corpus(spark, sf).filter("page % 100 between 1 and 3")
    return rows.select(
        (F.col("page") - F.col("page") % 100).alias("query_id"),
        (F.col("page") % 100).alias("n"),
        F.col("title").alias("query_text"),
        F.col("embedding").alias("query_vector"),
    )


def _links(spark, sf):
    """Every page links to its half and its third."""
    pages = _corpus(spark, sf).select(F.col("page").alias("source_page_id"))
    return pages.withColumn("target_page_id", F.explode(F.array(F.floor(F.col("source_page_id") / 2), F.floor(F.col("source_page_id") / 3))))


def _chunks(spark, sf):
    return _corpus(spark, sf).filter("embedding is not null").select(F.col("page").alias("chunk_id"), F.col("page").alias("page_id"), "embedding")


CORPUS = """corpus AS (SELECT doc_id AS doc, split_part(text, chr(10), 1) AS title, text AS body, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
qs AS (SELECT doc AS query_id, title AS query_text, embedding AS v FROM corpus WHERE doc % 100 = 0),
ex AS (SELECT (doc - doc % 100) * 10 + doc % 100 AS query_id, title AS query_text, embedding AS v FROM corpus WHERE doc % 100 BETWEEN 1 AND 3),
cos AS (SELECT query_id, doc, coalesce(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 0) AS cosine FROM corpus, qs WHERE embedding IS NOT NULL AND v IS NOT NULL),
xcos AS (SELECT query_id, doc, coalesce(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 0) AS cosine FROM corpus, ex WHERE embedding IS NOT NULL AND v IS NOT NULL)"""
FALLBACK = "first20 AS (SELECT doc, row_number() OVER (ORDER BY doc) AS rank FROM corpus QUALIFY rank <= 20)"


def lexical_sql(name: str, queries: str, channel: str, qid: str = "query_id", suffix: str = "''") -> str:
    bare = f"SELECT {qid}, '{channel}' || {suffix}, doc, rank FROM {queries}, first20 WHERE len({toks('query_text')}) = 0"
    return f"SELECT {qid} AS query_id, '{channel}' || {suffix} AS channel, doc AS page, rank FROM {ranked(name, 20)} UNION ALL {bare}"


HYBRID = f"""{CORPUS}, {FALLBACK}, {bm25_sql("hb", "qs", "corpus", "body")},
hybrid AS ({lexical_sql("hb", "qs", "body_bm25:original")} UNION ALL SELECT query_id, 'dense:0', doc, rank FROM {ranked("cos", 20, "cosine")})"""
QX, NX = "(query_id - query_id % 10) // 10", "query_id % 10"
ENHANCED = f"""{HYBRID}, {bm25_sql("ht", "qs", "corpus", "title")}, {bm25_sql("xb", "ex", "corpus", "body")}, {bm25_sql("xt", "ex", "corpus", "title")},
enhanced AS (SELECT * FROM hybrid UNION ALL {lexical_sql("ht", "qs", "title_bm25:original")}
  UNION ALL {lexical_sql("xb", "ex", "body_bm25:expansion_", QX, NX)} UNION ALL {lexical_sql("xt", "ex", "title_bm25:expansion_", QX, NX)}
  UNION ALL SELECT {QX}, 'dense:expansion_' || {NX}, doc, rank FROM {ranked("xcos", 20, "cosine")})"""


def blend_sql(channels: str) -> str:
    return f"""fused AS (SELECT query_id, page, SUM(1.0 / (60 + rank)) AS rrf FROM {channels} GROUP BY ALL),
blended AS (SELECT f.query_id, page, rrf, rrf / MAX(rrf) OVER (PARTITION BY f.query_id) AS normalized_rrf, coalesce(cosine, 0) AS cosine,
  0.7 * rrf / MAX(rrf) OVER (PARTITION BY f.query_id) + 0.3 * coalesce(cosine, 0) AS pre_graph FROM fused f LEFT JOIN cos c ON f.query_id = c.query_id AND f.page = c.doc)"""


GRAPH = f"""pool AS (SELECT query_id, page FROM {ranked("blended", 20, "pre_graph", "page")}),
links AS (SELECT DISTINCT source, target FROM (SELECT doc AS source, unnest([doc // 2, doc // 3]) AS target FROM corpus) WHERE source <> target),
inbound AS (SELECT p.query_id, p.page, COUNT(DISTINCT s.page) AS inbound FROM pool p LEFT JOIN links l ON l.target = p.page LEFT JOIN pool s ON s.query_id = p.query_id AND s.page = l.source GROUP BY ALL),
boosted AS (SELECT b.*, coalesce(inbound, 0) AS inbound, CASE WHEN coalesce(inbound, 0) >= 2 THEN 1.05 ELSE 1.0 END AS multiplier,
  pre_graph * CASE WHEN coalesce(inbound, 0) >= 2 THEN 1.05 ELSE 1.0 END AS final FROM blended b LEFT JOIN inbound USING (query_id, page))"""


@query(f"WITH {HYBRID} SELECT query_id, page, round(SUM(1.0 / (60 + rank)), 6) AS rrf FROM hybrid GROUP BY ALL")
def rrf_fusion(spark, sf):
    q, c = _text_queries(spark, sf), _chunks(spark, sf)
    return fusion.rrf(R.hybrid_channels(q, _corpus(spark, sf), R.window_bests(q, c, fusion.CANDIDATE_DEPTH))).select(
        "query_id",
        "page",
        F.round("rrf", 6).alias("rrf"),
    )


@query(f"WITH {HYBRID}, {blend_sql('hybrid')} SELECT query_id, page, round(pre_graph, 6) AS score, rank FROM {ranked('blended', 5, 'pre_graph', 'page')}")
def hybrid_topk(spark, sf):
    hits = R.retrieve(_text_queries(spark, sf), _corpus(spark, sf), _chunks(spark, sf), mode="hybrid")
    return hits.select("query_id", "page", F.round("score", 6).alias("score"), "rank")


@query(
    f"WITH {ENHANCED}, {blend_sql('enhanced')}, {GRAPH} SELECT query_id, page, round(final, 6) AS score, inbound, multiplier::DOUBLE AS multiplier, rank FROM {ranked('boosted', 5, 'final', 'page')}",
)
def enhanced_topk(spark, sf):
    hits = R.retrieve(_text_queries(spark, sf), _corpus(spark, sf), _chunks(spark, sf), _links(spark, sf), "enhanced", expansions=_expansions(spark, sf))
    return hits.select("query_id", "page", F.round("score", 6).alias("score"), "inbound", "multiplier", "rank")


def _blended(spark, sf):
    q = _text_queries(spark, sf)
    return R.blended(q, _corpus(spark, sf), _chunks(spark, sf))[2]


@query(f"WITH {HYBRID}, {blend_sql('hybrid')}, {GRAPH} SELECT query_id, page, inbound FROM inbound")
def graph_inbound_counts(spark, sf):
    return fusion.inbound_counts(_blended(spark, sf), _links(spark, sf))


@query(f"WITH {HYBRID}, {blend_sql('hybrid')}, {GRAPH} SELECT query_id, page, round(pre_graph, 6) AS pre_graph, inbound, round(final, 6) AS final FROM boosted")
def graph_boost(spark, sf):
    out = fusion.graph_boost(_blended(spark, sf), _links(spark, sf))
    return out.select("query_id", "page", F.round("pre_graph", 6).alias("pre_graph"), "inbound", F.round("final", 6).alias("final"))


@query(f"WITH {ENHANCED} SELECT query_id, page, string_agg(channel || '=' || rank, ',' ORDER BY channel) AS ranks FROM enhanced GROUP BY query_id, page")
def channel_rank_map(spark, sf):
    q, c = _text_queries(spark, sf), _chunks(spark, sf)
    channels = R.enhanced_channels(q, _corpus(spark, sf), c, R.window_bests(q, c, fusion.CANDIDATE_DEPTH), _expansions(spark, sf))
    entries = F.array_sort(F.map_entries("ranks"))
    return fusion.channel_ranks(channels).select(
        "query_id",
        "page",
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("ranks"),
    )


@query(
    f"""WITH {HYBRID}, hop AS (SELECT query_id, channel, page, rank FROM hybrid UNION ALL
  SELECT query_id, channel, next, rank + 1 FROM hybrid JOIN (SELECT DISTINCT doc AS page, unnest([doc // 2, doc // 3]) AS next FROM corpus) USING (page) WHERE page <> next),
best AS (SELECT query_id, channel, page, MIN(rank) AS rank FROM hop GROUP BY ALL)
SELECT query_id, page, round(SUM(1.0 / (60 + rank)), 6) AS score, COUNT(*) AS seeds FROM best GROUP BY ALL HAVING round(SUM(1.0 / (60 + rank)), 12) >= 0.016"""
)
def convergence_threshold(spark, sf):
    q, c = _text_queries(spark, sf), _chunks(spark, sf)
    channels = R.hybrid_channels(q, _corpus(spark, sf), R.window_bests(q, c, fusion.CANDIDATE_DEPTH)).withColumnRenamed("channel", "seed")
    return R.convergence(channels, _links(spark, sf), 0.016).select("query_id", "page", F.round("score", 6).alias("score"), "seeds")


# -- entities ---------------------------------------------------------------------------

MATCHES = f"""t AS (SELECT doc_id, {surface("text")} AS body, {surface("split_part(text, chr(10), 1)")} AS title FROM documents),
p AS (SELECT item_id, {surface("text")} AS phrase FROM benchmark),
hit AS (SELECT doc_id, item_id, body, title, phrase FROM t, p WHERE phrase <> '' AND contains(' ' || body || ' ', ' ' || phrase || ' '))"""


def _matches(spark, sf):
    return entities.phrase_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text").select(
        F.col("doc").alias("doc_id"),
        F.col("phrase_id").alias("item_id"),
    )


@query(f"WITH {MATCHES} SELECT doc_id, item_id FROM hit")
def gazetteer_match(spark, sf):
    return _matches(spark, sf)


@query(f"WITH {MATCHES} SELECT doc_id, item_id, CASE WHEN contains(' ' || title || ' ', ' ' || phrase || ' ') THEN 2.0 ELSE 0.0 END + 1.0 AS score FROM hit")
def exact_match_score(spark, sf):
    found = _matches(spark, sf)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    docs = entities.of_hits(texts, found.select(F.col("doc_id").alias("doc"))).select(
        F.col("doc").alias("doc_id"),
        T.normalize_surface(F.col("text")).alias("body"),
        T.normalize_surface(F.substring_index("text", "\n", 1)).alias("title"),
    )
    phrases = table(spark, sf, "benchmark").select("item_id", T.normalize_surface(F.col("text")).alias("phrase"))
    met = found.join(phrases, "item_id").join(docs, "doc_id")
    return met.select("doc_id", "item_id", entities.exact_score(F.col("title"), F.col("body"), F.col("phrase")).alias("score"))


@query(
    f"""WITH {MATCHES},
c AS (SELECT doc_id, i AS idx, doc_id || ':' || lpad(i::VARCHAR, 5, '0') AS chunk, part AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
pairs AS (SELECT h.item_id, h.doc_id, h.phrase, c.idx, c.chunk, {toks("c.text")} AS w, contains(' ' || ({surface("c.text")}) || ' ', ' ' || h.phrase || ' ') AS has FROM hit h JOIN c USING (doc_id)),
st AS (SELECT item_id, doc_id, COUNT(*) AS n, AVG(len(w)) AS av FROM pairs GROUP BY ALL),
tf AS (SELECT item_id, doc_id, chunk, term, COUNT(*) AS mult, ANY_VALUE(len(list_filter(w, lambda x: x = term))) AS tf, ANY_VALUE(len(w)) AS len FROM (SELECT *, unnest(string_split(phrase, ' ')) AS term FROM pairs) GROUP BY ALL HAVING tf > 0),
df AS (SELECT item_id, doc_id, term, COUNT(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT item_id, doc_id, chunk, SUM(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS bm FROM tf JOIN df USING (item_id, doc_id, term) JOIN st USING (item_id, doc_id) GROUP BY ALL)
SELECT item_id, doc_id, chunk AS chunk_id, has::INT::DOUBLE AS chunk_score FROM (SELECT p.item_id, p.doc_id, p.chunk, has, row_number() OVER (PARTITION BY p.item_id, p.doc_id ORDER BY has DESC, CASE WHEN NOT has THEN round(coalesce(bm, 0), 12) END DESC NULLS LAST, p.chunk) AS k
  FROM pairs p LEFT JOIN s ON s.item_id = p.item_id AND s.doc_id = p.doc_id AND s.chunk = p.chunk) WHERE k = 1"""
)
def best_exact_chunk(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    chunks = lines.select(
        F.col("doc_id").alias("page_id"),
        F.concat_ws(":", "doc_id", F.lpad(F.col("chunk_index").cast("string"), 5, "0")).alias("chunk_id"),
        "chunk_index",
        "text",
    )
    phrases = table(spark, sf, "benchmark").select("item_id", T.normalize_surface(F.col("text")).alias("surface"))
    seeds = _matches(spark, sf).join(phrases, "item_id").select(F.col("item_id").alias("seed_id"), F.col("doc_id").alias("page_id"), "surface")
    best = entities.best_exact_chunk(seeds, chunks)
    return best.select(F.col("seed_id").alias("item_id"), F.col("page_id").alias("doc_id"), "chunk_id", "chunk_score")


@query(
    rf"""WITH o AS (SELECT doc_id, {cf("text")} AS t FROM documents),
g AS (SELECT DISTINCT array_to_string(list_slice({toks("text")}, 1, 3), ' ') AS s FROM benchmark),
c AS MATERIALIZED (SELECT doc_id, s, t, unnest(range(1, length(t) - length(s) + 2)) AS k FROM o, g WHERE contains(t, s)),
m AS MATERIALIZED (SELECT doc_id, s, t, k FROM c WHERE substr(t, k, length(s)) = s),
f AS (SELECT doc_id, s, MIN(k) - 1 AS start FROM m WHERE NOT regexp_matches(substr(t, k - 1, 1), '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substr(t, k + length(s), 1), '[\p{{L}}\p{{N}}]') GROUP BY ALL)
SELECT doc_id AS observation_id, s AS surface, start AS span_start, start + length(s) AS span_end, row_number() OVER (PARTITION BY doc_id ORDER BY start + length(s), length(s) DESC, s) AS seed_no FROM f"""
)
def gazetteer_seeds(spark, sf):
    names = table(spark, sf, "benchmark").select(
        F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ").alias("surface"),
        F.col("item_id").cast("string").alias("id"),
    )
    gazetteer = names.groupBy("surface").agg(F.array_sort(F.collect_set("id")).alias("page_ids"))
    seeds = entities.gazetteer_seeds(table(spark, sf, "documents").select(F.col("doc_id").alias("observation_id"), "text"), gazetteer)
    return seeds.select(
        "observation_id",
        "surface",
        F.col("span_start").cast("long").alias("span_start"),
        F.col("span_end").cast("long").alias("span_end"),
        "seed_no",
    )


HITS = f"""{ITEMS}, {BODIES}, {bm25_sql("x", "items", "bodies", "body")}, {bm25_sql("y", "items", "bodies", "title")},
hits AS (SELECT query_id, 0 AS phase, doc, round(score, 6) AS score, rank FROM {ranked("x", 5)} UNION ALL SELECT query_id, 1, doc, round(score, 6), rank FROM {ranked("y", 5)})"""


def _hits(spark, sf):
    parts = [_bm25_top(spark, sf, items(spark, sf), text).withColumn("phase", F.lit(k)) for k, text in enumerate(("body", "title"))]
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH {HITS} SELECT query_id, doc, phase, rank, row_number() OVER (PARTITION BY query_id ORDER BY phase, rank) AS new_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY phase, rank) AS k FROM hits) WHERE k = 1"""
)
def first_seen_dedupe(spark, sf):
    return dedupe.first_seen(_hits(spark, sf), "query_id", "doc", ["phase", "rank"]).select("query_id", "doc", "phase", "rank", "new_rank")


@query(
    f"""WITH {HITS}, b AS (SELECT query_id, doc, rank, score, COUNT(*) OVER (PARTITION BY query_id, doc) AS contributors, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank, score DESC) AS k FROM hits)
SELECT query_id, doc, rank AS best_rank, score AS best_score, contributors, row_number() OVER (PARTITION BY query_id ORDER BY rank, score DESC, doc) AS new_rank FROM b WHERE k = 1"""
)
def entity_dedupe(spark, sf):
    hits = _hits(spark, sf).select("query_id", F.col("doc").alias("page_id"), "rank", "score", F.col("phase").alias("seed_id"))
    out = dedupe.best_hits(hits, "query_id")
    return out.select(
        "query_id",
        F.col("page_id").alias("doc"),
        "best_rank",
        "best_score",
        F.size("contributors").cast("long").alias("contributors"),
        "new_rank",
    )


@query(
    r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+') AS w FROM documents),
s AS (SELECT doc_id, text, w, unnest(range(0, greatest(len(w), 1), 128)) AS pos FROM w)
SELECT doc_id, pos // 128 AS n, CASE WHEN len(w) <= 128 THEN text ELSE array_to_string(list_slice(w, pos + 1, pos + 128), '') END AS "window" FROM s"""
)
def token_windows(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.posexplode(T.token_windows(F.col("text"), 128)).alias("n", "window"),
    ).withColumn("n", F.col("n").cast("long"))


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query()
def bpe_token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tokenizers.counter(*vocabulary())(F.col("text")).alias("n_tokens"))


@query()
def bpe_token_windows(spark, sf):
    cut = tokenizers.windower(*vocabulary(), 512)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(cut(F.col("text"))).alias("n", "window"))


# -- choices and scoring -------------------------------------------------------------------


@query(f"SELECT doc_id, {choice('text')} AS normalized FROM documents")
def choice_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_choice(F.col("text")).alias("normalized"))


CHOICES = f"""l AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Item ' || item_id || ' — ' WHEN 1 THEN 'Lead - ' ELSE '' END AS head, text FROM benchmark),
ch AS (SELECT item_id, head || text AS label, {choice("head || text")} AS whole, CASE WHEN head <> '' THEN {choice("text")} END AS title, CASE WHEN item_id % 3 = 0 THEN 'item ' || item_id END AS locator FROM l),
al AS (SELECT item_id, label, list_distinct(list_filter([whole, CASE WHEN length(title) >= 8 AND contains(title, ' ') THEN title END, locator], lambda x: x IS NOT NULL)) AS aliases FROM ch)"""


def _labels(spark, sf):
    n = F.col("item_id")
    head = F.when(n % 3 == 0, F.concat(F.lit("Item "), n.cast("string"), F.lit(" — "))).when(n % 3 == 1, F.lit("Lead - ")).otherwise("")
    return table(spark, sf, "benchmark").select("item_id", F.concat(head, "text").alias("label"))


@query(f"WITH {CHOICES} SELECT item_id, array_to_string(list_sort(aliases), '|') AS aliases FROM al")
def choice_aliases(spark, sf):
    return _labels(spark, sf).select("item_id", F.array_join(F.array_sort(T.choice_aliases(F.col("label"))), "|").alias("aliases"))


CASES = f"""turns AS (SELECT conv_id, turn, role, text, string_split({choice("text")}, ' ') AS w FROM conversations),
cases AS (SELECT conv_id || ':' || turn AS case_id, conv_id, turn, ['positive', 'cue-ablated', 'memory-included'][conv_id % 3 + 1] AS variant,
  'Plan ' || (conv_id % 7) || ' - ' || w[1] AS output_choice, w[1] AS memory_choice, ['p' || (conv_id % 5)] AS gold, w[2] AS sensitive FROM turns WHERE role = 'user'),
preds AS (SELECT conv_id || ':' || (turn - 1) AS case_id, turn AS position, CASE WHEN conv_id % 4 = 0 THEN '' ELSE text END AS response, list_distinct(['p' || (turn % 5), 'p' || (conv_id % 4)]) AS admitted FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id || ':' || (turn - 1), turn - 100, 'superseded', ['p0'] FROM turns WHERE role = 'assistant'),
last AS (SELECT case_id, max_by(response, position) AS response, max_by(admitted, position) AS admitted FROM preds GROUP BY case_id),
j AS (SELECT c.*, coalesce(response, '') AS response, coalesce(admitted, []) AS admitted, ' ' || ({choice("coalesce(response, chr(32))")}) || ' ' AS norm, CASE WHEN variant = 'positive' THEN gold ELSE [] END AS want FROM cases c LEFT JOIN last USING (case_id)),
m AS (SELECT *, contains(norm, ' ' || ({choice("output_choice")}) || ' ') OR contains(norm, ' plan ' || (conv_id % 7) || ' ') OR (length({choice("memory_choice")}) >= 8 AND contains({choice("memory_choice")}, ' ') AND contains(norm, ' ' || ({choice("memory_choice")}) || ' ')) AS out_hit,
  contains(norm, ' ' || ({choice("memory_choice")}) || ' ') AS mem_hit FROM j),
scored AS (SELECT case_id, variant, mem_hit AND NOT out_hit AS correct, variant = 'positive' AND mem_hit AND NOT out_hit AS beneficial, variant = 'cue-ablated' AND NOT (out_hit AND NOT mem_hit) AS false_intervention,
  trim(response) = '' AS abstained, sensitive IS NOT NULL AND contains({cf("response")}, {cf("sensitive")}) AS privacy_overexposure, list_contains(admitted, 'p1') AS poison_admitted,
  len(admitted) AS admitted_count, len(list_intersect(admitted, want)) AS gold_admitted_count, len(admitted) - len(list_intersect(admitted, want)) AS spurious_admitted_count, len(want) AS gold_total FROM m)"""


def _cases(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("w", F.split(T.normalize_choice(F.col("text")), " "))
    n = F.col("conv_id")
    word = lambda k: F.try_element_at("w", F.lit(k))
    cases = turns.filter("role = 'user'").select(
        F.concat_ws(":", "conv_id", "turn").alias("case_id"), F.element_at(
            F.array(F.lit("positive"), F.lit("cue-ablated"), F.lit("memory-included")),
            (n % 3 + 1).cast("int"),
        ).alias("variant"),
        F.concat(F.lit("Plan "), (n % 7).cast("string"), F.lit(" - "), word(1)).alias("output_choice"), word(1).alias("memory_choice"), F.array(
            F.concat(F.lit("p"), (n % 5).cast("string")),
        ).alias("gold"),
        F.when(word(2).isNotNull(), F.array(word(2))).otherwise(F.array().cast("array<string>")).alias("sensitive"), "conv_id", "turn",
    )
    answers = turns.filter("role = 'assistant'")
    key = F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("case_id")
    marks = F.create_map(F.lit("p1"), F.array(F.lit("poison"))).alias("perturbations")
    real = answers.select(
        key,
        F.col("turn").alias("position"),
        F.when(n % 4 == 0, "").otherwise(F.col("text")).alias("response_text"),
        F.array_distinct(F.array(F.concat(F.lit("p"), (F.col("turn") % 5).cast("string")), F.concat(F.lit("p"), (n % 4).cast("string")))).alias("admitted"),
        marks,
    )
    old = answers.select(
        key,
        (F.col("turn") - 100).alias("position"),
        F.lit("superseded").alias("response_text"),
        F.array(F.lit("p0")).alias("admitted"),
        marks,
    )
    return cases, real.unionByName(old)


FLAGS = ["correct", "beneficial", "false_intervention", "abstained", "privacy_overexposure", "poison_admitted"]
COUNTS = ["admitted_count", "gold_admitted_count", "spurious_admitted_count", "gold_total"]


@query(f"WITH {CASES} SELECT case_id, variant, {', '.join(FLAGS)}, {', '.join(f'{c}::BIGINT AS {c}' for c in COUNTS)} FROM scored")
def score_rows(spark, sf):
    return scoring.score_rows(*_cases(spark, sf)).select("case_id", "variant", *FLAGS, *[F.col(c).cast("long").alias(c) for c in COUNTS])


def _rate(top: str, bottom: str, name: str) -> str:
    return f"round(coalesce({top}, 0)::DOUBLE / greatest(coalesce({bottom}, 0), 1), 9) AS {name}"


R_ = "variant <> 'memory-included'"


@query(
    f"""WITH {CASES} SELECT COUNT(*) FILTER (WHERE {R_}) AS case_count, COUNT(*) FILTER (WHERE NOT ({R_})) AS memory_included_count,
{_rate(f"COUNT(*) FILTER (WHERE NOT ({R_}) AND correct)", f"COUNT(*) FILTER (WHERE NOT ({R_}))", "ceiling_accuracy")},
{_rate(f"COUNT(*) FILTER (WHERE {R_} AND correct)", f"COUNT(*) FILTER (WHERE {R_})", "correct_memory_conditioned_decision_rate")},
{_rate("COUNT(*) FILTER (WHERE beneficial)", "COUNT(*) FILTER (WHERE variant = 'positive')", "beneficial_decision_change_rate")},
{_rate("COUNT(*) FILTER (WHERE false_intervention)", "COUNT(*) FILTER (WHERE variant = 'cue-ablated')", "cue_ablated_false_intervention_rate")},
{_rate(f"SUM(gold_admitted_count) FILTER (WHERE {R_})", f"SUM(admitted_count) FILTER (WHERE {R_})", "memory_admission_precision")},
{_rate(f"SUM(gold_admitted_count) FILTER (WHERE {R_})", f"SUM(gold_total) FILTER (WHERE {R_})", "memory_admission_recall")},
{_rate(f"SUM(spurious_admitted_count) FILTER (WHERE {R_})", f"SUM(admitted_count) FILTER (WHERE {R_})", "spurious_memory_admission_rate")},
{_rate(f"COUNT(*) FILTER (WHERE {R_} AND poison_admitted)", f"COUNT(*) FILTER (WHERE {R_})", "poison_admission_rate")},
{_rate(f"COUNT(*) FILTER (WHERE {R_} AND abstained)", f"COUNT(*) FILTER (WHERE {R_})", "abstention_rate")},
{_rate(f"COUNT(*) FILTER (WHERE {R_} AND privacy_overexposure)", f"COUNT(*) FILTER (WHERE {R_})", "privacy_overexposure_rate")} FROM scored"""
)
def score_metrics(spark, sf):
    out = scoring.metrics(scoring.score_rows(*_cases(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in out.dtypes])


@query(
    f"""WITH {CASES}, g AS (SELECT variant, 'flow' || (length(case_id) % 3) AS flow, 'mode' || (admitted_count % 2) AS mode, correct FROM scored)
SELECT variant, flow, mode, SUM(correct::INT)::BIGINT AS correct, COUNT(*) AS total FROM g GROUP BY ALL UNION ALL SELECT variant, NULL, NULL, SUM(correct::INT)::BIGINT, COUNT(*) FROM g GROUP BY variant"""
)
def grid_rollup(spark, sf):
    rows = scoring.score_rows(*_cases(spark, sf))
    rows = rows.select(
        "variant",
        F.concat(F.lit("flow"), (F.length("case_id") % 3).cast("string")).alias("flow"),
        F.concat(F.lit("mode"), (F.col("admitted_count") % 2).cast("string")).alias("mode"),
        "correct",
    )
    return scoring.grid(rows)


@query(f"WITH {CASES} SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM preds)")
def missing_predictions(spark, sf):
    cases, predictions = _cases(spark, sf)
    return caches.misses(cases.select("case_id"), predictions, "case_id")


@query(f"WITH {CASES} SELECT case_id, response AS response_text FROM last")
def last_wins_dedupe(spark, sf):
    return dedupe.last_wins(_cases(spark, sf)[1], "case_id", "position").select("case_id", "response_text")


@query(
    f"""WITH {CASES}, e AS (SELECT case_id, variant, output_choice, memory_choice, CASE WHEN conv_id % 2 = 0 THEN 'no_memory' ELSE 'input_rag' END AS condition, gold, admitted AS retrieved, out_hit, mem_hit FROM m)
SELECT case_id, condition, CASE WHEN condition = 'no_memory' AND variant <> 'memory-included' THEN output_choice ELSE memory_choice END AS expected_choice,
  CASE WHEN condition = 'no_memory' AND variant <> 'memory-included' THEN out_hit AND NOT mem_hit ELSE mem_hit AND NOT out_hit END AS successful,
  CASE WHEN condition = 'no_memory' THEN CASE WHEN variant = 'memory-included' THEN 'ceiling' ELSE 'not-run' END WHEN variant = 'cue-ablated' THEN 'control'
    WHEN len(list_intersect(gold, retrieved)) = 0 THEN 'miss' WHEN len(list_intersect(gold, retrieved)) < len(gold) THEN 'partial' ELSE 'complete' END AS retrieval_status FROM e"""
)
def interactive_evaluation(spark, sf):
    cases, predictions = _cases(spark, sf)
    last = dedupe.last_wins(predictions, "case_id", "position").select("case_id", "response_text", F.col("admitted").alias("retrieved"))
    rows = cases.join(last, "case_id", "left").withColumn("condition", F.when(F.col("conv_id") % 2 == 0, "no_memory").otherwise("input_rag"))
    return scoring.evaluate(rows).select("case_id", "condition", "expected_choice", "successful", "retrieval_status")


@query(
    f"WITH {CASES} SELECT case_id, array_to_string(list_sort(list_intersect(admitted, gold)), ',') AS both, array_to_string(list_sort(list_filter(admitted, lambda x: NOT list_contains(gold, x))), ',') AS spurious, list_sort(admitted) = list_sort(gold) AS same FROM j",
)
def admission_set_ops(spark, sf):
    cases, predictions = _cases(spark, sf)
    last = dedupe.last_wins(predictions, "case_id", "position").select("case_id", "admitted")
    rows = cases.join(last, "case_id", "left").withColumn("admitted", F.coalesce("admitted", F.array().cast("array<string>")))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select(
        "case_id",
        joined(F.array_intersect("admitted", "gold")).alias("both"),
        joined(F.array_except("admitted", "gold")).alias("spurious"),
        (F.array_sort("admitted") == F.array_sort("gold")).alias("same"),
    )


@query(f"WITH {CASES} SELECT case_id, poison_admitted FROM scored")
def poison_flags(spark, sf):
    return scoring.score_rows(*_cases(spark, sf)).select("case_id", "poison_admitted")


@query(
    "SELECT conv_id, string_agg(n || '. ' || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id",
)
def memory_context_render(spark, sf):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(texts.alias("texts")).select("conv_id", T.render_context(F.col("texts")).alias("context"))


@query(
    "SELECT conv_id, turn, 'Task:' || chr(10) || 'Choose exactly one.' || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'Observed tool result:' || chr(10) || text ELSE '' END AS model_input FROM conversations",
)
def model_input_render(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        T.render_input(F.lit("Choose exactly one."), F.lit("tool_result"), F.col("text"), F.lit(None).cast("string")).alias("model_input"),
    )


# -- validation ----------------------------------------------------------------------------


@query(
    """SELECT 'label without document' AS rule, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document without label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'vector without document', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'order without customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def referential_violations(spark, sf):
    docs, labels, vectors, orders, customers = (table(spark, sf, n) for n in ("documents", "labels", "embeddings", "orders", "customer"))
    parts = [
        validate.dangling(labels, "doc_id", docs, "doc_id").select(F.lit("label without document").alias("rule"), F.col("doc_id").alias("id")),
        validate.dangling(docs, "doc_id", labels, "doc_id").select(F.lit("document without label").alias("rule"), F.col("doc_id").alias("id")),
        validate.dangling(vectors, "vec_id", docs, "doc_id").select(F.lit("vector without document").alias("rule"), F.col("vec_id").alias("id")),
        validate.dangling(orders, "o_custkey", customers, "c_custkey").select(F.lit("order without customer").alias("rule"), F.col("o_orderkey").alias("id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT o_custkey, COUNT(*) AS copies FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def duplicate_ids(spark, sf):
    return validate.duplicates(table(spark, sf, "orders"), "o_custkey")


@query("SELECT conv_id AS base_case_id FROM conversations GROUP BY conv_id HAVING list_sort(list_distinct(list(role))) <> ['assistant', 'system', 'user']")
def variant_completeness(spark, sf):
    names = F.create_map(F.lit("user"), F.lit("positive"), F.lit("assistant"), F.lit("cue-ablated"), F.lit("system"), F.lit("memory-included"))
    cases = table(spark, sf, "conversations").select(F.col("conv_id").alias("base_case_id"), F.try_element_at(names, F.col("role")).alias("variant"))
    return validate.variant_issues(cases).select(F.col("id").cast("long").alias("base_case_id"))


PHRASES = f"""words AS (SELECT item_id, text, {toks('text')} AS w FROM benchmark),
phrases AS (SELECT item_id || ':' || k AS phrase_id, CASE WHEN k = 0 THEN text ELSE array_to_string(list_slice(w, 1, k), ' ') END AS phrase FROM words, (SELECT unnest([0, 1, 2]) AS k))"""


def _phrases(spark, sf):
    """Every item's text, its first token and its first two."""
    first = F.expr("inline(array(named_struct('k', 0), named_struct('k', 1), named_struct('k', 2)))")
    rows = table(spark, sf, "benchmark").select("item_id", "text", T.tokens(F.col("text")).alias("w"), first)
    phrase = F.when(F.col("k") == 0, F.col("text")).otherwise(F.array_join(F.slice("w", F.lit(1), F.greatest("k", F.lit(1))), " "))
    return rows.select(F.concat_ws(":", "item_id", "k").alias("phrase_id"), phrase.alias("phrase"))


@query(
    f"WITH {PHRASES}, f AS (SELECT phrase_id, {cf('phrase')} AS p FROM phrases), d AS (SELECT doc_id, {cf('text')} AS t FROM documents) "
    "SELECT doc_id, phrase_id, (length(t) - length(replace(t, p, ''))) // length(p) AS n FROM d, f WHERE p <> '' AND contains(t, p)",
)
def occurrence_count(spark, sf):
    met = entities.substring_counts(table(spark, sf, "documents"), _phrases(spark, sf), "doc_id", "text", "phrase_id", "phrase")
    return met.select(F.col("doc").alias("doc_id"), "phrase_id", "n")


# -- caches and small text operators ----------------------------------------------------------

JSON = "to_json({x})"


@query(
    rf"""WITH n AS (SELECT page_id, trim(regexp_replace({cf("url")}, '\s+', ' ', 'g')) AS q FROM pages)
SELECT page_id, sha256('{{"model":"m","normalized_query":' || to_json(q) || ',"prompt_version":"v1"}}') AS expansion_key, sha256('{{"model": "m", "prompt": ' || to_json(q) || '}}') AS response_key FROM n"""
)
def cache_keys(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select(
        "page_id",
        caches.expansion_key(F.col("url"), "m", "v1").alias("expansion_key"),
        caches.response_key({"model": F.lit("m"), "prompt": T.normalize_query(F.col("url"))}).alias("response_key"),
    )


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def frozen_cache_misses(spark, sf):
    return caches.misses(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(
    """SELECT doc_id, CASE WHEN NOT contains(text, 'the') THEN NULL ELSE CASE WHEN NOT contains(a, 'and') THEN NULL ELSE substr(a, 1, strpos(a, 'and') - 1) || 'AND' || substr(a, strpos(a, 'and') + 3) END END AS folded
FROM (SELECT doc_id, text, substr(text, 1, strpos(text, 'the') - 1) || 'andthe' || substr(text, strpos(text, 'the') + 3) AS a FROM documents)"""
)
def replacement_fold(spark, sf):
    edits = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("the", "andthe"), ("and", "AND"))])
    return table(spark, sf, "documents").select("doc_id", T.fold_replacements(F.col("text"), edits).alias("folded"))


PREFIXES = sorted({*T.SLUG_PREFIXES, *T.SLUG_TYPES, "notes", "other"})
_PICK = f"[{', '.join(repr(p) for p in PREFIXES)}][c_custkey % {len(PREFIXES)} + 1]"


def _sql_case(x: str, mapping: dict[str, str], otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {otherwise} END"


@query(f"SELECT c_custkey, {_sql_case(_PICK, T.SLUG_PREFIXES, _PICK)} || '/' || c_name || '/x' AS slug FROM customer")
def slug_canonicalize(spark, sf):
    """Every prefix of the table, the collections that stay, and unknown ones."""
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("c_custkey") % len(PREFIXES) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", T.canonical_slug(F.concat(prefix, F.lit("/"), "c_name", F.lit("/x"))).alias("slug"))


@query(
    "SELECT c_custkey, 'company/' || c_nationkey AS slug, c_name AS label FROM customer UNION ALL SELECT c_custkey, 'people/' || c_custkey, c_name FROM customer",
)
def markdown_links(spark, sf):
    text = F.concat(
        F.lit("See ["),
        F.col("c_name"),
        F.lit("](company/"),
        F.col("c_nationkey").cast("string"),
        F.lit(") and ["),
        F.col("c_name"),
        F.lit("](people/"),
        F.col("c_custkey").cast("string"),
        F.lit(")."),
    )
    return table(spark, sf, "customer").select("c_custkey", F.explode(T.markdown_links(text)).alias("l")).select("c_custkey", "l.slug", "l.label")


@query(
    "SELECT 'evt-' || o_orderkey AS uid, 'Order; of: ' || o_custkey AS summary, strftime(o_orderdate, '%Y%m%d') AS starts, 1::BIGINT AS n_attendees FROM orders",
)
def calendar_parse(spark, sf):
    n = F.col("o_orderkey").cast("string")
    event = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:evt-"),
        n,
        F.lit("@cal\r\nSUMMARY:Order; \r\n of: "),
        F.col("o_custkey").cast("string"),
        F.lit("\r\nDTSTART;VALUE=DATE:"),
        F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("\r\nATTENDEE;CN=A:mailto:a@b\r\nEND:VEVENT\r\nEND:VCALENDAR"),
    )
    return corpus.calendar_events(table(spark, sf, "orders").select(event.alias("text"))).select(
        "uid",
        "summary",
        "starts",
        F.size("attendees").cast("long").alias("n_attendees"),
    )


@query(
    "SELECT i, ['alpha', 'beta', 'gamma', 'delta', 'epsilon'][(i * 3) % 5 + 1] AS pick, i % 22 = 18 AS decoy FROM (SELECT unnest(range(COUNT(*))) AS i FROM region, nation)",
)
def strided_generator(spark, sf):
    n = table(spark, sf, "region").count() * table(spark, sf, "nation").count()
    pool = F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta", "epsilon")])
    return spark.range(n).select(
        F.col("id").alias("i"),
        F.element_at(pool, (F.pmod(F.col("id") * 3, F.lit(5)) + 1).cast("int")).alias("pick"),
        (F.col("id") % 22 == 18).alias("decoy"),
    )


@query(
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, COUNT(*) AS n, round(SUM(value), 4) AS value FROM events GROUP BY ALL",
)
def event_stream_admission(spark, sf):
    """Extension: the same counts from a stream that reads the table once."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{shared_dir(spark)}/recollect-stream-{uuid.uuid4().hex}"
    admission.run_available(admission.windowed_counts(stream), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"),
        "event_type",
        "n",
        F.round("value", 4).alias("value"),
    )


from . import composite_queries, source_queries  # noqa: E402, F401  register their queries
