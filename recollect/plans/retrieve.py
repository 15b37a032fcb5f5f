"""Retrieval modes and conditions as lazy plans over batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import balls, dedupe, dense, entities, fusion, lexical
from ..operators.fusion import CANDIDATE_DEPTH, OFFICIAL_TOP_K
from ..session import settled

class Retriever(Protocol):
    """Maps (query_id, query_text) to (query_id, page, rank), a batch of queries at a time."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class QueryExpander(Protocol):
    """Maps (query_id, query_text) to (query_id, n from 1 to 3, query_text, query_vector); a frozen one joins a cache."""

    model: str
    prompt_version: str

    def __call__(self, queries: DataFrame) -> DataFrame: ...


MODES = ("dense", "hybrid", "enhanced")
FLOWS = ("tool_output_only", "model_output_only", "tool_then_model_output")


def _sides(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    window = F.col("window") if "window" in queries.columns else F.lit(0)
    asked = queries.select("query_id", window.alias("window"), "query_vector").filter("query_vector is not null")
    return asked, chunks.select(F.col("page_id").alias("page"), F.col("chunk_id").alias("chunk"), F.col("embedding").alias("vector"))


def window_bests(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, window, page, chunk, cosine): best chunk of each page for each query window.

    queries: query_id, query_vector and optionally window; chunks: chunk_id, page_id, embedding.
    With ``k`` at least the k best pages of each window, and not all of the rest. A query without
    a vector has none.
    """
    asked, vectors = _sides(queries, chunks)
    asked = asked.select(F.struct(F.col("query_id").alias("q"), F.col("window").alias("w")).alias("query_id"), "query_vector")
    best = balls.best(asked, vectors, k)
    return best.select(F.col("query_id.q").alias("query_id"), F.col("query_id.w").alias("window"), "page", "chunk", "cosine")


def pooled_cosines(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, page, window, chunk, cosine): the best window and chunk of candidate pages only."""
    asked, vectors = _sides(queries, chunks)
    found = dense.cosines_of(candidates.select("query_id", "page").distinct(), asked, vectors)
    return dense.pool_windows(dense.best_chunk(found, ("query_id", "window", "page")))


def pooled_ranks(candidates: DataFrame, ranked: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """As ``pooled_cosines``, from what is known: a page that a window ranks (ranked: query_id, window, page, chunk, cosine) has its
    best chunk there. Only windows that do not rank a candidate of their query meet its chunks again."""
    asked, vectors = _sides(queries, chunks)
    both = F.struct("query_id", "window").alias("query_id")
    wanted = candidates.select("query_id", "page").distinct().join(asked.select("query_id", "window"), "query_id")
    missing = settled(wanted.join(ranked, ["query_id", "window", "page"], "left_anti").select(both, "page"))
    known = ranked.select("query_id", "window", "page", "chunk", "cosine")
    if not missing.isEmpty():
        found = dense.cosines_of(missing, asked.select(both, "window", "query_vector"), vectors)
        known = known.unionByName(dense.best_chunk(found.withColumn("query_id", F.col("query_id.query_id")), ("query_id", "window", "page")))
    return dense.pool_windows(known)


def window_ranks(bests: DataFrame) -> DataFrame:
    """The CANDIDATE_DEPTH best pages of each window, with rank."""
    return lexical.top_k(bests, CANDIDATE_DEPTH, ("query_id", "window"), "cosine", "page")


def dense_channel(bests: DataFrame, name: str) -> DataFrame:
    """(query_id, channel, page, rank) with a channel for each window."""
    ranked = bests if "rank" in bests.columns else window_ranks(bests)
    return ranked.select("query_id", F.concat(F.lit(f"{name}:"), F.col("window").cast("string")).alias("channel"), "page", "rank")


def lexical_channel(queries: DataFrame, docs: DataFrame, text: str, name: str) -> DataFrame:
    ranked = lexical.bm25_rank(queries, docs, CANDIDATE_DEPTH, "page", text)
    return ranked.select("query_id", F.lit(name).alias("channel"), F.col("doc").alias("page"), "rank")


def dense_mode(queries: DataFrame, chunks: DataFrame, k: int = OFFICIAL_TOP_K) -> DataFrame:
    """One window: the cosine, over at most CANDIDATE_DEPTH candidates. Several: raw fusion over windows."""
    ranked = settled(window_ranks(window_bests(queries, chunks, CANDIDATE_DEPTH)))
    fused = settled(fusion.rrf(dense_channel(ranked, "dense")))
    windows = queries.groupBy("query_id").agg(F.count("*").alias("windows"))
    scored = fused.join(pooled_ranks(fused, ranked, queries, chunks), ["query_id", "page"]).join(windows, "query_id")
    scored = scored.select("query_id", "page", "chunk", F.when(F.col("windows") > 1, F.col("rrf")).otherwise(F.col("cosine")).alias("score"))
    return lexical.top_k(scored, k, tie="page")


def hybrid_channels(queries: DataFrame, docs: DataFrame, bests: DataFrame) -> DataFrame:
    text = queries.select("query_id", "query_text").distinct()
    return lexical_channel(text, docs, "body", "body_bm25:original").unionByName(dense_channel(bests, "dense"))


def enhanced_channels(queries: DataFrame, docs: DataFrame, chunks: DataFrame, bests: DataFrame, expansions: DataFrame) -> DataFrame:
    """expansions: (query_id, n from 1 to 3, query_text, query_vector), frozen. The original (n = 0)
    and all expansions of all queries run as one batch for each kind of text."""

    def key(n: Column) -> Column:
        return F.struct(F.col("query_id").alias("q"), n.cast("int").alias("n")).alias("query_id")

    keyed = expansions.select(key(F.col("n")), "query_text", "query_vector")
    texts = queries.select("query_id", "query_text").distinct().select(key(F.lit(0)), "query_text").unionByName(keyed.select("query_id", "query_text"))
    query, n = F.col("query_id.q").alias("query_id"), F.col("query_id.n")

    def name(kind: str) -> Column:
        return F.when(n == 0, f"{kind}:original").otherwise(F.concat(F.lit(f"{kind}:expansion_"), n.cast("string"))).alias("channel")

    parts = [dense_channel(bests, "dense")]
    for kind in ("body", "title"):
        ranked = lexical.bm25_rank(texts, docs, CANDIDATE_DEPTH, "page", kind)
        parts.append(ranked.select(query, name(f"{kind}_bm25"), F.col("doc").alias("page"), "rank"))
    best = balls.best(keyed.filter("query_vector is not null"), _sides(queries, chunks)[1], CANDIDATE_DEPTH)
    ranked = lexical.top_k(best, CANDIDATE_DEPTH, ("query_id",), "cosine", "page")
    parts.append(ranked.select(query, name("dense"), "page", "rank"))
    return reduce(DataFrame.unionByName, parts)


def blended(queries: DataFrame, docs: DataFrame, chunks: DataFrame, expansions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, cosines of their pages, blended scores) of the hybrid, with expansions of the
    enhanced mode. At most CANDIDATE_DEPTH rows a channel of a query, so that they are kept and not computed again."""
    bests = window_bests(queries, chunks, CANDIDATE_DEPTH)
    channels = settled(hybrid_channels(queries, docs, bests) if expansions is None else enhanced_channels(queries, docs, chunks, bests, expansions))
    pooled = settled(pooled_cosines(channels, queries, chunks))
    return channels, pooled, fusion.blend(channels, pooled)


def retrieve(
    queries: DataFrame,
    docs: DataFrame,
    chunks: DataFrame,
    links: DataFrame | None = None,
    mode: str = "dense",
    k: int = OFFICIAL_TOP_K,
    expansions: DataFrame | None = None,
) -> DataFrame:
    """Ranked pages for every query: query_id, page, chunk, score, rank (and, beyond dense, the parts of the score).

    docs: page, title, body; a page need not have a chunk (its chunk is null then, its
    cosine 0). ``expansions`` is required by, and only allowed for, enhanced.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if (expansions is not None) != (mode == "enhanced"):
        raise ValueError("expansions go with the enhanced mode, and only with it")
    if mode == "dense":
        return dense_mode(queries, chunks, k)
    channels, pooled, scored = blended(queries, docs, chunks, expansions)
    if mode == "enhanced":
        scored = fusion.graph_boost(scored, links)
    else:
        scored = scored.withColumn("inbound", F.lit(0).cast("long")).withColumn("multiplier", F.lit(1.0)).withColumn("final", F.col("pre_graph"))
    ranked = lexical.top_k(scored, k, score="final", tie="page")
    return ranked.join(pooled.select("query_id", "page", "chunk"), ["query_id", "page"], "left").withColumnRenamed("final", "score")


def convergence(seeds: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Extension. seeds: (query_id, seed, page, rank). Candidates and their one-hop
    neighbours (one rank later) are fused across seeds; pages that reach the
    threshold are admitted, which may be none."""
    hop = seeds.join(links.select(F.col("source_page_id").alias("page"), F.col("target_page_id").alias("next")).filter("page <> next").distinct(), "page")
    near = hop.select("query_id", "seed", F.col("next").alias("page"), (F.col("rank") + 1).alias("rank"))
    best = seeds.select("query_id", "seed", "page", "rank").unionByName(near).groupBy("query_id", "seed", "page").agg(F.min("rank").alias("rank"))
    scored = best.groupBy("query_id", "page").agg(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))).alias("score"), F.count("*").alias("seeds"))
    return scored.filter(F.round("score", 12) >= threshold)


# -- conditions: DataFrame of cases -> admitted hits ---------------------------

Condition = Callable[..., DataFrame]
_conditions: dict[str, Condition] = {}
NAMED_ONLY = ("prompted_memory_tool", "key_sentence_output_rag", "oracle_cue")


def register(name: str) -> Callable[[Condition], Condition]:
    """Add a condition; blank and repeated names are refused."""
    if not name.strip():
        raise ValueError("a condition needs a name")
    if name in _conditions:
        raise ValueError(f"condition {name!r} is registered already")

    def keep(condition: Condition) -> Condition:
        _conditions[name] = condition
        return condition

    return keep


def get_condition(name: str) -> Condition:
    if name in NAMED_ONLY:
        raise NotImplementedError(f"condition {name!r} is named but not built")
    if name not in _conditions:
        raise KeyError(f"unknown condition {name!r}; known: {', '.join(sorted(_conditions))}")
    return _conditions[name]


@register("no_memory")
def no_memory(cases: DataFrame, retriever=None, **_) -> DataFrame:
    """Nothing is retrieved; a retriever is refused."""
    if retriever is not None:
        raise ValueError("no_memory takes no retriever")
    return cases.filter(F.lit(False)).select("case_id", F.lit("").alias("page"), F.lit(0).alias("rank"))


@register("input_rag")
def input_rag(cases: DataFrame, retriever: Retriever, **_) -> DataFrame:
    """The prompt is the query. ``retriever`` maps (query_id, query_text) to (query_id, page, rank)."""
    hits = retriever(cases.select(F.col("case_id").alias("query_id"), F.col("prompt").alias("query_text")))
    return hits.select(F.col("query_id").alias("case_id"), "page", "rank")


@register("naive_output_rag")
def naive_output_rag(cases: DataFrame, retriever: Retriever, flow: str = "tool_output_only", **_) -> DataFrame:
    """The observation, the first answer, or both in turn are the query; pages of both passes count once."""
    if flow not in FLOWS:
        raise ValueError(f"unknown flow {flow!r}")
    phases = {"tool_output_only": ["observation"], "model_output_only": ["answer"], "tool_then_model_output": ["observation", "answer"]}[flow]
    parts = []
    for phase, column in enumerate(phases):
        hits = retriever(cases.select(F.col("case_id").alias("query_id"), F.col(column).alias("query_text")))
        parts.append(hits.select(F.col("query_id").alias("case_id"), "page", F.lit(phase).alias("phase"), "rank"))
    return dedupe.first_seen(reduce(DataFrame.unionByName, parts), "case_id", "page", ["phase", "rank"]).select(
        "case_id",
        "page",
        F.col("new_rank").alias("rank"),
    )


@register("all_entity_output_rag")
def all_entity_output_rag(
    cases: DataFrame,
    retriever=None,
    gazetteer: DataFrame | None = None,
    pages: DataFrame | None = None,
    chunks: DataFrame | None = None,
    k: int = OFFICIAL_TOP_K,
    **_
) -> DataFrame:
    """Every gazetteer surface and phrase of the observation admits its pages, each page once:
    its best hit by rank, then exact score; numbered by rank, score and id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if gazetteer is None or pages is None or chunks is None:
        raise ValueError("all_entity_output_rag needs a gazetteer, pages and chunks")
    hits = entities.entity_exact(cases.select(F.col("case_id").alias("observation_id"), F.col("observation").alias("text")), gazetteer, pages, chunks, k)
    hits = hits.select(F.col("observation_id").alias("case_id"), F.col("seed_no").alias("seed_id"), "page_id", "rank", "score")
    return dedupe.best_hits(hits).select("case_id", F.col("page_id").alias("page"), F.col("new_rank").alias("rank"))


# -- hits with what a reader sees ----------------------------------------------

#: Parts of a score that differ between runs of a model by its last digits; a kept trace leaves them out.
NOT_REPRODUCIBLE = ("original_query_cosine", "pre_graph_score", "final_score")


def hits_with_pages(hits: DataFrame, pages: DataFrame, chunks: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Ranked hits with page metadata, chunk text and diagnostics.

    hits: query_id, page, chunk, score, rank and what the mode adds; pages: page_id, source_id, slug,
    title, perturbations; chunks: chunk_id, text; channels: (query_id, channel, page, rank).
    """
    named = hits.join(pages.withColumnRenamed("page_id", "page"), "page")
    named = named.join(chunks.select(F.col("chunk_id").alias("chunk"), "text"), "chunk", "left")
    if channels is None:
        named = named.withColumn("ranks", F.lit(None).cast("map<string,int>"))
    else:
        named = named.join(fusion.channel_ranks(channels), ["query_id", "page"], "left")

    def part(name: str, otherwise: Column) -> Column:
        return F.col(name) if name in hits.columns else otherwise

    nothing = F.lit(None).cast("double")
    diagnostics = F.struct(
        F.coalesce("ranks", F.create_map().cast("map<string,int>")).alias("channel_ranks"),
        part("rrf", nothing).alias("raw_rrf"),
        part("normalized_rrf", nothing).alias("normalized_rrf"),
        part("cosine", nothing).alias("original_query_cosine"),
        part("pre_graph", F.col("score")).alias("pre_graph_score"),
        part("inbound", F.lit(0)).cast("bigint").alias("graph_inbound_count"),
        part("multiplier", F.lit(1.0)).alias("graph_multiplier"),
        F.col("score").alias("final_score"),
    )
    return named.select(
        "query_id",
        F.col("page").alias("page_id"),
        "source_id",
        "slug",
        "title",
        F.col("chunk").alias("chunk_id"),
        "text",
        "score",
        "rank",
        "perturbations",
        diagnostics.alias("diagnostics"),
    )


def traced(hits: DataFrame) -> DataFrame:
    """One row a query: the returned pages in order, without diagnostics that are not reproducible."""
    page = F.struct(
        F.col("rank").alias("final_rank"), "page_id", "source_id", "slug", F.col("chunk_id").alias("selected_chunk_id"), "perturbations", F.col("diagnostics").dropFields(*NOT_REPRODUCIBLE).alias("diagnostics")
    )
    in_order = F.array_sort(F.collect_list(page), lambda a, b: a["final_rank"] - b["final_rank"])
    return hits.groupBy("query_id").agg(in_order.alias("returned_pages"))


def check_arguments(
    condition: str,
    mode: str | None = None,
    index: str | None = None,
    k: int | None = None,
    expansions: str | None = None,
    policy: str | None = None,
    flow: str | None = None,
    responses: str | None = None,
    response_policy: str | None = None,
) -> None:
    """Which arguments go with which condition; ValueError names those that do not."""
    if response_policy and not responses:
        raise ValueError("a response policy needs a response cache")
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    given = {"mode": mode, "index": index, "k": k, "expansions": expansions, "expansion policy": policy, "flow": flow}
    refused = {"no_memory": set(given), "all_entity_output_rag": {"mode", "expansions", "expansion policy", "flow"}}.get(
        condition,
        set() if condition == "naive_output_rag" else {"flow"},
    )
    wrong = [name for name, value in given.items() if value and name in refused]
    if wrong:
        raise ValueError(f"{condition} takes no {', '.join(wrong)}")
    needed = {"no_memory": [], "all_entity_output_rag": ["index"], "naive_output_rag": ["flow", "mode", "index"]}.get(condition, ["mode", "index"])
    missing = [name for name in needed if not given[name]]
    if missing:
        raise ValueError(f"{condition} needs {', '.join(missing)}")
    if mode == "enhanced" and not expansions:
        raise ValueError("the enhanced mode needs expansions")
    if mode != "enhanced" and (expansions or policy):
        raise ValueError("expansions go with the enhanced mode, and only with it")


def max_merge(hits: DataFrame, k: int) -> DataFrame:
    """hits: (query_id, window, source_id, score). The best score of each source over a query's windows, ranked."""
    best = hits.groupBy("query_id", "source_id").agg(F.max("score").alias("score"))
    return lexical.top_k(best, k, tie="source_id")


def text_windows(text: Column, longest: int = 8000, step: int = 6000) -> Column:
    """Texts of more than ``longest`` characters cut every ``step``; others stay whole."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.when(F.length(text) > longest, F.transform(starts, lambda s: F.substring(text, s, F.lit(step)))).otherwise(F.array(text))
