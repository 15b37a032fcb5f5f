"""A retriever bound to an index and a model, and query expansion from a cache that jobs fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import TextEmbedder, check_embedder, embedder
from ..operators import caches
from ..operators.fusion import OFFICIAL_TOP_K
from ..session import settled
from ..sources.index import MemoryIndex
from ..sources.keyed import KeyedTable
from .retrieve import MODES, QueryExpander, retrieve

EXPANSION = "query_hash string, normalized_query string, model string, prompt_version string, alternatives array<string>"
POLICIES = ("frozen", "populate")


class CachedExpander:
    """Three other wordings of each query, from a keyed table.

    The policy "frozen" raises FrozenMiss for a query without an entry; "populate" asks ``answer`` for those, which
    maps (query_hash, normalized_query, query_text) to (query_hash, alternatives) as a batch job, checks what it says
    and adds it. Jobs that populate at the same time keep one answer for each query.
    """

    def __init__(self, cache: KeyedTable, model: str, prompt_version: str, policy: str = "frozen", answer: Callable[[DataFrame], DataFrame] | None = None) -> None:
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
        if policy == "populate" and answer is None:
            raise ValueError("the populate policy needs something that answers")
        self.cache, self.model, self.prompt_version, self.policy, self.answer = cache, model, prompt_version, policy, answer

    def _asked(self, queries: DataFrame) -> DataFrame:
        hash_ = caches.expansion_key(F.col("query_text"), self.model, self.prompt_version)
        return queries.select("query_id", "query_text", hash_.alias("query_hash"))

    def populate(self, queries: DataFrame) -> int:
        """Answer and add what the cache lacks; how many entries were added. ValueError for an answer that is not three unlike wordings."""
        from ..functions import text as T

        asked = self._asked(queries).select("query_hash", T.normalize_query(F.col("query_text")).alias("normalized_query"), "query_text").dropDuplicates(["query_hash"])
        lost = settled(caches.misses(asked, self.cache.read(), "query_hash"))
        if lost.isEmpty():
            return 0
        said = settled(self.answer(lost).select("query_hash", "alternatives").join(lost, "query_hash"))
        fine = F.coalesce(caches.valid_expansions(F.col("alternatives"), F.col("query_text")), F.lit(False))
        wrong = said.filter(~fine).select("query_text").head(1)
        if wrong:
            raise ValueError(f"not three unlike wordings for {wrong[0].query_text!r}")
        return self.cache.upsert(said.select("query_hash", "normalized_query", F.lit(self.model).alias("model"), F.lit(self.prompt_version).alias("prompt_version"), "alternatives"))

    def __call__(self, queries: DataFrame) -> DataFrame:
        """(query_id, n from 1 to 3, query_text)."""
        if self.policy == "populate":
            self.populate(queries)
        asked = self._asked(queries.select("query_id", "query_text").distinct())
        found = caches.lookup(asked, self.cache.read().select("query_hash", "alternatives"), "query_hash", frozen=True)
        rows = found.select("query_id", F.posexplode("alternatives").alias("n", "query_text"))
        return rows.select("query_id", (F.col("n") + 1).alias("n"), "query_text")


class IndexRetriever:
    """Maps (query_id, query_text) to (query_id, page, rank) over one index.

    Refused with ValueError: a model other than the index was built with, or of another width; an
    expander without the enhanced mode, or the mode without one; a limit below 1.
    """

    def __init__(self, index: MemoryIndex, mode: str, model: TextEmbedder, expander: QueryExpander | None = None, k: int = OFFICIAL_TOP_K) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
        if index.manifest is None:
            raise ValueError("an index without a manifest names no model")
        check_embedder(model, index.manifest.first())
        if (expander is not None) != (mode == "enhanced"):
            raise ValueError("an expander goes with the enhanced mode, and only with it")
        if k < 1:
            raise ValueError("k must be at least 1")
        self.index, self.mode, self.model, self.expander, self.k = index, mode, model, expander, k

    def hits(self, queries: DataFrame) -> DataFrame:
        embed = embedder(self.model)
        asked = queries.withColumn("query_vector", embed(F.col("query_text")))
        expansions = None
        if self.expander is not None:
            expansions = self.expander(queries).withColumn("query_vector", embed(F.col("query_text")))
        docs = self.index.documents.withColumnRenamed("page_id", "page")
        return retrieve(asked, docs, self.index.chunks, self.index.links, self.mode, self.k, expansions)

    def __call__(self, queries: DataFrame) -> DataFrame:
        return self.hits(queries).select("query_id", "page", "rank")
