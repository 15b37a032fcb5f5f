"""Ranking rules on small indexes."""

import math

import pytest
from pyspark.sql import functions as F

from recollect.operators import dense, fusion, lexical
from recollect.plans import retrieve as R

CHUNKS = [
    ("s:p1:0", "s:p1", [0.2, 0.98]),
    ("s:p1:1", "s:p1", [1.0, 0.0]),
    ("s:p2:0", "s:p2", [0.99, 0.1]),
    ("s:p3:0", "s:p3", [0.0, 1.0]),
    ("s:p4:0", "s:p4", [-1.0, 0.0]),
]
DOCS = [("s:p1", "First", "alpha weak alpha strongest"), ("s:p2", "Second", "alpha second"), ("s:p3", "Third", "other"), ("s:p4", "Fourth", "other")]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, page_id string, embedding array<float>")
    docs = spark.createDataFrame(DOCS, "page string, title string, body string")
    return docs, chunks


def asked(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, query_text string, query_vector array<float>")


def test_dense_takes_the_best_chunk_of_each_page(spark, index):
    docs, chunks = index
    hits = R.retrieve(asked(spark, ("q", "alpha", [1.0, 0.0])), docs, chunks, k=3).orderBy("rank").collect()
    assert (hits[0].page, hits[0].chunk) == ("s:p1", "s:p1:1")
    assert len({h.page for h in hits}) == 3


def test_dense_order_by_cosine_then_id(spark, index):
    docs, chunks = index
    hits = R.retrieve(asked(spark, ("q", "vertical", [0.0, 1.0])), docs, chunks, k=2).orderBy("rank").collect()
    assert [h.page for h in hits] == ["s:p3", "s:p1"]


def test_windows_are_fused_by_rank(spark, index):
    docs, chunks = index
    rows = [("q", i, "t", [1.0, 0.0] if i % 2 == 0 else [0.0, 1.0]) for i in range(4)]
    queries = spark.createDataFrame(rows, "query_id string, window int, query_text string, query_vector array<float>")
    hits = R.retrieve(queries, docs, chunks, k=5).orderBy("rank").collect()
    assert hits[0].page == "s:p1" and hits[-1].page == "s:p4"
    assert hits[0].score < 0.1  # raw fusion, no cosine


def test_hybrid_blends_normalised_fusion_and_cosine(spark, index):
    docs, chunks = index
    top = R.retrieve(asked(spark, ("q", "alpha", [1.0, 0.0])), docs, chunks, mode="hybrid", k=2).orderBy("rank").first()
    assert top.normalized_rrf == pytest.approx(1.0)
    assert top.score == pytest.approx(0.7 + 0.3 * top.cosine)


@pytest.mark.parametrize("mode", ["hybrid", "enhanced"])
def test_pages_without_a_vector_are_ranked_too(spark, index, mode):
    docs, chunks = index
    more = docs.unionByName(spark.createDataFrame([("s:p9", "Ninth", "gamma gamma")], docs.schema))
    query = asked(spark, ("q", "gamma", [1.0, 0.0]))
    links = spark.createDataFrame([("s:p1", "s:p2")], "source_page_id string, target_page_id string")
    expansions = spark.createDataFrame([("q", 1, "gamma", [1.0, 0.0])], "query_id string, n int, query_text string, query_vector array<float>")
    hits = {h.page: h for h in R.retrieve(query, more, chunks, links, mode, 5, expansions if mode == "enhanced" else None).collect()}
    assert hits["s:p9"].chunk is None and hits["s:p9"].cosine == 0.0
    assert hits["s:p9"].score == pytest.approx(0.7 * hits["s:p9"].normalized_rrf)
    assert {h.chunk for p, h in hits.items() if p != "s:p9"} == {"s:p1:1", "s:p2:0", "s:p3:0", "s:p4:0"}


def test_enhanced_needs_expansions_and_boosts_linked_pages(spark):
    chunks = spark.createDataFrame(
        [(f"s:p{i}:0", f"s:p{i}", [1 - 0.01 * i, 0.01 * i]) for i in range(1, 6)],
        "chunk_id string, page_id string, embedding array<float>",
    )
    texts = ["red one", "green two", "blue three"]
    docs = spark.createDataFrame(
        [("s:p1", "First", "alpha"), ("s:p2", " ".join(texts), "unrelated"), *[(f"s:p{i}", "T", "unrelated") for i in (3, 4, 5)]],
        "page string, title string, body string",
    )
    links = spark.createDataFrame([("s:p3", "s:p2"), ("s:p4", "s:p2"), ("s:p1", "s:p5"), ("s:p2", "s:p2")], "source_page_id string, target_page_id string")
    expansions = spark.createDataFrame(
        [("q", n, t, [1.0, 0.0]) for n, t in enumerate(texts, 1)],
        "query_id string, n int, query_text string, query_vector array<float>",
    )
    queries = asked(spark, ("q", "alpha", [1.0, 0.0]))
    hits = {h.page: h for h in R.retrieve(queries, docs, chunks, links, "enhanced", 5, expansions).collect()}
    assert hits["s:p2"].inbound == 2 and hits["s:p2"].multiplier == 1.05 and hits["s:p2"].rank == 1
    assert hits["s:p5"].multiplier == 1.0
    with pytest.raises(ValueError):
        R.retrieve(queries, docs, chunks, links, "enhanced")
    with pytest.raises(ValueError):
        R.retrieve(queries, docs, chunks, mode="sparse")


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("p1", "orange orange climate"), ("p2", "orange"), ("p3", "unrelated"), ("p4", "")], "doc string, body string")
    queries = spark.createDataFrame([("a", "orange climate"), ("b", "orange orange"), ("c", "?!"), ("d", "absent")], "query_id string, query_text string")
    got = {(r.query_id, r.doc): r.score for r in lexical.bm25(queries, docs, "doc", "body").collect()}
    avg = 5 / 4

    def part(tf, df, length):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))

    assert got["a", "p1"] == pytest.approx(part(2, 2, 3) + part(1, 1, 3))
    assert got["b", "p2"] == pytest.approx(2 * part(1, 2, 1))
    ranks = lexical.bm25_rank(queries, docs, 2, "doc", "body").collect()
    assert [r.doc for r in sorted(ranks, key=lambda r: r.rank) if r.query_id == "c"] == ["p1", "p2"]
    assert not [r for r in ranks if r.query_id == "d"]


def test_rrf_and_zero_vectors(spark):
    rows = [("q", "a", "p1", 1), ("q", "a", "p2", 2), ("q", "b", "p2", 1), ("q", "b", "p1", 2)]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id string, channel string, page string, rank int")).collect()
    assert all(r.rrf == pytest.approx(1 / 61 + 1 / 62) for r in got)
    zero = spark.range(1).select(dense.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c
    assert zero == 0.0


def test_results_do_not_depend_on_partitioning(spark, index):
    docs, chunks = index
    queries = asked(spark, ("q", "alpha", [1.0, 0.0]), ("r", "other second", [0.5, 0.5]))

    def run(n):
        hits = R.retrieve(queries.repartition(n), docs.repartition(n), chunks.repartition(n), mode="hybrid").collect()
        return sorted((h.query_id, h.page, h.rank, round(h.score, 9)) for h in hits)

    assert run(1) == run(7)


def test_conditions(spark):
    cases = spark.createDataFrame([("c", "p", "o", "a")], "case_id string, prompt string, observation string, answer string")
    table = {"p": ["x"], "o": ["shared"], "a": ["model", "shared"]}

    def retriever(q):
        rows = [(r.query_id, page, n) for r in q.collect() for n, page in enumerate(table[r.query_text], 1)]
        return spark.createDataFrame(rows, "query_id string, page string, rank int")

    both = R.get_condition("naive_output_rag")(cases, retriever, flow="tool_then_model_output").orderBy("rank").collect()
    assert [h.page for h in both] == ["shared", "model"]
    assert R.get_condition("no_memory")(cases).count() == 0
    assert [h.page for h in R.get_condition("input_rag")(cases, retriever).collect()] == ["x"]
    with pytest.raises(ValueError):
        R.get_condition("no_memory")(cases, retriever)
    with pytest.raises(NotImplementedError):
        R.get_condition("oracle_cue")
    with pytest.raises(KeyError):
        R.get_condition("unheard")
    with pytest.raises(ValueError):
        R.register("no_memory")
