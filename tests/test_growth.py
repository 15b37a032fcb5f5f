"""Steps that once grew faster than their input, or lay in one task."""

import numpy as np
from pyspark.sql import functions as F

from recollect import queries, source_queries
from recollect.operators import dense, entities
from recollect.plans import retrieve as R


def vectors(spark, pages, n=60, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, i % pages, [float(x) for x in rng.normal(size=4)]) for i in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id long, page_id long, embedding array<double>")
    asked = [(q, w, [float(x) for x in rng.normal(size=4)]) for q in range(3) for w in range(2)]
    return chunks, spark.createDataFrame(asked, "query_id long, window int, query_vector array<double>")


def test_ranked_pages_do_not_meet_their_chunks_again(spark, monkeypatch):
    chunks, asked = vectors(spark, pages=6)
    before = R.pooled_cosines(asked.select("query_id").distinct().join(chunks.select(F.col("page_id").alias("page")).distinct()), asked, chunks)
    best = {(r.query_id, r.page): (r.window, r.chunk) for r in before.collect()}

    def refused(*_):
        raise AssertionError("chunks of ranked pages are compared once")

    monkeypatch.setattr(dense, "cosines_of", refused)
    ranked = R.window_ranks(R.window_bests(asked, chunks, R.CANDIDATE_DEPTH))
    pooled = R.pooled_ranks(ranked, ranked, asked, chunks)
    assert {(r.query_id, r.page): (r.window, r.chunk) for r in pooled.collect()} == best
    assert R.dense_mode(asked, chunks).count() == 15


def test_windows_that_do_not_rank_a_page_still_pool(spark, monkeypatch):
    monkeypatch.setattr(R, "CANDIDATE_DEPTH", 3)
    chunks, asked = vectors(spark, pages=20)
    ranked = R.window_ranks(R.window_bests(asked, chunks, 3))
    rows = lambda t: {(r.query_id, r.page): (r.window, r.chunk, round(r.cosine, 9)) for r in t.collect()}
    assert rows(R.pooled_ranks(ranked, ranked, asked, chunks)) == rows(R.pooled_cosines(ranked, asked, chunks))


def test_strips_of_queries_give_the_same_rows(spark, monkeypatch):
    chunks, asked = vectors(spark, pages=6)
    sides = asked.filter("window = 0").select("query_id", "query_vector"), chunks.select(F.col("page_id").alias("page"), F.col("chunk_id").alias("chunk"), F.col("embedding").alias("vector"))
    rows = lambda k: sorted((r.query_id, r.page, r.chunk, round(r.cosine, 9)) for r in dense.best_in_blocks(*sides, k).collect())
    whole = rows(None), rows(2)
    monkeypatch.setattr(dense, "STRIP", 1)
    assert (rows(None), rows(2)) == whole


def test_customers_of_one_file_are_dealt_over_all_cores(spark, tmp_path):
    rows = [(n, f"Customer {n}") for n in range(40)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert source_queries._case_rows(spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_only_matching_texts_are_normalised_for_scores(spark, tmp_path, monkeypatch):
    docs = [(1, "One two three\nfour"), (2, "nothing here"), (3, "zero\none two three")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one, TWO three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    true = entities.of_hits
    monkeypatch.setattr(entities, "of_hits", lambda docs, near: kept.append(true(docs, near)) or kept[-1])
    assert sorted(map(tuple, queries.exact_match_score(spark, str(tmp_path)).collect())) == [(1, 7, 3.0), (3, 7, 1.0)]
    assert sorted(r.doc for r in kept[-1].collect()) == [1, 3]
