"""Term tables that are counted where the texts lie."""

import re

import pytest
from pyspark.sql import functions as F

from recollect import composite_queries, queries
from recollect.operators import lexical, postings

TEXTS = ["b a b", "Zebra", None, "", "zebra İx ſt Kelvin", "a", "été a-b_c", "x" * 70 + " " + "y1 " * 50, "ß b"]


def words(text):
    return re.findall("[a-z0-9]+", (text or "").casefold())


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


def docs_at(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stretch", [1, 8, 1 << 20])
def test_terms_are_counted_where_texts_lie(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(lexical, "STRETCH", stretch)
    at = docs_at(spark, tmp_path, list(enumerate(TEXTS)))
    expected = {(n, w): words(t).count(w) for n, t in enumerate(TEXTS) for w in words(t)}
    made = queries.term_frequencies(spark, at)
    assert "Exchange" not in plan(made)  # nothing is shuffled
    assert {(r.doc_id, r.term): r.tf for r in made.collect()} == expected
    frequencies = queries.document_frequencies(spark, at)
    assert plan(frequencies).count("Exchange") == 1
    every = {w for _, w in expected}
    assert {r.term: r.df for r in frequencies.collect()} == {w: sum(v == w for _, v in expected) for w in every}
    merged = composite_queries.merged_hits(spark, at)
    assert "Exchange" not in plan(merged) and "Window" not in plan(merged)
    order = sorted((n, i + 1, w) for n, t in enumerate(TEXTS) for i, w in enumerate(dict.fromkeys(words(t))))
    assert sorted((r.case_id, r.new_rank, r.page) for r in merged.collect()) == order


def test_texts_that_share_an_id_count_as_one(spark, tmp_path):
    at = docs_at(spark, tmp_path, [(1, "a b"), (1, "b b c"), (2, "c"), (None, "c d")])
    assert {(r.doc_id, r.term): r.tf for r in queries.term_frequencies(spark, at).collect()} == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (2, "c"): 1, (None, "c"): 1, (None, "d"): 1}
    assert {r.term: r.df for r in queries.document_frequencies(spark, at).collect()} == {"a": 1, "b": 1, "c": 2, "d": 0}  # as COUNT(DISTINCT doc_id)


@pytest.mark.parametrize("stretch", [1, 1 << 20])
def test_counts_of_written_tokens_need_no_table_of_groups(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(postings, "STRETCH", stretch)
    rows = [(n, len(words(t)), words(t)) for n, t in enumerate(TEXTS)]
    tokens = spark.createDataFrame(rows, "doc long, len int, terms array<string>")
    made = postings.count_rows(tokens)
    assert "Aggregate" not in plan(made)
    assert {(r.doc, r.term): (r.tf, r.len) for r in made.collect()} == {(n, w): (ws.count(w), k) for n, k, ws in rows for w in ws}
    twice = postings.count_rows(tokens.unionByName(tokens.filter("doc = 0")))
    assert {r.term: r.tf for r in twice.filter(F.col("doc") == 0).collect()} == {"a": 2, "b": 4}
