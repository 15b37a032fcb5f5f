"""Keyed tables, expansion caches, wired retrievers, digest trees and hub pages."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import caches, fusion, merkle
from recollect.plans import retrieve as R
from recollect.plans.wired import EXPANSION, CachedExpander, IndexRetriever
from recollect.sources.index import MemoryIndex
from recollect.sources.keyed import KeyedTable


def answers(lost):
    return lost.select("query_hash", F.array(*[F.concat(F.lit(f"{x} "), "query_text") for x in ("one", "two", "three")]).alias("alternatives"))


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query_text string")


def test_populate_then_frozen_replay(spark, tmp_path):
    cache = KeyedTable(spark, f"file://{tmp_path}/c", EXPANSION, "query_hash")
    asked = queries(spark, "Original query", " original   QUERY ", "Other")
    made = CachedExpander(cache, "m", "v1", "populate", answers)(asked)
    said = sorted((r.query_id, r.n, r.query_text) for r in made.collect())
    assert len(said) == 9 and cache.read().count() == 2
    again = KeyedTable(spark, f"file://{tmp_path}/c", EXPANSION, "query_hash")
    frozen = CachedExpander(again, "m", "v1")(asked)
    assert sorted((r.query_id, r.n, r.query_text) for r in frozen.collect()) == said
    assert caches.used_digest(again.read(), "query_hash", "normalized_query").first().entries == 2
    never = CachedExpander(again, "m", "v1", "populate", lambda lost: pytest.fail("asked again"))
    assert never.populate(asked) == 0


def test_frozen_miss_and_wrong_answers(spark, tmp_path):
    cache = KeyedTable(spark, f"file://{tmp_path}/c", EXPANSION, "query_hash")
    with pytest.raises(caches.FrozenMiss):
        CachedExpander(cache, "m", "v1")(queries(spark, "missing"))
    same = lambda lost: lost.select("query_hash", F.array(F.lit("same"), F.lit("Same "), F.lit("different")).alias("alternatives"))
    with pytest.raises(ValueError):
        CachedExpander(cache, "m", "v1", "populate", same).populate(queries(spark, "original"))
    assert cache.read().count() == 0
    with pytest.raises(ValueError):
        CachedExpander(cache, "m", "v1", "sometimes")
    with pytest.raises(ValueError):
        CachedExpander(cache, "m", "v1", "populate")


def test_jobs_at_the_same_time_write_a_key_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k string, who int"
    errors = []

    def fill(who):
        try:
            own = KeyedTable(spark, path, schema, "k")
            rows = spark.createDataFrame([(f"k{i}", who) for i in range(who, who + 6)], schema)
            own.upsert(rows)
            assert own.upsert(rows) == 0
        except Exception as error:  # noqa: BLE001  a thread's failure is the test's
            errors.append(error)

    jobs = [threading.Thread(target=fill, args=(who,)) for who in range(4)]
    for job in jobs:
        job.start()
    for job in jobs:
        job.join()
    assert errors == []
    got = [r.k for r in KeyedTable(spark, path, schema, "k").read().collect()]
    assert sorted(got) == [f"k{i}" for i in range(9)]


def toy():
    """A model of a class that goes to the workers by value."""

    class Model:
        model, dimensions = "toy", 2

        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    return Model()


def index(spark, model="toy", dimensions=2):
    pages = spark.createDataFrame([("p1", "Alpha"), ("p2", "Beta")], "page_id string, title string")
    chunks = spark.createDataFrame([("p1:0", "p1", 0, "alpha text", [1.0, 0.0]), ("p2:0", "p2", 0, "beta", [0.0, 1.0])], "chunk_id string, page_id string, chunk_index int, text string, embedding array<float>")
    links = spark.createDataFrame([("p1", "p2")], "source_page_id string, target_page_id string")
    manifest = spark.createDataFrame([(model, dimensions)], "embedding_model string, embedding_dimensions int")
    return MemoryIndex(pages, chunks, links, manifest)


def test_wiring_is_checked(spark, tmp_path):
    good = index(spark)
    expander = CachedExpander(KeyedTable(spark, f"file://{tmp_path}/c", EXPANSION, "query_hash"), "m", "v1", "populate", answers)
    for wrong in (
        lambda: IndexRetriever(index(spark, model="other"), "dense", toy()),
        lambda: IndexRetriever(index(spark, dimensions=3), "dense", toy()),
        lambda: IndexRetriever(good, "enhanced", toy()),
        lambda: IndexRetriever(good, "hybrid", toy(), expander),
        lambda: IndexRetriever(good, "dense", toy(), k=0),
        lambda: IndexRetriever(good, "odd", toy()),
        lambda: R.retrieve(None, None, None, k=0),
        lambda: R.check_arguments("input_rag", mode="dense", index="i", k=0),
        lambda: R.get_condition("all_entity_output_rag")(None, k=0),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_wired_retriever_answers(spark, tmp_path):
    asked = queries(spark, "alpha text of some length", "b")
    expander = CachedExpander(KeyedTable(spark, f"file://{tmp_path}/c", EXPANSION, "query_hash"), "m", "v1", "populate", answers)
    for mode, own in (("dense", None), ("hybrid", None), ("enhanced", expander)):
        got = {(r.query_id, r["rank"]): r.page for r in IndexRetriever(index(spark), mode, toy(), own, k=1)(asked).collect()}
        assert got[0, 1] == "p1", mode


def test_digest_tree_whatever_the_partitioning(spark):
    rows = spark.range(2000).selectExpr("concat('n', id) AS k", "concat('v', id % 7) AS v")
    one, other = (sorted(map(tuple, merkle.tree(rows.repartition(n, "v"), "k", "v").collect())) for n in (1, 5))
    assert one == other and len([r for r in one if len(r[0]) == 3]) > 1000 and sum(r[1] for r in one if r[0] == "") == 2000
    now = rows.withColumn("v", F.when(F.col("k") == "n17", "new").otherwise(F.col("v"))).filter("k <> 'n30'").unionByName(spark.range(1).selectExpr("'added' AS k", "'x' AS v"))
    met = {r.range for r in merkle.changed(merkle.tree(rows, "k", "v"), merkle.tree(now, "k", "v")).collect()}
    assert met == {r[0] for r in spark.createDataFrame([("n17",), ("n30",), ("added",)], "k string").select(merkle.range_of(F.col("k"))).collect()}
    assert merkle.changed(merkle.tree(rows, "k", "v"), merkle.tree(rows, "k", "v")).count() == 0
    assert merkle.root(rows.limit(0), "k", "v").first().entries == 0
    assert merkle.root(rows.union(rows), "k", "v").first().digest != merkle.root(rows, "k", "v").first().digest


def test_a_hub_adds_no_rows_beyond_its_pools(spark):
    scored = spark.createDataFrame([(q, f"p{i}", 1.0 / (i + 1)) for q in range(3) for i in range(5)], "query_id int, page string, pre_graph double")
    hub = spark.range(200_000).selectExpr("concat('x', id) AS source_page_id", "'p0' AS target_page_id")
    links = hub.unionByName(spark.createDataFrame([("p1", "p0"), ("p1", "p0"), ("p2", "p0"), ("p0", "p0"), ("p0", "p3"), ("x1", "p9")], "source_page_id string, target_page_id string"))
    counts = fusion.inbound_counts(scored, links)
    assert {(r.query_id, r.page): r.inbound for r in counts.collect()} == {(q, f"p{i}"): {0: 2, 3: 1}.get(i, 0) for q in range(3) for i in range(5)}
    plan = counts._jdf.queryExecution().executedPlan()
    assert "getbit" in plan.toString()
