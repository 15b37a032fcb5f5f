"""A run end to end over a frozen cache, and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from recollect.operators import caches
from recollect.plans import run as P
from recollect.streaming import admission


def test_run_from_frozen_responses(spark, tmp_path):
    cases = spark.createDataFrame(
        [("c1", "positive", "pick", ("tool_result",), "seen"), ("c2", "cue-ablated", "pick", ("tool_result",), "other")],
        "case_id string, variant string, prompt string, observation struct<kind:string>, observation_text string",
    )
    texts = spark.createDataFrame([("p1", "memory one"), ("p2", "memory two")], "page string, text string")

    def retriever(q):
        return q.filter("query_id = 'c1'").select(
            "query_id",
            F.explode(
                F.array(F.struct(F.lit("p2").alias("page"), F.lit(1).alias("rank")), F.struct(F.lit("p1").alias("page"), F.lit(2).alias("rank"))),
            ).alias("h"),
        ).select("query_id", "h.page", "h.rank")

    # noqa: E731
    key = lambda memory, seen: caches.response_key(
        {"max_output_tokens": F.lit("4096"), "memory": F.lit(memory), "model": F.lit("m"), "observation": F.lit(seen), "prompt": F.lit("pick")},
    )
    cache = spark.range(1).select(key("1. memory two\n\n2. memory one", "seen").alias("request_hash"), F.lit("first").alias("text"))
    with pytest.raises(caches.FrozenMiss):
        P.predict(cases, "input_rag", cache, texts, "m", retriever=retriever)
    whole = cache.unionByName(spark.range(1).select(key("", "other").alias("request_hash"), F.lit("second").alias("text")))
    got = {r.case_id: r for r in P.predict(cases, "input_rag", whole, texts, "m", retriever=retriever).collect()}
    assert got["c1"].response_text == "first" and got["c1"].admitted_page_ids == ["p2", "p1"] and got["c2"].admitted_page_ids == []
    path = str(tmp_path / "run")
    P.publish(P.predict(cases, "input_rag", whole, texts, "m", retriever=retriever), path, {"model": "m", "condition": "input_rag"})
    assert spark.read.json(path).count() == 2 and spark.read.json(f"{path}.config").columns == ["condition", "model"]
    assert P.select_variants(cases, "positive").count() == 1 and P.find_case(cases).first().case_id == "c1"
    with pytest.raises(ValueError):
        P.select_variants(cases, "memory-included")


def test_stream_admits_once(spark, tmp_path):
    rows = [
        ("o1", "2024-01-01 00:00:00", "The Alpha project, today"),
        ("o1", "2024-01-01 00:01:00", "The Alpha project, today"),
        ("o2", "2024-01-01 00:02:00", "nothing"),
    ]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "observation_id string, ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    gazetteer = spark.createDataFrame([("alpha project", ["a", "b"])], "surface string, page_ids array<string>")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    admission.run_available(admission.admit_stream(stream, gazetteer), str(tmp_path / "out"), str(tmp_path / "state"), mode="append")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.observation_id, r.page_id) for r in got) == [("o1", "a"), ("o1", "b")]
