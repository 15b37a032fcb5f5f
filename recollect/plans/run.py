"""A benchmark run as one plan: cases, a condition, frozen responses, predictions."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caches, fusion, scoring
from .retrieve import get_condition

MAX_OUTPUT_TOKENS = 4096


def select_variants(cases: DataFrame, *variants: str) -> DataFrame:
    """Cases of the given variants; an empty choice is an error."""
    chosen = cases.filter(F.col("variant").isin(*variants)) if variants else cases
    if not chosen.take(1):
        raise ValueError(f"no case has a variant among {', '.join(variants) or 'any'}")
    return chosen


def find_case(cases: DataFrame, case_id: str | None = None, position: str = "case_id") -> DataFrame:
    """The first case, by ``position``, with the given id; without one, of all."""
    found = cases.filter(F.col("case_id") == case_id) if case_id else cases
    return found.orderBy(position).limit(1)


def public(case: DataFrame) -> DataFrame:
    """A case without its private fields and the observation's text."""
    return case.select(*[c for c in case.columns if not c.startswith("_") and c != "observation_text"])


def visible(cases: DataFrame) -> DataFrame:
    """What a model may see of a case; gold fields are not read."""
    return cases.select("case_id", "prompt", F.col("observation.kind").alias("observation_kind"), "observation_text")


def contexts(admitted: DataFrame, texts: DataFrame) -> DataFrame:
    """(case_id, memory): admitted pages' texts in order of rank. texts: (page, text)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return admitted.join(texts, "page").groupBy("case_id").agg(T.render_context(parts).alias("memory"))


def predict(cases: DataFrame, condition: str, responses: DataFrame, texts: DataFrame, model: str, frozen: bool = True, **given) -> DataFrame:
    """Predictions from the response cache (request_hash, text). A frozen cache must hold
    every request; otherwise a missing response is null and left to a populate job."""
    admitted = get_condition(condition)(cases, **given)
    asked = visible(cases).join(contexts(admitted, texts), "case_id", "left")
    fields = {
        "max_output_tokens": F.lit(str(MAX_OUTPUT_TOKENS)),
        "memory": F.col("memory"),
        "model": F.lit(model),
        "observation": F.col("observation_text"),
        "prompt": F.col("prompt"),
    }
    requests = asked.withColumn("request_hash", caches.response_key(fields))
    answered = caches.lookup(requests, responses.select("request_hash", F.col("text").alias("response_text")), "request_hash", frozen)
    pages = admitted.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("admitted_page_ids"))
    out = answered.join(pages, "case_id", "left")
    return out.select(
        "case_id",
        F.lit(condition).alias("baseline"),
        "response_text",
        F.lit(model).alias("requested_model"),
        F.coalesce("admitted_page_ids", F.array().cast("array<string>")).alias("admitted_page_ids"),
        "request_hash",
    )


#: What a run's settings hold, whether or not a value is known.
SETTINGS = (
    "admission_policy baseline chunker_version constants corpus dependency_versions embedding_model expansion_cache_hash expansion_model expansion_prompt_version "
    "index_version output_rag_flow perturbation_filtering requested_model response_cache_hash retrieval_condition_detail retrieval_index retrieval_limit "
    "retrieval_manifest_hash retrieval_mode variants"
).split()


def settings(
    condition: str,
    model: str,
    mode: str | None = None,
    k: int | None = None,
    flow: str | None = None,
    variants: list[str] | None = None,
    index=None,
    **known
) -> dict:
    """All settings of a run. ``index``: (path, manifest row); ``known`` names further ones."""
    unknown = set(known) - set(SETTINGS)
    if unknown:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    out: dict = dict.fromkeys(SETTINGS)
    out |= {"baseline": condition, "requested_model": model, "retrieval_mode": mode, "retrieval_limit": k, "output_rag_flow": flow, "variants": variants}
    if index is not None:
        path, manifest = index
        out |= {
            "retrieval_index": path,
            "retrieval_manifest_hash": manifest["content_hash"],
            "corpus": manifest["corpus_id"],
            "embedding_model": manifest["embedding_model"],
        }
        out |= {
            "chunker_version": manifest.get("chunker_version"),
            "admission_policy": "all_retrieved",
            "perturbation_filtering": False,
            "dependency_versions": {"numpy": np.__version__, "pyspark": pyspark.__version__},
        }
        if mode is None:
            out["retrieval_condition_detail"] = "entity_exact_match"
    if mode is not None:
        out["constants"] = {
            "candidate_depth": fusion.CANDIDATE_DEPTH, "cosine_weight": fusion.COSINE_WEIGHT, "graph_min_inbound": fusion.GRAPH_MIN_INBOUND, "graph_multiplier": fusion.GRAPH_MULTIPLIER,
            "rrf_k": fusion.RRF_K, "rrf_weight": fusion.RRF_WEIGHT,
        }
    return out | known


def publish(predictions: DataFrame, path: str, configuration: dict) -> None:
    """Predictions as JSON lines, and beside them one row of settings with sorted keys.

    Earlier results are never touched: an existing path is refused. Rows are written to a
    folder beside it that takes its name when whole; the settings follow.
    """
    spark = predictions.sparkSession
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(made)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(f"{path} exists")
    try:
        predictions.write.json(made)
        if files.exists(target) or not files.rename(part, target):
            raise FileExistsError(f"{path} exists")
    finally:
        files.delete(part, True)
    line = json.dumps(configuration, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}.config")


def grid_of_runs(predictions: DataFrame, cases: DataFrame, prefix: str, file: str = "file") -> DataFrame:
    """Runs named '<prefix><flow>-<mode>.<ext>' joined with their cases: correct answers by plain
    containment and totals by variant, flow and mode, with a grand total for every variant.

    predictions: file, case_id, response_text; cases: case_id, variant, output_choice, memory_choice.
    """
    named = predictions.select("case_id", "response_text", T.run_name(F.col(file), prefix).alias("r")).join(cases, "case_id")
    right = T.coarse_correct(F.coalesce("response_text", F.lit("")), F.col("output_choice"), F.col("memory_choice"), F.col("variant") == "cue-ablated")
    return scoring.grid(named.select("variant", "r.flow", "r.mode", right.alias("correct")))
