"""Integrity rules: every violation is a row, nothing fails fast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import OBSERVATION_KINDS, VARIANTS

# The fields that every case has.
REQUIRED_FIELDS = ["base_case_id", "case_id", "cue", "decisions", "distractors", "memory", "observation", "prompt", "provenance", "variant"]
MIN_TOKENS, MAX_TOKENS, MIN_CHOICES, MIN_DISTRACTORS = 8_000, 12_000, 25, 3


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, copies) of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has (null keys included)."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def issue(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("id"), F.lit(rule).alias("message"))


def index_issues(pages: DataFrame, chunks: DataFrame, links: DataFrame, dimensions: int) -> DataFrame:
    """Duplicate ids, broken references, pages without chunks, wrong or non-finite vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    parts = [
        issue(duplicates(pages, "page_id"), "page_id", "duplicate page id"),
        issue(duplicates(chunks, "chunk_id"), "chunk_id", "duplicate chunk id"),
        issue(dangling(chunks, "page_id", pages, "page_id"), "chunk_id", "chunk without page"),
        issue(dangling(pages, "page_id", chunks, "page_id"), "page_id", "page without chunk"),
        issue(dangling(links, "source_page_id", pages, "page_id"), "source_page_id", "link from unknown page"),
        issue(dangling(links, "target_page_id", pages, "page_id"), "target_page_id", "link to unknown page"),
        issue(chunks.filter(F.col("embedding").isNull() | (F.size("embedding") != dimensions)), "chunk_id", "wrong vector width"),
        issue(chunks.filter(~finite), "chunk_id", "vector is not finite"),
    ]
    return reduce(DataFrame.unionByName, parts)


def count_issues(manifest: DataFrame, **tables: DataFrame) -> DataFrame:
    """Counts stated in the manifest against the tables."""
    parts = []
    for name, table in tables.items():
        real = table.agg(F.count("*").alias("n"))
        wrong = manifest.select(F.try_element_at("counts", F.lit(name)).alias("stated")).join(real, F.col("stated").isNull() | (F.col("stated") != F.col("n")))
        parts.append(wrong.select(F.lit(name).alias("id"), F.lit("count differs from manifest").alias("message")))
    return reduce(DataFrame.unionByName, parts)


def variant_issues(cases: DataFrame) -> DataFrame:
    """Base cases whose variants are not exactly the three."""
    sets = cases.groupBy("base_case_id").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    return issue(sets.filter(F.col("variants") != F.lit(sorted(VARIANTS))), "base_case_id", "must contain positive, cue-ablated, and memory-included variants")


def missing_fields(cases: DataFrame) -> list[tuple[str, Column]]:
    """A rule for each required field: absent from the array ``fields`` of a case's own keys (a null that is written
    down is no missing field); where cases have no such column, from their columns."""

    def missing(name: str) -> Column:
        if "fields" in cases.columns:
            return ~F.array_contains(F.coalesce("fields", F.array().cast("array<string>")), name)
        return F.lit(name not in cases.columns)

    return [(f"missing required field '{name}'", missing(name)) for name in REQUIRED_FIELDS]


def case_issues(cases: DataFrame, files: DataFrame | None = None, token_count=None) -> DataFrame:
    """All rules on cases; ``cases`` follows schemas.CASE with observation_text, and fields as of ``missing_fields``.

    ``files`` (path, sha256) are the corpus files; ``token_count`` maps a text
    column to its token count (default: words of a-z and 0-9).
    """
    text = F.coalesce("observation_text", F.lit(""))
    prompt = T.casefold(F.coalesce("prompt", F.lit("")))
    cue = F.coalesce("cue.text", F.lit(""))
    present = F.col("variant").isin("positive", "memory-included")
    n_tokens = (token_count or (lambda t: F.size(T.tokens(t))))(text)
    labels = T.listing_labels(text)
    sources = F.coalesce("memory.sources", F.array().cast(cases.schema["memory"].dataType["sources"].dataType))
    ids = F.coalesce("memory.gold_source_ids", F.array().cast("array<string>"))
    choice = {"output-only": F.col("decisions.output_only.choice"), "memory-conditioned": F.col("decisions.memory_conditioned.choice")}
    prefix = lambda p: F.substring_index(p, "/", 1)
    rules: list[tuple[str, Column]] = [
        *missing_fields(cases),
        ("invalid variant", F.col("variant").isNull() | ~F.col("variant").isin(*VARIANTS)),
        ("invalid observation.kind", F.col("observation.kind").isNull() | ~F.col("observation.kind").isin(*OBSERVATION_KINDS)),
        ("observation length out of bounds", ~n_tokens.between(MIN_TOKENS, MAX_TOKENS)),
        ("cue leaks into prompt", F.contains(prompt, T.casefold(cue))),
        ("cue.present disagrees with variant", F.coalesce("cue.present", F.lit(False)) != present),
        ("gold cue is absent from observation", present & ~F.contains(text, cue)),
        ("ablated observation still contains cue", (F.col("variant") == "cue-ablated") & F.contains(text, cue)),
        (
            "prompt must contain the injected memory",
            (F.col("variant") == "memory-included") & (
                (F.coalesce("memory.text", F.lit("")) == "") | ~F.contains(prompt, T.casefold(F.coalesce("memory.text", F.lit(""))))
            ),
        ),
        ("answer_type must be natural_language_choice", ~F.col("decisions.answer_type").eqNullSafe(F.lit("natural_language_choice"))),
        ("prompt must request exactly one choice", ~F.contains(prompt, F.lit("exactly one"))),
        *[(f"{name} choice must be natural language", F.trim(F.coalesce(c, F.lit(""))) == "") for name, c in choice.items()],
        *[
            (
                f"{name} choice must appear exactly once",
                (F.trim(F.coalesce(c, F.lit(""))) != "") & (T.count_occurrences(text, c) != 1),
            ) for name, c in choice.items()
        ],
        ("decision does not change", present & choice["output-only"].eqNullSafe(choice["memory-conditioned"])),
        ("control changes decision", (F.col("variant") == "cue-ablated") & ~choice["output-only"].eqNullSafe(choice["memory-conditioned"])),
        ("too few visible choices", F.size(labels) < MIN_CHOICES),
        ("visible labels must be unique", F.size(labels) != F.size(F.array_distinct(F.transform(labels, T.casefold)))),
        ("too few distractors", F.coalesce(F.size("distractors.sources"), F.lit(0)) < MIN_DISTRACTORS),
        ("memory text must be readable prose", F.trim(F.coalesce("memory.text", F.lit(""))) == ""),
        (
            "gold source ids and sources disagree",
            F.array_sort(F.array_distinct(ids)) != F.array_sort(F.array_distinct(F.transform(sources, lambda s: s["source_id"]))),
        ),
        (
            "poison source cannot be gold",
            F.exists(sources, lambda s: F.array_contains(F.coalesce(s["perturbations"], F.array().cast("array<string>")), "poison")),
        ),
        (
            "source id prefix differs from corpus folder",
            F.exists(
                sources,
                lambda s: s["path"].endswith(".md") & F.contains(s["path"], F.lit("/")) & F.contains(s["source_id"], F.lit("/")) & (
                    prefix(s["path"]) != prefix(s["source_id"])
                ),
            ),
        ),
    ]
    found = F.filter(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules]), lambda m: m.isNotNull())
    parts = [
        cases.select(F.col("case_id").alias("id"), F.explode(found).alias("message")),
        issue(duplicates(cases, "case_id"), "case_id", "duplicate case_id"),
        variant_issues(cases),
    ]
    if files is not None:
        used = cases.select(F.col("case_id").alias("id"), F.explode(sources).alias("s")).select(
            "id",
            F.col("s.path").alias("path"),
            F.col("s.sha256").alias("stated"),
        )
        met = used.join(files.select("path", F.col("sha256").alias("real")), "path", "left")
        parts.append(met.filter("real is null").select("id", F.lit("missing memory source").alias("message")))
        parts.append(met.filter("real is not null and not (real <=> stated)").select("id", F.lit("source hash mismatch").alias("message")))
    return reduce(DataFrame.unionByName, parts)
