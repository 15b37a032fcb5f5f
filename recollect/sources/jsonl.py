"""JSON lines: strict, with broken lines as rows, and lenient."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strict(spark: SparkSession, path: str, schema: str, fields: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines). Blank lines are skipped; a line that is no JSON object is broken.

    With ``fields`` a column of that name lists the keys that each object has.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.input_file_name().alias("file"), "value")
    is_object = F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False))
    keys = [F.json_object_keys("value").alias(fields)] if fields else []
    rows = lines.filter(is_object).select(F.from_json("value", schema).alias("r"), *keys).select("r.*", *([fields] if fields else []))
    return rows, lines.filter(~is_object)


def require_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file in which every line that is not blank must be a JSON object; ValueError names the first that is not."""
    rows, broken = strict(spark, path, schema)
    lost = broken.head(1)
    if lost:
        raise ValueError(f"{lost[0].file}: no JSON object: {lost[0].value[:80]}")
    return rows


def lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with their position, for last-wins rules: (file, offset of the split, line of the split)
    as one string that sorts in file order, however the files are split into tasks."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value",
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        F.monotonically_increasing_id().alias("n"),
    )
    place = F.concat_ws(":", "file", F.lpad(F.col("start").cast("string"), 19, "0"), F.lpad(F.col("n").cast("string"), 19, "0"))
    return lines.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), place.alias("position")).select("r.*", "position")


def cases(spark: SparkSession, path: str, texts: DataFrame, schema: str) -> DataFrame:
    """Cases with the fields that each has and observation_text: the file at content_path after its replacements
    (null where a replacement's old text is absent). texts: (path, text)."""
    from ..functions.text import fold_replacements

    rows, _ = strict(spark, path, schema, "fields")
    met = rows.join(texts.select(F.col("path").alias("_path"), F.col("text").alias("_text")), F.col("observation.content_path") == F.col("_path"), "left")
    edits = F.coalesce("observation.replacements", F.array().cast("array<struct<old:string,new:string>>"))
    return met.withColumn("observation_text", fold_replacements(F.col("_text"), edits)).drop("_path", "_text")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object with sorted keys; committed whole."""
    metrics.select(*sorted(metrics.columns)).coalesce(1).write.mode("overwrite").json(path)
