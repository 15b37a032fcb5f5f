"""Corpus pipeline: from raw documents to token ids in five stages.

1. toxicity: documents that score 0.5 or more go;
2. n-gram Jaccard join: one document of each group of near-duplicates stays;
3. secret scans: secrets are replaced inside the texts, and n_chars follows;
4. mixing: documents are repeated to the target weights of their sources;
5. SentencePiece: texts become token ids, decoded again as a check.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes and rereads each result and deletes what no later stage reads.
SQL cannot express the stages (a learned score, a merge agenda), so there is no
ORACLE_SQL; tests hold the stages against brute force.

Defined results: null and empty texts are clean, have no near-duplicates and no
secrets, count no characters (so that mixing keeps them at the rate of their source)
and encode to nothing; repeated rows meet in stage 2, where one stays (rows without
words all do); rows with a null doc_id are judged by their text; a null source is a
source of its own; an empty table passes through every stage; columns other than
those of documents are left out at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import mixing, ngram_join, pieces, queries, secret_scan, toxicity
from recollect.llm.util import cut, drop, scratch, tuned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return ngram_join.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return mixing.mix(docs.select(*COLUMNS), queries.WEIGHTS, queries.MIX_SEED).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    model = queries.tokenizer_file(queries.PIECE_MODEL)
    return pieces.encode_decode(docs, ["doc_id", "source"], model).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the shared folder and reread."""
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            after = kept(cut(stage(spark, docs, sf_dir), name))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
