"""A corpus pipeline: toxic documents out, one of each group of near copies, no benchmark leaks, no secrets, rates.

Each stage takes (spark, docs, sf_dir) and returns a frame, written as Parquet
and read again as the next stage's documents. Rows without a doc_id or a text
pass all stages; rows of one doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.llm.containment import contained_items
from understory.llm.keys import with_ids, without_ids
from understory.llm.mixing import mix_to_targets
from understory.llm.probminhash import near_duplicates
from understory.llm.secret_spans import redact_secrets
from understory.llm.toxicity import toxicity_score, train_on
from understory.sources.shared import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from the labelled ones that are not held out.

    Those without a word stay, and all do where there is too little to learn from.
    """
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_score(docs, model, wordless=0.0) < TOXIC) if model.fitted else docs


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, once, and all documents without copies."""
    by_id = cut_lineage(near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    kept = without_ids(docs, by_id.where("not kept").select("doc_id"))
    again = by_id.where("kept and n > 1").select("doc_id")
    once = with_ids(kept, again).dropDuplicates(["doc_id", "text"])
    return without_ids(kept, again).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain a benchmark item."""
    leaks = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, cut_lineage(leaks.select("doc_id").distinct()))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark, and n_chars, where there is one, follows."""
    clean = docs.select(*docs.columns, redact_secrets(F.col("text")).alias("__clean"))
    changed = ~F.col("__clean").eqNullSafe(F.col("text"))
    new = {"text": F.col("__clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__clean")).otherwise(F.col("n_chars")).cast("long")
    return clean.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its text, tokens, chances of belonging to each domain, and the rate it is to be used at."""
    return mix_to_targets(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=["text"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact),
    ("mixing", rates),
]
ORACLE_SQL = None  # classifiers and similarity search are beyond SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
