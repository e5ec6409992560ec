"""A corpus pipeline: filter, deduplicate, decontaminate and mix documents.

``STAGES`` run in order; each takes what the one before wrote.  All but the last return the
columns of documents.  What each stage decides:

* quality: documents the classifier scores below 0.3 go; it learns from ``labels`` rows whose
  document is still there;
* line dedup: lines on many sites stay in one document only; documents left without text go;
* near duplicates: of each component of linked documents the one with the smallest id stays;
* decontamination: documents with a benchmark window go;
* mixing: every document is repeated as the capped target weights of its source ask (``copy``).

Stages pass on null ids, sources and texts, empty texts and unknown columns as their operators
define; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crossrank.llm import decontaminate, line_dedup, mixing, quality_classifier, shingle_join
from crossrank.llm.common import table
from crossrank.staging import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("source_mixing", mix),
]

# A learned classifier has no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/crossrank/pipeline_{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
