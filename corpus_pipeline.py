"""Documents to training windows in five stages; each stage's table is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import classifier, mixing, packing, rules, similar
from millrace.llm.common import load, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the table of rules."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on a sample of all labelled documents, scores as good."""
    return classifier.keep_good(docs, classifier.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity of 0.8 or more), the document with the smallest doc_id."""
    return similar.keep_one(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight takes it."""
    return mixing.mixed_rows(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of at most 1024 ids."""
    return packing.pack_digests(docs)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("SimHash near-dedup", near_duplicates), ("mixing to weights", mixing_weights), ("packing", windows)]

#: The classifier's scores and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
