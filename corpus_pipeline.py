"""Corpus pipeline: language identification, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, packing, simhash, toxicity
from tessera.llm.shared import written


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole rows go to Python and back in batches of few texts: a batch's buffers stand outside the executor's heap,
    and with the usual 10,000 rows they come to hundreds of MB. A stage's result is computed after the stage has
    returned, so the setting must outlast it; `run` puts the session's own value back."""
    spark.conf.set(BATCH, "256")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay; those without letters or with a doubtful language go.

    A null text goes; null tags and sources are no evidence; repeated rows stay or go alike; an empty table gives an
    empty one; further columns stay, whatever their names. So it is in the next two stages too, where not said."""
    small_batches(spark)
    return langid.known(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network learned from the labelled ones among them takes for toxic go.

    A null or empty text is scored like any other. Labels of ids that are not among docs are not learned from; with
    labels of one class only, the table stays or goes as a whole by that class, and without any it stays."""
    small_batches(spark)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id.

    Of rows that share that id, the one of the least text hash. Null and empty texts are one group; rows without an
    id stay only where no other row of their group has one."""
    small_batches(spark)
    return simhash.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens; a null text is its end token alone."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("toxicity", toxicity_filter), ("SimHash near-dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: SQL cannot express the network, the fingerprints or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH)
    try:
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = written(docs)
    finally:
        spark.conf.set(BATCH, before)
    return docs
