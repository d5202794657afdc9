"""A corpus pipeline of the training-data operators.

toxicity drops documents that score as toxic; near duplicates keeps one document of each SimHash component;
decontamination drops documents that hold a benchmark item; personal data is redacted in the texts; mixing, last, adds
how many words of each document the mix takes. Every stage works on all rows that its predecessor kept and, but for the
last, returns the columns of documents, further ones with any names too.

Defined results: a null or empty text is kept by all stages that judge texts (near duplicates: one of them, as they are
alike), is not redacted and takes 0 words; a null doc_id is kept as one, and is what goes first where it has a near
duplicate; of repeated doc_ids near duplicates keeps one row; ties are settled as the operators say; empty documents
give an empty result at every stage; without labels nothing is toxic and all documents weigh the same; without
benchmark items nothing is contaminated.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import step, table
from matchloom.llm.decontamination import drop_contaminated
from matchloom.llm.mixing import mix_to_weights, quality_weights
from matchloom.llm.pii import redact
from matchloom.llm.simhash import deduplicate
from matchloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score below the threshold of toxicity, fitted on labels of those rows that are not held out."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each component of near duplicates."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that hold no copy, whole or edited, of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, personal data in their texts replaced by its kind; n_chars counted anew."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, target and taken of each document; texts are found by doc_id in the stage before."""
    mixed = mix_to_weights(docs, quality_weights(table(spark, sf_dir, "labels")))
    return mixed.withColumn("copies", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Trees, neighbours and alignments are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written, and replaces the one before it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = before = step(partial(stage, spark, docs, sf_dir), f"stage-{name}", before)
    return STAGES[-1][1](spark, docs, sf_dir)
