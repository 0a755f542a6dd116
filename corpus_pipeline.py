"""A corpus pipeline over `documents`: toxicity, exact dedup, SimHash near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. run() writes each stage's result as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, packing, similar, substring, toxicity
from tickloom.llm.common import remove, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, scores below 0.5."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id. Of rows that repeat id and text, one."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex[:12]}")
    kept = exact_dedup.without_copies(docs, index)
    index.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id: five-word shingles, similarity 0.8.

    Documents without an id stay. Documents that share an id stay or go together.
    """
    gone = similar.groups(docs, words=5, similarity=0.8).where("doc_id <> group_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document has; n_chars follows, null texts stay null."""
    return substring.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages; the last one's result, for which all texts have been read. The folder of the others' results goes unless it is to be kept."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    if not keep:
        remove(spark, folder)
    return packed


#: SQL can't express the classifier, SimHash or packing; tests compare run() with a brute-force version.
ORACLE_SQL = None
