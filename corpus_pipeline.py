"""A cleaning pipeline over `documents`: each stage applies one operator to all that the stage before has kept.

All stages take nulls in any column, repeated rows and ids, very long texts, empty tables and further columns, which all but
the last stage hand on as they are. What each makes of such rows stands in its docstring and in that of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.bpe import bpe, digests
from recollect.llm.decontaminate import clean
from recollect.llm.near_dups import one_of_each
from recollect.llm.quality import quality
from recollect.llm.shared import result, table, temporary
from recollect.llm.substrings import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier rule keep. A null or empty text fails the base rules; equal rows are judged
    alike; null languages and sources are values of their own."""
    return quality(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id, and of rows with that id one. Rows without a
    doc_id stay; texts without words have no duplicates."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has; the others stay as they are, and
    so do null texts. Rows without a doc_id lose and take nothing."""
    cut = remove_repeats(docs, columns=[c for c in docs.columns if c != "text"], unchanged=True)
    changed = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
    values = {"text": F.col("kept"), "n_chars": changed.cast("long")}
    return cut.select(*[(values[c] if c in values else F.col("row").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; those without words hold none."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Count and digests of the ids of the texts that are left, and of what they decode to; a null text is an empty one."""
    return digests(bpe(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage wrote in between is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):
            docs = result(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL can't express the robust estimates, the sampled buckets or the merges; tests hold run() against brute force.
ORACLE_SQL = None
