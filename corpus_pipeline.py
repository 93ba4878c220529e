"""From raw documents to token files: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranksmith.llm.decontaminate import clean_documents
from ranksmith.llm.mixing import mixed_documents
from ranksmith.llm.quality import sound_documents
from ranksmith.llm.queries import END_ID, WEIGHTS, table, tokenizer_path
from ranksmith.llm.simhash import one_of_each
from ranksmith.llm.tokenfiles import token_table
from ranksmith.storage import owned, remove, scratch_path, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule or lie far outside their language and source go."""
    return sound_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints of four-word shingles that differ in at most four bits, the smallest id stays."""
    return one_of_each(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times."""
    return mixed_documents(docs, WEIGHTS, share=1.5, cap=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row for each document of the mix."""
    return token_table(docs, tokenizer_path(), END_ID, by_word=True, keep=["doc_id"])


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", token_files),
]

# Fingerprints, suffix arrays, Newton's iterations and token ids have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next.

    A stage's own copies, and the result it read, are removed when its result stands; of the last stage the token files stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with owned(spark, "stage") as folder:
            docs = written(stage(spark, docs, sf_dir), name, path=path)
        for done in (folder, before):
            if done:
                remove(spark, done)
        before = path
    found = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return found
