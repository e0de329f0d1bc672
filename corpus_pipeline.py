"""A training-data pipeline of five operators: quality rules, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again for the next one, so that a
lost executor costs no more than the stage at work.

Quality rules, decontamination and the secret scan judge every row by its own text, so null and repeated ids change nothing
there. Null and empty texts have no words and go with the quality rules. Of rows that repeat an id, whatever their texts, one
stays as of other near duplicates; rows with a null id are linked with nothing and stay. Stages keep columns beside those of
documents; an empty table goes through all of them and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import decontam, neardup, packing, quality, secrets
from chunkloom.llm.common import dropped, small_batches, written
from chunkloom.llm.queries import table, vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, one with the smallest id, of each group of near duplicates."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blanked and n_chars brought up to date."""
    return secrets.redact(docs, secrets.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: a row for each piece of a document."""
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scan", secret_scan),
    ("best-fit packing", pack),
]

#: zstandard, learned automata and tokenizers have no SQL form; tests/llm/test_pipeline.py holds run() against a version by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if before is not None:
                dropped(before)
            before = docs
    return docs
