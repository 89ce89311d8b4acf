"""From raw documents to packed training sequences: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Copies of a document that mixing repeats share its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm import mixing, neardup, packing, pii, quality
from deckloom.llm.common import fold, shared_folder, table
from deckloom.llm.queries import MOST_REPEATS, TARGET_ENTROPY, TEST_KEY, tokenizer_path

#: Repeats of a source in the mixture; the budget is the least that uses every document.
REPEATS = min(2.0, MOST_REPEATS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good; it learns from the labels outside the held-out fold.

    Null and empty texts are scored as empty ones. Repeated rows share a score. Columns named like the classifier's stay as they are.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = quality.score(docs, model, [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)])
    return scored.where("predicted = 1").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one of the smallest id, and of its texts the one of the smallest key.

    Texts without words are linked with nothing and stay; of rows with one id and one text one stays.
    """
    return neardup.keep_one(docs, neardup.jaccard_components(docs, keyed=True))


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of validated values; ``n_chars`` follows the text. Null texts stay null."""
    changed = pii.pseudonymise(docs, TEST_KEY, spans=None)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often, towards the target entropy. A null source is one of its own."""
    return mixing.apply(docs, mixing.mix(docs, TARGET_ENTROPY, REPEATS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences, with their ids. A null text is the end id alone. An empty table passes all stages without rows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("private_data", private_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, shingles, pseudonyms and tokenizer have no SQL; tests/llm/test_pipeline.py repeats every stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
