"""From raw documents to packed training sequences: classify, deduplicate lines, deduplicate documents, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framekit.llm import line_dedup, mixing, packing, quality_classifier, simhash
from framekit.llm.common import cut, table

LEAST_QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``LEAST_QUALITY`` or more stay."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, name="__score").where(f"__score >= {LEAST_QUALITY}").drop("__score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all; ``n_chars`` follows the text."""
    return line_dedup.dedup_lines(docs, lines="__lines", dropped="__dropped").drop("__lines", "__dropped")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked as in ``op2_simhash`` or by a five-word similarity of 0.8 or more the one with the smallest id stays."""
    return simhash.deduplicate_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL can train the classifier or draw the mix; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
