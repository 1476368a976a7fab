"""The queries of this package and the SQL that some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as fp
from . import html_text as ht
from . import line_dedup as ld
from . import mixing as mx
from . import packing as pk
from . import quality_classifier as qc
from . import quality_rules as qr
from . import simhash as sh
from . import suffix_dedup as sd
from . import token_counts as tc
from .common import table
from .oracles import ORACLES as ORACLES


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sh.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def middle_edit(text: str) -> list[tuple[int, int, str]]:
    """The edits of op4: 64 characters from a third on give way to the first 48, then the last 20 go, then the first word comes again in front."""
    n = len(text)
    return [(n // 3, min(64, n // 3), text[:48]), (max(0, n - min(64, n // 3) + min(48, n) - 20), 20, ""), (0, 0, (text.split() or [""])[0] + " ")]


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.counts(table(spark, sf_dir, "documents"), edits=middle_edit)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.size("placed") * F.col("size")).alias("taken"), "placed")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fp.edited(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fp.as_hex(F.col("fingerprint")).alias("fingerprint"), fp.as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), fp.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ld.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    texts = sd.remove_repeats(docs).select("digest", F.length("bytes").cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", sd.text_digest(F.col("text")).alias("digest")).join(texts, "digest").drop("digest")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

