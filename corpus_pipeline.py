"""The corpus pipeline: stages over documents, each calling one operator and working on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one adds the tokens). ``run`` writes each
stage's result to the shared folder and reads it back as the next one's input. It goes with the subpackage ``sentrel.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import bpe, decontaminate, line_dedup, near_copies, quality
from sentrel.llm.common import Scratch, free, table

#: Documents with a lower score go.
QUALITY = 0.3


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that are named as an operator's results out of the way, and their names."""
    back = {free(docs, f"_{c}"): c for c in docs.columns if c.lower() in ("score", "n_lines", "n_removed", "n_words", "spans", "items")}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, fitted on the labels; documents that it rejects go."""
    docs, back = _aside(docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= QUALITY).drop("score").withColumnsRenamed(back)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; later copies of repeated runs are cut out, and documents of which nothing is left go."""
    docs, back = _aside(docs)
    cut = line_dedup.remove_repeats(docs)
    return _with_length(cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).drop("n_lines", "n_removed")).withColumnsRenamed(back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 over runs of five words, its links verified (a Jaccard similarity of 0.8 or more), with bands for near copies beyond its two bits; one document of each component stays."""
    return near_copies.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; words in benchmark windows are cut out, and documents of which no word is left go."""
    docs, back = _aside(docs)
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    found = found.where((F.size("spans") == 0) | (decontaminate.hit_words() < F.col("n_words")))
    return _with_length(decontaminate.remove_spans(found).select(*docs.columns)).withColumnsRenamed(back)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; token ids and their digests, and a digest of the decoded text."""
    import public_tokenizers

    return bpe.encode_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL can't express the classifier, XXH64 digests or BPE; tests/llm/test_pipeline.py holds the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
