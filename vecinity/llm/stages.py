"""The stages of the corpus pipeline: each takes and (but for the last) returns documents' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecinity.llm import decontaminate, jaccard_join, language, line_dedup, packing
from vecinity.llm.queries import held_out, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is recognised: texts without letters, in another script or of random letters have no language or a score under 0.3 and go."""
    model = language.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)), "text", "lang", "doc_id")
    found = language.predict(docs, model)
    return found.where("lang_pred <> 'und' and score >= 0.3").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their site's boilerplate lines; every document stays. n_chars follows the text."""
    return with_length(line_dedup.drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id; documents without words stay."""
    found = jaccard_join.similar(docs)["documents"].where("doc_id <> component_id").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that the benchmark also has. n_chars follows the text."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), clean=True)
    return with_length(found.select(*[F.col(f"`{c}`") for c in docs.columns]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there, as the length of text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs
