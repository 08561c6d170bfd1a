"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows to the
shared checkpoint folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm import decontam, lines, mixing, neardup, toxicity
from govlake.session import materialize

#: Documents scored at or above this go.
TOXIC = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no column of ``documents`` can
    clash with one of an operator."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _unpacked(packed: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return packed.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the tagger, fitted on the labelled documents at hand, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    packed = _packed(docs)
    scored = toxicity.score_toxicity(packed, toxicity.train(packed, labels), keep=["row"])
    return _unpacked(scored.filter(F.col("toxicity") < TOXIC), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by many documents go; every document stays, with its new
    text and length (a null text stays null)."""
    out = lines.drop_repeated_lines(_packed(docs))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return _unpacked(out, docs, text=text, n_chars=F.length(text).cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest id;
    documents without words are no one's duplicate and stay."""
    gone = neardup.near_duplicates(docs, k=5, percent=80).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.contamination(docs, benchmark).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in the mixture of sources."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("mixing", mix)]

#: The tagger and the min-hashes are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
