"""Corpus pipeline: from documents to packed training sequences.

Each stage works on all that the one before kept; ``run`` writes each stage's result as Parquet in the shared folder and reads it
back, so a stage's lineage starts at a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, decontamination, lines, packing, quality, similarity


LEAST_LEFT = 0.2  # a copied text that line dedup would leave less of stays whole for the stage after it, which keeps one of its copies


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; its decision uses the source as host and the language as path.

    Null and empty texts are judged by their lack of words, null sources and languages are sites of their own, rows of null ids and
    repeated rows are judged alike and all kept or dropped. A very long text is one row. An empty table gives an empty one; without
    labels everything is kept. Extra columns of any name stay.
    """
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("quality_keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text.

    A copy of a text that is whole on as many sites as make a line boilerplate stays whole if less than ``LEAST_LEFT`` would be left:
    the next stage keeps one of these, and cut copies would no longer be seen as such. Any other text is cut however little is left.
    Null texts stay null, empty ones empty; no row is dropped, repeated ones
    neither. Very long texts are read whole. An empty table gives an empty one. Extra columns of any name stay.
    """
    lean = lines.dedup(docs, least_left=LEAST_LEFT, copies_only=True)
    return lean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else lean


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest doc_id, then the smallest hash of the text.

    Null, empty and wordless texts all stay; of repeated rows one stays; classes of null ids alone stay. Very long texts are compared
    whole. An empty table gives an empty one. Extra columns of any name stay.
    """
    return similarity.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have no words and stay; repeated rows stay or go alike, whatever their ids. A very long text is searched
    whole. An empty table gives an empty one, an empty benchmark drops nothing. Extra columns of any name stay.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences.

    Null and empty texts are the end id alone; null ids and repeated rows are packed as any other, equal lengths go by id. A very long
    text is cut into pieces. An empty table gives no rows. Extra columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, name)
    return docs
