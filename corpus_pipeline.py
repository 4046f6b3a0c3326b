"""The corpus pipeline: stages of the training-data operators, each over all that its predecessor kept.

Columns besides doc_id and text are carried along; rows with a null id or text pass the filters (a null text has no words) and are
packed as empty documents. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from doctables.llm.common import free_name, table, written
from doctables.llm.decontaminate import drop_contaminated
from doctables.llm.ngram_join import link_documents, set_ids
from doctables.llm.packing import pack_documents
from doctables.llm.secret_scan import redact_documents
from doctables.llm.toxicity import drop_toxic
from doctables.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays; of several texts of that id in a group the one with the smallest set id."""
    links = written(link_documents(docs).select("doc_id", "component_id", "sid", "root"), "pipeline-links")
    # the lists are stored: Spark knows their size when it picks the join
    gone = written(links.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    repeated = written(links.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows of one id may have different texts, which are judged by their sets
    sid = free_name(docs, "_sid")
    stay = links.join(repeated, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("sid").alias(sid))
    stay = written(stay.select("doc_id", sid), "pipeline-stay")
    again = set_ids(docs.join(repeated, "doc_id", "left_semi"), sid).join(stay, ["doc_id", sid], "left_semi").dropDuplicates(["doc_id", sid]).drop(sid)
    once = docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    return once.select(docs.columns).unionByName(again.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind."""
    return redact_documents(docs, scratch_path(spark, "ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: No SQL for trained scores, edit distances and tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
