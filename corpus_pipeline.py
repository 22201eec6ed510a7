"""A corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing; each stage is written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borefield.llm.common import materialize, spread_join, table
from borefield.llm.decontamination import drop_contaminated
from borefield.llm.packing import pack_documents
from borefield.llm.secrets import redact_secrets
from borefield.llm.similar import similar_components
from borefield.llm.toxicity import drop_toxic, fit_toxicity
from borefield.session import configure


def keep_least(docs: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each component of rows the least row stays: by doc_id, null last, then by a hash of the whole row; of equal rows one.

    Every row counts for itself: repeated rows are one component, and rows that share a doc_id may be of several.
    `components` gets each row's hash as doc_id, its text, and its id as rank, and gives (doc_id, component_id). `docs` must be stable.
    """
    keyed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    found = components(keyed.select(F.col("__row").alias("doc_id"), "text", F.col("doc_id").alias("rank")))
    labels = found.groupBy(F.col("doc_id").alias("__row")).agg(F.min("component_id").alias("label"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row").alias("at")
    rows = materialize(keyed.select(order).groupBy("at").agg(F.count("*").alias("copies")).withColumn("__row", F.col("at.__row")).join(labels, "__row"))
    least = materialize(rows.groupBy("label").agg(F.min("at").alias("least"), F.count("*").alias("n")))
    named = spread_join(rows, least, "label", rows.count())
    stays = F.col("at").eqNullSafe(F.col("least")).alias("stays")
    cut = materialize(named.select("__row", stays, "copies").where("NOT stays OR copies > 1").drop("copies"))
    once = keyed.join(cut.where("stays"), "__row", "left_semi").dropDuplicates(["__row"])
    return keyed.join(cut, "__row", "left_anti").unionByName(once).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    configure(spark)
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose five-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash, links followed, the least stays.

    Rows count for themselves (`keep_least`): repeated rows are copies, an id may have several texts, rows without id take part,
    rows without words are copies of each other, an empty table stays empty.
    """
    configure(spark)
    return keep_least(docs, similar_components)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    configure(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    configure(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces with their places in training sequences."""
    configure(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: No SQL: hashes, tokenizers and a fitted model take part. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
