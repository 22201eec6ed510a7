"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, id_text, table
from .tokenizing import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each row of `docs`; map-only.

    Batches hold about equal bytes and long texts are cut where no token can cross. Null and empty texts
    count 0; repeated rows are counted each; null ids stay null; other columns are ignored.
    """

    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            for part in by_bytes(batch):
                sizes = pc.binary_length(part.column("text")).cast(pa.int64())
                counts = pa.array(own.counts(part.column("text").to_pylist()), pa.int64())
                yield pa.record_batch([part.column("doc_id"), sizes, counts], ["doc_id", "n_bytes", "n_tokens"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, limit: int = 2048) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
