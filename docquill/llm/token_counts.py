"""Token counts: lengths only, by a public sentencepiece model.

Arrow batches of texts are cut at word starts, where no piece of the
vocabulary can cross; each worker encodes words it has not seen yet in
batches balanced by bytes and adds up the lengths. A long text is so many
words, so its size does not matter.

Defined results: a null or empty text has 0 bytes and 0 tokens; every row is
counted on its own, whatever its id; empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import per_worker, read, ready
from docquill.llm.tokens import PieceCounts

LIMIT = 4096


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, find=vocabulary) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row per row of ``docs``."""
    ready(docs.sparkSession)

    def run(batches):
        counter = per_worker(f"pieces:{model}", lambda: PieceCounts(find(model)))
        for batch in batches:
            n = pa.array([counter.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
                    text.alias("t"))
    out = d.mapInArrow(run, "id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(read(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")
