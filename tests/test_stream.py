"""M1: the stream gives the batch results; a restart does not redo files."""

import os
import tempfile

from pyspark.sql import functions as F

from docquill.plans import q_annotate as A
from docquill.streaming.stream import annotate_stream
from tests.conftest import SMOKE


def test_stream_matches_batch_and_is_incremental(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    base = tempfile.mkdtemp(prefix="docquill-stream-")
    inbox = os.path.join(base, "in")
    docs.where(F.col("doc_id") < 100).coalesce(1).write.parquet(os.path.join(inbox, "part1"))
    docs.where(F.col("doc_id") >= 100).coalesce(1).write.parquet(os.path.join(inbox, "part2"))
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")

    def run():
        return annotate_stream(
            spark, os.path.join(inbox, "*"), out, ckpt,
            annotate_fn=lambda b: A.annotation_results(spark, SMOKE, src=A._as_documents_source(b)),
            finish_fn=lambda b, d: A.patch_summary(A._as_documents_source(b), d),
            max_files_per_trigger=1)

    q = run()
    assert q.lastProgress is not None
    got = spark.read.parquet(os.path.join(out, "ok"))
    assert got.select("batch_id").distinct().count() == 2
    batch = A.q_annotate_documents(spark, SMOKE)
    cols = sorted(batch.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    n_err = A.q_annotate_errors(spark, SMOKE).count()
    if n_err:  # an empty batch writes no files
        assert spark.read.parquet(os.path.join(out, "dead_letter")).count() == n_err
    # a restart with the same checkpoint finds nothing new
    run()
    assert spark.read.parquet(os.path.join(out, "ok")).count() == batch.count()


def test_first_batch_without_units(spark):
    base = tempfile.mkdtemp(prefix="docquill-stream-")
    spark.read.parquet(f"{SMOKE}/documents.parquet").limit(3).withColumn("text", F.lit(None).cast("string")) \
        .coalesce(1).write.parquet(os.path.join(base, "in"))
    annotate_stream(spark, os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt"),
                    annotate_fn=lambda b: A.annotation_results(spark, SMOKE, src=A._as_documents_source(b)),
                    finish_fn=lambda b, d: A.patch_summary(A._as_documents_source(b), d))
    assert spark.read.parquet(os.path.join(base, "out", "ok")).count() == 3
