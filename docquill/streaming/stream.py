"""M1: annotation as a stream over arriving files.

New files under the input path are picked up by the file stream source;
each micro-batch runs the same stateless plan as the batch job (there is no
keyed state: every document arrives whole in one row) through
``foreachBatch`` and writes two outputs, the per-document results and the
dead-letter rows. Writes replace the batch's own ``batch_id`` partition, so a
micro-batch re-run after a failure overwrites rather than duplicates.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.session import ensure_checkpoint_dir
from docquill.sources.tables import spread

Annotate = Callable[[DataFrame], DataFrame]
Finish = Callable[[DataFrame, DataFrame], DataFrame]


def _is_file(spark: SparkSession, path: str) -> bool:
    """Asks the file system that ``path`` belongs to; a glob is no file."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def annotate_stream(spark: SparkSession, source_path: str, out_dir: str, checkpoint: str,
                    annotate_fn: Annotate, finish_fn: Finish, *, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None, available_now: bool = True,
                    processing_time: str | None = None, key: str | None = None):
    """Run the annotation plan over files arriving under ``source_path``.

    ``annotate_fn(batch) -> docs`` makes the model calls (rows with an
    ``error`` column); ``finish_fn(batch, docs) -> ok`` applies the answers.
    Per micro-batch the docs are written once to ``out_dir/_annotated`` and
    read back, so the provider runs once per unit even though two outputs
    use them, and a lost executor does not re-run the calls. Outputs:
    ``out_dir/ok`` and ``out_dir/dead_letter`` (parquet, partitioned by
    ``batch_id``); progress is kept in ``checkpoint``. With ``available_now``
    the query processes what is there, stops and is returned; otherwise it
    runs every ``processing_time``. ``key``: the column that
    ``sources.tables.spread`` deals a micro-batch by, if the session asks for it.
    """
    schema = spark.read.format(fmt).load(source_path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if _is_file(spark, source_path):
        # A single file: watch it through an exact glob under its folder.
        folder, name = os.path.split(source_path)
        reader = reader.option("basePath", folder)
        source_path = os.path.join(folder, name[:-1] + "[" + name[-1] + "]")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_path)
    ann_path = os.path.join(out_dir, "_annotated")
    ok_path, dead_path = os.path.join(out_dir, "ok"), os.path.join(out_dir, "dead_letter")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = spread(batch, key)
        answers = annotate_fn(batch)
        _write_batch(answers, ann_path, batch_id)
        known = answers.withColumn("batch_id", F.lit(batch_id)).schema      # a batch without units writes no file
        docs = (batch.sparkSession.read.schema(known).parquet(ann_path)
                .where(F.col("batch_id") == batch_id).drop("batch_id"))
        _write_batch(finish_fn(batch, docs), ok_path, batch_id)
        _write_batch(docs.where(F.col("error").isNotNull()), dead_path, batch_id)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.trigger(processingTime=processing_time or "30 seconds").start()


def stream_workdir(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders under the session's shared
    ``spark.checkpoint.dir``."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")
