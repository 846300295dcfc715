"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.session import ensure_checkpoint_dir, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read as the scan splits it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Make Python stages of this package run on executors that have no copy of it."""
    ship_package(spark)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage with a plain Parquet table (compressed, columnar), so a
    later stage re-reads files instead of recomputing, also after a lost executor.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/docquill-{uuid.uuid4().hex}"


def per_worker(name: str, make):
    """``make()``, kept for later tasks of the same Python worker process."""
    store = sys.modules.setdefault("_docquill_worker", types.ModuleType("_docquill_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def among(df: DataFrame, key: str, keys: DataFrame, bits: int = 25) -> DataFrame:
    """The rows of ``df`` whose long ``key`` may be in column ``key`` of ``keys``
    (all that are, and a few others): a cheap step before a join.

    ``keys`` become a bitmap of 2 ** ``bits`` bits, built by a grouping. Only
    that bitmap is broadcast: 4 MB, however many keys there are. With far
    more keys than bits it lets more rows pass; the join after it is exact.
    Let that be an inner join with unique keys: the optimizer moves a semi
    join below this step.
    """
    slot = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    maps = (keys.select(slot(key).alias("_slot"))
            .groupBy(F.shiftright("_slot", 15).alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.col("_slot").bitwiseAND(F.lit(32767))).alias("_map")))
    at = slot(key).bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(`{key}` & 7 as int))")) != 0
    found = df.join(F.broadcast(maps), F.shiftright(slot(key), 15) == F.col("_bucket"))
    return found.where(hit).select(df.columns)
