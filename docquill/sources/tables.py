"""Sources: parquet tables and file trees as ``source_text`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.sources.tree import local_path, scan_tree

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Primary keys of the driver tables that carry text (used to spread rows).
PRIMARY_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id",
                "events": "event_id", "benchmark": "item_id", "labels": "doc_id", "embeddings": "vec_id"}


SPREAD = "docquill.spread.partitions"


def spread(df: DataFrame, key: str | None, rebalance: int | bool | None = None) -> DataFrame:
    """Rows hash-partitioned by ``key`` into as many partitions as the caller asks.

    For small tables in one or two files, which a handful of tasks would read
    while the other cores wait. ``rebalance`` is a number of partitions, or
    False; without it the session's ``docquill.spread.partitions`` counts, and
    where that is unset too, the scan's own splits stay. Never decided by the
    data. The partitioning is deterministic, so a retried task sees the same rows.
    """
    if rebalance is None:
        rebalance = int(df.sparkSession.conf.get(SPREAD, "0"))
    if not rebalance:
        return df
    return df.repartition(int(rebalance), key) if key else df.repartition(int(rebalance))


def load(spark: SparkSession, sf_dir: str, name: str, rebalance: int | bool | None = None) -> DataFrame:
    """One driver table: ``{sf_dir}/{name}.parquet``, spread if the caller asks."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, PRIMARY_KEYS.get(name), rebalance)


def read_table(spark: SparkSession, path: str, id_col: str, text_col: str,
               language: str | None = None, language_col: str | None = None) -> DataFrame:
    """A2: a parquet table as ``source_text(path, language, text)``.

    ``path`` is the id column as a string. Only the needed columns reach the
    scan (column pruning), so wide tables cost nothing extra.
    """
    df = spark.read.parquet(path)
    lang = F.col(language_col) if language_col else F.lit(language)
    return df.select(F.col(id_col).cast("string").alias("path"), lang.cast("string").alias("language"),
                     F.col(text_col).alias("text"))


def documents_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``path = <source>/<doc_id>.txt``, language = lang."""
    d = load(spark, sf_dir, "documents", rebalance=False)
    d = d.select("doc_id", F.format_string("%s/%d.txt", "source", "doc_id").alias("path"),
                 F.col("lang").alias("language"), "text")
    return spread(d, "path")


def url_path(url) -> "F.Column":
    """Path part of a URL without the leading slash ('' when there is none)."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.regexp_extract(c, r"^[a-z]+://[^/?#]*(/[^?#]*)?", 1), r"^/", "")


def pages_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files: ``path = <host>/<url path>``, language html."""
    p = load(spark, sf_dir, "pages", rebalance=False)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    p = p.select("page_id", F.concat(host, F.lit("/"), url_path("url")).alias("path"),
                 F.lit("html").alias("language"), F.col("html").alias("text"))
    return spread(p, "path")


def _tree(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    if local_path(root) is not None:
        found = scan_tree(spark, root).where(F.col("kind").isin("file", "unreadable"))
        if glob:
            from docquill.functions.globs import globs_regex
            found = found.where(F.regexp_like(F.regexp_extract("path", "[^/]*$", 0), F.lit(globs_regex([glob]) or r"\A\b")))
        return found.select("path", "text", "error")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rel = F.regexp_replace(F.col("path"), r"^(?:file:)?/*" + _escape(root.rstrip("/").lstrip("/")) + "/", "")
    text = F.col("content").cast("string")
    return reader.load(root).select(rel.alias("path"), text.alias("text"),
                                    F.when(~F.is_valid_utf8(text), F.lit("not UTF-8 text")).alias("error"))


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """A1: every UTF-8 file under ``root`` as ``(path, text)``; ``path`` relative
    to ``root`` with forward slashes. Other files are in ``unreadable_files``.

    Mounted storage is walked in tasks (``sources/tree.py``) and hides no name.
    Other schemes go through Spark's ``binaryFile`` source, which skips names
    starting with ``_`` or ``.`` at any depth.
    """
    return _tree(spark, root, glob).where("error is null").drop("error")


def unreadable_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, error)`` of what lies under ``root`` and is no readable UTF-8 text."""
    return _tree(spark, root, glob).where("error is not null").select("path", "error")


def _escape(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in ".^$|()[]{}*+?\\" else ch)
    return "".join(out)


def save_bucketed(df: DataFrame, table: str, location: str, key: str = "path",
                  buckets: int | None = None) -> DataFrame:
    """Write a corpus once as a table bucketed and sorted by ``key``.

    Joins and groupings on ``key`` against the table (applying edits, joining
    findings to their texts) then read each bucket in place: the texts are
    never shuffled again, only the small side is, into the same buckets.
    ``buckets`` defaults to the session's shuffle partition count so the
    other side's exchange lines up with the buckets. ``location`` is where
    the files go (shared storage on a cluster).
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.mode("overwrite").option("path", location)
     .bucketBy(n, key).sortBy(key).saveAsTable(table))
    return spark.table(table)
