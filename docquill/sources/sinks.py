"""Sinks: reports, parsing of reports, and writing patched texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings_json(findings: DataFrame, key: str = "path", col: str = "identifier") -> DataFrame:
    """Per file, the sorted findings as a JSON array string."""
    return findings.groupBy(key).agg(
        F.to_json(F.sort_array(F.collect_list(col))).alias("findings_json"),
        F.count(F.lit(1)).alias("n_findings"))


def findings_lines(findings: DataFrame, file_col: str = "path", col: str = "identifier") -> DataFrame:
    """A6, line form: ``file@identifier`` per finding."""
    return findings.select(F.concat_ws("@", F.col(file_col), F.col(col)).alias("value"))


def parse_findings(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """Parse a JSON array of identifiers per row. Returns (parsed, bad);
    a row whose JSON does not parse goes to ``bad`` with the raw text."""
    parsed = df.withColumn("_ids", F.from_json(F.col(json_col), "array<string>"))
    ok = parsed.where(F.col("_ids").isNotNull()).withColumnRenamed("_ids", "identifiers")
    bad = parsed.where(F.col("_ids").isNull()).drop("_ids").withColumn(
        "error", F.concat(F.lit("invalid findings JSON: "), F.col(json_col)))
    return ok, bad


def parse_position(df: DataFrame, json_col: str) -> DataFrame:
    """A ``{"line": n, "character": m}`` object; invalid JSON gives NULLs
    and an ``error``."""
    pos = F.from_json(F.col(json_col), "line int, character int")
    return df.select("*", pos["line"].alias("line"), pos["character"].alias("col")).withColumn(
        "error", F.when(F.col("line").isNull(), F.concat(F.lit("invalid position JSON: "), F.col(json_col))))


def _plain(location: str) -> str:
    """A location without a local scheme, doubled or trailing slashes, so that
    two spellings of one folder compare equal."""
    scheme, sep, rest = location.partition(":/")
    path = ("/" + rest.lstrip("/")) if sep and scheme == "file" else location
    head, sep, tail = path.partition("://")
    parts = (tail if sep else path).split("/")
    return (head + sep if sep else "") + "/".join(x for i, x in enumerate(parts) if x not in ("", ".") or i == 0).rstrip("/")


def refuse_input(out: str, source_location: str | None) -> None:
    """Raise where ``out`` is the input location, inside it or around it."""
    if source_location:
        here, there = _plain(out), _plain(source_location)
        if (here + "/").startswith(there + "/") or (there + "/").startswith(here + "/"):
            raise ValueError("refusing to write over the input location, inside it or around it")


def write_patched(preview: DataFrame, out: str, partition_by: str | None = "language",
                  source_location: str | None = None) -> None:
    """A4: write patched texts (``path``, ``after`` as ``text``) as parquet.

    Refuses to write over the location it was read from: a failed or retried
    job must never destroy its own input.
    """
    refuse_input(out, source_location)
    cols = ["path", F.col("after").alias("text")]
    if partition_by and partition_by in preview.columns:
        cols.append(partition_by)
    w = preview.select(*cols).write.mode("overwrite")
    if partition_by and partition_by in preview.columns:
        w = w.partitionBy(partition_by)
    w.parquet(out)
