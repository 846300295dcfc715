"""Queries: a source tree written from the documents and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquill.session import ensure_checkpoint_dir
from docquill.sources.tables import load
from docquill.sources.tree import scan_tree, write_tree


def document_files(spark, sf_dir):
    """Every document as a file: folders by source, some of them below a vendor
    folder, a few names that begin with an underscore or a dot."""
    d = load(spark, sf_dir, "documents")
    folder = F.concat(F.col("source"), F.when(F.col("doc_id") % 11 == 0, F.lit("/vendor/lib")).otherwise(""))
    mark = F.when(F.col("doc_id") % 7 == 0, "_").when(F.col("doc_id") % 7 == 1, ".").otherwise("")
    return d.select(F.concat(folder, F.lit("/"), mark, F.col("doc_id"), F.lit("."), F.col("lang")).alias("path"), "text")


def q_tree_round_trip(spark, sf_dir):
    """A1, A4: the tree as it is found again, excluded folders pruned and unwanted extensions skipped."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docquill-tree-{uuid.uuid4().hex}"
    write_tree(document_files(spark, sf_dir), place)
    found = scan_tree(spark, place, exclude=["**/vendor"], exts=[".en", ".de", ".fr"])
    return found.select("path", "kind", "error", F.md5("text").alias("text_md5"))


QUERIES = {"tree_round_trip": q_tree_round_trip}

ORACLE = {
    "tree_round_trip": """
WITH d AS (
  SELECT source, doc_id % 11 = 0 AS vendored, lang, coalesce(text, '') AS text,
         source || '/' || CASE doc_id % 7 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || doc_id || '.' || lang AS path
  FROM documents)
SELECT path, CASE WHEN lang IN ('en', 'de', 'fr') THEN 'file' ELSE 'skipped' END AS kind,
       CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'extension' END AS error,
       CASE WHEN lang IN ('en', 'de', 'fr') THEN md5(text) END AS text_md5
FROM d WHERE NOT vendored
UNION ALL SELECT DISTINCT source || '/vendor', 'pruned', 'excluded', NULL FROM d WHERE vendored""",
}
