"""The user-facing commands as library calls, each one Spark job.

* ``find``: select files, extract units, keep what would be documented.
* ``generate``: ``find``, then shrink each file once, prompt, call the
  model, clean the answers and apply them as comments. Returns the preview
  and the dead-letter rows, and writes the patched files when asked.
* ``pos``: line and column of identifiers.
* ``minify``: shrink texts to a token limit, with the trace of steps.

Go files get ``//`` comments that replace an existing comment block;
TypeScript and JavaScript files get ``/** */`` blocks inserted at the unit,
wrapped to the width its indent leaves (an existing comment is kept).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions import text as T
from docquill.functions.identifiers import DEFAULT_KINDS
from docquill.functions.tokens import token_count
from docquill.operators import select as SEL
from docquill.operators.annotate import Provider, annotate, build_prompt, dead_letter, finish_docs
from docquill.operators.budget import (DEFAULT_MAX_TOKENS, MODEL_LIMITS, attach_model, completion_budget,
                                       go_rungs, shrink_to_budget, ts_rungs)
from docquill.operators.patch import apply_edits, replace_comments
from docquill.operators.units import clear_comments, go_units, locate_units, ts_units
from docquill.sources.sinks import write_patched
from docquill.sources.tables import read_tree, unreadable_files
from docquill.sources.tree import write_tree

UNIT_COLUMNS = ["path", "language", "identifier", "kind", "name", "line", "col", "comment_from", "documented", "exported"]


def source_files(spark: SparkSession, root: str, exts=None, include=None, exclude=None,
                 exclude_internal: bool = True, languages=None) -> DataFrame:
    """Files under ``root`` that pass the path filters, with their language."""
    src = SEL.select_paths(read_tree(spark, root), exts, include, exclude, exclude_internal)
    hit, _ = SEL.dispatch_language(src, SEL.languages_table(spark, languages))
    return hit


def units_of(src: DataFrame) -> DataFrame:
    """Go and TypeScript units of the files, in one frame."""
    go = go_units(src.where(F.col("language") == "go").select("path", "text"))
    go = go.withColumn("language", F.lit("go")).withColumn("public", F.lit(True))
    ts = ts_units(src.where(F.col("language") == "ts").select("path", "text"))
    ts = ts.withColumn("language", F.lit("ts")).withColumn("exported", F.lit(True))
    return SEL.union_findings([go.select(*UNIT_COLUMNS, "public"), ts.select(*UNIT_COLUMNS, "public")])


def find(spark: SparkSession, root: str, *, exts=None, include=None, exclude=None,
         exclude_internal: bool = True, match: Sequence[str] | None = None,
         kinds: Sequence[str] | None = tuple(DEFAULT_KINDS), include_documented: bool = False,
         include_tests: bool = False, languages=None, src: DataFrame | None = None) -> DataFrame:
    """Findings ``(path, language, identifier, line, col, ...)`` in path and
    identifier order: exported, public units without a comment unless
    ``include_documented``, without Go tests unless asked. ``kinds`` selects
    among TypeScript symbols; Go units of every kind count.
    ``src`` passes already selected files (then the path options are unused)."""
    if src is None:
        src = source_files(spark, root, exts, include, exclude, exclude_internal, languages)
    u = units_of(src).where(F.col("exported"))
    u = SEL.only_public(u)
    u = SEL.exclude_tests(u, enabled=not include_tests)
    u = SEL.only_undocumented(u, include_documented)
    if kinds:
        u = u.where((F.col("language") != "ts") | F.col("kind").isin(list(kinds)))
    u = SEL.match_any(u, "identifier", match)
    return SEL.order_findings(u)


def generate(spark: SparkSession, root: str, provider: Provider, *, model: str = "gpt-3.5-turbo",
             max_tokens: int = DEFAULT_MAX_TOKENS, footer: str | None = None, limit_files: int = 0,
             clear: bool = False, out: str | None = None, out_tree: str | None = None, threads: int = 2, partitions: int | None = None,
             src: DataFrame | None = None, **find_options) -> tuple[DataFrame, DataFrame]:
    """Document the findings of ``find`` with ``provider``.

    Each file is shrunk once to the model's context (Go rungs must fit, else
    the file's units go to the dead letters without a call; TypeScript rungs
    are best effort) and, with ``clear``, freed of Go declaration comments. It
    meets its findings on ``path``; they are prompted, answered once (the
    answers are checkpointed), cleaned and formatted, then all edits of a file
    are applied in one pass. ``src`` passes already selected files.
    Files that are not UTF-8 text are dead letters without an identifier.
    Returns ``(preview, dead_letter)``; with ``out`` the patched files are
    written there as parquet, with ``out_tree`` as files at their own paths in a
    new folder (never over ``root``).
    """
    selection = {k: find_options.pop(k) for k in ("exts", "include", "exclude", "exclude_internal", "languages")
                 if k in find_options}
    unread = None
    if src is None:
        src = source_files(spark, root, **selection)
        unread = SEL.select_paths(unreadable_files(spark, root), *[selection.get(k) for k in ("exts", "include", "exclude")],
                                  selection.get("exclude_internal", True))
    findings = find(spark, root, src=src, **find_options)
    findings = SEL.first_n_files(findings, limit_files)
    ctx = dict(MODEL_LIMITS).get(model, dict(MODEL_LIMITS)["default"])
    go = shrink_to_budget(src.where(F.col("language") == "go"), "text", go_rungs(), ctx)
    ts = shrink_to_budget(src.where(F.col("language") != "go"), "text", ts_rungs(), ctx, on_overflow="keep")
    cleared = clear_comments("text_min") if clear else F.col("text_min")
    shrunk = go.select("path", cleared.alias("code"), F.col("error").alias("shrink_error")).unionByName(
        ts.select("path", F.col("text_min").alias("code"), F.lit(None).cast("string").alias("shrink_error")))
    place = ["path", "language", "identifier", "line", "col", "comment_from"]
    req = findings.select(*place).join(shrunk, "path")
    too_long = req.where(F.col("shrink_error").isNotNull()).select("path", "identifier", F.col("shrink_error").alias("error"))
    req = req.where(F.col("shrink_error").isNull())
    req = req.withColumn("prompt", build_prompt("identifier", "language", "path", "code"))
    req = attach_model(req.withColumn("model", F.lit(model)))
    req = req.withColumn("max_tokens", completion_budget(token_count("prompt"), "ctx_tokens", max_tokens))
    answers = annotate(req, provider, keep=[*place, "model"], threads=threads, partitions=partitions, durable=True)
    docs = finish_docs(answers, footer)
    bad = dead_letter(docs).select("path", "identifier", "error").unionByName(too_long)

    good = docs.where(F.col("error").isNull())
    go_edits = good.where(F.col("language") == "go").select(
        "path", "line", F.col("comment_from").alias("from_line"), "identifier", T.line_comment("text").alias("text"))
    go_preview = replace_comments(src.where(F.col("language") == "go"), go_edits).withColumn("n_missed", F.lit(0))
    ts_edits = good.where(F.col("language") != "go").select(
        "path", "line", "col", "identifier", T.block_comment("text", F.col("col")).alias("text"))
    ts_preview, misses = apply_edits(src.where(F.col("language") != "go"), ts_edits)
    cols = ["path", "language", "before", "after", "n_missed"]
    preview = go_preview.select(*cols).unionByName(ts_preview.select(*cols))
    if out:
        write_patched(preview, out, source_location=root)
    if out_tree:
        write_tree(preview, out_tree, text="after", source_location=root)
    bad = bad.unionByName(misses.select("path", "identifier", "error"))
    return preview, bad if unread is None else bad.unionByName(unread.withColumn("identifier", F.lit(None).cast("string")))


def pos(units: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line and column of each wanted ``(path, identifier)``; misses apart."""
    return locate_units(units, wanted)


def minify(df: DataFrame, text_col: str, limit: int, rungs=None) -> DataFrame:
    """Best-effort shrink with the TypeScript rungs (or ``rungs``) and the
    executed steps."""
    return shrink_to_budget(df, text_col, rungs or ts_rungs(), limit, on_overflow="keep", trace=True)
