"""Selecting records and units: path filters, language dispatch, pattern
filters, ordering, first-n files, union, de-duplication and counts.

All are narrow transformations or joins against tiny fixed tables, except
``first_n_files`` (a top-n of distinct paths) and the grouped counts, which
aggregate map-side before their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions._util import col_of
from docquill.functions.globs import globs_regex

# Extension to language registrations of the two built-in languages.
DEFAULT_LANGUAGES = [(".go", "go")] + [(ext, "ts") for ext in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")]
# Without a choice, the registered extensions are read.
DEFAULT_EXTENSIONS = [ext for ext, _ in DEFAULT_LANGUAGES]
# Globs excluded on every walk
# (hidden names, build output, dependencies, test data, generated code).
DEFAULT_EXCLUDE = [
    "**/.*/**",
    "**/dist/**",
    "**/node_modules/**",
    "**/vendor/**",
    "**/testdata/**",
    "**/test/**",
    "**/tests/**",
    "**/*.pb.go",
]
INTERNAL_EXCLUDE = "**/internal/**/*.go"


def extension(path) -> Column:
    """Extension of the last path segment, with its dot ('' if none)."""
    return F.regexp_extract(col_of(path), r"(\.[^./]*)$", 1)


def filter_ext(df: DataFrame, exts: Sequence[str] | None = None, path: str = "path") -> DataFrame:
    """B1: keep paths whose extension is listed; empty means the defaults."""
    exts = list(exts) if exts else DEFAULT_EXTENSIONS
    return df.where(extension(path).isin(exts))


def include_condition(globs: Sequence[str] | None, path: str = "path") -> Column:
    if not globs:
        return F.lit(True)
    rx = globs_regex(globs)
    return F.lit(False) if rx is None else F.regexp_like(F.col(path), F.lit(rx))


def exclude_condition(globs: Sequence[str] | None, path: str = "path") -> Column:
    """True when a glob matches the path or any of its ancestor directories."""
    if not globs:
        return F.lit(False)
    rx = globs_regex(globs, ancestors=True)
    return F.lit(False) if rx is None else F.regexp_like(F.col(path), F.lit(rx))


def filter_include(df: DataFrame, globs: Sequence[str] | None, path: str = "path") -> DataFrame:
    """B2: with include globs, at least one must match."""
    return df.where(include_condition(globs, path))


def filter_exclude(df: DataFrame, globs: Sequence[str] | None, path: str = "path") -> DataFrame:
    """Drop a path when a glob matches it or one of its ancestors."""
    return df.where(~exclude_condition(globs, path))


def exclude_globs(user: Sequence[str] | None = None, exclude_internal: bool = False,
                  defaults: bool = True) -> list[str]:
    """Defaults plus user globs (added, not substituted), plus the
    internal-package glob when asked."""
    out = list(DEFAULT_EXCLUDE) if defaults else []
    out += list(user or [])
    if exclude_internal:
        out.append(INTERNAL_EXCLUDE)
    return out


def select_paths(df: DataFrame, exts=None, include=None, exclude=None, exclude_internal: bool = False,
                 path: str = "path") -> DataFrame:
    """B1-B5 in the reference's order: extension first, then include, then
    exclude. One filter; Catalyst keeps the conjunct order."""
    exts = list(exts) if exts else DEFAULT_EXTENSIONS
    cond = (extension(path).isin(exts)
            & include_condition(include, path)
            & ~exclude_condition(exclude_globs(exclude, exclude_internal), path))
    return df.where(cond)


def languages_table(spark: SparkSession, registrations=None) -> DataFrame:
    """``languages(ext, language)``; a later registration of an extension wins."""
    regs = list(registrations or DEFAULT_LANGUAGES)
    last = {}
    for ext, lang in regs:
        last[ext] = lang
    return spark.createDataFrame(sorted(last.items()), "ext string, language string")


def dispatch_language(df: DataFrame, languages: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Language by extension. Returns (dispatched, skipped).

    ``languages`` is a registration table; the planner broadcasts it while it is small.
    """
    keyed = df.withColumn("_ext", extension(path))
    langs = languages.select(F.col("ext").alias("_ext"), "language")
    hit = keyed.join(langs, "_ext", "inner").drop("_ext")
    skipped = keyed.join(langs, "_ext", "left_anti").withColumnRenamed("_ext", "ext")
    return hit, skipped


def match_any(df: DataFrame, col: str, patterns: Sequence[str] | None) -> DataFrame:
    """Keep rows where any regex finds a match anywhere in ``col``."""
    if not patterns:
        return df
    cond = None
    for p in patterns:
        c = F.regexp_like(F.col(col), F.lit(p))
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def only_undocumented(units: DataFrame, include_documented: bool = False) -> DataFrame:
    """Drop documented units unless asked to keep them."""
    return units if include_documented else units.where(~F.col("documented"))


def exclude_tests(units: DataFrame, enabled: bool = True) -> DataFrame:
    """Drop Go functions whose name starts with ``Test``."""
    if not enabled:
        return units
    return units.where(~((F.col("kind") == "func") & F.col("name").startswith("Test")))


def filter_kinds(units: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    """Keep listed kinds; empty keeps all."""
    return units.where(F.col("kind").isin(list(kinds))) if kinds else units


def only_public(units: DataFrame) -> DataFrame:
    """Drop private, protected and ``#name`` members."""
    return units.where(F.coalesce(F.col("public"), F.lit(True)))


def order_findings(df: DataFrame, keys=("path", "identifier")) -> DataFrame:
    """G1: byte-wise order by (path, identifier)."""
    return df.orderBy(*keys)


def first_n_files(df: DataFrame, n: int, path: str = "path") -> DataFrame:
    """Rows of the first ``n`` distinct paths in path order; 0 keeps all.

    The n paths come from a top-n over distinct paths (map-side dedup, then a
    bounded sort) that the rows are semi-joined to.
    """
    if n <= 0:
        return df
    first = df.select(path).distinct().orderBy(path).limit(n)
    return df.join(first, path, "left_semi")


def union_findings(dfs: Sequence[DataFrame]) -> DataFrame:
    """H1: append findings of all files and languages; duplicates are kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_units(df: DataFrame, keys=("path", "identifier")) -> DataFrame:
    """One row per key (map-side partial dedup before the shuffle)."""
    return df.dropDuplicates(list(keys))


def count_findings(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Number of findings, optionally per group."""
    if by:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"))
    return df.agg(F.count(F.lit(1)).alias("n_findings"))
