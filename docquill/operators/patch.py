"""Applying edits to texts.

Edits are grouped per path, joined to the text once, sorted by position, and
spliced between slices of the text's lines: lines are never shuffled, the work
is linear in lines and edits, and positions always refer to the original
text, so a file's edits need no sequential re-parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.functions._util import bind, explode_rows, filter_computed


def resolve_edits(docs: DataFrame, units: DataFrame, keys=("path", "identifier")) -> tuple[DataFrame, DataFrame]:
    """Positions for docs. Returns (edits, misses); a miss is a doc whose
    identifier is not among the file's units. An identifier that stands several
    times in a file (overloads) means its first position."""
    keys = list(keys)
    u = units.groupBy(*keys).agg(F.min(F.struct("line", "col")).alias("_at"))
    edits = docs.join(u, keys, "inner").select(*docs.columns, "_at.line", "_at.col")
    misses = docs.join(u, keys, "left_anti").withColumn(
        "error", F.concat(F.lit("node not found: "), F.col("identifier")))
    return edits, misses


def edits_per_path(edits: DataFrame) -> DataFrame:
    """One row per path with its edits in the order of the text: line,
    column, identifier. One shuffle, on the key that the texts are joined by.

    Rows with a NULL ``text`` are failed units: counted in ``n_failed`` (and
    ``n_units``) but not applied.
    """
    return edits.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(
            "line", "col", "identifier", "text")))).alias("edits"),
        F.count(F.lit(1)).alias("n_units"),
        F.count(F.when(F.col("text").isNull(), 1)).alias("n_failed"),
    )


def _in_range(lines: Column, line: Column, col: Column) -> Column:
    n = F.size(lines)
    return (line >= 0) & (line < n) & (col >= 0) & (col <= F.length(F.get(lines, line)))


def _from(line: Column, start: Column) -> Column:
    """The rest of ``line`` from the 0-based ``start``."""
    return F.substring(line, start + 1, F.length(line))


def splice(lines: Column, edits: Column) -> Column:
    """L1 + L3: the text of ``lines`` with all ``edits`` inserted, in one pass.

    ``edits`` is sorted by position. Each contributes the text between it and
    the edit before, then its own text, whose continuation lines get the
    target line's leading white space; every line is read once. Pass both as
    columns of an earlier projection: inside a lambda an expression is
    re-evaluated at every call.
    """
    def gap(pl, pc, line, col):
        between = F.slice(lines, pl + 2, line - pl - 1)
        return (F.when(pl == line, F.substring(F.get(lines, line), pc + 1, col - pc))
                .otherwise(F.concat(_from(F.get(lines, pl), pc), F.lit("\n"),
                                    F.when(line - pl > 1, F.concat(F.array_join(between, "\n"), F.lit("\n"))).otherwise(""),
                                    F.substring(F.get(lines, line), 1, col))))

    def piece(e, k):
        before = F.get(edits, k - 1)
        prefix = F.regexp_extract(F.get(lines, e["line"]), r"(?U)^\s*", 0)
        return F.concat(gap(F.coalesce(before["line"], F.lit(0)), F.coalesce(before["col"], F.lit(0)), e["line"], e["col"]),
                        F.replace(e["text"], F.lit("\n"), F.concat(F.lit("\n"), prefix)))

    last = F.get(edits, F.size(edits) - 1)
    rest = F.slice(lines, last["line"] + 2, F.size(lines))
    tail = F.concat(_from(F.get(lines, last["line"]), last["col"]),
                    F.when(F.size(rest) > 0, F.concat(F.lit("\n"), F.array_join(rest, "\n"))).otherwise(""))
    return F.when(F.size(edits) > 0, F.concat(F.array_join(F.transform(edits, piece), ""), tail)).otherwise(
        F.array_join(lines, "\n"))


def apply_edits(source: DataFrame, edits: DataFrame, mode: str = "permissive") -> tuple[DataFrame, DataFrame]:
    """L3 with L4/L5: apply all edits of each file.

    ``source(path, text, ...)``, ``edits(path, line, col, identifier, text)``.
    Returns (preview, misses). ``preview`` has ``before`` and ``after`` and
    the counts; in ``permissive`` mode a file with any miss keeps its
    original text (``n_applied`` 0), in ``failfast`` mode the job raises on the
    first miss. Edits of paths that are not in ``source`` are misses too.
    """
    edit_t = "array<struct<line:int,col:int,identifier:string,text:string>>"
    per_path = edits_per_path(edits)
    joined = source.join(per_path, "path", "left").withColumn("_lines", F.split("text", "\n"))
    joined = joined.withColumn("_edits", F.coalesce(F.col("edits"), F.array().cast(edit_t)))
    lines = F.col("_lines")
    joined = joined.withColumn("_missed", F.filter("_edits", lambda e: ~_in_range(lines, e["line"], e["col"])))
    out = joined.withColumn("n_missed", F.size("_missed")).withColumn(
        "n_applied", F.when(F.size("_missed") == 0, F.size("_edits")).otherwise(0))
    after = F.when(F.col("n_missed") == 0, splice(lines, F.col("_edits")))
    after = after.otherwise(F.raise_error(F.concat(F.lit("edit position out of range in "), F.col("path")))
                            if mode == "failfast" else F.col("text"))
    preview = out.withColumn("after", after).withColumnRenamed("text", "before")
    place = ["path", "line", "col", "identifier", "error"]
    misses = (filter_computed(out, F.col("n_missed") > 0)
              .transform(lambda d: explode_rows(d, F.col("_missed"), ["path"], value="m"))
              .select("path", "m.line", "m.col", "m.identifier", F.lit("position out of range").alias("error")))
    nowhere = (edits.where(F.col("text").isNotNull()).join(source.select("path"), "path", "left_anti")
               .withColumn("error", F.lit("file not found")))
    misses = misses.unionByName(nowhere.select(
        "path", F.col("line").cast("int"), F.col("col").cast("int"), "identifier", "error").select(place))
    return preview.drop("_missed", "_edits", "edits", "_lines"), misses


_CLOSING = r"^[ \t]*[)}\]]"


def _spaced(gap: Column, target: Column, followed: Column) -> Column:
    """``gap``, the lines after a documented ``target`` line, with an empty line
    after the target's declaration unless one is there or its block ends.

    A declaration of several lines ends at the first line with the target's
    indent and a closing bracket; it is looked for in the gap only.
    """
    def opened(l):
        return F.regexp_count(l, F.lit(r"[({\[]")) - F.regexp_count(l, F.lit(r"[)}\]]"))

    indent = F.regexp_extract(target, r"^[ \t]*", 0)
    ends = F.array_position(F.transform(gap, lambda l: F.regexp_like(l, F.lit(_CLOSING))
                                        & (F.regexp_extract(l, r"^[ \t]*", 0) == indent)), True).cast("int")

    def put(at):
        after = F.get(gap, at)
        need = F.when(after.isNull(), followed).otherwise(
            ~F.regexp_like(after, F.lit(r"^\s*$")) & ~F.regexp_like(after, F.lit(_CLOSING)))
        return F.when((at < 0) | ~need, gap).otherwise(
            F.concat(F.slice(gap, F.lit(1), at), F.array(F.lit("")), F.slice(gap, at + 1, F.size(gap))))

    return bind(F.when(opened(target) <= 0, F.lit(0)).when(ends > 0, ends).otherwise(F.lit(-1)), put)


def replace_comments(source: DataFrame, edits: DataFrame) -> DataFrame:
    """L2: replace the comment block above each target line.

    ``edits(path, line, from_line, identifier, text)``: lines
    ``from_line .. line-1`` (the old comment) are removed and the formatted
    ``text`` is placed above ``line``, indented like it; an empty text only
    removes. Docs for the same line follow each other in identifier order. The
    documented declaration is followed by an empty line, unless its block ends
    there. Each line is read once, so the cost is linear in lines and edits.
    """
    per_path = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(
        "line", "from_line", "identifier", "text"))).alias("_edits"))
    j = source.join(per_path, "path", "left").withColumn("_lines", F.split("text", "\n"))
    lines, es = F.col("_lines"), F.col("_edits")
    none = F.array().cast("array<string>")

    def after(k, until, followed):
        """Lines between the target of edit ``k`` and line ``until``."""
        before = F.get(es, k)["line"]
        gap = F.slice(lines, before + 2, F.greatest(until - before - 1, F.lit(0)))
        return F.when(k < 0, F.slice(lines, F.lit(1), until)).otherwise(
            bind(gap, lambda g: _spaced(g, F.get(lines, before), followed)))

    def piece(e, k):
        first = F.coalesce(F.get(es, k - 1)["line"] != e["line"], F.lit(True))
        last = F.coalesce(F.get(es, k + 1)["line"] != e["line"], F.lit(True))
        target = F.get(lines, e["line"])
        comment = F.transform(F.split(e["text"], "\n"), lambda c: F.concat(F.regexp_extract(target, r"^[ \t]*", 0), c))
        return F.concat(F.when(first, after(k - 1, e["from_line"], F.lit(True))).otherwise(none),
                        F.when(e["text"] == "", none).otherwise(comment),
                        F.when(last, F.array(target)).otherwise(none))

    out = F.array_join(F.concat(F.flatten(F.transform(es, piece)), after(F.size(es) - 1, F.size(lines), F.lit(False))), "\n")
    out = F.when(es.isNull(), F.col("text")).otherwise(out)
    return j.withColumn("after", out).withColumnRenamed("text", "before").drop("_edits", "_lines")


def preview_summary(preview: DataFrame, key: str = "path") -> DataFrame:
    """A3: per file, lengths, changed flag and digests instead of full texts."""
    return preview.select(
        key,
        F.length("before").cast("bigint").alias("before_chars"),
        F.length("after").cast("bigint").alias("after_chars"),
        (F.col("before") != F.col("after")).alias("changed"),
        F.coalesce(F.col("n_applied"), F.lit(0)).cast("int").alias("n_applied"),
        F.coalesce(F.col("n_missed"), F.lit(0)).cast("int").alias("n_missed"),
        F.md5("after").alias("after_md5"),
    )
