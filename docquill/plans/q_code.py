"""Queries: unit extraction on source code generated from the conversations.

Each conversation becomes one Go file and one TypeScript file with a fixed
layout: a turn becomes a declaration chosen by its role, and the turn's whole
text becomes the comment above it (line, block or doc comment, by role). The
code grows with the table and carries real prose in its comments, while its
expected units, positions and comments can be stated independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.functions import text as T
from docquill.operators.budget import MODEL_LIMITS as B_LIMITS
from docquill.operators.annotate import PROMPT_TEMPLATES
from docquill.plans import sqlgen as S
from docquill.operators import select as SEL
from docquill.operators.units import clear_comments, existing_comment, go_units, locate_units, ts_units
from docquill.sources.tables import load


def _turns(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _prefixed(text, prefix: str):
    return F.transform(F.split(text, "\n"), lambda l: F.concat(F.lit(prefix), l))


def go_code(spark, sf_dir):
    """``conv/<id>.go``: 3 header lines, then per turn its whole text as the
    comment (``//`` lines for assistant turns, a ``/* * */`` block for system
    turns, a blank line for user turns) and a 3-line declaration."""
    g = _turns(spark, sf_dir)

    def block(t, k):
        slot = (F.when(t["role"] == "assistant", _prefixed(t["text"], "// "))
                .when(t["role"] == "system", F.concat(F.array(F.lit("/*")), _prefixed(t["text"], " * "),
                                                      F.array(F.lit(" */"))))
                .otherwise(F.array(F.lit(""))))
        decl = (F.when(t["role"] == "user", F.concat(F.lit("func Ask"), k, F.lit("() string {")))
                .when(t["role"] == "assistant", F.concat(F.lit("var Reply"), k, F.lit(" = "), k))
                .otherwise(F.concat(F.lit("type system"), k, F.lit(" struct {"))))
        body = (F.when(t["role"] == "user", F.lit('\treturn ""')).when(t["role"] == "assistant", F.lit(""))
                .otherwise(F.lit("\tName string")))
        close = F.when(t["role"] == "assistant", F.lit("")).otherwise(F.lit("}"))
        return F.concat(slot, F.array(decl, body, close))

    header = F.array(F.concat(F.lit("// Package conv"), F.col("conv_id"), F.lit(" holds one conversation.")),
                     F.concat(F.lit("package conv"), F.col("conv_id")), F.lit(""))
    text = F.array_join(F.concat(header, F.flatten(F.transform("turns", block))), "\n")
    return g.select(F.format_string("conv/%d.go", "conv_id").alias("path"), text.alias("text"))


def ts_code(spark, sf_dir):
    """``conv/<id>.ts``: a class with one member per turn, each preceded by
    the turn's whole text as a comment (a ``/** * */`` block for assistant
    turns, ``//`` lines for system turns, a blank line for user turns)."""
    g = _turns(spark, sf_dir)

    def block(t, k):
        slot = (F.when(t["role"] == "assistant", F.concat(F.array(F.lit("  /**")), _prefixed(t["text"], "   * "),
                                                          F.array(F.lit("   */"))))
                .when(t["role"] == "system", _prefixed(t["text"], "  // "))
                .otherwise(F.array(F.lit(""))))
        member = (F.when(t["role"] == "user", F.concat(F.lit("  ask"), k, F.lit("(q: string): string { return q }")))
                  .when(t["role"] == "assistant", F.concat(F.lit("  reply"), k, F.lit(": string")))
                  .otherwise(F.concat(F.lit("  private sys"), k, F.lit(" = "), k)))
        return F.concat(slot, F.array(member, F.lit("")))

    header = F.array(F.concat(F.lit("// Conversation "), F.col("conv_id"), F.lit(".")),
                     F.concat(F.lit("export class Conv"), F.col("conv_id"), F.lit(" {")))
    footer = F.array(F.lit("}"), F.concat(F.lit("export const turns"), F.col("conv_id"), F.lit(" = "),
                                          F.size("turns")))
    text = F.array_join(F.concat(header, F.flatten(F.transform("turns", block)), footer), "\n")
    return g.select(F.format_string("conv/%d.ts", "conv_id").alias("path"), text.alias("text"))


def q_go_units(spark, sf_dir):
    """Every Go unit with position, exported and documented flags."""
    u = go_units(go_code(spark, sf_dir))
    return u.select("path", "identifier", "line", "col", "exported", "documented")


def q_go_findings(spark, sf_dir):
    """C1 + B7 + B8 + B9 + G1: what the annotate command would document."""
    u = go_units(go_code(spark, sf_dir)).where(F.col("exported"))
    u = SEL.only_undocumented(SEL.exclude_tests(u))
    return SEL.order_findings(u.select("path", "identifier"))


def q_ts_units(spark, sf_dir):
    """C3 + B11: TypeScript declarations and class members."""
    u = ts_units(ts_code(spark, sf_dir))
    return u.select("path", "identifier", "kind", "line", "col", "documented", "public")


def q_existing_comment(spark, sf_dir):
    """The comment text above each TypeScript unit, markers removed."""
    src = ts_code(spark, sf_dir)
    c = existing_comment(src, ts_units(src))
    return c.select("path", "identifier", "comment_from", "comment")


def q_locate_units(spark, sf_dir):
    """Positions of wanted identifiers: the members each conversation's
    class should have (named from the turns, not from the scan), plus one
    that is not there and one that is not an identifier, per file."""
    from docquill.functions._util import explode_rows
    src = ts_code(spark, sf_dir)
    units = ts_units(src)
    g = _turns(spark, sf_dir)
    conv = F.col("conv_id")

    def member(t, k):
        return (F.when(t["role"] == "user", F.concat(F.lit("method:Conv"), conv, F.lit(".ask"), k))
                .when(t["role"] == "assistant", F.concat(F.lit("prop:Conv"), conv, F.lit(".reply"), k))
                .otherwise(F.concat(F.lit("prop:Conv"), conv, F.lit(".sys"), k)))

    path = F.format_string("conv/%d.ts", "conv_id")
    names = F.concat(F.transform("turns", member), F.array(
        F.concat(F.lit("class:Conv"), conv), F.concat(F.lit("var:turns"), conv),
        F.concat(F.lit("method:Missing"), path), F.lit("bogus")))
    wanted = explode_rows(g.withColumn("path", path), names, ["path"], value="identifier")
    found, missing = locate_units(units, wanted)
    return found.select("path", "identifier", "line", "col", F.lit(None).cast("string").alias("error")) \
        .unionByName(missing.select("path", "identifier", F.lit(None).cast("int").alias("line"),
                                    F.lit(None).cast("int").alias("col"), "error"))


def q_strip_comments(spark, sf_dir):
    """I11 + I12: TypeScript shrinker comment removal (look-ahead rules)."""
    src = ts_code(spark, sf_dir)
    out = src.select("path", T.strip_comments("text").alias("s"))
    return out.select("path", F.md5("s").alias("stripped_md5"),
                      F.size(F.split("s", "\n")).cast("bigint").alias("n_lines"))


def q_clear_comments(spark, sf_dir):
    """Go code with its comments removed before prompting."""
    src = go_code(spark, sf_dir)
    return src.select("path", F.md5(clear_comments("text")).alias("cleared_md5"))


CODE_MODEL = "gpt-3.5-turbo"


def q_annotate_code(spark, sf_dir):
    """The annotate command on Go code: exported, undocumented, non-test
    units; each file shrunk once (Go rungs) to the model's context and joined
    to its findings on ``path``; prompt, model call, clean-up, ``//`` comment
    formatting, positions by identifier, and all edits of a file applied in
    one pass. One summary row per file."""
    from docquill.functions.tokens import token_count
    from docquill.operators.annotate import WordSpanProvider, annotate, build_prompt, finish_docs
    from docquill.operators.budget import (attach_model, completion_budget, go_rungs,
                                           shrink_to_budget)
    from docquill.operators.patch import apply_edits

    src = go_code(spark, sf_dir).withColumn("language", F.lit("go"))
    units = go_units(src)
    findings = SEL.only_undocumented(SEL.exclude_tests(units.where(F.col("exported"))))
    ctx = dict(B_LIMITS)[CODE_MODEL]
    shrunk = shrink_to_budget(src, "text", go_rungs(), ctx).select(
        "path", "language", F.col("text_min").alias("code"))
    # Positions travel with the findings, so the text is scanned once.
    req = findings.select("path", "identifier", "line", "col").join(shrunk, "path")
    req = req.withColumn("prompt", build_prompt("identifier", "language", "path", "code"))
    req = attach_model(req.withColumn("model", F.lit(CODE_MODEL)))
    req = req.withColumn("max_tokens", completion_budget(token_count("prompt"), "ctx_tokens"))
    docs = finish_docs(annotate(req, WordSpanProvider(), keep=["path", "identifier", "line", "col"],
                                threads=2, partitions=int(spark.conf.get("spark.sql.shuffle.partitions"))))
    edits = docs.withColumn("text", F.when(F.col("error").isNull(),
                                           F.concat(T.line_comment("text"), F.lit("\n"))))
    preview, _ = apply_edits(src, edits.select("path", "line", "col", "identifier", "text", "error"))
    return preview.select(
        "path",
        F.coalesce(F.col("n_units"), F.lit(0)).cast("bigint").alias("n_units"),
        F.coalesce(F.col("n_failed"), F.lit(0)).cast("bigint").alias("n_failed"),
        F.col("n_applied").cast("bigint").alias("n_applied"),
        (F.col("before") != F.col("after")).alias("changed"),
        F.md5("after").alias("after_md5"))


QUERIES = {
    "annotate_code": q_annotate_code,
    "go_units": q_go_units,
    "go_findings": q_go_findings,
    "ts_units": q_ts_units,
    "existing_comment": q_existing_comment,
    "locate_units": q_locate_units,
    "strip_comments": q_strip_comments,
    "clear_comments": q_clear_comments,
}

_T = """t0 AS (
  SELECT conv_id, turn, role, text, CAST(len(string_split(text, chr(10))) AS INTEGER) AS nl,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
t AS (
  SELECT *,
         CASE role WHEN 'assistant' THEN nl WHEN 'system' THEN nl + 2 ELSE 1 END AS go_slot,
         CASE role WHEN 'assistant' THEN nl + 2 WHEN 'system' THEN nl ELSE 1 END AS ts_slot
  FROM t0),
t2 AS (
  SELECT *,
         coalesce(sum(go_slot + 3) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS go_before,
         coalesce(sum(ts_slot + 2) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ts_before,
         sum(ts_slot + 2) OVER (PARTITION BY conv_id) AS ts_total
  FROM t)"""

_GO_UNITS = "WITH " + _T + """
SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.go' AS path,
       CASE role WHEN 'user' THEN 'func:Ask' || k WHEN 'assistant' THEN 'var:Reply' || k ELSE 'type:system' || k END
         AS identifier,
       CAST(3 + go_before + go_slot AS INTEGER) AS line, 0 AS col, role <> 'system' AS exported,
       role <> 'user' AS documented
FROM t2"""

_TS_UNITS = "WITH " + _T + """,
members AS (
  SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.ts' AS path,
         CASE role WHEN 'user' THEN 'method:Conv' || conv_id || '.ask' || k
                   WHEN 'assistant' THEN 'prop:Conv' || conv_id || '.reply' || k
                   ELSE 'prop:Conv' || conv_id || '.sys' || k END AS identifier,
         CASE role WHEN 'user' THEN 'method' ELSE 'prop' END AS kind,
         CAST(2 + ts_before + ts_slot AS INTEGER) AS line, 2 AS col, role <> 'user' AS documented,
         role <> 'system' AS public,
         CASE WHEN role <> 'user' THEN text END AS comment,
         CAST(CASE WHEN role = 'user' THEN 2 + ts_before + ts_slot ELSE 2 + ts_before END AS INTEGER) AS comment_from
  FROM t2),
heads AS (
  SELECT DISTINCT 'conv/' || CAST(conv_id AS VARCHAR) || '.ts' AS path, conv_id, ts_total FROM t2),
tops AS (
  SELECT path, 'class:Conv' || conv_id AS identifier, 'class' AS kind, 1 AS line, 0 AS col, true AS documented,
         true AS public, 'Conversation ' || conv_id || '.' AS comment, 0 AS comment_from FROM heads
  UNION ALL
  SELECT path, 'var:turns' || conv_id, 'var', CAST(2 + ts_total + 1 AS INTEGER), 0, false, true, NULL,
         CAST(2 + ts_total + 1 AS INTEGER) FROM heads),
u AS (SELECT * FROM members UNION ALL SELECT * FROM tops)"""

_GO_TEXT = "WITH " + _T + """,
blocks AS (
  SELECT conv_id, turn,
         CASE role WHEN 'user' THEN '' || chr(10) || 'func Ask' || k || '() string {' || chr(10) || chr(9) || 'return ""'
                                    || chr(10) || '}'
                   WHEN 'assistant' THEN 'var Reply' || k || ' = ' || k || chr(10) || '' || chr(10) || ''
                   ELSE 'type system' || k || ' struct {' || chr(10) || chr(9) || 'Name string' || chr(10) || '}'
         END AS b
  FROM t)
SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.go' AS path,
       md5('package conv' || conv_id || chr(10) || '' || chr(10) || string_agg(b, chr(10) ORDER BY turn)) AS cleared_md5
FROM blocks GROUP BY conv_id"""

def _block_sql(with_comment: bool) -> str:
    ins = "doc_line || chr(10) || " if with_comment else ""
    return f"""CASE role WHEN 'assistant' THEN '// ' || replace(text, chr(10), chr(10) || '// ')
                   WHEN 'system' THEN '/*' || chr(10) || ' * ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' */'
                   ELSE '' END || chr(10) ||
         CASE role WHEN 'user' THEN {ins}'func Ask' || k || '() string {{' WHEN 'assistant' THEN 'var Reply' || k || ' = ' || k
                   ELSE 'type system' || k || ' struct {{' END || chr(10) ||
         CASE role WHEN 'user' THEN chr(9) || 'return ""' WHEN 'assistant' THEN '' ELSE chr(9) || 'Name string' END
         || chr(10) || CASE role WHEN 'assistant' THEN '' ELSE '}}' END"""


_PROMPT = S.render(PROMPT_TEMPLATES["go"], {
    "target": "'function \"Ask' || k || '()\"'", "name": "'Ask' || k", "path": "path", "code": "code"})

_ANNOTATE_CODE = "WITH " + _T + f""",
files AS (
  SELECT conv_id, 'conv/' || CAST(conv_id AS VARCHAR) || '.go' AS path,
         '// Package conv' || conv_id || ' holds one conversation.' || chr(10) || 'package conv' || conv_id || chr(10)
         || '' || chr(10) || string_agg({_block_sql(False)}, chr(10) ORDER BY turn) AS code
  FROM t GROUP BY conv_id),
req AS (
  SELECT t.conv_id, t.turn, t.k, f.path, f.code, {_PROMPT} AS prompt
  FROM t JOIN files f ON t.conv_id = f.conv_id WHERE t.role = 'user'),
ans AS (
  SELECT *, greatest(0, least(512, 4096, 4096 - {S.n_tokens('prompt')})) > 0 AS ok,
         {S.clean("' \"' || regexp_extract_all(code, '\\S+')[1] || ' ... ' || regexp_extract_all(code, '\\S+')[-1] || ' (' || len(regexp_extract_all(code, '\\S+')) || ' words)' || '\"' || chr(10)")}
           AS doc
  FROM req),
per_file AS (
  SELECT conv_id, count(*) AS n_units, count(*) FILTER (WHERE NOT ok) AS n_failed,
         max(CASE WHEN ok THEN {S.line_comment('doc')} END) AS doc_line
  FROM ans GROUP BY conv_id),
patched AS (
  SELECT t.conv_id, string_agg({_block_sql(True)}, chr(10) ORDER BY turn) AS body,
         coalesce(max(p.n_units), 0) AS n_units, coalesce(max(p.n_failed), 0) AS n_failed
  FROM t LEFT JOIN per_file p ON t.conv_id = p.conv_id GROUP BY t.conv_id)
SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.go' AS path, CAST(n_units AS BIGINT) AS n_units,
       CAST(n_failed AS BIGINT) AS n_failed, CAST(n_units - n_failed AS BIGINT) AS n_applied, n_units > n_failed AS changed,
       md5('// Package conv' || conv_id || ' holds one conversation.' || chr(10) || 'package conv' || conv_id || chr(10)
           || '' || chr(10) || body) AS after_md5
FROM patched"""

ORACLE = {
    "annotate_code": _ANNOTATE_CODE,
    "go_units": _GO_UNITS,
    "go_findings": "SELECT path, identifier FROM (" + _GO_UNITS + """) g
WHERE exported AND NOT documented AND NOT (identifier LIKE 'func:Test%')""",
    "ts_units": _TS_UNITS + " SELECT path, identifier, kind, line, col, documented, public FROM u",
    "existing_comment": _TS_UNITS + " SELECT path, identifier, comment_from, comment FROM u",
    "locate_units": _TS_UNITS + """
SELECT path, identifier, line, col, CAST(NULL AS VARCHAR) AS error FROM u
UNION ALL SELECT path, 'method:Missing' || path, NULL, NULL, 'node not found: method:Missing' || path FROM heads
UNION ALL SELECT path, 'bogus', NULL, NULL, 'invalid identifier: bogus' FROM heads""",
    "clear_comments": _GO_TEXT,
}
