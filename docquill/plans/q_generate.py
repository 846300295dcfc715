"""Queries: the commands ``find`` and ``generate`` over Go and TypeScript files
made from the conversations, prompts of every kind, and resolved edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.functions import text as T
from docquill.functions.identifiers import target_phrase
from docquill.operators.annotate import PROMPT_TEMPLATES, WordSpanProvider, build_prompt
from docquill.operators.patch import resolve_edits
from docquill.operators.units import ts_units
from docquill.plans import commands as C
from docquill.plans import q_code as Q
from docquill.plans import sqlgen as S
from docquill.sources.tables import load

SCRIPTS = [".ts", ".tsx", ".js", ".mjs"]
MODEL, LIMIT = "gpt-3.5-turbo", 4096
KIND_CYCLE = ["func", "type", "var", "class", "iface", "method", "prop", "other"]


def mixed_files(spark, sf_dir):
    """A Go and a script file per conversation, scripts with four extensions in
    turn; every tenth Go file holds a literal that no reduction makes fit."""
    number = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    blob = F.concat(F.col("text"), F.lit("\nvar blob = `"), F.repeat(F.lit("w "), F.lit(LIMIT + 900)), F.lit("`"))
    go = Q.go_code(spark, sf_dir).withColumn("text", F.when(number % 10 == 3, blob).otherwise(F.col("text")))
    ext = F.get(F.array(*[F.lit(e) for e in SCRIPTS]), (number % len(SCRIPTS)).cast("int"))
    ts = Q.ts_code(spark, sf_dir).withColumn("path", F.concat(F.regexp_replace("path", r"\.ts$", ""), ext))
    return go.withColumn("language", F.lit("go")).unionByName(ts.withColumn("language", F.lit("ts")))


def q_find_code(spark, sf_dir):
    """The find command over files of both languages and four script extensions."""
    return C.find(spark, "", src=mixed_files(spark, sf_dir)).select("path", "language", "identifier", "line", "col")


def q_generate_code(spark, sf_dir):
    """The generate command: one row per file, and one per unit that was not documented."""
    preview, dead = C.generate(spark, "", WordSpanProvider(), model=MODEL, src=mixed_files(spark, sf_dir))
    files = preview.select("path", F.lit(None).cast("string").alias("identifier"), F.lit(None).cast("string").alias("error"),
                           (F.col("before") != F.col("after")).alias("changed"), F.md5("after").alias("after_md5"))
    units = dead.select("path", "identifier", F.split_part("error", F.lit(" ("), F.lit(1)).alias("error"),
                        F.lit(None).cast("boolean").alias("changed"), F.lit(None).cast("string").alias("after_md5"))
    return files.unionByName(units)


def named_documents(spark, sf_dir):
    """Documents as units: eight kinds in turn, both languages, with and without an owner."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.get(F.array(*[F.lit(k) for k in KIND_CYCLE]), (F.col("doc_id") % 8).cast("int"))
    owned = kind.isin("method", "prop") | (F.floor(F.col("doc_id") / 16) % 2 == 1)
    name = F.concat(F.when(owned, F.concat(F.lit("Own"), F.col("doc_id"), F.lit("."))).otherwise(""), F.lit("n"), F.col("doc_id"))
    return d.select("doc_id", "text", F.concat(kind, F.lit(":"), name).alias("identifier"),
                    F.when(F.floor(F.col("doc_id") / 8) % 2 == 0, "go").otherwise("ts").alias("language"))


def q_target_phrase(spark, sf_dir):
    """How a prompt names its target, for every kind and language."""
    return named_documents(spark, sf_dir).select("doc_id", "identifier", "language",
                                                 target_phrase("identifier", F.col("language")).alias("phrase"))


def q_build_prompt(spark, sf_dir):
    """The whole prompt, with the document as code."""
    d = named_documents(spark, sf_dir)
    return d.select("doc_id", F.md5(build_prompt("identifier", "language", F.col("doc_id").cast("string"), "text")).alias("prompt_md5"))


def q_resolve_edits(spark, sf_dir):
    """Places for docs by identifier; every turn has a doc, user turns'
    methods and assistant turns' properties exist, system turns' docs name a
    member that does not."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = c.select(F.format_string("conv/%d.ts", "conv_id").alias("path"), "conv_id", F.posexplode("turns").alias("k", "t"))
    role = F.col("t.role")
    ident = (F.when(role == "user", F.concat(F.lit("method:Conv"), "conv_id", F.lit(".ask"), "k"))
             .when(role == "assistant", F.concat(F.lit("prop:Conv"), "conv_id", F.lit(".reply"), "k"))
             .otherwise(F.concat(F.lit("prop:Conv"), "conv_id", F.lit(".none"), "k")))
    docs = rows.select("path", ident.alias("identifier"), F.col("t.text").alias("text"))
    edits, misses = resolve_edits(docs, ts_units(Q.ts_code(spark, sf_dir)))
    return edits.select("path", "identifier", "line", "col", F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("error")) \
        .unionByName(misses.select("path", "identifier", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"),
                                   F.md5("text").alias("text_md5"), "error"))


QUERIES = {
    "find_code": q_find_code,
    "generate_code": q_generate_code,
    "target_phrase": q_target_phrase,
    "build_prompt": q_build_prompt,
    "resolve_edits": q_resolve_edits,
}

# ---- oracle SQL -----------------------------------------------------------

_EXT = "[" + ", ".join(f"'{e}'" for e in SCRIPTS) + f"][conv_id % {len(SCRIPTS)} + 1]"

_FIND = Q._TS_UNITS + f"""
SELECT 'conv/' || conv_id || '.go' AS path, 'go' AS language, 'func:Ask' || k AS identifier,
       CAST(3 + go_before + go_slot AS INTEGER) AS line, 0 AS col FROM t2 WHERE role = 'user'
UNION ALL
SELECT 'conv/' || conv_id || {_EXT}, 'ts', 'method:Conv' || conv_id || '.ask' || k,
       CAST(2 + ts_before + ts_slot AS INTEGER), 2 FROM t2 WHERE role = 'user'
UNION ALL
SELECT 'conv/' || conv_id || {_EXT}, 'ts', 'var:turns' || conv_id, CAST(2 + ts_total + 1 AS INTEGER), 0 FROM heads"""


def _said(code: str) -> str:
    """The stand-in model's answer for ``code``."""
    w = f"regexp_extract_all({code}, '\\S+')"
    return f"{w}[1] || ' ... ' || {w}[-1] || ' (' || len({w}) || ' words)'"


def _ts_block(doc: str) -> str:
    return f"""CASE role WHEN 'assistant' THEN '  /**' || chr(10) || '   * ' || replace(text, chr(10), chr(10) || '   * ') || chr(10) || '   */'
                   WHEN 'system' THEN '  // ' || replace(text, chr(10), chr(10) || '  // ') ELSE '' END || chr(10) ||
         CASE role WHEN 'user' THEN {doc} || '  ask' || k || '(q: string): string {{ return q }}'
                   WHEN 'assistant' THEN '  reply' || k || ': string' ELSE '  private sys' || k || ' = ' || k END || chr(10) || ''"""


_GO_HEAD = "'// Package conv' || conv_id || ' holds one conversation.' || chr(10) || 'package conv' || conv_id || chr(10) || ''"
_TS_HEAD = "'// Conversation ' || conv_id || '.' || chr(10) || 'export class Conv' || conv_id || ' {'"
_TS_FOOT = "'export const turns' || conv_id || ' = ' || n"

_GENERATE = "WITH " + Q._T + f""",
tn AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM t),
go0 AS (
  SELECT conv_id, {_GO_HEAD} || chr(10) || string_agg({Q._block_sql(False)}, chr(10) ORDER BY turn)
         || CASE WHEN conv_id % 10 = 3 THEN chr(10) || 'var blob = `' || repeat('w ', {LIMIT + 900}) || '`' ELSE '' END AS code
  FROM tn GROUP BY conv_id),
ts0 AS (
  SELECT conv_id, any_value(n) AS n, {_TS_HEAD} || chr(10) || string_agg({_ts_block("''")}, chr(10) ORDER BY turn)
         || chr(10) || '}}' || chr(10) || any_value({_TS_FOOT}) AS code
  FROM t GROUP BY conv_id),
gd AS (SELECT conv_id, code, {S.line_comment(_said('code'))} AS doc_line FROM go0),
td AS (SELECT conv_id, n, code, '/** ' || {_said('code')} || ' */' AS doc FROM ts0),
go1 AS (
  SELECT conv_id, {_GO_HEAD} || chr(10) || string_agg({Q._block_sql(True)}
         || CASE WHEN role = 'user' AND next_role IN ('assistant', 'system') THEN chr(10) ELSE '' END, chr(10) ORDER BY turn) AS after
  FROM tn JOIN gd USING (conv_id) GROUP BY conv_id),
ts1 AS (
  SELECT conv_id, {_TS_HEAD} || chr(10) || string_agg({_ts_block("'  ' || doc || chr(10)")}, chr(10) ORDER BY turn)
         || chr(10) || '}}' || chr(10) || any_value(doc) || chr(10) || any_value({_TS_FOOT.replace('|| n', '|| t.n')}) AS after
  FROM t JOIN td USING (conv_id) GROUP BY conv_id)
SELECT 'conv/' || conv_id || '.go' AS path, CAST(NULL AS VARCHAR) AS identifier, CAST(NULL AS VARCHAR) AS error,
       conv_id % 10 <> 3 AND go1.after <> go0.code AS changed,
       md5(CASE WHEN conv_id % 10 = 3 THEN go0.code ELSE go1.after END) AS after_md5
FROM go0 JOIN go1 USING (conv_id)
UNION ALL
SELECT 'conv/' || conv_id || {_EXT}, NULL, NULL, ts1.after <> ts0.code, md5(ts1.after) FROM ts0 JOIN ts1 USING (conv_id)
UNION ALL
SELECT 'conv/' || conv_id || '.go', 'func:Ask' || k, 'shrunk text exceeds {LIMIT} tokens', NULL, NULL
FROM t WHERE role = 'user' AND conv_id % 10 = 3"""

_NAMED = """WITH d0 AS (
  SELECT doc_id, text, ['func', 'type', 'var', 'class', 'iface', 'method', 'prop', 'other'][doc_id % 8 + 1] AS kind,
         CASE WHEN (doc_id // 8) % 2 = 0 THEN 'go' ELSE 'ts' END AS language FROM documents),
d1 AS (SELECT *, CASE WHEN kind IN ('method', 'prop') OR (doc_id // 16) % 2 = 1 THEN 'Own' || doc_id END AS owner, 'n' || doc_id AS name FROM d0),
d2 AS (SELECT *, coalesce(owner || '.', '') || name AS p FROM d1),
d AS (SELECT *, kind || ':' || p AS identifier,
        CASE WHEN language = 'go' THEN
          CASE kind WHEN 'func' THEN 'function "' || p || '()"' WHEN 'type' THEN 'type "' || p || '"'
                    WHEN 'var' THEN 'variable "' || p || '"' ELSE '"' || kind || ':' || p || '"' END
        ELSE
          CASE kind WHEN 'func' THEN 'function "' || name || '()"' WHEN 'var' THEN 'variable "' || name || '"'
                    WHEN 'class' THEN 'class "' || name || '"' WHEN 'iface' THEN 'interface "' || name || '"'
                    WHEN 'type' THEN 'type "' || name || '"'
                    WHEN 'method' THEN 'method "' || name || '" of "' || owner || '"'
                    WHEN 'prop' THEN 'property "' || name || '" of "' || owner || '"' ELSE kind || ':' || p END
        END AS phrase FROM d2)"""


def _prompt(key: str) -> str:
    return S.render(PROMPT_TEMPLATES[key], {"target": "phrase", "name": "name", "path": "CAST(doc_id AS VARCHAR)", "code": "text"})


# The oracle's own statement: one pattern per kind, one pass each.
_COMMENT = r"(?://[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"
_STATEMENTS = {"variables": "var|let|const", "functions": "function", "classes": "class", "interfaces": "interface"}
_STARTS = {k: rf"(?:export\s+)?(?:{w})\s" for k, w in _STATEMENTS.items()} | {"properties": r"\w+\s*:\s*\w", "methods": r"\w+\s*\("}
_STRIP = "s0 AS (SELECT conv_id, code AS c0 FROM ts0)" + "".join(
    f",\ns{i + 1} AS (SELECT conv_id, regexp_replace(c{i}, '{_COMMENT}\\s*({_STARTS[k]})', '\\1', 'g') AS c{i + 1} FROM s{i})"
    for i, k in enumerate(T.STRIP_ORDER))
_STRIPPED = S.trim_ws(f"regexp_replace(c{len(T.STRIP_ORDER)}, '(?m)^\\s*[\\r\\n]+', '', 'g')")

ORACLE = {
    "find_code": _FIND,
    "generate_code": _GENERATE,
    "target_phrase": _NAMED + " SELECT doc_id, identifier, language, phrase FROM d",
    "build_prompt": _NAMED + f""" SELECT doc_id, md5(CASE WHEN language = 'go' THEN {_prompt('go')}
  WHEN kind = 'func' THEN {_prompt('ts:func')} WHEN kind = 'method' THEN {_prompt('ts:method')}
  WHEN kind = 'prop' THEN {_prompt('ts:prop')} ELSE {_prompt('ts')} END) AS prompt_md5 FROM d""",
    "resolve_edits": Q._TS_UNITS + """
SELECT u.path, u.identifier, u.line, u.col, md5(t2.text) AS text_md5, CAST(NULL AS VARCHAR) AS error
FROM t2 JOIN u ON u.path = 'conv/' || t2.conv_id || '.ts' AND u.identifier =
  CASE role WHEN 'user' THEN 'method:Conv' || t2.conv_id || '.ask' || k WHEN 'assistant' THEN 'prop:Conv' || t2.conv_id || '.reply' || k END
UNION ALL
SELECT 'conv/' || conv_id || '.ts', 'prop:Conv' || conv_id || '.none' || k, NULL, NULL, md5(text),
       'node not found: prop:Conv' || conv_id || '.none' || k FROM t2 WHERE role = 'system'""",
    "strip_comments": "WITH " + Q._T + f""",
ts0 AS (
  SELECT conv_id, {_TS_HEAD} || chr(10) || string_agg({_ts_block("''")}, chr(10) ORDER BY turn)
         || chr(10) || '}}' || chr(10) || any_value({_TS_FOOT}) AS code
  FROM t GROUP BY conv_id),
{_STRIP},
o AS (SELECT conv_id, {_STRIPPED} AS s FROM s{len(T.STRIP_ORDER)})
SELECT 'conv/' || conv_id || '.ts' AS path, md5(s) AS stripped_md5, CAST(len(string_split(s, chr(10))) AS BIGINT) AS n_lines FROM o""",
}
