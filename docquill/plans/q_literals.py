"""Queries: units and reductions of code whose literals and comments hold code.

Every conversation becomes Go and TypeScript files. A turn's whole text stands
in a comment, and again in a raw string, a string or a template literal, next
to brackets and words that would open declarations. The expected units,
positions, texts and counts are stated independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.operators import budget as B
from docquill.operators import select as SEL
from docquill.operators.units import go_units, ts_units
from docquill.plans.q_code import _T, _turns

NL = "chr(10)"


def _raw(text):
    """A text that ends no raw string, template literal or block comment."""
    return F.regexp_replace(F.translate(text, "`\\$", "'/S"), r"\*/", "*|")


def _flat(text):
    """A text that ends no string either, on one line."""
    return F.translate(_raw(text), '"\n', "' ")


def _lines(*parts):
    """One array of lines, of lines and, in lists, arrays of lines."""
    return F.concat(*[p[0] if isinstance(p, list) else F.array(F.lit(p) if isinstance(p, str) else p) for p in parts])


def _text_lines(c, prefix=""):
    return [F.transform(F.split(c, "\n"), lambda l: F.concat(F.lit(prefix), l))]


def _by_role(t, user, assistant, system):
    return F.when(t["role"] == "user", user).when(t["role"] == "assistant", assistant).otherwise(system)


def _file(spark, sf_dir, header, block, footer, path):
    """One file a conversation: header, a block for every turn, footer."""
    g = _turns(spark, sf_dir)
    blocks = F.flatten(F.transform("turns", block))
    text = F.array_join(F.concat(_lines(*header), blocks, *([_lines(*footer)] if footer else [])), "\n")
    return g.select("conv_id", path.alias("path"), text.alias("text"), "turns")


def _c(before: str, after: str = ""):
    return F.concat(F.lit(before), F.col("conv_id"), F.lit(after))


def literal_go(spark, sf_dir):
    header = [_c("// Package conv", ' holds "{ one conversation.'), _c("package conv"), "", _c("type Store", " interface {"),
              "\t// Get has a comment: {", "\tGet(x struct{ a int }) string", '\tPut(s string) // "{"', "\thidden()", "\tfmt.Stringer", "}", "",
              "var (", F.concat(_c("\tfirst", ", other"), _c("", " = '{', \"(\"")), "\t// Third has a comment.", _c("\tThird", ' = "}"'), ")", "",
              _c("func (s *Set[K]) Add", '(k K) { s.m["}"] = k }'), "", _c("func TestConv", '(t *testing.T) { t.Log("func Nothing() {") }'), ""]

    def block(t, k):
        name = lambda a, b="": F.concat(F.lit(a), k, F.lit(b))
        return _by_role(
            t, _lines(name("func Ask", "() string {"), name("\tq := `func Hidden", "() {"), _text_lines(_raw(t["text"])), "}`",
                      "\treturn q + \"{\" + string('}')", "}", ""),
            _lines(_text_lines(t["text"], "// "), F.concat(name("var Reply", ' = "{ '), _flat(t["text"]), F.lit('"')), ""),
            _lines("/* {", _text_lines(_raw(t["text"])), "*/", name("type system", " struct {"), "\tName string // }", "}", ""))

    path = F.concat(F.when(F.col("conv_id") % 5 == 0, F.lit("internal/")).otherwise(""), _c("conv/", ".go"))
    return _file(spark, sf_dir, header, block, [], path)


def literal_ts(spark, sf_dir):
    def block(t, k):
        name = lambda a, b="": F.concat(F.lit(a), k, F.lit(b))
        return _by_role(
            t, _lines(name("  ask", "(q: {"), "    text: string", "  }): string {", name("    return `export function hidden", "() {"),
                      _text_lines(_raw(t["text"])), '    ${q.text + `{`}` + "}"', "  }", ""),
            _lines("  /** {", _text_lines(_raw(t["text"])), "  */", name("  reply", ": string = '{'"), ""),
            _lines(F.concat(name("  private sys", ' = "{ '), _flat(t["text"]), F.lit('"')), ""))

    footer = ["}", _c("export const turns", ' = /[{"]/.test("")'), _c("export interface Log", " {"), "  f(", "    a: string", "  ): void // {",
              "  g: number", "}"]
    return _file(spark, sf_dir, [_c("// Conversation ", ': "{'), _c("export class Conv", " {")], block, footer, _c("conv/", ".ts"))


def q_literal_go_units(spark, sf_dir):
    """Groups, interfaces, receivers, generics and functions around literals that hold code."""
    u = go_units(literal_go(spark, sf_dir))
    return u.select("path", "identifier", "line", "col", "exported", "documented")


def q_literal_go_findings(spark, sf_dir):
    """What the find command reports, first and last in its order per file."""
    files = SEL.select_paths(literal_go(spark, sf_dir).select("path", "text"), exclude_internal=True)
    u = go_units(files).where(F.col("exported"))
    found = SEL.order_findings(SEL.only_undocumented(SEL.exclude_tests(u)).select("path", "identifier"))
    # Numbered in the order of the sorted stream.
    found = found.withColumn("at", F.monotonically_increasing_id())
    return found.groupBy("path").agg(F.min_by("identifier", "at").alias("first"), F.max_by("identifier", "at").alias("last"),
                                     F.count(F.lit(1)).alias("n"))


def q_literal_ts_units(spark, sf_dir):
    """Members whose signature spans lines, nested types, literals and patterns that hold brackets."""
    u = ts_units(literal_ts(spark, sf_dir))
    return u.select("path", "identifier", "kind", "line", "col", "documented", "public")


# --------------------------------------------------------------------------
# Reductions


def _sizes(role: str, constant: int, lines: int, words: int):
    """Sum over the turns of a role of constant + lines * (its lines) + words * (its tokens)."""
    def one(acc, t):
        n = (F.lit(constant) + lines * F.size(F.split(t["text"], "\n")) + words * F.size(F.regexp_extract_all(t["text"], F.lit(r"\S+"), F.lit(0))))
        return acc + F.when(t["role"] == role, n).otherwise(0)
    return F.aggregate("turns", F.lit(0), one)


def _limits(df, cuts):
    """A limit at which rung ``conv_id % (len(cuts) + 2)`` decides: the tokens that earlier rungs leave, less one."""
    n, limit = len(cuts) + 2, B.token_count(F.col("text")).cast("int")
    which = (F.col("conv_id") % n).cast("int")
    gone = F.lit(0)
    chosen = F.when(which == 0, limit)
    for k, cut in enumerate([F.lit(0), *cuts], start=1):
        gone = gone + cut
        chosen = chosen.when(which == k, limit - gone - 1)
    return df.withColumn("limit", F.greatest(chosen, F.lit(1)).cast("int"))


def shrinkable_go(spark, sf_dir):
    header = [_c("// Package s", " holds one conversation."), _c("package s"), ""]

    def block(t, k):
        name = lambda a, b="": F.concat(F.lit(a), k, F.lit(b))
        return _by_role(
            t, _lines(_text_lines(t["text"], "// "), name("func ask", "() {"), "\tx := `", _text_lines(_raw(t["text"])), "}`", "}", ""),
            _lines(_text_lines(t["text"], "// "), F.concat(name("func Reply", '() { return "{ '), _flat(t["text"]), F.lit(' }" }')), ""),
            _lines("/* {", _text_lines(_raw(t["text"])), " */", name("type System", " struct {"), "}", ""))

    df = _file(spark, sf_dir, header, block, [], _c("s/", ".go"))
    return _limits(df, [_sizes("user", 6, 1, 2), _sizes("assistant", 5, 0, 1),
                        _sizes("assistant", 0, 1, 1) + _sizes("system", 3, 0, 1)])


def shrinkable_ts(spark, sf_dir):
    def block(t, k):
        name = lambda a, b="": F.concat(F.lit(a), k, F.lit(b))
        text = _flat(t["text"])
        return _lines(F.concat(F.lit("/* "), text, F.lit(" */")), [_by_role(
            t, F.array(F.concat(name("export const v", ' = "// '), text, F.lit(' const"')), F.lit("")),
            F.array(name("export interface I", " {"), F.lit("}"), F.lit("")),
            F.array(F.concat(name("export function f", "() { return `/* "), text, F.lit(" */ function` }")), F.lit("")))])

    df = _file(spark, sf_dir, ["// Conversation.", ""], block, [], _c("s/", ".ts"))
    return _limits(df, [_sizes("user", 2, 0, 1), _sizes("assistant", 2, 0, 1)])


def _shrunk(df):
    return df.select("path", "rung", "tokens_in", "tokens", "fits", F.md5("text_min").alias("text_md5"))


def q_shrink_go(spark, sf_dir):
    """Go reductions, with limits at which every rung decides for some files and some fit after none."""
    return _shrunk(B.shrink_to_budget(shrinkable_go(spark, sf_dir), "text", B.go_rungs(), F.col("limit")))


def q_shrink_ts(spark, sf_dir):
    """TypeScript reductions, with limits at which every rung decides for some files."""
    return _shrunk(B.shrink_to_budget(shrinkable_ts(spark, sf_dir), "text", B.ts_rungs(), F.col("limit"), on_overflow="keep"))


QUERIES = {
    "literal_go_units": q_literal_go_units,
    "literal_go_findings": q_literal_go_findings,
    "literal_ts_units": q_literal_ts_units,
    "shrink_go": q_shrink_go,
    "shrink_ts": q_shrink_ts,
}


# --------------------------------------------------------------------------
# Oracles

_P = "WITH " + _T + f""",
p AS (
  SELECT *, replace(translate(text, '`\\$', '''/S'), '*/', '*|') AS rt,
         translate(replace(translate(text, '`\\$', '''/S'), '*/', '*|'), '"' || {NL}, ''' ') AS ft,
         CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS nt,
         '// ' || replace(text, {NL}, {NL} || '// ') AS comment,
         CASE role WHEN 'user' THEN nl + 6 WHEN 'assistant' THEN nl + 2 ELSE nl + 6 END AS go_n,
         CASE role WHEN 'user' THEN nl + 7 WHEN 'assistant' THEN nl + 4 ELSE 2 END AS ts_n
  FROM t0),
q AS (
  SELECT *, coalesce(sum(go_n) OVER w, 0) AS go_at, coalesce(sum(ts_n) OVER w, 0) AS ts_at,
         sum(ts_n) OVER (PARTITION BY conv_id) AS ts_all
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT DISTINCT conv_id, ts_all FROM q)"""

_GO = _P + """,
u AS (
  SELECT conv_id, CASE role WHEN 'user' THEN 'func:Ask' || k WHEN 'assistant' THEN 'var:Reply' || k ELSE 'type:system' || k END AS identifier,
         21 + go_at + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN nl ELSE nl + 2 END AS line, 0 AS col,
         role <> 'system' AS exported, role <> 'user' AS documented
  FROM q
  UNION ALL SELECT conv_id, 'type:Store' || conv_id, 3, 0, true, false FROM c
  UNION ALL SELECT conv_id, 'func:Store' || conv_id || '.Get', 5, 1, true, true FROM c
  UNION ALL SELECT conv_id, 'func:Store' || conv_id || '.Put', 6, 1, true, false FROM c
  UNION ALL SELECT conv_id, 'func:Store' || conv_id || '.hidden', 7, 1, false, false FROM c
  UNION ALL SELECT conv_id, 'var:first' || conv_id, 12, 1, false, false FROM c
  UNION ALL SELECT conv_id, 'var:Third' || conv_id, 14, 1, true, true FROM c
  UNION ALL SELECT conv_id, 'func:(*Set).Add' || conv_id, 17, 0, true, false FROM c
  UNION ALL SELECT conv_id, 'func:TestConv' || conv_id, 19, 0, true, false FROM c),
g AS (
  SELECT CASE WHEN conv_id % 5 = 0 THEN 'internal/' ELSE '' END || 'conv/' || conv_id || '.go' AS path, identifier,
         CAST(line AS INTEGER) AS line, col, exported, documented FROM u)"""

_GO_PIECE = f"""CASE role
  WHEN 'user' THEN CASE WHEN r < 1 THEN comment || {NL} || 'func ask' || k || '() {{' || {NL} || chr(9) || 'x := `' || {NL} || rt || {NL} || '}}`'
                        || {NL} || '}}' ELSE 'func ask' || k || '()' END
  WHEN 'assistant' THEN CASE WHEN r < 3 THEN comment || {NL} ELSE '' END || 'func Reply' || k || '()'
                        || CASE WHEN r < 2 THEN ' {{ return "{{ ' || ft || ' }}" }}' ELSE '' END
  ELSE CASE WHEN r < 3 THEN '/* {{' || {NL} || rt || {NL} || ' */' || {NL} ELSE '' END || 'type System' || k || ' struct {{' || {NL} || '}}'
  END || {NL}"""

_TS_PIECE = f"""CASE WHEN r <= CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END THEN '/* ' || ft || ' */' || {NL} ELSE '' END ||
  CASE role WHEN 'user' THEN 'export const v' || k || ' = "// ' || ft || ' const"'
  WHEN 'assistant' THEN 'export interface I' || k || ' {{' || {NL} || '}}'
  ELSE 'export function f' || k || '() {{ return `/* ' || ft || ' */ function` }}' END || CASE WHEN r = 0 THEN {NL} ELSE '' END"""


def _shrink_oracle(head: str, piece: str, steps: list[str], ext: str, keep: bool) -> str:
    """``steps``: tokens that each rung takes from a turn (the last one's may differ from the limits' last cut)."""
    n = len(steps) + 1
    gone = ", ".join(f"CAST(sum({s}) AS BIGINT) AS g{k + 1}" for k, s in enumerate(steps))
    limit = " ".join(f"WHEN {k} THEN tok{k - 1} - 1" for k in range(1, n))
    toks = ", ".join(["n0 AS tok0", *[f"n0 - {' - '.join(f'g{j}' for j in range(1, k + 1))} AS tok{k}" for k in range(1, n)]])
    return _P + f""",
texts AS (
  SELECT conv_id, r, {head} || string_agg({piece}, {NL} ORDER BY turn) AS code
  FROM p, (SELECT unnest(range(0, {n})) AS r) GROUP BY conv_id, r),
gone AS (SELECT conv_id, {gone} FROM p GROUP BY conv_id),
counted AS (
  SELECT conv_id, {toks} FROM gone JOIN (SELECT conv_id, CAST(len(regexp_extract_all(code, '\\S+')) AS BIGINT) AS n0 FROM texts WHERE r = 0) USING (conv_id)),
lim AS (SELECT *, greatest(1, CASE conv_id % {n} WHEN 0 THEN tok0 {limit} END) AS lim FROM counted),
pick AS (
  SELECT *, CASE {' '.join(f'WHEN tok{k} <= lim THEN {k}' for k in range(n))} END AS fit FROM lim),
done AS (SELECT *, coalesce(fit, {n - 1}) AS rung FROM pick)
SELECT 's/' || done.conv_id || '.{ext}' AS path, CAST(rung AS INTEGER) AS rung, tok0 AS tokens_in,
       CASE rung {' '.join(f'WHEN {k} THEN tok{k}' for k in range(n))} END AS tokens, fit IS NOT NULL AS fits,
       {'md5(code)' if keep else 'CASE WHEN fit IS NOT NULL THEN md5(code) END'} AS text_md5
FROM done JOIN texts ON texts.conv_id = done.conv_id AND texts.r = done.rung"""


_ROLE = "CASE WHEN role = '{}' THEN {} ELSE 0 END"

ORACLE = {
    "literal_go_units": _GO + " SELECT * FROM g",
    "literal_go_findings": _GO + """
SELECT path, min(identifier) AS "first", max(identifier) AS "last", count(*) AS n FROM g
WHERE exported AND NOT documented AND path NOT LIKE 'internal/%' AND identifier NOT LIKE 'func:Test%' GROUP BY path""",
    "literal_ts_units": _P + """,
u AS (
  SELECT conv_id, CASE role WHEN 'user' THEN 'method:Conv' || conv_id || '.ask' || k WHEN 'assistant' THEN 'prop:Conv' || conv_id || '.reply' || k
                  ELSE 'prop:Conv' || conv_id || '.sys' || k END AS identifier, CASE role WHEN 'user' THEN 'method' ELSE 'prop' END AS kind,
         2 + ts_at + CASE role WHEN 'assistant' THEN nl + 2 ELSE 0 END AS line, 2 AS col, role = 'assistant' AS documented,
         role <> 'system' AS public
  FROM q
  UNION ALL SELECT conv_id, 'class:Conv' || conv_id, 'class', 1, 0, true, true FROM c
  UNION ALL SELECT conv_id, 'var:turns' || conv_id, 'var', 3 + ts_all, 0, false, true FROM c
  UNION ALL SELECT conv_id, 'iface:Log' || conv_id, 'iface', 4 + ts_all, 0, false, true FROM c
  UNION ALL SELECT conv_id, 'method:Log' || conv_id || '.f', 'method', 5 + ts_all, 2, false, true FROM c
  UNION ALL SELECT conv_id, 'prop:Log' || conv_id || '.g', 'prop', 8 + ts_all, 2, false, true FROM c)
SELECT 'conv/' || conv_id || '.ts' AS path, identifier, kind, CAST(line AS INTEGER) AS line, col, documented, public FROM u""",
    "shrink_go": _shrink_oracle(
        f"CASE WHEN r < 4 THEN '// Package s' || conv_id || ' holds one conversation.' || {NL} ELSE '' END || 'package s' || conv_id || {NL} || {NL}",
        _GO_PIECE,
        [_ROLE.format("user", "6 + nl + 2 * nt"), _ROLE.format("assistant", "5 + nt"),
         "CASE role WHEN 'assistant' THEN nl + nt WHEN 'system' THEN 3 + nt ELSE 0 END", "CASE WHEN k = 0 THEN 6 ELSE 0 END"], "go", False),
    "shrink_ts": _shrink_oracle(
        f"'// Conversation.' || {NL} || CASE WHEN r = 0 THEN {NL} ELSE '' END", _TS_PIECE,
        [_ROLE.format("user", "2 + nt"), _ROLE.format("assistant", "2 + nt"), _ROLE.format("system", "2 + nt")], "ts", True),
}
