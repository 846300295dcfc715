"""Queries: path selection, dispatch, rule extraction, identifiers, ordering,
grouping and reports on pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions._util import bind, explode_rows
from docquill.functions.identifiers import format_identifier, is_exported, parse_identifier, valid_identifier
from docquill.functions.text import words
from docquill.operators import select as SEL
from docquill.operators.annotate import flatten_docs, group_inputs
from docquill.operators.units import extract_by_rules
from docquill.sources.sinks import findings_json, parse_findings, parse_position
from docquill.sources.tables import documents_source, load, pages_source

# ---- rules used on pages --------------------------------------------------

LINK_RULES = [("html", "link", r'href="([^"]*)"', 1)]
HEAD_RULES = [("html", "heading", r"<h1>([^<]*)</h1>", 1), ("html", "title", r"<title>([^<]*)</title>", 1)]
BLOCK_PATTERN = r"(-->\s*)?<(div|article|nav|footer)[ >]"


def page_units(spark: SparkSession, sf_dir: str, rules=None) -> DataFrame:
    src = pages_source(spark, sf_dir)
    return extract_by_rules(src, rules or (LINK_RULES + HEAD_RULES), keys=("page_id", "path"))


# ---- B1-B5 -----------------------------------------------------------------

PATH_EXTS = [".html"]
PATH_INCLUDE = ["**/en/**", "**/de/*.html", "www.*/**"]
PATH_EXCLUDE = ["m.*/**", "**/fr/**"]


def q_path_filter(spark, sf_dir):
    """Extension, include and exclude globs (plus the defaults)."""
    src = pages_source(spark, sf_dir)
    return SEL.select_paths(src, PATH_EXTS, PATH_INCLUDE, PATH_EXCLUDE).select("page_id", "path")


# ---- D1 --------------------------------------------------------------------

PAGE_LANGUAGES = SEL.DEFAULT_LANGUAGES + [(".html", "html"), (".htm", "html"), (".html", "web")]


def _dispatch(spark, sf_dir):
    return SEL.dispatch_language(pages_source(spark, sf_dir).drop("language"),
                                 SEL.languages_table(spark, PAGE_LANGUAGES))


def q_language_dispatch(spark, sf_dir):
    hit, _ = _dispatch(spark, sf_dir)
    return hit.select("page_id", "path", "language")


def q_dispatch_skipped(spark, sf_dir):
    _, skipped = _dispatch(spark, sf_dir)
    return skipped.select("page_id", "path", "ext")


# ---- B6 --------------------------------------------------------------------

MATCH_PATTERNS = [r"^de:", r"src1[0-9]$", r"fr:src[0-3]$"]


def q_match_any(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(
        "doc_id", F.concat("lang", F.lit(":"), "source").alias("identifier"))
    return SEL.match_any(d, "identifier", MATCH_PATTERNS)


# ---- C4, B8, B10 -----------------------------------------------------------

def q_rule_units(spark, sf_dir):
    return page_units(spark, sf_dir).select("page_id", "kind", "name", "identifier")


def q_undocumented_units(spark, sf_dir):
    """B8 + B10: block elements with or without a comment right before them."""
    p = load(spark, sf_dir, "pages")
    docd = F.regexp_extract_all("html", F.lit(BLOCK_PATTERN), F.lit(1))
    kinds = F.regexp_extract_all("html", F.lit(BLOCK_PATTERN), F.lit(2))
    u = explode_rows(p, F.arrays_zip(docd.alias("d"), kinds.alias("k")), ["page_id"], value="u").select(
        "page_id", F.col("u.k").alias("kind"), (F.col("u.d") != "").alias("documented"))
    u = SEL.filter_kinds(u, ["div", "article", "nav"])
    return SEL.only_undocumented(u).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n_undocumented"))


# ---- B7, B12-B14 -----------------------------------------------------------

def conversation_identifiers(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "method").when(F.col("role") == "assistant", "prop").otherwise("class")
    ident = F.when(F.col("turn") == 0, F.concat(F.lit("method:Conv"), F.col("conv_id"))).otherwise(
        F.concat(kind, F.lit(":Conv"), F.col("conv_id"), F.lit(".t"), F.col("turn")))
    return c.select("conv_id", "turn", ident.alias("identifier"))


def q_identifier_parts(spark, sf_dir):
    c = conversation_identifiers(spark, sf_dir)
    p = parse_identifier("identifier")
    return c.select("conv_id", "turn", "identifier", p["kind"].alias("kind"), p["owner"].alias("owner"),
                    p["name"].alias("name"), p["error"].isNull().alias("ok"),
                    valid_identifier("identifier").alias("valid"))


def q_identifier_roundtrip(spark, sf_dir):
    c = conversation_identifiers(spark, sf_dir).withColumn("p", parse_identifier("identifier"))
    ok = c.where(F.col("p.error").isNull())
    back = format_identifier(F.col("p.kind"), F.col("p.owner"), F.col("p.name"))
    return ok.groupBy(F.col("p.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(back == F.col("identifier"), 1)).alias("n_roundtrip"))


def exported_words(text) -> Column:
    """STRUCT<n_words, pos, words>: the number of words of a text, and the places
    and the texts, with one space between them, of those that are exported as ``func:<word>``."""
    def chosen(ws):
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        pos = F.filter(places, lambda i: is_exported(F.concat(F.lit("func:"), F.get(ws, i))))
        return bind(pos, lambda ps: F.struct(F.greatest(F.size(ws), F.lit(0)).alias("n_words"), ps.alias("pos"),
                                             F.array_join(F.transform(ps, lambda i: F.get(ws, i)), " ").alias("words")))
    return bind(words(text), chosen)


def q_exported_flag(spark, sf_dir):
    """B7 on every word of every document, as ``func:<word>``.

    The rule runs inside the row, so one row per document is shuffled, with its
    exported words alone. Documents of one id count as one, its words in the
    order of place, then text; documents without a word have no row."""
    d = load(spark, sf_dir, "documents").select("doc_id", exported_words("text").alias("w"))
    found = F.size("w.pos") > 0
    g = d.groupBy("doc_id").agg(
        F.sum("w.n_words").alias("n_words"),
        F.sum(F.size("w.pos")).alias("n_exported"),
        F.collect_list(F.when(found, F.struct("w.pos", "w.words"))).alias("ex"))

    def merged(ex):
        each = F.transform(ex, lambda x: F.arrays_zip(x["pos"].alias("pos"), F.split(x["words"], " ").alias("word")))
        return F.array_join(F.transform(F.sort_array(F.flatten(each)), lambda x: x["word"]), " ")

    text = F.when(F.size("ex") == 1, F.get("ex", F.lit(0))["words"]).otherwise(merged(F.col("ex")))
    return g.where("n_words > 0").select("doc_id", "n_words", "n_exported", F.md5(text).alias("exported_md5"))


# ---- G1, G2, H1, E6, E7 ----------------------------------------------------

def q_ordered_findings(spark, sf_dir):
    from pyspark.sql import Window
    u = page_units(spark, sf_dir)
    w = Window.partitionBy("page_id").orderBy("identifier")
    return u.select("page_id", "identifier", F.row_number().over(w).cast("bigint").alias("rn"))


FIRST_N = 25


def q_first_n_files(spark, sf_dir):
    return SEL.first_n_files(documents_source(spark, sf_dir), FIRST_N).select("doc_id", "path")


def q_union_findings(spark, sf_dir):
    links = page_units(spark, sf_dir, LINK_RULES)
    heads = page_units(spark, sf_dir, HEAD_RULES)
    return SEL.union_findings([links, heads]).select("page_id", "kind", "identifier")


def q_distinct_units(spark, sf_dir):
    return SEL.distinct_units(page_units(spark, sf_dir), ("page_id", "identifier")).select("page_id", "identifier")


def q_count_findings(spark, sf_dir):
    return SEL.count_findings(page_units(spark, sf_dir), ["kind"])


# ---- D2, E1, E3, A6, A7 ----------------------------------------------------

def attach_text(findings: DataFrame, source: DataFrame, key: str = "path", **derived) -> DataFrame:
    """Bring per-file values to each finding. ``derived`` columns are
    computed on the source side *before* the join, so only digests or lengths
    (not whole texts) cross the shuffle."""
    cols = [key] + [c.alias(n) for n, c in derived.items()] if derived else [key, "text"]
    return findings.join(source.select(*cols), key, "inner")


def q_attach_text(spark, sf_dir):
    src = pages_source(spark, sf_dir)
    u = page_units(spark, sf_dir).drop("page_id")
    j = attach_text(u, src, "path", page_id=F.col("page_id"), text_md5=F.md5("text"),
                    text_bytes=F.octet_length("text").cast("bigint"))
    return j.select("page_id", "identifier", "text_md5", "text_bytes")


def q_group_inputs(spark, sf_dir):
    g = group_inputs(page_units(spark, sf_dir), key="page_id", fields=["identifier"])
    ids = F.transform("inputs", lambda s: s["identifier"])
    return g.select("page_id", F.size("inputs").cast("bigint").alias("n_inputs"),
                    F.md5(F.array_join(ids, "\n")).alias("inputs_md5"))


def q_flatten_docs(spark, sf_dir):
    g = group_inputs(page_units(spark, sf_dir), key="page_id", fields=["identifier"])
    return flatten_docs(g, key="page_id", list_col="inputs")


def q_findings_json(spark, sf_dir):
    j = findings_json(page_units(spark, sf_dir), key="page_id")
    return j.select("page_id", "n_findings", F.md5("findings_json").alias("json_md5"))


def q_parse_findings(spark, sf_dir):
    """The reports of all pages; those of every seventh page are cut off
    before the end and must come back as bad."""
    j = findings_json(page_units(spark, sf_dir), key="page_id")
    whole = F.col("findings_json")
    j = j.withColumn("findings_json", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("{"), whole)).otherwise(whole))
    ok, bad = parse_findings(j, "findings_json")
    return ok.select("page_id", F.size("identifiers").cast("bigint").alias("n_parsed"),
                     F.md5(F.array_join("identifiers", "\n")).alias("identifiers_md5"),
                     F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("page_id", F.lit(None).cast("bigint").alias("n_parsed"),
                   F.lit(None).cast("string").alias("identifiers_md5"), F.md5("error").alias("error")))


def q_parse_props(spark, sf_dir):
    """Positions. ``events.props`` has no position, so every second event's
    becomes one, from its own number; the others are errors."""
    e = load(spark, sf_dir, "events").select("event_id", "props")
    k = F.from_json("props", "k int")["k"]
    at = F.format_string('{"line": %d, "character": %d}', k, F.col("event_id") % 80)
    e = e.withColumn("k", k).withColumn("props", F.when(F.col("event_id") % 2 == 0, at).otherwise(F.col("props")))
    p = parse_position(e, "props")
    return p.select("event_id", "k", "line", "col", F.col("error").isNotNull().alias("is_error"))


QUERIES = {
    "path_filter": q_path_filter,
    "language_dispatch": q_language_dispatch,
    "dispatch_skipped": q_dispatch_skipped,
    "match_any": q_match_any,
    "rule_units": q_rule_units,
    "undocumented_units": q_undocumented_units,
    "identifier_parts": q_identifier_parts,
    "identifier_roundtrip": q_identifier_roundtrip,
    "exported_flag": q_exported_flag,
    "ordered_findings": q_ordered_findings,
    "first_n_files": q_first_n_files,
    "union_findings": q_union_findings,
    "distinct_units": q_distinct_units,
    "count_findings": q_count_findings,
    "attach_text": q_attach_text,
    "group_inputs": q_group_inputs,
    "flatten_docs": q_flatten_docs,
    "findings_json": q_findings_json,
    "parse_findings": q_parse_findings,
    "parse_props": q_parse_props,
}

# ---- oracle SQL (hand-written twins) ----------------------------------------

_PAGES = """pg AS (
  SELECT page_id, html AS text,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' ||
         regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1), '^/', '') AS path
  FROM pages)"""

_UNITS = _PAGES + """,
units AS (
  SELECT page_id, path, 'link' AS kind, unnest(regexp_extract_all(text, 'href="([^"]*)"', 1)) AS name FROM pg
  UNION ALL
  SELECT page_id, path, 'heading', unnest(regexp_extract_all(text, '<h1>([^<]*)</h1>', 1)) FROM pg
  UNION ALL
  SELECT page_id, path, 'title', unnest(regexp_extract_all(text, '<title>([^<]*)</title>', 1)) FROM pg),
u AS (SELECT *, kind || ':' || name AS identifier FROM units)"""

_CONV_IDS = """ci AS (
  SELECT conv_id, turn,
         CASE WHEN turn = 0 THEN 'method:Conv' || CAST(conv_id AS VARCHAR)
              ELSE CASE role WHEN 'user' THEN 'method' WHEN 'assistant' THEN 'prop' ELSE 'class' END
                   || ':Conv' || CAST(conv_id AS VARCHAR) || '.t' || CAST(turn AS VARCHAR) END AS identifier
  FROM conversations),
parsed AS (
  SELECT *, split_part(identifier, ':', 1) AS k, split_part(identifier, ':', 2) AS p FROM ci),
parts AS (
  SELECT *, k IN ('method', 'prop') AS owned,
         CASE WHEN k IN ('method', 'prop') THEN split_part(p, '.', 1) END AS o,
         CASE WHEN k IN ('method', 'prop') THEN split_part(p, '.', 2) ELSE p END AS n
  FROM parsed),
chk AS (
  SELECT *, NOT (k = '' OR p = '' OR k NOT IN ('var','func','class','iface','method','prop','type')
                 OR (owned AND (o = '' OR n = ''))) AS ok
  FROM parts)"""

ORACLE = {
    "path_filter": "WITH " + _PAGES + """
SELECT page_id, path FROM pg
WHERE regexp_extract(path, '(\\.[^./]*)$', 1) IN ('.html')
  AND (regexp_matches(path, '^(.*/)?en/.*$') OR regexp_matches(path, '^(.*/)?de/[^/]*\\.html$')
       OR regexp_matches(path, '^www\\.[^/]*/.*$'))
  AND NOT regexp_matches(path, '^m\\.[^/]*/') AND NOT regexp_matches(path, '(^|/)fr/')
  AND NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(path, '(^|/)(dist|node_modules|vendor|testdata|test|tests)(/|$)')
  AND NOT regexp_matches(path, '\\.pb\\.go$')""",
    "language_dispatch": "WITH " + _PAGES + """
SELECT page_id, path, 'web' AS language FROM pg WHERE regexp_extract(path, '(\\.[^./]*)$', 1) = '.html'""",
    "dispatch_skipped": "WITH " + _PAGES + """
SELECT page_id, path, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM pg
WHERE regexp_extract(path, '(\\.[^./]*)$', 1) NOT IN ('.html', '.htm', '.go', '.ts')""",
    "match_any": """SELECT doc_id, lang || ':' || source AS identifier FROM documents
WHERE regexp_matches(lang || ':' || source, '^de:') OR regexp_matches(lang || ':' || source, 'src1[0-9]$')
   OR regexp_matches(lang || ':' || source, 'fr:src[0-3]$')""",
    "rule_units": "WITH " + _UNITS + " SELECT page_id, kind, name, identifier FROM u",
    "undocumented_units": """WITH b AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(-->\\s*)?<(div|article|nav|footer)[ >]', 1)) AS d,
         unnest(regexp_extract_all(html, '(-->\\s*)?<(div|article|nav|footer)[ >]', 2)) AS kind
  FROM pages)
SELECT page_id, kind, count(*) AS n_undocumented FROM b
WHERE kind IN ('div', 'article', 'nav') AND coalesce(d, '') = '' GROUP BY page_id, kind""",
    "identifier_parts": "WITH " + _CONV_IDS + """
SELECT conv_id, turn, identifier, CASE WHEN ok THEN k END AS kind, CASE WHEN ok THEN o END AS owner,
       CASE WHEN ok THEN n END AS name, ok,
       regexp_matches(identifier, '^(var|func|class|iface|method|prop|type):') AS valid
FROM chk""",
    "identifier_roundtrip": "WITH " + _CONV_IDS + """
SELECT k AS kind, count(*) AS n,
       count(*) FILTER (WHERE (CASE WHEN owned THEN k || ':' || o || '.' || n ELSE k || ':' || n END) = identifier)
         AS n_roundtrip
FROM chk WHERE ok GROUP BY k""",
    "exported_flag": """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents),
e AS (SELECT doc_id, ws, list_filter(ws, lambda w: (length((CASE WHEN position('.' IN split_part('func:' || w, ':', 2)) > 0 THEN split_part(split_part('func:' || w, ':', 2), '.', 2) ELSE split_part('func:' || w, ':', 2) END)) > 0 AND (CASE WHEN position('.' IN split_part('func:' || w, ':', 2)) > 0 THEN split_part(split_part('func:' || w, ':', 2), '.', 2) ELSE split_part('func:' || w, ':', 2) END) <> '_' AND strlen(substr((CASE WHEN position('.' IN split_part('func:' || w, ':', 2)) > 0 THEN split_part(split_part('func:' || w, ':', 2), '.', 2) ELSE split_part('func:' || w, ':', 2) END), 1, 1)) = 1 AND NOT (substr((CASE WHEN position('.' IN split_part('func:' || w, ':', 2)) > 0 THEN split_part(split_part('func:' || w, ':', 2), '.', 2) ELSE split_part('func:' || w, ':', 2) END), 1, 1) BETWEEN 'a' AND 'z'))) AS ex FROM w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ex) AS BIGINT) AS n_exported,
       md5(array_to_string(ex, ' ')) AS exported_md5
FROM e""",
    "ordered_findings": "WITH " + _UNITS + """
SELECT page_id, identifier, row_number() OVER (PARTITION BY page_id ORDER BY identifier) AS rn FROM u""",
    "first_n_files": f"""WITH s AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents)
SELECT doc_id, path FROM s WHERE path IN (SELECT DISTINCT path FROM s ORDER BY path LIMIT {FIRST_N})""",
    "union_findings": "WITH " + _UNITS + " SELECT page_id, kind, identifier FROM u",
    "distinct_units": "WITH " + _UNITS + " SELECT DISTINCT page_id, identifier FROM u",
    "count_findings": "WITH " + _UNITS + " SELECT kind, count(*) AS n_findings FROM u GROUP BY kind",
    "attach_text": "WITH " + _UNITS + """
SELECT p.page_id, u.identifier, md5(p.text) AS text_md5, CAST(strlen(p.text) AS BIGINT) AS text_bytes
FROM u JOIN pg p ON u.path = p.path""",
    "group_inputs": "WITH " + _UNITS + """
SELECT page_id, count(*) AS n_inputs, md5(array_to_string(list_sort(list(identifier)), chr(10))) AS inputs_md5
FROM u GROUP BY page_id""",
    "flatten_docs": "WITH " + _UNITS + " SELECT page_id, identifier FROM u",
    "findings_json": "WITH " + _UNITS + """
SELECT page_id, count(*) AS n_findings, md5(CAST(to_json(list_sort(list(identifier))) AS VARCHAR)) AS json_md5
FROM u GROUP BY page_id""",
    "parse_findings": "WITH " + _UNITS + """
SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN count(*) END AS n_parsed,
       CASE WHEN page_id % 7 <> 0 THEN md5(array_to_string(list_sort(list(identifier)), chr(10))) END AS identifiers_md5,
       CASE WHEN page_id % 7 = 0 THEN md5('invalid findings JSON: {' || CAST(to_json(list_sort(list(identifier))) AS VARCHAR)) END AS error
FROM u GROUP BY page_id""",
    "parse_props": """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS line,
       CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 80 AS INTEGER) END AS col,
       event_id % 2 <> 0 AS is_error FROM events""",
}
