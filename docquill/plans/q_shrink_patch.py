"""Queries: shrinking texts to a token budget, and applying edits."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docquill.functions import text as T
from docquill.functions._util import explode_rows, filter_computed
from docquill.operators.budget import html_rungs, shrink_to_budget
from docquill.operators.patch import apply_edits, preview_summary, replace_comments
from docquill.plans import sqlgen as S
from docquill.plans.q_annotate import noisy_conversations
from docquill.sources.tables import documents_source, load

PAGE_LIMIT = 300
NOISY_LIMIT = 240


def _shrunk_pages(spark: SparkSession, sf_dir: str, on_overflow: str = "null"):
    p = load(spark, sf_dir, "pages").select("page_id", "html")
    return shrink_to_budget(p, "html", html_rungs(), PAGE_LIMIT, on_overflow=on_overflow, trace=True)


def q_shrink_pages(spark, sf_dir):
    """First of (as is, -comments, -scripts, -styles, -tags) within the limit."""
    s = _shrunk_pages(spark, sf_dir)
    return s.select("page_id", "rung", "tokens_in", "tokens", "fits", F.md5("text_min").alias("text_md5"))


def q_shrink_trace(spark, sf_dir):
    """One row per executed reduction step."""
    s = _shrunk_pages(spark, sf_dir)
    return explode_rows(s, F.col("steps"), ["page_id"], value="s").select(
        "page_id", "s.step", "s.rung", "s.tokens_in", "s.tokens_out")


def q_over_budget(spark, sf_dir):
    """Texts that still exceed the limit after every reduction."""
    s = _shrunk_pages(spark, sf_dir)
    return filter_computed(s, ~F.col("fits")).select("page_id", "tokens", "error")


def noisy_rungs():
    return [
        ("blank_lines", T.drop_empty_lines),
        ("reflow", T.reflow),
        ("short_words", lambda c: F.array_join(F.filter(F.split(c, " "), lambda w: F.length(w) > 4), " ")),
    ]


def q_shrink_best_effort(spark, sf_dir):
    """Best effort; over-budget results are returned, not dropped."""
    n = noisy_conversations(spark, sf_dir)
    s = shrink_to_budget(n, "noisy", noisy_rungs(), NOISY_LIMIT, on_overflow="keep")
    return s.select("conv_id", "rung", "tokens_in", "tokens", "fits", F.md5("text_min").alias("text_md5"))


# ---- edits ----------------------------------------------------------------

def document_edits(spark, sf_dir):
    """Three edits per document: a head comment at (0, 0), an inline marker at
    (2, 3), and for French documents one far past the end (line 99999).
    Built in one pass over the documents."""
    d = documents_source(spark, sf_dir)
    edit_t = "struct<line:int,col:int,identifier:string,text:string>"

    def edit(line, col, ident, text):
        return F.struct(F.lit(line).alias("line"), F.lit(col).alias("col"), F.lit(ident).alias("identifier"),
                        text.alias("text"))

    all_edits = F.filter(F.array(
        edit(0, 0, "a", F.concat(F.lit("// head of "), F.col("path"), F.lit("\n"))),
        edit(2, 3, "b", F.lit("<<x>>")),
        F.when(F.col("language") == "fr", edit(99999, 0, "c", F.lit("// far\n"))).cast(edit_t),
    ), lambda e: e.isNotNull())
    edits = explode_rows(d, all_edits, ["path"], value="e").select("path", "e.*")
    return d, edits


def q_apply_edits(spark, sf_dir):
    """L1 + L3 + L4 + A3: all edits of a file in one pass; a file with a miss
    keeps its text (permissive)."""
    d, edits = document_edits(spark, sf_dir)
    preview, _ = apply_edits(d, edits)
    return preview_summary(preview, key="path")


def q_unresolved_edits(spark, sf_dir):
    """The edits that could not be placed."""
    d, edits = document_edits(spark, sf_dir)
    _, misses = apply_edits(d, edits)
    return misses


def q_insert_at(spark, sf_dir):
    """L1 alone: one inline insert per document at (2, 3)."""
    d, edits = document_edits(spark, sf_dir)
    preview, _ = apply_edits(d, edits.where(F.col("identifier") == "b"))
    return preview.select("path", "n_applied", "n_missed", F.md5("after").alias("after_md5"))


def q_replace_comment(spark, sf_dir):
    """L2: the first line is treated as the comment of the second and replaced
    (English, German) or only removed (other languages)."""
    d = documents_source(spark, sf_dir)
    e = d.select("path", F.lit(1).alias("line"), F.lit(0).alias("from_line"), F.lit("x").alias("identifier"),
                 F.when(F.col("language").isin("en", "de"),
                        F.concat(F.lit("// replaced in "), F.col("path"))).otherwise(F.lit("")).alias("text"))
    out = replace_comments(d, e)
    return out.select("path", F.md5("after").alias("after_md5"),
                      F.size(F.split("after", "\n")).cast("bigint").alias("n_lines"))


QUERIES = {
    "shrink_pages": q_shrink_pages,
    "shrink_trace": q_shrink_trace,
    "over_budget": q_over_budget,
    "shrink_best_effort": q_shrink_best_effort,
    "apply_edits": q_apply_edits,
    "unresolved_edits": q_unresolved_edits,
    "insert_at": q_insert_at,
    "replace_comment": q_replace_comment,
}

# ---- oracle SQL -----------------------------------------------------------

_SHRUNK = f"""s0 AS (SELECT page_id, html AS t0 FROM pages),
s1 AS (SELECT *, regexp_replace(t0, '(?s)<!--.*?-->', '', 'g') AS t1 FROM s0),
s2 AS (SELECT *, regexp_replace(t1, '(?is)<script[^>]*>.*?</script>', '', 'g') AS t2 FROM s1),
s3 AS (SELECT *, regexp_replace(t2, '(?is)<style[^>]*>.*?</style>', '', 'g') AS t3 FROM s2),
s4 AS (SELECT *, regexp_replace(t3, '<[^>]*>', '', 'g') AS t4 FROM s3),
n AS (SELECT *, {S.n_tokens('t0')} AS n0, {S.n_tokens('t1')} AS n1, {S.n_tokens('t2')} AS n2,
             {S.n_tokens('t3')} AS n3, {S.n_tokens('t4')} AS n4 FROM s4),
r AS (SELECT *, CASE WHEN n0 <= {PAGE_LIMIT} OR length(t0) = 0 THEN 0 WHEN n1 <= {PAGE_LIMIT} THEN 1
                     WHEN n2 <= {PAGE_LIMIT} THEN 2 WHEN n3 <= {PAGE_LIMIT} THEN 3 ELSE 4 END AS rung FROM n),
f AS (SELECT *, [n0, n1, n2, n3, n4][rung + 1] AS tokens, [t0, t1, t2, t3, t4][rung + 1] AS tl FROM r)"""

_NOISY = f"""noisy AS (
  SELECT conv_id, ' ' || chr(9) || '"' ||
         replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), ', ', ',   ') || '"' || chr(10) || ' ' AS t0
  FROM conversations GROUP BY conv_id),
s1 AS (SELECT *, {S.trim_ws("regexp_replace(t0, '(?m)^\\s*[\\r\\n]+', '', 'g')")} AS t1 FROM noisy),
s2 AS (SELECT *, {S.reflow('t1')} AS t2 FROM s1),
s3 AS (SELECT *, array_to_string(list_filter(string_split(t2, ' '), lambda w: length(w) > 4), ' ') AS t3 FROM s2),
n AS (SELECT *, {S.n_tokens('t0')} AS n0, {S.n_tokens('t1')} AS n1, {S.n_tokens('t2')} AS n2,
             {S.n_tokens('t3')} AS n3 FROM s3),
r AS (SELECT *, CASE WHEN n0 <= {NOISY_LIMIT} OR length(t0) = 0 THEN 0 WHEN n1 <= {NOISY_LIMIT} THEN 1
                     WHEN n2 <= {NOISY_LIMIT} THEN 2 ELSE 3 END AS rung FROM n)"""

_EDITS = """d AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang, text,
                string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT *, len(ls) > 2 AND 3 <= length(ls[3]) AS b_ok, lang = 'fr' AS has_c FROM d),
m AS (SELECT *, CAST((CASE WHEN b_ok THEN 0 ELSE 1 END) + (CASE WHEN has_c THEN 1 ELSE 0 END) AS INTEGER) AS n_missed,
             CAST(CASE WHEN b_ok AND NOT has_c THEN 2 ELSE 0 END AS INTEGER) AS n_applied FROM e),
p AS (SELECT *, CASE WHEN n_missed > 0 THEN text ELSE
          array_to_string(list_transform(ls, lambda l, i: CASE
              WHEN i = 1 THEN '// head of ' || path || chr(10) || regexp_extract(l, '^\\s*') || l
              WHEN i = 3 THEN substr(l, 1, 3) || '<<x>>' || substr(l, 4)
              ELSE l END), chr(10)) END AS after FROM m)"""

ORACLE = {
    "shrink_pages": "WITH " + _SHRUNK + f"""
SELECT page_id, rung, n0 AS tokens_in, tokens, tokens <= {PAGE_LIMIT} OR rung = 0 AS fits,
       md5(CASE WHEN tokens <= {PAGE_LIMIT} OR rung = 0 THEN tl END) AS text_md5 FROM f""",
    "shrink_trace": "WITH " + _SHRUNK + """,
steps AS (SELECT page_id, rung AS final, unnest([1, 2, 3, 4]) AS step,
                 unnest(['comments', 'scripts', 'styles', 'tags']) AS rung,
                 unnest([n0, n1, n2, n3]) AS tokens_in, unnest([n1, n2, n3, n4]) AS tokens_out FROM f)
SELECT page_id, step, rung, tokens_in, tokens_out FROM steps WHERE step <= final""",
    "over_budget": "WITH " + _SHRUNK + f"""
SELECT page_id, tokens, 'shrunk text exceeds {PAGE_LIMIT} tokens (' || CAST(tokens AS VARCHAR) || ' tokens)' AS error
FROM f WHERE NOT (tokens <= {PAGE_LIMIT} OR rung = 0)""",
    "shrink_best_effort": "WITH " + _NOISY + f""",
f AS (SELECT *, [n0, n1, n2, n3][rung + 1] AS tokens, [t0, t1, t2, t3][rung + 1] AS tl FROM r)
SELECT conv_id, rung, n0 AS tokens_in, tokens, tokens <= {NOISY_LIMIT} OR rung = 0 AS fits, md5(tl) AS text_md5 FROM f""",
    "apply_edits": "WITH " + _EDITS + """
SELECT path, CAST(length(text) AS BIGINT) AS before_chars, CAST(length(after) AS BIGINT) AS after_chars,
       text <> after AS changed, n_applied, n_missed, md5(after) AS after_md5 FROM p""",
    "unresolved_edits": "WITH " + _EDITS + """
SELECT path, 2 AS line, 3 AS col, 'b' AS identifier, 'position out of range' AS error FROM m WHERE NOT b_ok
UNION ALL
SELECT path, 99999, 0, 'c', 'position out of range' FROM m WHERE has_c""",
    "insert_at": "WITH " + _EDITS + """
SELECT path, CAST(CASE WHEN b_ok THEN 1 ELSE 0 END AS INTEGER) AS n_applied,
       CAST(CASE WHEN b_ok THEN 0 ELSE 1 END AS INTEGER) AS n_missed,
       md5(CASE WHEN b_ok THEN array_to_string(list_transform(ls, lambda l, i: CASE
              WHEN i = 3 THEN substr(l, 1, 3) || '<<x>>' || substr(l, 4) ELSE l END), chr(10)) ELSE text END) AS after_md5
FROM e""",
    "replace_comment": """WITH d AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang, string_split(text, chr(10)) AS ls
  FROM documents),
r AS (SELECT path, array_to_string(flatten(list_transform(ls, lambda l, i: CASE
          WHEN i = 1 THEN []::VARCHAR[]
          WHEN i = 2 THEN list_concat(
            CASE WHEN lang IN ('en', 'de') THEN [regexp_extract(l, '^[ \\t]*') || '// replaced in ' || path] ELSE [] END,
            [l], CASE WHEN len(ls) > 2 AND regexp_matches(ls[3], '\\S') THEN [''] ELSE [] END)
          ELSE [l] END)), chr(10)) AS after FROM d)
SELECT path, md5(after) AS after_md5, CAST(len(string_split(after, chr(10))) AS BIGINT) AS n_lines FROM r""",
}
