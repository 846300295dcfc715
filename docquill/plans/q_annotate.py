"""Queries: the annotation pipeline on documents, and the text, token and
budget operators it is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions import text as T
from docquill.functions._util import explode_rows
from docquill.functions.tokens import token_count
from docquill.operators.annotate import (PROMPT_TEMPLATES, WordSpanProvider, annotate, build_prompt,
                                         dead_letter, finish_docs, group_docs, usage_totals)
from docquill.operators.budget import attach_model, chat_tokens, completion_budget
from docquill.operators.patch import apply_edits
from docquill.plans import sqlgen as S
from docquill.sources.tables import documents_source, load

MODEL = "gpt-3.5-turbo"
FOOTER = "Generated from the corpus."


def _paragraph_units(src: DataFrame) -> DataFrame:
    """One unit per line of a document: ``para:<line>``, its own text as code."""
    u = explode_rows(src, F.split("text", "\n"), ["doc_id", "path"], pos="line", value="para")
    return u.withColumn("identifier", F.concat(F.lit("para:"), F.col("line")))


def annotation_results(spark: SparkSession, sf_dir: str, model: str = MODEL, src: DataFrame | None = None) -> DataFrame:
    """Units -> prompt -> token count -> budget -> provider -> cleaned doc."""
    src = documents_source(spark, sf_dir) if src is None else src
    units = _paragraph_units(src)
    req = units.withColumn("prompt", build_prompt("identifier", F.lit("go"), "path", "para"))
    req = attach_model(req.withColumn("model", F.lit(model)))
    req = req.withColumn("max_tokens", completion_budget(token_count("prompt"), "ctx_tokens"))
    res = annotate(req, WordSpanProvider(),
                   keep=["doc_id", "path", "identifier", "line", "model"], threads=1)
    return finish_docs(res)


def patch_summary(src: DataFrame, docs: DataFrame) -> DataFrame:
    """Insert each successful answer as a ``//`` comment above its paragraph
    and summarise each document (counts and a digest of the new text)."""
    edits = docs.select("path", "line", F.lit(0).alias("col"), "identifier", "error",
                        F.when(F.col("error").isNull(),
                               F.concat(T.line_comment("text"), F.lit("\n"))).alias("text"))
    preview, _ = apply_edits(src, edits)
    return preview.select(
        "doc_id",
        F.col("n_units").cast("bigint").alias("n_units"),
        F.col("n_failed").cast("bigint").alias("n_failed"),
        F.col("n_applied").cast("bigint").alias("n_applied"),
        (F.col("before") != F.col("after")).alias("changed"),
        F.octet_length("after").cast("bigint").alias("after_bytes"),
        F.md5("after").alias("after_md5"),
    )


def q_annotate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: annotate every paragraph of every document and insert the
    answers as ``//`` comments above their paragraphs; one summary row per
    document (the full patched text is represented by its digest). Both
    branches read the same spread source, so its exchange is shared."""
    src = documents_source(spark, sf_dir).select("doc_id", "path", "text")
    return patch_summary(src, annotation_results(spark, sf_dir, src=src))


def q_annotate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the dead-letter rows of the annotation run."""
    docs = annotation_results(spark, sf_dir)
    return dead_letter(docs).select("doc_id", "line", "identifier", "error")


def q_annotate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + I1 + I2: every unit's cleaned answer with the footer (digest)."""
    docs = annotation_results(spark, sf_dir)
    return docs.where(F.col("error").isNull()).select(
        "doc_id", "line", F.md5(T.with_footer(F.col("text"), FOOTER)).alias("doc_md5"),
        F.col("prompt_tokens"), F.col("completion_tokens"))


def q_group_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful docs per file in identifier order (digest), with the
    unit and failure counts; files whose units all failed keep a row."""
    g = group_docs(annotation_results(spark, sf_dir))
    listing = F.array_join(F.transform("docs", lambda d: F.concat(d["identifier"], F.lit("="), d["text"])), "\n")
    return g.select("path", F.size("docs").cast("bigint").alias("n_docs"), "n_units", "n_failed",
                    F.md5(listing).alias("docs_md5"))


def q_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: tokens used per model."""
    return usage_totals(annotation_results(spark, sf_dir))


# ---- text clean-up on the noisy view ---------------------------------------

def noisy_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in order, joined by a blank line, with widened
    commas, outer white space and quotes. Grouping is per conversation (a
    handful of turns), so no group outgrows one conversation."""
    c = load(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return g.select("conv_id", T.noisy_text(F.transform("turns", lambda t: t["text"])).alias("noisy"))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, I2, I3, I12 on the noisy view (digests of each result)."""
    n = noisy_conversations(spark, sf_dir)
    return n.select(
        "conv_id",
        F.md5("noisy").alias("noisy_md5"),
        F.md5(T.clean_answer("noisy")).alias("clean_md5"),
        F.md5(T.drop_empty_lines("noisy")).alias("no_blank_md5"),
        F.md5(T.reflow("noisy")).alias("reflow_md5"),
        F.md5(T.with_footer(T.clean_answer("noisy"), FOOTER)).alias("footer_md5"),
    )


def q_wrap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 at width 77 and I6 on whole documents."""
    d = load(spark, sf_dir, "documents")
    w = T.wrap_lines("text", 77)
    return d.select("doc_id", F.size(w).cast("bigint").alias("n_lines"),
                    F.md5(F.array_join(w, "\n")).alias("wrap77_md5"),
                    F.md5(T.line_comment("text")).alias("line_comment_md5"))


def q_wrap_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 at width 20 and I5 at 40 on the noisy view (over-long words)."""
    n = noisy_conversations(spark, sf_dir)
    return n.select("conv_id", F.md5(T.wrap("noisy", 20)).alias("wrap20_md5"),
                    F.md5(T.wrap_paragraphs(T.reflow("noisy"), 40)).alias("wrap_paragraphs_md5"))


def q_comment_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7, I8, I9, I10 on all turns wrapped as generated comments."""
    c = load(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("/**\n * "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n * ")), F.lit("\n */"))
    indented = F.concat(F.lit("\t"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n    ")))
    return c.select("conv_id", "turn",
                    F.md5(T.strip_block_comment(raw)).alias("strip_md5"),
                    F.md5(T.block_comment(raw, 4)).alias("block_md5"),
                    F.md5(T.star_block(T.reflow("text"), 80, True)).alias("star_md5"),
                    F.md5(T.dedent(indented)).alias("dedent_md5"))


# ---- tokens and budgets ---------------------------------------------------

def q_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native token count per document."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", token_count("text").alias("tokens"), F.octet_length("text").cast("bigint").alias("bytes"))


def q_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat prompt tokens per conversation for gpt-4 (system turns named)."""
    c = load(spark, sf_dir, "conversations").withColumn(
        "name", F.when(F.col("role") == "system", F.lit("sys")))
    return chat_tokens(c, "gpt-4", name="name")


# Models assigned by language for the budget queries (one unknown model).
LANG_MODELS = [("en", "gpt-4"), ("de", "gpt-3.5-turbo"), ("es", "gpt-3.5-turbo-16k"), ("fr", "text-davinci-003")]


def q_completion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 + J2: context by model (unknown -> default), budget per document."""
    d = load(spark, sf_dir, "documents")
    lm = spark.createDataFrame(LANG_MODELS, "lang string, model string")
    r = d.join(F.broadcast(lm), "lang", "left")
    r = attach_model(r)
    pt = token_count("text")
    return r.select("doc_id", "model", F.col("ctx_tokens").cast("int").alias("ctx_tokens"),
                    pt.alias("prompt_tokens"), completion_budget(pt, "ctx_tokens", 512).alias("max_tokens"))


def q_model_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: documents per (model, context size) incl. the default fallback."""
    b = q_completion_budget(spark, sf_dir)
    return b.groupBy("model", "ctx_tokens").agg(F.count(F.lit(1)).alias("n_docs"),
                                                F.sum(F.when(F.col("max_tokens") == 0, 1).otherwise(0))
                                                .cast("bigint").alias("n_zero_budget"))


def _as_documents_source(batch: DataFrame) -> DataFrame:
    return batch.select("doc_id", F.format_string("%s/%d.txt", "source", "doc_id").alias("path"),
                        F.col("lang").alias("language"), "text")


def q_annotate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the flagship as a stream over the documents file (available-now
    trigger); returns what the stream wrote. Same results as the batch job."""
    from docquill.streaming.stream import annotate_stream, stream_workdir
    out, ckpt = stream_workdir(spark, "annotate-stream")
    annotate_stream(
        spark, f"{sf_dir.rstrip('/')}/documents.parquet", out, ckpt,
        annotate_fn=lambda b: annotation_results(spark, sf_dir, src=_as_documents_source(b)),
        finish_fn=lambda b, docs: patch_summary(_as_documents_source(b), docs), key="doc_id")
    return spark.read.parquet(f"{out}/ok").drop("batch_id")


QUERIES = {
    "annotate_documents": q_annotate_documents,
    "annotate_stream": q_annotate_stream,
    "annotate_errors": q_annotate_errors,
    "annotate_docs": q_annotate_docs,
    "group_docs": q_group_docs,
    "usage_totals": q_usage_totals,
    "clean_text": q_clean_text,
    "wrap_documents": q_wrap_documents,
    "wrap_noisy": q_wrap_noisy,
    "comment_styles": q_comment_styles,
    "token_count": q_token_count,
    "chat_tokens": q_chat_tokens,
    "completion_budget": q_completion_budget,
    "model_default": q_model_default,
}


# ---- oracle SQL -----------------------------------------------------------

def _prompt_sql() -> str:
    return S.render(PROMPT_TEMPLATES["go"], {
        "target": "'\"para:' || CAST(line AS VARCHAR) || '\"'",
        "name": "CAST(line AS VARCHAR)",
        "path": "path",
        "code": "para",
    })


_ERR = "ValueError: completion budget is 0: the prompt fills the context"


def _annotation_sql() -> str:
    return f"""
src AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents),
units0 AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS para,
                  unnest(range(len(string_split(text, chr(10))))) AS line0 FROM src),
units AS (SELECT doc_id, path, para, CAST(line0 AS INTEGER) AS line FROM units0),
req AS (SELECT *, {_prompt_sql()} AS prompt FROM units),
bud AS (SELECT *, greatest(0, least(512, 4096, 4096 - {S.n_tokens('prompt')})) AS max_tokens FROM req),
ans AS (SELECT *, CASE WHEN max_tokens > 0 THEN regexp_extract_all(para, '\\S+') END AS ws
        FROM bud),
spans AS (SELECT *, CASE WHEN len(ws) > 0 THEN ws[1] || ' ... ' || ws[-1] || ' (' || len(ws) || ' words)'
                         ELSE '(0 words)' END AS body FROM ans),
docs AS (SELECT *, CASE WHEN ws IS NOT NULL THEN {S.clean("' \"' || body || '\"' || chr(10)")} END AS doc,
                CASE WHEN ws IS NOT NULL THEN {S.n_tokens('prompt')} END AS prompt_tokens,
                CASE WHEN ws IS NOT NULL THEN {S.n_tokens('body')} END AS completion_tokens,
                CASE WHEN ws IS NULL THEN '{_ERR}' END AS error
         FROM spans)"""


def _oracle_annotate_documents() -> str:
    return f"""WITH {_annotation_sql()},
patched AS (
  SELECT doc_id, line, para, error,
         CASE WHEN error IS NULL
              THEN replace({S.line_comment('doc')} || chr(10), chr(10), chr(10) || regexp_extract(para, '^\\s*')) || para
              ELSE para END AS new_line
  FROM docs),
agg AS (
  SELECT p.doc_id, count(*) AS n_units, count(error) AS n_failed,
         string_agg(new_line, chr(10) ORDER BY line) AS after_text
  FROM patched p GROUP BY p.doc_id)
SELECT a.doc_id, CAST(n_units AS BIGINT) AS n_units, CAST(n_failed AS BIGINT) AS n_failed,
       CAST(n_units - n_failed AS BIGINT) AS n_applied, after_text <> d.text AS changed,
       CAST(strlen(after_text) AS BIGINT) AS after_bytes, md5(after_text) AS after_md5
FROM agg a JOIN documents d ON a.doc_id = d.doc_id"""


def _noisy_sql() -> str:
    return """noisy AS (
  SELECT conv_id, ' ' || chr(9) || '"' ||
         replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), ', ', ',   ') || '"' || chr(10) || ' ' AS noisy
  FROM conversations GROUP BY conv_id)"""


def _n_zero(expr: str) -> str:
    return expr


ORACLE = {
    "annotate_documents": _oracle_annotate_documents(),
    "annotate_stream": _oracle_annotate_documents(),
    "annotate_errors": f"WITH {_annotation_sql()} SELECT doc_id, line, 'para:' || CAST(line AS VARCHAR) AS identifier, error FROM docs WHERE error IS NOT NULL",
    "annotate_docs": f"WITH {_annotation_sql()} SELECT doc_id, line, md5(doc || chr(10) || chr(10) || {S.lit(FOOTER)}) AS doc_md5, prompt_tokens, completion_tokens FROM docs WHERE error IS NULL",
    "group_docs": f"""WITH {_annotation_sql()}
SELECT path, CAST(count(doc) AS BIGINT) AS n_docs, count(*) AS n_units, count(error) AS n_failed,
       md5(coalesce(string_agg('para:' || CAST(line AS VARCHAR) || '=' || doc, chr(10)
                              ORDER BY 'para:' || CAST(line AS VARCHAR)) FILTER (WHERE doc IS NOT NULL), '')) AS docs_md5
FROM docs GROUP BY path""",
    "usage_totals": f"""WITH {_annotation_sql()}
SELECT '{MODEL}' AS model, count(*) AS n_calls, count(error) AS n_errors,
       CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
       CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens
FROM docs""",
    "clean_text": f"""WITH {_noisy_sql()}
SELECT conv_id, md5(noisy) AS noisy_md5, md5({S.clean('noisy')}) AS clean_md5,
       md5({S.trim_ws("regexp_replace(noisy, '(?m)^\\s*[\\r\\n]+', '', 'g')")}) AS no_blank_md5,
       md5({S.reflow('noisy')}) AS reflow_md5,
       md5({S.clean('noisy')} || chr(10) || chr(10) || {S.lit(FOOTER)}) AS footer_md5
FROM noisy""",
    "wrap_documents": f"""SELECT doc_id, CAST(len(string_split({S.wrap('text', 77)}, chr(10))) AS BIGINT) AS n_lines,
       md5({S.wrap('text', 77)}) AS wrap77_md5, md5({S.line_comment('text')}) AS line_comment_md5
FROM documents""",
    "wrap_noisy": f"""WITH {_noisy_sql()}
SELECT conv_id, md5({S.wrap('noisy', 20)}) AS wrap20_md5,
       md5({S.wrap_paragraphs(S.reflow('noisy'), 40)}) AS wrap_paragraphs_md5
FROM noisy""",
    "token_count": f"SELECT doc_id, {S.n_tokens('text')} AS tokens, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "chat_tokens": f"""SELECT conv_id, count(*) AS n_messages,
       CAST(4 + sum(3 + {S.n_tokens('text')} + CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS prompt_tokens
FROM conversations GROUP BY conv_id""",
}

_STRIPPED = f"""{S.reflow(S.trim_ws("array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(" + S.trim_ws('raw') + ", '^/[*][*]', ''), '[*]/$', ''), '*/', '*' || chr(92) || '/'), chr(10)), lambda l: regexp_replace(l, '^[ \\t\\n\\f\\r][*][ \\t\\n\\f\\r]?', '')), lambda l: NOT starts_with(l, '@')), chr(10))"))}"""

ORACLE["comment_styles"] = f"""WITH c AS (
  SELECT conv_id, turn, text, '/**' || chr(10) || ' * ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' */' AS raw,
         chr(9) || replace(text, chr(10), chr(10) || '    ') AS indented
  FROM conversations),
s AS (SELECT *, {_STRIPPED} AS stripped FROM c),
w AS (SELECT *, string_split({S.wrap('stripped', 73)}, chr(10)) AS wl FROM s),
d AS (SELECT *, list_transform(string_split(indented, chr(10)),
                 lambda l: replace(regexp_extract(l, '^\\s*'), chr(9), '  ') || substr(l, length(regexp_extract(l, '^\\s*')) + 1)) AS dl
      FROM w),
e AS (SELECT *, list_min(list_transform(list_filter(dl, lambda l: length(trim(l)) > 0),
                 lambda l: length(regexp_extract(l, '^\\s*')))) AS mi FROM d)
SELECT conv_id, turn, md5(stripped) AS strip_md5,
       md5(CASE WHEN len(wl) = 1 THEN '/** ' || {S.trim_ws('wl[1]')} || ' */' || chr(10)
                ELSE '/**' || chr(10) || array_to_string(list_transform(wl, lambda l: ' * ' || l), chr(10)) || chr(10) || ' */' || chr(10) END)
         AS block_md5,
       md5('/**' || chr(10) || array_to_string(list_transform(string_split({S.wrap_paragraphs(S.reflow('text'), 77)}, chr(10)),
           lambda l: ' * ' || l), chr(10)) || chr(10) || ' */') AS star_md5,
       md5(CASE WHEN mi IS NULL THEN '' ELSE {S.trim_ws("array_to_string(list_transform(dl, lambda l: substr(l, mi + 1)), chr(10))")} END)
         AS dedent_md5
FROM e"""

_LM_SQL = ("(VALUES ('en','gpt-4',8192),('de','gpt-3.5-turbo',4096),('es','gpt-3.5-turbo-16k',16384),"
           "('fr','text-davinci-003',2049)) AS lm(lang, model, ctx_tokens)")
ORACLE["completion_budget"] = f"""SELECT doc_id, lm.model, CAST(lm.ctx_tokens AS INTEGER) AS ctx_tokens,
       {S.n_tokens('text')} AS prompt_tokens,
       CAST(greatest(0, least(512, lm.ctx_tokens, lm.ctx_tokens - {S.n_tokens('text')})) AS INTEGER) AS max_tokens
FROM documents d JOIN {_LM_SQL} ON d.lang = lm.lang"""
ORACLE["model_default"] = f"""SELECT model, ctx_tokens, count(*) AS n_docs,
       CAST(sum(CASE WHEN max_tokens = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_budget
FROM ({ORACLE['completion_budget']}) GROUP BY model, ctx_tokens"""
