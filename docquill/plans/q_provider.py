"""Queries: what a provider is sent, what is made of its answers, and answers that are kept."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from docquill.functions.tokens import token_count
from docquill.operators.annotate import REQUEST_PARAMS, Answer, Provider, WordSpanProvider, annotate
from docquill.operators.answers import AnswerStore
from docquill.operators.budget import MODEL_LIMITS, attach_model, completion_budget
from docquill.plans import sqlgen as S
from docquill.session import ensure_checkpoint_dir
from docquill.sources.tables import load

MODELS = ["gpt-4", "text-davinci-003", "gpt-3.5-turbo"]
DEADLINE_S = 4.0


@dataclass
class EchoProvider(Provider):
    """Answers with the request; by the prompt's last word it returns no choice,
    another role, nothing in time, or fails."""

    def complete(self, prompt, model, max_tokens, params):
        what = prompt.rsplit(" ", 1)[1]
        if what == "none":
            return Answer(text=None)
        if what == "fails":
            raise RuntimeError("no service")
        if what == "late":
            time.sleep(10 * DEADLINE_S)
        sent = f"{model} {max_tokens} {json.dumps(params, sort_keys=True)}"
        return Answer(text=sent, role="user" if what == "role" else "assistant", prompt_tokens=1, completion_tokens=2)


def _requests(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("doc_id")
    what = (F.when(n % 2000 == 7, "late").when(n % 7 == 1, "none").when(n % 7 == 2, "role").when(n % 7 == 3, "fails").otherwise("ok"))
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (n % 3).cast("int"))
    d = attach_model(d.select("doc_id", F.concat("text", F.lit(" "), what).alias("prompt"), model.alias("model")))
    return d.withColumn("max_tokens", completion_budget(token_count("prompt"), "ctx_tokens"))


def q_provider_requests(spark, sf_dir):
    """K2-K6: parameters by path, routing, checks of answers, calls side by side, deadline."""
    got = annotate(_requests(spark, sf_dir), EchoProvider(), keep=["doc_id", "model"], threads=4, timeout_s=DEADLINE_S)
    return got.select("doc_id", "model", "answer", "error")


def q_annotate_again(spark, sf_dir):
    """K1: all documents annotated, a tenth of them changed, annotated again:
    the run that called for each answer of the second pass."""
    store = AnswerStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/docquill-answers-{uuid.uuid4().hex}")
    d = load(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("prompt"), F.lit("gpt-4").alias("model"), F.lit(64).alias("max_tokens"))
    store.annotate(d, WordSpanProvider(), keep=["doc_id"], run="1")
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("prompt", F.lit(" changed"))).otherwise(F.col("prompt"))
    again = store.annotate(d.withColumn("prompt", changed), WordSpanProvider(), keep=["doc_id"], run="2")
    return again.select("doc_id", "run", F.md5("answer").alias("answer_md5"))


QUERIES = {"provider_requests": q_provider_requests, "annotate_again": q_annotate_again}

_LIMIT = dict(MODEL_LIMITS)
_CTX = " ".join(f"WHEN {k} THEN {_LIMIT.get(m, _LIMIT['default'])}" for k, m in enumerate(MODELS))
_NAME = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODELS))
_ALL = json.dumps(REQUEST_PARAMS, sort_keys=True)
_CHAT = json.dumps({k: v for k, v in REQUEST_PARAMS.items() if k != "top_p"}, sort_keys=True)

ORACLE = {
    "provider_requests": f"""
WITH d AS (
  SELECT doc_id, CASE doc_id % 3 {_NAME} END AS model, CASE doc_id % 3 {_CTX} END AS ctx,
         {S.n_tokens("coalesce(text, '')")} + 1 AS n,
         CASE WHEN doc_id % 2000 = 7 THEN 'late' WHEN doc_id % 7 = 1 THEN 'none' WHEN doc_id % 7 = 2 THEN 'role'
              WHEN doc_id % 7 = 3 THEN 'fails' ELSE 'ok' END AS what
  FROM documents),
e AS (
  SELECT *, greatest(0, least(512, ctx, ctx - n)) AS budget, model LIKE 'gpt-%' AS chat FROM d),
f AS (
  SELECT *, CASE WHEN budget = 0 THEN 'ValueError: completion budget is 0: the prompt fills the context'
                 WHEN what = 'late' THEN 'deadline of {DEADLINE_S:g}s exceeded' WHEN what = 'none' THEN 'ValueError: empty answer'
                 WHEN what = 'fails' THEN 'RuntimeError: no service'
                 WHEN what = 'role' AND chat THEN 'ValueError: unexpected message role in answer: ''user''' END AS error
  FROM e)
SELECT doc_id, model, CASE WHEN error IS NULL THEN model || ' ' || budget || ' ' || CASE WHEN chat THEN '{_CHAT}' ELSE '{_ALL}' END END AS answer,
       error FROM f""",
    "annotate_again": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS p FROM documents),
again AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN p || ' changed' ELSE p END AS p FROM d),
w AS (SELECT *, regexp_extract_all(p, '\\S+') AS ws FROM again)
SELECT doc_id, CASE WHEN p IN (SELECT p FROM d) THEN '1' ELSE '2' END AS run,
       md5(' "' || CASE WHEN len(ws) > 0 THEN ws[1] || ' ... ' || ws[-1] || ' (' || len(ws) || ' words)' ELSE '(0 words)' END
           || '"' || chr(10)) AS answer_md5
FROM w""",
}
