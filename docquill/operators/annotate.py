"""Prompts, the model call, and grouping of results per file.

The model call is the one Python stage of the engine: ``mapInPandas`` over
Arrow batches, a small thread pool per batch, a deadline per call, and
row-level error capture so one failing unit never fails the job. A retried
task calls the provider again, so providers should be idempotent.
"""

from __future__ import annotations

import math
import queue
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.functions._util import col_of, explode_rows
from docquill.functions.identifiers import short_name, target_phrase
from docquill.functions.text import clean_answer, with_footer
from docquill.session import ensure_checkpoint_dir, ship_package

# Our own instruction text. Placeholders: {target} {name} {path} {code}.
PROMPT_TEMPLATES = {
    "go": (
        "Write a documentation comment for {target}.\n"
        "Say what {name} does for the caller, not what it is, in plain sentences.\n"
        "Refer to other types in square brackets.\n"
        "Start the comment with \"{name} \" and keep it short.\n"
        "Answer with the comment text only: no markers, links, code or examples.\n"
        "\n"
        "File: {path}\n"
        "---\n"
        "{code}"
    ),
}
_TS_HEAD = "Write a TSDoc comment for {target}.\n"
_TS_TAIL = (
    "Keep it short and leave out tags, links, code and examples.\n"
    "Answer with the comment text only: no markers.\n"
    "\n"
    "File: {path}\n"
    "---\n"
    "{code}"
)
_TS_BODY = {
    "ts": "Say what {name} stands for, in plain sentences.\n",
    "ts:func": "Say what {name} does for the caller, not that it is a function, in plain sentences.\n",
    "ts:method": "Say what {name} does for users of its owner, in plain sentences.\n",
    "ts:prop": "Say what {name} holds and who uses it, in plain sentences.\n",
}
PROMPT_TEMPLATES.update({key: _TS_HEAD + body + _TS_TAIL for key, body in _TS_BODY.items()})
CODE_MARKER = "\n---\n"

# Sampling parameters of every request; the chat path has no top_p.
REQUEST_PARAMS = {"temperature": 0.618, "top_p": 0.3, "presence_penalty": 0.2, "frequency_penalty": 0.3}
CALL_TIMEOUT_S = 30.0


def _render(template: str, slots: dict[str, Column]) -> Column:
    """Template text with ``{slot}`` markers as one ``concat``."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i) if i >= 0 else -1
        if i < 0 or j < 0 or rest[i + 1:j] not in slots:
            parts.append(F.lit(rest))
            break
        if i > 0:
            parts.append(F.lit(rest[:i]))
        parts.append(slots[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


def build_prompt(identifier, language, path, code, templates: dict[str, str] | None = None) -> Column:
    """The instruction text for one unit. The template is picked by
    ``language:kind``, then by language (a CASE over a handful of literals);
    ``go`` is the fallback."""
    templates = templates or PROMPT_TEMPLATES
    identifier, language = col_of(identifier), col_of(language)
    slots = {
        "target": target_phrase(identifier, language),
        "name": short_name(identifier),
        "path": col_of(path),
        "code": F.coalesce(col_of(code), F.lit("")),
    }
    kind = F.split_part(identifier, F.lit(":"), F.lit(1))
    fallback = _render(templates.get("go", next(iter(templates.values()))), slots)
    expr = None
    for key in sorted(templates, key=lambda k: ":" not in k):       # the special ones first
        lang, _, of_kind = key.partition(":")
        fits = (language == lang) & (kind == of_kind) if of_kind else language == lang
        rendered = _render(templates[key], slots)
        expr = F.when(fits, rendered) if expr is None else expr.when(fits, rendered)
    return fallback if expr is None else expr.otherwise(fallback)


def route_model(model) -> Column:
    """K3: ``gpt-`` models use the chat path."""
    return col_of(model).startswith("gpt-")


@dataclass
class Answer:
    text: str | None
    finish_reason: str = "stop"
    role: str = "assistant"
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Provider:
    """K1 extension point: one call per unit. Must be picklable."""

    def complete(self, prompt: str, model: str, max_tokens: int, params: dict) -> Answer:
        raise NotImplementedError


@dataclass
class WordSpanProvider(Provider):
    """Deterministic local provider whose answer depends on the whole code
    section: its first word, its last word and its word count, wrapped in
    white space and quotes."""

    def complete(self, prompt, model, max_tokens, params):
        code = prompt.split(CODE_MARKER, 1)[1] if CODE_MARKER in prompt else prompt
        ws = code.split()
        body = f"{ws[0]} ... {ws[-1]} ({len(ws)} words)" if ws else "(0 words)"
        return Answer(text=' "' + body + '"\n', prompt_tokens=len(prompt.split()),
                      completion_tokens=len(body.split()))


ANSWER_SCHEMA = ("answer string, finish_reason string, prompt_tokens bigint, "
                 "completion_tokens bigint, total_tokens bigint, error string")


def _validate(ans: Answer | None, is_chat: bool) -> str | None:
    """K4: an empty answer, or a chat answer not from the assistant, is an error."""
    if ans is None or ans.text is None:
        return "empty answer"
    if is_chat and ans.role != "assistant":
        return f"unexpected message role in answer: {ans.role!r}"
    return None


def call_all(requests: list, fn, threads: int, timeout_s: float, late) -> list:
    """K5/K6: ``fn`` of every request, ``threads`` at a time; ``late`` for a call
    that has run for ``timeout_s``. Daemon threads take one request after the
    other, so nothing waits in a queue with its clock running."""
    results, state = [None] * len(requests), threading.Lock()
    done, running, todo = queue.SimpleQueue(), {}, iter(range(len(requests)))

    def worker(me):
        while True:
            with state:
                k = next(todo, None) if me in running else None
                if k is None:
                    return
                running[me] = (k, time.monotonic() + timeout_s)
            answer = fn(requests[k])
            done.put((me, k, answer))

    def start():
        me = object()
        running[me] = (None, math.inf)
        threading.Thread(target=worker, args=(me,), daemon=True).start()

    with state:
        for _ in range(min(threads, len(requests))):
            start()
    left = len(requests)
    while left:
        with state:
            first = min((end for _, end in running.values()), default=math.inf)
        try:
            me, k, answer = done.get(timeout=max(0.0, min(first - time.monotonic(), 1.0)))
            with state:
                if me in running and running[me][0] == k:
                    running[me] = (None, math.inf)
            if results[k] is None:
                results[k] = answer
                left -= 1
        except queue.Empty:
            with state:
                for me, (k, end) in list(running.items()):
                    if end <= time.monotonic() and done.empty():
                        del running[me]
                        results[k] = late
                        left -= 1
                        start()
    return results


def annotate(requests: DataFrame, provider: Provider, *, keep: list[str] | None = None,
             prompt_col: str = "prompt", model_col: str = "model", budget_col: str = "max_tokens",
             threads: int = 2, timeout_s: float = CALL_TIMEOUT_S, partitions: int | None = None,
             durable: bool = False) -> DataFrame:
    """K1 (with K2-K6): call ``provider`` once per request row.

    Output: ``keep`` columns + ``ANSWER_SCHEMA``. Failures (exceptions,
    deadline, invalid answers) fill ``error`` and leave ``answer`` NULL.
    A request without completion budget is an error; the provider is not called.
    ``threads`` calls of a task run at once. The clock of ``timeout_s`` starts
    with the call; a call that passes it is left alone and its thread replaced,
    so it holds up neither other calls nor the end of the task.
    ``partitions`` optionally spreads requests by path and identifier first
    (K5), so that one large file's units run in many tasks.

    ``durable=True`` materialises the answers with a reliable ``checkpoint``
    in the session's ``spark.checkpoint.dir``: later stages, retries after a
    lost executor, and several outputs read the saved answers instead of
    calling the provider again. Without it, Spark recomputes lost partitions and
    calls the provider again for their units, and so does every further output.
    """
    keep = list(keep or ["path", "identifier"])
    cols = keep + [prompt_col, model_col, budget_col]
    req = requests.select(*[F.col(c) for c in dict.fromkeys(cols)],
                          F.coalesce(route_model(model_col), F.lit(False)).alias("_chat"))
    if partitions:
        by = [c for c in ("path", "identifier") if c in keep]
        req = req.repartition(partitions, *by) if by else req.repartition(partitions)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in req.schema.fields if f.name in keep)
    out_schema = out_schema + ", " + ANSWER_SCHEMA
    threads = max(1, int(threads))

    def call(prompt, model, budget, is_chat):
        if budget is None or pd.isna(budget) or budget <= 0:
            raise ValueError("completion budget is 0: the prompt fills the context")
        params = {k: v for k, v in REQUEST_PARAMS.items() if not (is_chat and k == "top_p")}
        ans = provider.complete(prompt, model, int(budget), params)
        err = _validate(ans, is_chat)
        if err:
            raise ValueError(err)
        return ans

    def one(request):
        try:
            a = call(*request)
            return (a.text, a.finish_reason, a.prompt_tokens, a.completion_tokens,
                    a.prompt_tokens + a.completion_tokens, None)
        except Exception as exc:  # one unit's failure never stops the others
            return (None, None, None, None, None, f"{type(exc).__name__}: {exc}")

    late = (None, None, None, None, None, f"deadline of {timeout_s:g}s exceeded")

    def frame(pdf: pd.DataFrame, rows: list) -> pd.DataFrame:
        res = pd.DataFrame(rows, columns=["answer", "finish_reason", "prompt_tokens",
                                          "completion_tokens", "total_tokens", "error"])
        for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
            res[c] = res[c].astype("Int64")
        return pd.concat([pdf[keep].reset_index(drop=True), res], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            requests_ = list(zip(pdf[prompt_col], pdf[model_col], pdf[budget_col], pdf["_chat"]))
            yield frame(pdf, call_all(requests_, one, threads, timeout_s, late))

    ship_package(requests.sparkSession)
    out = req.mapInPandas(run, out_schema)
    if durable:
        ensure_checkpoint_dir(requests.sparkSession)
        out = out.checkpoint(eager=True)
    return out


def finish_docs(results: DataFrame, footer: str | None = None) -> DataFrame:
    """Clean the answer (I1) and append the footer (I2) on successful rows."""
    return results.withColumn(
        "text", F.when(F.col("error").isNull(), with_footer(clean_answer(F.col("answer")), footer)))


def dead_letter(df: DataFrame) -> DataFrame:
    """A5: rows that carry an error."""
    return df.where(F.col("error").isNotNull())


def group_docs(docs: DataFrame, key: str = "path") -> DataFrame:
    """Successful docs per file, sorted by identifier; a file whose units
    all failed still appears, with an empty list."""
    return docs.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("error").isNull(),
                                           F.struct("identifier", "text")))).alias("docs"),
        F.count(F.lit(1)).alias("n_units"),
        F.count("error").alias("n_failed"),
    )


def group_inputs(inputs: DataFrame, key: str = "path", fields: list[str] | None = None) -> DataFrame:
    """Inputs per file as a sorted list of structs led by the identifier."""
    fields = fields or ["identifier"]
    return inputs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("inputs"))


def flatten_docs(files: DataFrame, key: str = "path", list_col: str = "docs") -> DataFrame:
    """All docs of all files, one row each."""
    return explode_rows(files, F.col(list_col), [key], value="_d").select(key, "_d.*")


def usage_totals(responses: DataFrame, by: str = "model") -> DataFrame:
    """E5: prompt, completion and total tokens per model (map-side partial sums)."""
    return responses.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count("error").alias("n_errors"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("bigint").alias("completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
    )
