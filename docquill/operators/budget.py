"""Token budgets: model limits, chat token totals, completion budgets and
shrinking a text through an ordered list of reductions until it fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions import lexer
from docquill.functions._util import bind, col_of, fold
from docquill.functions.tokens import token_count

# Context sizes per model name; unknown models get "default".
MODEL_LIMITS = [
    ("default", 2049),
    ("gpt-4-1106-preview", 128000),
    ("gpt-4-vision-preview", 128000),
    ("gpt-4-32k-0314", 32768),
    ("gpt-4-32k", 32768),
    ("gpt-4-0314", 8192),
    ("gpt-4", 8192),
    ("gpt-3.5-turbo-16k", 16384),
    ("gpt-3.5-turbo-0301", 4096),
    ("gpt-3.5-turbo", 4096),
]
DEFAULT_MAX_TOKENS = 512
DEFAULT_CTX = 2049


def per_name(model: Column) -> Column:
    """Extra tokens for a named chat message: +1 for gpt-4*, -1 for gpt-3.5*."""
    return F.when(model.startswith("gpt-4"), 1).when(model.startswith("gpt-3.5"), -1).otherwise(0)


def models_table(spark: SparkSession) -> DataFrame:
    """Dimension table models(model, ctx_tokens, is_chat, per_name); ten rows."""
    df = spark.createDataFrame(MODEL_LIMITS, "model string, ctx_tokens int")
    return df.select(
        "model", "ctx_tokens",
        F.col("model").startswith("gpt-").alias("is_chat"),
        per_name(F.col("model")).alias("per_name"),
    )


def attach_model(df: DataFrame, models: DataFrame | None = None, model_col: str = "model") -> DataFrame:
    """D3: context size by model name, else the ``default`` row (2049).

    With the built-in table (``models=None``) the lookup is a map literal of
    ten entries: no join at all. A custom ``models`` table is a small
    dimension table; the planner decides how to join it.
    """
    if models is None:
        lookup = F.create_map(*[x for name, ctx in MODEL_LIMITS if name != "default"
                                for x in (F.lit(name), F.lit(ctx))])
        return df.withColumn("ctx_tokens", F.coalesce(F.try_element_at(lookup, col_of(model_col)),
                                                      F.lit(DEFAULT_CTX)))
    default = F.lit(DEFAULT_CTX)
    m = models.where(F.col("model") != "default").select(
        F.col("model").alias("_m_model"), F.col("ctx_tokens").alias("_m_ctx"))
    out = df.join(m, col_of(model_col) == F.col("_m_model"), "left")
    return out.withColumn("ctx_tokens", F.coalesce(F.col("_m_ctx"), default)).drop("_m_model", "_m_ctx")


def completion_budget(prompt_tokens, ctx_tokens, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """max(0, min(max_tokens, ctx, ctx - prompt_tokens))."""
    ctx = col_of(ctx_tokens)
    return F.greatest(F.lit(0), F.least(F.lit(max_tokens), ctx, ctx - col_of(prompt_tokens))).cast("int")


def chat_tokens(messages: DataFrame, model: str, key: str = "conv_id", content: str = "text",
                name: str | None = None, counter=token_count) -> DataFrame:
    """Prompt tokens of a chat request per conversation.

    3 + sum over messages of (3 + tokens(content) + per_name if named) + 1.
    A plain grouped sum: partial aggregation happens map-side.
    """
    pn = per_name(F.lit(model))
    named = (col_of(name).isNotNull() & (col_of(name) != "")) if name else F.lit(False)
    per_msg = F.lit(3) + counter(col_of(content)) + F.when(named, pn).otherwise(0)
    return messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_messages"),
        (F.lit(4) + F.sum(per_msg)).cast("bigint").alias("prompt_tokens"),
    )


Rung = tuple[str, Callable[[Column], Column]]


def shrink_to_budget(df: DataFrame, text_col: str, rungs: Sequence[Rung], limit, *,
                     counter=token_count, on_overflow: str = "null", trace: bool = False,
                     native_counter: bool | None = None) -> DataFrame:
    """Apply ordered, cumulative reductions until the text fits.

    The text is checked before any rung and after each; the first that fits
    wins and later rungs are never evaluated for that row. Adds columns:

    ``text_min`` (NULL when nothing fits and ``on_overflow='null'``; the last
    reduction when ``on_overflow='keep'``), ``rung`` (number of rungs applied),
    ``tokens_in``, ``tokens`` (count of the returned/last text), ``fits`` and
    ``error`` (set when nothing fits). With ``trace=True`` also ``steps``:
    ARRAY<STRUCT<step, rung, tokens_in, tokens_out>> of the executed rungs.
    ``on_overflow='error'`` raises inside the job.

    With the native counter the whole ladder is one ``aggregate`` over the rung
    numbers: the expression grows linearly with the rungs and each row's text
    is reduced and counted once per executed rung, even when a filter on the
    result is pushed below the projection. A pandas-UDF counter cannot run in
    a lambda, so it gets one guarded projection per rung instead.
    """
    lim = col_of(limit) if not isinstance(limit, int) else F.lit(limit)
    native = counter is token_count if native_counter is None else native_counter
    if native:
        ladder = _ladder_aggregate(F.coalesce(col_of(text_col), F.lit("")), rungs, lim, counter)
        out = df.withColumn("_shrink", ladder)
    else:
        out = _ladder_staged(df, text_col, rungs, lim, counter)
    fits = F.col("_shrink.fits")
    err = F.when(~fits, F.format_string("shrunk text exceeds %d tokens (%d tokens)", lim, F.col("_shrink.n")))
    if on_overflow == "error":
        text_min = F.when(fits, F.col("_shrink.t")).otherwise(F.raise_error(err))
    elif on_overflow == "keep":
        text_min = F.col("_shrink.t")
    else:
        text_min = F.when(fits, F.col("_shrink.t"))
    cols = {
        "text_min": text_min,
        "rung": F.col("_shrink.rung"),
        "tokens_in": F.col("_shrink.n0"),
        "tokens": F.col("_shrink.n"),
        "fits": fits,
        "error": err,
    }
    if trace:
        cols["steps"] = F.col("_shrink.steps")
    return out.withColumns(cols).drop("_shrink")


_STEP_T = "struct<step:int,rung:string,tokens_in:bigint,tokens_out:bigint>"


def _ladder_aggregate(text: Column, rungs: Sequence[Rung], lim: Column, counter) -> Column:
    empty_steps = F.array().cast(f"array<{_STEP_T}>")

    def start(t):
        return bind(counter(t).cast("bigint"), lambda n: F.struct(
            t.alias("t"), n.alias("n"), n.alias("n0"),
            ((n <= lim) | (F.length(t) == 0) | F.lit(len(rungs) == 0)).alias("fits"),
            F.lit(0).alias("rung"), empty_steps.alias("steps")))

    init = bind(text, start)
    if not rungs:
        return init

    def reduce_text(k, t):
        expr = None
        for i, (_, fn) in enumerate(rungs, start=1):
            expr = F.when(k == i, fn(t)) if expr is None else expr.when(k == i, fn(t))
        return expr

    names = F.array(*[F.lit(name) for name, _ in rungs])

    def step(acc, k):
        def after(t2):
            return bind(counter(t2).cast("bigint"), lambda n2: F.struct(
                t2.alias("t"), n2.alias("n"), acc["n0"].alias("n0"), (n2 <= lim).alias("fits"),
                k.alias("rung"),
                F.concat(acc["steps"], F.array(F.struct(
                    k.alias("step"), F.get(names, k - 1).alias("rung"),
                    acc["n"].alias("tokens_in"), n2.alias("tokens_out")))).alias("steps")))
        return F.when(acc["fits"], acc).otherwise(bind(reduce_text(k, acc["t"]), after))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(rungs))), init, step)


def _ladder_staged(df: DataFrame, text_col: str, rungs: Sequence[Rung], lim: Column, counter) -> DataFrame:
    out = df.withColumn("_t0", F.coalesce(col_of(text_col), F.lit("")))
    out = out.withColumn("_n0", counter(F.col("_t0")).cast("bigint"))
    out = out.withColumn("_f0", (F.col("_n0") <= lim) | (F.length("_t0") == 0) | F.lit(len(rungs) == 0))
    out = out.withColumn("_r0", F.lit(0))
    steps = []
    for k, (name, fn) in enumerate(rungs, start=1):
        p = k - 1
        out = out.withColumn(f"_t{k}", F.when(F.col(f"_f{p}"), F.col(f"_t{p}")).otherwise(fn(F.col(f"_t{p}"))))
        out = out.withColumn(f"_n{k}", F.when(F.col(f"_f{p}"), F.col(f"_n{p}"))
                             .otherwise(counter(F.col(f"_t{k}")).cast("bigint")))
        out = out.withColumn(f"_f{k}", F.col(f"_f{p}") | (F.col(f"_n{k}") <= lim))
        out = out.withColumn(f"_r{k}", F.when(F.col(f"_f{p}"), F.col(f"_r{p}")).otherwise(F.lit(k)))
        steps.append((k, name))
    last = len(rungs)
    trace = F.filter(F.array(*[F.when(F.col(f"_r{last}") >= k, F.struct(
        F.lit(k).alias("step"), F.lit(name).alias("rung"), F.col(f"_n{k-1}").alias("tokens_in"),
        F.col(f"_n{k}").alias("tokens_out"))) for k, name in steps]), lambda s: s.isNotNull()) \
        if steps else F.array().cast(f"array<{_STEP_T}>")
    out = out.withColumn("_shrink", F.struct(
        F.col(f"_t{last}").alias("t"), F.col(f"_n{last}").alias("n"), F.col("_n0").alias("n0"),
        F.col(f"_f{last}").alias("fits"), F.col(f"_r{last}").alias("rung"), trace.alias("steps")))
    return out.drop(*[f"_{c}{k}" for c in "tnfr" for k in range(last + 1)])


def drop_go_bodies(text: Column, exported: bool) -> Column:
    """Go code without the bodies of its exported (or its other) functions and methods.

    A fold over the text's tokens keeps the bracket depth. A function opens
    with ``func`` at the start of a line outside all brackets; its body is the
    first pair of braces outside brackets that does not belong to a struct or
    interface type of its results, and goes with the white space before it.
    Literals and comments are tokens of their own, so no bracket in them counts.
    """
    def features(t):
        last = F.regexp_extract(t, r"(?:\A|\n)func(?:\s+(\w+))?\s*\z", 0)
        return F.struct(
            t.alias("t"), t.isin("{", "(", "[").alias("opens"), t.isin("}", ")", "]").alias("closes"),
            (lexer.is_comment(t) | lexer.is_literal(t)).alias("apart"), F.contains(t, F.lit("\n")).alias("breaks"),
            (last != "").alias("func"), F.regexp_extract(last, r"func\s+(\w+)", 1).alias("name"),
            F.regexp_extract(t, r"\A[ \t]*(\w+)", 1).alias("word"),
            F.regexp_like(t, F.lit(r"\b(?:struct|interface)\s*\z")).alias("type"))

    # state: '' outside, 'func' (name not read yet), 'head' (name read), 'body' of a function to cut
    def step(acc, f, i):
        depth = acc["depth"]
        top, code = depth == 0, ~f["opens"] & ~f["closes"] & ~f["apart"]
        opens_body = top & (f["t"] == "{") & acc["at"].isin("func", "head") & ~acc["type"] & (acc["name"] != "")
        wanted = F.regexp_like(acc["name"], F.lit("^[A-Z]" if exported else "^[a-z_]"))
        cut = opens_body & wanted
        inside = acc["at"] == "body"
        now = depth + F.when(f["opens"], 1).when(f["closes"], -1).otherwise(0)
        ends = inside & (now <= 0)
        new_func = top & code & f["func"]
        # A line break outside brackets ends a signature that has no body.
        ended = top & code & f["breaks"] & ~new_func
        at = (F.when(inside, F.when(ends, F.lit("")).otherwise(F.lit("body")))
              .when(new_func, F.when(f["name"] != "", F.lit("head")).otherwise(F.lit("func")))
              .when(ended, F.lit(""))
              .when(opens_body, F.when(cut, F.lit("body")).otherwise(F.lit("")))
              .when(top & code & (acc["at"] == "func") & (f["word"] != ""), F.lit("head"))
              .otherwise(acc["at"]))
        name = (F.when(new_func, f["name"]).when(top & code & (acc["at"] == "func") & (f["word"] != ""), f["word"])
                .otherwise(acc["name"]))
        # The token before is written once it is known whether a body follows it.
        write = F.when(cut, F.regexp_replace(acc["held"], r"[ \t]+\z", "")).otherwise(acc["held"])
        held = F.when(inside | cut, F.lit("")).otherwise(f["t"])
        return F.when(write != "", write), {
            "depth": F.greatest(now, F.lit(0)).cast("int"), "at": at, "name": name, "held": held,
            "type": F.when(code, f["type"]).otherwise(F.when(f["apart"], acc["type"]).otherwise(F.lit(False)))}

    start = {"depth": F.lit(0), "at": F.lit(""), "name": F.lit(""), "held": F.lit(""), "type": F.lit(False)}
    ended = F.concat(lexer.tokens(text, "go"), F.array(F.lit("")))
    return F.array_join(fold(ended, features, "string", start, step), "")


def drop_go_comments(text: Column, before: str) -> Column:
    """Go code without the comment lines right above declarations that begin with the pattern ``before``.

    Code with its comments is taken between literals, so that nothing in a raw string is a comment."""
    comment = r"(?<=\n)(?://[^\n]*+\n|/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*+\n)++(?=" + before + ")"
    parts = lexer.code_parts(F.concat(F.lit("\n"), text), "go")
    kept = F.transform(parts, lambda t: F.when(lexer.is_literal(t), t).otherwise(F.regexp_replace(t, comment, "")))
    return bind(F.array_join(kept, ""), lambda t: F.substring(t, F.lit(2), F.length(t)))


def go_rungs() -> list[Rung]:
    """Default Go reductions, in order: bodies and comments of unexported
    functions and comments of unexported types, exported bodies, exported
    comments, package comment. Comments of variables and constants stay."""
    func = r"func (?:\([^)]*\) )?"
    of = lambda first: "(?:" + func + "|type )" + first
    return [
        ("unexported", lambda c: drop_go_comments(drop_go_bodies(c, False), of("[a-z_]"))),
        ("exported_bodies", lambda c: drop_go_bodies(c, True)),
        ("exported_comments", lambda c: drop_go_comments(c, of("[A-Z]"))),
        ("package_comment", lambda c: drop_go_comments(c, "package ")),
    ]


def html_rungs() -> list[Rung]:
    """Reductions for web pages: comments, then scripts, then styles, then
    all remaining tags. Every rung only deletes text, so counts never rise."""
    return [
        ("comments", lambda c: F.regexp_replace(c, r"(?s)<!--.*?-->", "")),
        ("scripts", lambda c: F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")),
        ("styles", lambda c: F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")),
        ("tags", lambda c: F.regexp_replace(c, r"<[^>]*>", "")),
    ]


def ts_rungs() -> list[Rung]:
    """TypeScript reductions: comments before variables and properties, then
    classes and interfaces, then functions and methods; blank lines go each time."""
    from docquill.functions.text import strip_comments
    return [
        ("variables_properties", lambda c: strip_comments(c, ["variables", "properties"])),
        ("classes_interfaces", lambda c: strip_comments(c, ["classes", "interfaces"])),
        ("functions_methods", lambda c: strip_comments(c, ["functions", "methods"])),
    ]
