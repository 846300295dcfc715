"""Token counts, model limits, budgets and shrinking."""

from pyspark.sql import functions as F

from docquill.functions.tokens import exact_counter, token_count
from docquill.operators import budget as B


def test_token_count(spark):
    df = spark.createDataFrame([("a b  c\n d",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_count("t")).collect()] == [4, 0, None]


def test_exact_counter_plugs_in(spark):
    count = exact_counter(lambda: (lambda s: list(s.encode())))
    df = spark.createDataFrame([("abc",), ("ä",)], "t string")
    assert [r[0] for r in df.select(count(F.col("t"))).collect()] == [3, 2]


def test_attach_model_and_budget(spark):
    df = spark.createDataFrame([("gpt-4", 8000), ("gpt-3.5-turbo", 100), ("unknown", 3000)],
                               "model string, prompt_tokens int")
    out = B.attach_model(df, B.models_table(spark)).select(
        "model", "ctx_tokens", B.completion_budget("prompt_tokens", "ctx_tokens").alias("b"))
    got = {r.model: (r.ctx_tokens, r.b) for r in out.collect()}
    assert got == {"gpt-4": (8192, 192), "gpt-3.5-turbo": (4096, 512), "unknown": (2049, 0)}


def test_chat_tokens(spark):
    msgs = spark.createDataFrame([(1, "one two", None), (1, "three", "bob"), (2, "x", None)],
                                 "conv_id int, text string, name string")
    got = {r.conv_id: r.prompt_tokens for r in B.chat_tokens(msgs, "gpt-4", name="name").collect()}
    # 3 + (3 + 2) + (3 + 1 + 1) + 1 and 3 + (3 + 1) + 1
    assert got == {1: 14, 2: 8}
    got35 = {r.conv_id: r.prompt_tokens for r in B.chat_tokens(msgs, "gpt-3.5-turbo", name="name").collect()}
    assert got35[1] == 12


RUNGS = [
    ("drop_b", lambda c: F.regexp_replace(c, "b ", "")),
    ("drop_c", lambda c: F.regexp_replace(c, "c ", "")),
]


def shrink_rows(spark, texts, limit, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = B.shrink_to_budget(df, "t", RUNGS, limit, trace=True, **kw)
    return out.select("t", "text_min", "rung", "tokens_in", "tokens", "fits", "steps").collect()


def test_shrink_ladder(spark):
    rows = shrink_rows(spark, ["a a", "a b b a", "b c c c a", "a a a a"], 2)
    by = {r.t: r for r in rows}
    assert (by["a a"].rung, by["a a"].text_min, by["a a"].steps) == (0, "a a", [])
    assert (by["a b b a"].rung, by["a b b a"].text_min) == (1, "a a")
    assert (by["b c c c a"].rung, by["b c c c a"].tokens) == (2, 1)
    assert by["a a a a"].fits is False and by["a a a a"].text_min is None and by["a a a a"].rung == 2
    assert [s.step for s in by["a a a a"].steps] == [1, 2]
    # counts never rise along the trace
    for r in rows:
        assert all(s.tokens_out <= s.tokens_in for s in r.steps)


def test_shrink_keep_and_staged_agree(spark):
    texts = ["a b c d e", "b b b", "c c", ""]
    keep = shrink_rows(spark, texts, 1, on_overflow="keep")
    staged = shrink_rows(spark, texts, 1, on_overflow="keep", native_counter=False)
    assert [tuple(r) for r in keep] == [tuple(r) for r in staged]
    assert {r.t: r.text_min for r in keep}["a b c d e"] == "a d e"
    assert {r.t: r.rung for r in keep}[""] == 0


def test_shrink_error_mode(spark):
    import pytest
    df = spark.createDataFrame([("a a a a",)], "t string")
    with pytest.raises(Exception):
        B.shrink_to_budget(df, "t", RUNGS, 1, on_overflow="error").collect()


def test_go_rungs(spark):
    code = ("// Package p.\npackage p\n\n// hidden does things.\nfunc hidden() {\n\tx := 1\n\t_ = x\n}\n\n"
            "// Shown does things.\nfunc Shown(a int) int {\n\treturn a\n}\n")
    df = spark.createDataFrame([(code,)], "t string")
    out = B.shrink_to_budget(df, "t", B.go_rungs(), 19, trace=True).first()
    assert out.rung == 1
    assert "x := 1" not in out.text_min and "// hidden" not in out.text_min and "return a" in out.text_min
    out = B.shrink_to_budget(df, "t", B.go_rungs(), 5, on_overflow="keep").first()
    assert out.text_min == "package p\n\nfunc hidden()\n\nfunc Shown(a int) int\n"


def test_ts_rungs_step_down(spark):
    code = ("// A var.\nexport const a = 1\n\n/** A class. */\nexport class C {\n  /** p */\n  p: string\n"
            "  // m\n  m() {}\n}\n\n/** f */\nexport function f() {}\n")
    df = spark.createDataFrame([(code,)], "t string")
    out = B.shrink_to_budget(df, "t", B.ts_rungs(), 1, trace=True, on_overflow="keep").first()
    assert [s.rung for s in out.steps] == ["variables_properties", "classes_interfaces", "functions_methods"]
    assert all(s.tokens_out <= s.tokens_in for s in out.steps)
    assert out.text_min == "export const a = 1\nexport class C {\n  p: string\n  m() {}\n}\nexport function f() {}"
