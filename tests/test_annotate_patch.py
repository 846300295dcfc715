"""Annotation (K1-K6, I15, E1-E3, E5, A5) and edits."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from docquill.operators import annotate as A
from docquill.operators import patch as P
from docquill.sources.sinks import write_patched


class FlakyProvider(A.Provider):
    """Fails for identifiers containing 'bad', sleeps for 'slow'."""

    def complete(self, prompt, model, max_tokens, params):
        if "bad" in prompt:
            raise RuntimeError("provider failed")
        if "slow" in prompt:
            time.sleep(2)
        if "role" in prompt:
            return A.Answer(text="x", role="user")
        return A.Answer(text=f' "doc for {model} top_p={params.get("top_p")}" ', prompt_tokens=3, completion_tokens=2)


class SleepyProvider(A.Provider):
    """Hangs for identifiers containing 'slow'."""

    def complete(self, prompt, model, max_tokens, params):
        if "slow" in prompt:
            time.sleep(30)
        return A.Answer(text="ok")


def requests(spark, idents, model="gpt-4"):
    rows = [("f.go", i, "go", "code", model, 100) for i in idents]
    df = spark.createDataFrame(rows, "path string, identifier string, language string, code string, "
                                     "model string, max_tokens int")
    return df.withColumn("prompt", F.concat(A.build_prompt("identifier", "language", "path", "code"),
                                            F.lit(" "), F.col("identifier")))


def test_build_prompt(spark):
    df = spark.createDataFrame([("func:Foo", "go", "a.go", "func Foo() {}"), ("method:C.m", "ts", "b.ts", "m() {}")],
                               "i string, l string, p string, c string")
    got = [r[0] for r in df.select(A.build_prompt("i", "l", "p", "c")).collect()]
    assert got[0].startswith('Write a documentation comment for function "Foo()".')
    assert 'Start the comment with "Foo "' in got[0] and got[0].endswith("File: a.go\n---\nfunc Foo() {}")
    assert got[1].startswith('Write a TSDoc comment for method "m" of "C".')


def test_annotate_isolates_failures(spark):
    res = A.annotate(requests(spark, ["func:Ok", "func:bad", "func:role"]), FlakyProvider(), threads=2)
    got = {r.identifier: r for r in res.collect()}
    assert got["func:Ok"].error is None and got["func:Ok"].answer.strip().startswith('"doc for gpt-4 top_p=None')
    assert "provider failed" in got["func:bad"].error and got["func:bad"].answer is None
    assert "unexpected message role" in got["func:role"].error
    # completion path keeps top_p
    res2 = A.annotate(requests(spark, ["func:Ok"], model="text-davinci-003"), FlakyProvider(), threads=1)
    assert "top_p=0.3" in res2.first().answer


def test_annotate_deadline(spark):
    res = A.annotate(requests(spark, ["func:slow", "func:Ok"]), FlakyProvider(), threads=2, timeout_s=0.5)
    got = {r.identifier: r.error for r in res.collect()}
    assert "deadline" in got["func:slow"] and got["func:Ok"] is None


def test_group_flatten_usage_dead_letter(spark):
    res = A.finish_docs(A.annotate(requests(spark, ["func:B", "func:A", "func:bad"]), FlakyProvider(),
                                   keep=["path", "identifier", "model"]), "Footer")
    files = A.group_docs(res).first()
    assert [d.identifier for d in files.docs] == ["func:A", "func:B"]
    assert files.n_units == 3 and files.n_failed == 1
    assert files.docs[0].text.endswith("\n\nFooter") and not files.docs[0].text.startswith('"')
    assert A.flatten_docs(A.group_docs(res)).count() == 2
    assert A.dead_letter(res).count() == 1
    u = A.usage_totals(res).first()
    assert (u.n_calls, u.n_errors, u.prompt_tokens, u.completion_tokens, u.total_tokens) == (3, 1, 6, 4, 10)
    # a file whose units all failed still appears, with an empty list
    allbad = A.group_docs(A.finish_docs(A.annotate(requests(spark, ["func:bad"]), FlakyProvider()))).first()
    assert allbad.docs == [] and allbad.n_failed == 1


def test_request_without_budget_is_not_sent(spark):
    log = os.path.join(tempfile.mkdtemp(prefix="docquill-calls-"), "calls")
    req = requests(spark, ["func:A", "func:B"]).withColumn("max_tokens", F.when(F.col("identifier") == "func:A", 0).otherwise(9))
    got = {r.identifier: r.error for r in A.annotate(req, CountingProvider(log)).collect()}
    assert "budget" in got["func:A"] and got["func:B"] is None and len(open(log).readlines()) == 1


@pytest.mark.parametrize("threads", [1, 2])
def test_slow_units_fail_alone_and_hold_up_nothing(spark, threads):
    idents = [f"func:{'slow' if k in (0, 3) else 'Ok'}{k}" for k in range(8)]
    t = time.perf_counter()
    req = requests(spark, idents).coalesce(1)
    got = {r.identifier: r.error for r in A.annotate(req, SleepyProvider(), threads=threads, timeout_s=1).collect()}
    assert time.perf_counter() - t < 12
    assert all(("deadline" in e) if "slow" in i else e is None for i, e in got.items()) and len(got) == 8


SRC = "package p\n\nfunc A() {}\n\ttype T struct{}\nvar x = 1"


def source(spark, text=SRC, path="p.go"):
    return spark.createDataFrame([(path, text, "go")], "path string, text string, language string")


def edits(spark, rows):
    return spark.createDataFrame(rows, "path string, line int, col int, identifier string, text string")


def test_insert_with_indent_and_same_line(spark):
    e = edits(spark, [("p.go", 2, 0, "func:A", "// A does.\n// More.\n"),
                      ("p.go", 3, 1, "type:T", "// T is.\n"),
                      ("p.go", 4, 4, "var:x", "/*1*/"), ("p.go", 4, 0, "var:y", "/*0*/")])
    preview, misses = P.apply_edits(source(spark), e)
    r = preview.first()
    assert r.after == ("package p\n\n// A does.\n// More.\nfunc A() {}\n\t// T is.\n\ttype T struct{}\n"
                       "/*0*/var /*1*/x = 1")
    assert (r.n_applied, r.n_missed) == (4, 0) and misses.count() == 0


def test_same_position_edits_read_in_identifier_order(spark):
    e = edits(spark, [("p.go", 2, 0, "func:B", "// B\n"), ("p.go", 2, 0, "func:A", "// A\n")])
    preview, _ = P.apply_edits(source(spark), e)
    assert "// A\n// B\nfunc A() {}" in preview.first().after


def test_out_of_range_permissive_and_failfast(spark):
    e = edits(spark, [("p.go", 0, 0, "a", "// ok\n"), ("p.go", 99, 0, "b", "x"), ("p.go", 0, 50, "c", "y")])
    preview, misses = P.apply_edits(source(spark), e)
    r = preview.first()
    assert r.after == SRC and (r.n_applied, r.n_missed) == (0, 2)
    assert sorted(m.identifier for m in misses.collect()) == ["b", "c"]
    with pytest.raises(Exception):
        P.apply_edits(source(spark), e, mode="failfast")[0].collect()


def test_no_edits_leave_text_unchanged(spark):
    preview, _ = P.apply_edits(source(spark), edits(spark, [("other.go", 0, 0, "a", "x")]))
    r = preview.first()
    assert r.after == SRC and r.n_applied == 0


def test_resolve_edits(spark):
    docs = spark.createDataFrame([("p.go", "func:A", "// A.\n"), ("p.go", "func:Z", "// Z.\n")],
                                 "path string, identifier string, text string")
    units = spark.createDataFrame([("p.go", "func:A", 5, 0), ("p.go", "func:A", 2, 1)],
                                  "path string, identifier string, line int, col int")
    ok, miss = P.resolve_edits(docs, units)
    assert [(r.identifier, r.line, r.col) for r in ok.collect()] == [("func:A", 2, 1)]
    assert [r.error for r in miss.collect()] == ["node not found: func:Z"]


def test_replace_comments_indents(spark):
    text = "var (\n\t// old\n\tA = 1\n)"
    e = spark.createDataFrame([("p.go", 2, 1, "var:A", "// new\n// two")],
                              "path string, line int, from_line int, identifier string, text string")
    assert P.replace_comments(source(spark, text), e).first().after == "var (\n\t// new\n\t// two\n\tA = 1\n)"


def test_replace_comments(spark):
    text = "// old one\n// old two\nfunc A() {}\n// stale\nfunc B() {}\nfunc C() {}"
    e = spark.createDataFrame([("p.go", 2, 0, "func:A", "// new A"), ("p.go", 4, 3, "func:B", ""),
                               ("p.go", 5, 5, "func:C", "// C")],
                              "path string, line int, from_line int, identifier string, text string")
    out = P.replace_comments(source(spark, text), e).first()
    assert out.after == "// new A\nfunc A() {}\n\nfunc B() {}\n\n// C\nfunc C() {}"


def test_documented_specs_and_blocks_are_followed_by_an_empty_line(spark):
    text = "package p\n\nconst (\n\tFoo = 1\n\tBar = 2\n)\nfunc A() {\n\treturn\n}\nfunc B() {}\n\ntype I interface {\n\tX()\n\tY()\n}"
    e = spark.createDataFrame([("p.go", n, n, i, "// " + i) for n, i in ((3, "Foo"), (4, "Bar"), (6, "A"), (9, "B"), (12, "X"), (13, "Y"))],
                              "path string, line int, from_line int, identifier string, text string")
    assert P.replace_comments(source(spark, text), e).first().after == (
        "package p\n\nconst (\n\t// Foo\n\tFoo = 1\n\n\t// Bar\n\tBar = 2\n)\n// A\nfunc A() {\n\treturn\n}\n\n"
        "// B\nfunc B() {}\n\ntype I interface {\n\t// X\n\tX()\n\n\t// Y\n\tY()\n}")


def test_edits_of_unknown_files_are_misses(spark):
    preview, misses = P.apply_edits(source(spark), edits(spark, [("no.go", 1, 2, "a", "x"), ("p.go", 0, 0, "b", "y")]))
    assert [(r.path, r.identifier, r.error) for r in misses.collect()] == [("no.go", "a", "file not found")]
    assert preview.first().n_applied == 1


def test_work_of_edits_is_linear(spark):
    import time

    def seconds(n):
        text = "\n".join(f"func F{i}() {{}}" for i in range(n))
        at = spark.range(n).select(F.lit("p.go").alias("path"), F.col("id").cast("int").alias("line"), F.lit(0).alias("col"),
                                   F.col("id").cast("int").alias("from_line"), F.col("id").cast("string").alias("identifier"),
                                   F.lit("// x\n").alias("text"))
        best = []
        for _ in range(2):
            t = time.perf_counter()
            P.apply_edits(source(spark, text), at)[0].select(F.length("after")).collect()
            P.replace_comments(source(spark, text), at).select(F.length("after")).collect()
            best.append(time.perf_counter() - t)
        return min(best)
    seconds(2000)
    assert seconds(40_000) < 4 * seconds(20_000) + 1


def test_preview_summary_and_write(spark):
    e = edits(spark, [("p.go", 0, 0, "a", "// x\n")])
    preview, _ = P.apply_edits(source(spark), e)
    s = P.preview_summary(preview).first()
    assert s.changed and s.n_applied == 1 and s.after_chars == len(SRC) + 5
    out = tempfile.mkdtemp(prefix="docquill-write-")
    write_patched(preview, os.path.join(out, "patched"))
    back = spark.read.parquet(os.path.join(out, "patched")).first()
    assert back.text.startswith("// x\npackage p") and back.language == "go"
    with pytest.raises(ValueError):
        write_patched(preview, out, source_location=out)


class CountingProvider(A.Provider):
    """Appends one line per call to a file, to count calls across workers."""

    def __init__(self, log):
        self.log = log

    def complete(self, prompt, model, max_tokens, params):
        with open(self.log, "a") as f:
            f.write("x\n")
        return A.Answer(text="ok")


def test_durable_answers_are_not_recomputed(spark):
    log = os.path.join(tempfile.mkdtemp(prefix="docquill-calls-"), "calls")
    res = A.annotate(requests(spark, ["func:A", "func:B", "func:C"]), CountingProvider(log), durable=True)
    res.count()
    res.where(F.col("error").isNull()).count()
    A.usage_totals(res.withColumn("model", F.lit("m"))).collect()
    with open(log) as f:
        assert len(f.readlines()) == 3
