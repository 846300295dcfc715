"""Tokens of Go and TypeScript, and units of files whose literals hold code."""

import pytest
from pyspark.sql import functions as F

from conftest import one
from docquill.functions import lexer
from docquill.operators.units import go_units, ts_units

GO = 'a := "x{" + `r\n{ "` // c "{\nvar r = \'"\'; /* { \n" */ b["\\"("] = \'\\\'\'\n"open\nx / y'
TS = "a = '{' + `t ${f({b: `}`})} \\` {` / 2 // c `\nlet r = /[/\"{]\\//g, q = x / y / z\nreturn /\"/ \"s\\\n{\""


@pytest.mark.parametrize("language,text", [("go", GO), ("ts", TS), ("go", ""), ("ts", "/"), ("ts", "`open ${"), ("go", "/* open"), ("go", "'")])
def test_tokens_cover_the_text(spark, language, text):
    for brackets in (True, False):
        got = one(spark, lexer.tokens(F.col("t"), language, brackets), text)
        assert "".join(got) == text and "" not in got


def test_token_kinds(spark):
    go = one(spark, lexer.tokens(F.col("t"), "go"), GO)
    assert {'"x{"', '`r\n{ "`', '// c "{', "'\"'", '/* { \n" */', '"\\"("', "'\\''", "[", "]"} <= set(go)
    ts = one(spark, lexer.tokens(F.col("t"), "ts"), TS)
    assert {"'{'", "`t ${f({b: `}`})} \\` {`", "// c `", '/[/"{]\\//g', '/"/', '"s\\\n{"'} <= set(ts)
    assert "{" not in ts and "/" in ts


def test_hollow_keeps_lines(spark):
    for language, text in (("go", GO), ("ts", TS)):
        got = one(spark, lexer.hollow(F.col("t"), language), text)
        assert got.count("\n") == text.count("\n") and "{" not in got
    assert one(spark, lexer.hollow(F.col("t"), "go"), 'x("a") /* b */ // c') == 'x("") /**/ //'


def test_long_literals(spark):
    text = "var x = `" + "{\n\" \\" * 200_000 + "`\nvar y = \"" + "\\\"{" * 200_000 + "\"\n/*" + "* {" * 200_000 + "*/\nfunc Last() {}\n"
    df = spark.createDataFrame([("a.go", text)], "path string, text string")
    assert [r["identifier"] for r in go_units(df).orderBy("line").collect()] == ["var:x", "var:y", "func:Last"]


def units(spark, scan, text, *cols):
    df = spark.createDataFrame([("f", text)], "path string, text string")
    return [tuple(r) if len(cols) > 1 else r[0] for r in scan(df).orderBy("line", "col").select(*(cols or ("identifier",))).collect()]


def test_go_code_in_literals(spark):
    text = "\n".join([
        "package p", "", "var Q = `", "func NotThere() {", "`", "", "var (", '\t"{"', "\tm = map[string]int{", '\t\t"{": 1,', "\t}",
        "\tAfter = '{'", ")", "", "// doc \" here `", "func Documented() {", '\ts := "}"', "\treturn", "}", "", "func Last() { x(`}`) }",
        "", "type I interface {", '\tGet(x string) // a "{', "\tPut()", "}", "func End() {}"])
    assert units(spark, go_units, text, "identifier", "documented") == [
        ("var:Q", False), ("var:m", False), ("var:After", False), ("func:Documented", True), ("func:Last", False),
        ("type:I", False), ("func:I.Get", False), ("func:I.Put", False), ("func:End", False)]


def test_ts_code_in_literals(spark):
    text = "\n".join([
        "export class C {", '  a = "{"', "  b = `", "export const no = 1", "  c: {", "`", "  m(): string { return '}' }", "  r = /[{\"]/", "}",
        "export const x = `${'}'}`", "export interface I {", "  p: string // {", "  f(a: {", "    b: string", "  }): void",
        "  g(", "    first: string,", "    second: number", "  ): void", "  list: [", "    string", "  ]", "}",
        "export function last() { return \"}\" }", "export type T = {", "  z: number", "}"])
    assert units(spark, ts_units, text) == [
        "class:C", "prop:C.a", "prop:C.b", "method:C.m", "prop:C.r", "var:x", "iface:I", "prop:I.p", "method:I.f", "method:I.g", "prop:I.list",
        "func:last", "type:T", "prop:T.z"]


GO_BODIES = """// Package p.
package p

// low does it.
func low(a interface{}, b struct{ c int }) (x interface{ M() }, err error) {
\ts := `
}
// not a comment
func low2() {
`
\tif a { return "}" }
}

/* high
   does too */
func (t *T[K]) High(f func() error) struct {
\tA int
} {
\treturn '}' // }
}
func Short() int { return len("{") }
func low3() {}
func extern(a int) int

// T is a type.
type T struct {
\tf func() // {
}

var raw = `
// kept
func kept() {
}
`
"""


def test_go_bodies_by_their_own_brackets(spark):
    from docquill.operators import budget as B
    low = one(spark, B.drop_go_bodies(F.col("t"), False), GO_BODIES)
    assert "func low(a interface{}, b struct{ c int }) (x interface{ M() }, err error)\n\n/* high" in low
    assert "func low3()\nfunc extern(a int) int\n" in low and "return '}' // }\n}" in low and 'Short() int { return len("{") }' in low
    high = one(spark, B.drop_go_bodies(F.col("t"), True), GO_BODIES)
    assert "High(f func() error) struct {\n\tA int\n}\nfunc Short() int\nfunc low3() {}" in high and "// not a comment\nfunc low2()" in high
    for out in (low, high):
        assert out.endswith("var raw = `\n// kept\nfunc kept() {\n}\n`\n") and "type T struct {\n\tf func() // {\n}" in out
    text = GO_BODIES
    for _, rung in B.go_rungs():
        text = one(spark, rung(F.col("t")), text)
    assert text == ("package p\n\nfunc low(a interface{}, b struct{ c int }) (x interface{ M() }, err error)\n\n"
                    "func (t *T[K]) High(f func() error) struct {\n\tA int\n}\nfunc Short() int\nfunc low3()\nfunc extern(a int) int\n\n"
                    "type T struct {\n\tf func() // {\n}\n\nvar raw = `\n// kept\nfunc kept() {\n}\n`\n")


def test_go_comments_in_raw_strings_stay(spark):
    from docquill.operators import budget as B
    text = "// first\nfunc a() {\n\tx := `\n// in a string\nfunc b()`// beside\n}\n// second\n/* third */\nfunc c()\n"
    assert one(spark, B.drop_go_comments(F.col("t"), "func "), text) == \
        "func a() {\n\tx := `\n// in a string\nfunc b()`// beside\n}\nfunc c()\n"


@pytest.mark.parametrize("kinds,gone", [(["variables"], "12"), (["functions"], "3"), (["classes"], "4"), (["properties"], "5"),
                                        (["methods"], "6"), (["interfaces"], "7"), (None, "1234567"), ([], "")])
def test_ts_comments_by_the_declaration_that_follows(spark, kinds, gone):
    from docquill.functions import text as T
    marks = {k: f"/* c{k} */" for k in "1234567"}
    code = (f"{marks['1']}\nexport const a = \"// s\\n const\"\n{marks['2']} let b = `/* t */ var`\n// x\n{marks['3']}\nfunction f() {{}}\n"
            f"{marks['4']}\nexport class C {{\n  {marks['5']}\n  p: string = '// q'\n  {marks['6']}\n  m() {{ return /\\/\\* r/ }}\n}}\n"
            f"{marks['7']}\nexport interface I {{}}\n// end\n")
    got = one(spark, T.strip_comments("t", kinds, empty_lines=False), code)
    assert all((m in got) == (k not in gone) for k, m in marks.items())
    assert all(x in got for x in ('"// s\\n const"', "`/* t */ var`", "'// q'", "/\\/\\* r/", "// x\n", "// end\n"))


def test_long_go_text_in_linear_time(spark):
    import time
    from docquill.operators import budget as B

    def seconds(n):
        text = "".join(f"// f{k} does.\nfunc f{k}(a int) int {{\n\tx := \"{{\" // }}\n\treturn a\n}}\n" for k in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(F.length(B.drop_go_bodies(F.col("t"), False)).alias("n"))
        df.collect()
        began = time.time()
        df.collect()
        return time.time() - began

    assert seconds(8000) < 12 * seconds(2000) + 2
