"""Selection (B1-B11, D1, G1, G2, H1, E6, E7) and identifiers."""

import re

from pyspark.sql import functions as F

from docquill.functions.globs import glob_to_regex, globs_regex
from docquill.functions.identifiers import (format_identifier, is_exported, parse_identifier, short_name,
                                            target_phrase, valid_identifier)
from docquill.operators import select as SEL
from tests.conftest import one

TREE = ["foo.go", "bar.go", "baz.ts", "README.md", "bar/foo.go", "bar/baz.go", "baz/foo.ts", "foo/bar/baz.go",
        ".hidden/x.go", "a/.git/y.go", "dist/z.go", "x/node_modules/m.ts", "vendor/v.go", "testdata/t.go",
        "pkg/test/t.go", "pkg/tests/t.go", "api/gen.pb.go", "internal/i.go", "pkg/internal/deep/j.go", "_under.go"]


def paths_df(spark, paths=TREE):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def selected(df):
    return sorted(r.path for r in df.collect())


def test_glob_translation():
    assert re.fullmatch(glob_to_regex("**/*.go"), "a/b/c.go")
    assert re.fullmatch(glob_to_regex("**/*.go"), "c.go")
    assert not re.fullmatch(glob_to_regex("*.go"), "a/c.go")
    assert re.fullmatch(glob_to_regex("{foo,bar}/*.?s"), "bar/x.ts")
    assert re.fullmatch(glob_to_regex("[!b]ar.go"), "car.go") and not re.fullmatch(glob_to_regex("[!b]ar.go"), "bar.go")
    assert re.fullmatch(glob_to_regex("dist/**"), "dist") and re.fullmatch(glob_to_regex("dist/**"), "dist/a/b")
    assert glob_to_regex("[abc") is None and glob_to_regex("{a,b") is None
    rx = globs_regex(["**/vendor/**"], ancestors=True)
    assert re.fullmatch(rx, "vendor/v.go") and not re.fullmatch(rx, "vendors/v.go")


def test_default_selection(spark):
    got = selected(SEL.select_paths(paths_df(spark)))
    assert got == ["_under.go", "bar.go", "bar/baz.go", "bar/foo.go", "baz.ts", "baz/foo.ts", "foo.go",
                   "foo/bar/baz.go", "internal/i.go", "pkg/internal/deep/j.go"]


def test_extension_include_exclude(spark):
    df = paths_df(spark)
    assert selected(SEL.select_paths(df, exts=[".ts"])) == ["baz.ts", "baz/foo.ts"]
    assert selected(SEL.select_paths(df, include=["bar/**"])) == ["bar/baz.go", "bar/foo.go"]
    assert selected(SEL.select_paths(df, include=["**/foo.go"], exclude=["bar/**"])) == ["foo.go"]
    # a malformed include glob matches nothing
    assert selected(SEL.select_paths(df, include=["[bad"])) == []
    # internal packages, when asked
    got = selected(SEL.select_paths(df, exclude_internal=True))
    assert "internal/i.go" not in got and "pkg/internal/deep/j.go" not in got


def test_filters_never_add_rows(spark):
    df = paths_df(spark)
    for kw in ({}, {"exts": [".go"]}, {"include": ["**"]}, {"exclude": ["**/*.go"]}):
        assert SEL.select_paths(df, **kw).count() <= df.count()


def test_dispatch_language(spark):
    df = paths_df(spark, ["a.go", "b.ts", "c.md", "d"])
    langs = SEL.languages_table(spark, SEL.DEFAULT_LANGUAGES + [(".ts", "typescript")])
    hit, skipped = SEL.dispatch_language(df, langs)
    assert sorted((r.path, r.language) for r in hit.collect()) == [("a.go", "go"), ("b.ts", "typescript")]
    assert sorted((r.path, r.ext) for r in skipped.collect()) == [("c.md", ".md"), ("d", "")]


def test_match_any(spark):
    df = spark.createDataFrame([("func:Foo",), ("func:bar",), ("type:Baz",)], "identifier string")
    assert SEL.match_any(df, "identifier", ["^func:", "Baz$"]).count() == 3
    assert SEL.match_any(df, "identifier", ["oo"]).count() == 1
    assert SEL.match_any(df, "identifier", []).count() == 3


def test_first_n_and_union_distinct_count(spark):
    df = paths_df(spark, ["c", "a", "b", "a"])
    assert selected(SEL.first_n_files(df, 2)) == ["a", "a", "b"]
    assert SEL.first_n_files(df, 0).count() == 4
    u = SEL.union_findings([df, df])
    assert u.count() == 8
    assert SEL.distinct_units(u.withColumn("identifier", F.lit("x"))).count() == 3
    assert SEL.count_findings(u).first()["n_findings"] == 8


def test_units_filters(spark):
    units = spark.createDataFrame(
        [("func", "TestX", True, True), ("func", "Run", False, True), ("prop", "p", False, False)],
        "kind string, name string, documented boolean, public boolean")
    assert SEL.exclude_tests(units).count() == 2
    assert SEL.only_undocumented(units).count() == 2
    assert SEL.only_undocumented(units, include_documented=True).count() == 3
    assert SEL.filter_kinds(units, ["prop"]).count() == 1
    assert SEL.only_public(units).count() == 2


def test_parse_and_format_identifier(spark):
    rows = ["method:Foo.bar", "func:baz", "prop:Foo", "nope:x", "var:", "class:A:B"]
    df = spark.createDataFrame([(r,) for r in rows], "i string").select("i", parse_identifier("i").alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert (got["method:Foo.bar"].kind, got["method:Foo.bar"].owner, got["method:Foo.bar"].name) == ("method", "Foo", "bar")
    assert got["func:baz"].owner is None and got["func:baz"].name == "baz"
    assert got["prop:Foo"].error and got["nope:x"].error and got["var:"].error
    assert got["class:A:B"].name == "A"
    back = df.where(F.col("p.error").isNull()).select(
        "i", format_identifier(F.col("p.kind"), F.col("p.owner"), F.col("p.name")).alias("b"))
    assert all(r.b == r.i for r in back.collect() if r.i != "class:A:B")


def test_valid_identifier(spark):
    assert one(spark, valid_identifier("t"), "iface:X") is True
    assert one(spark, valid_identifier("t"), "interface:X") is False


def test_is_exported(spark):
    cases = {"func:Foo": True, "func:foo": False, "func:T.Method": True, "func:T.method": False,
             "func:_x": True, "func:_": False, "func:9x": True, "func:Ärger": False, "Foo": True, "func:": False,
             "func:(*T).Get": True}
    for ident, want in cases.items():
        assert one(spark, is_exported("t"), ident) is want, ident


def test_target_phrase_and_short_name(spark):
    go = {"func:Foo": 'function "Foo()"', "type:T": 'type "T"', "var:v": 'variable "v"',
          "func:T.M": 'function "T.M()"', "iface:I": '"iface:I"', "x": "x"}
    for ident, want in go.items():
        assert one(spark, target_phrase("t", "go"), ident) == want
    ts = {"class:C": 'class "C"', "iface:I": 'interface "I"', "interface:I": 'interface "I"',
          "method:C.m": 'method "m" of "C"', "prop:C.p": 'property "p" of "C"', "func:f": 'function "f()"',
          "odd:x": "odd:x"}
    for ident, want in ts.items():
        assert one(spark, target_phrase("t", "ts"), ident) == want
    assert one(spark, short_name("t"), "method:C.m") == "m"
    assert one(spark, short_name("t"), "func:f") == "f"


def test_units_kept_plus_dropped_is_all(spark):
    from pyspark.sql import functions as F
    from docquill.operators.units import go_units
    from docquill.plans.q_code import go_code
    units = go_units(go_code(spark, "/root/testdata/sf0.001"))
    total = units.count()
    kept = SEL.only_undocumented(units).count()
    dropped = units.where(F.col("documented")).count()
    assert kept + dropped == total and 0 < kept < total


def test_quote_escapes(spark):
    assert one(spark, target_phrase("t", "go"), 'iface:a"b\tc') == '"iface:a\\"b\\tc"'


def test_exported_flag_shuffles_no_row_per_word(spark, tmp_path):
    import hashlib
    from docquill.plans.q_select import q_exported_flag
    rows = [(1, "Foo bar  _\tBaz.qux x.Y\n_z Ärger a:B"), (2, None), (3, ""), (4, "only lower"), (5, " Two A"), (5, "b C One"),
            (5, None), (None, "Null"), (None, "Key"), (6, "Ab Cd ef Gh:i.j")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_exported_flag(spark, str(tmp_path))
    got = {r["doc_id"]: (r["n_words"], r["n_exported"], r["exported_md5"]) for r in out.collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == {1: (8, 3, md5("Foo x.Y _z")), 4: (2, 0, md5("")), 5: (5, 4, md5("Two A C One")),
                   None: (2, 2, md5("Key Null")), 6: (4, 3, md5("Ab Cd Gh:i.j"))}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
