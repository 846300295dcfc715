"""The commands end to end on a small source tree."""

import os
import tempfile

from pyspark.sql import functions as F

from docquill.operators.annotate import Answer, Provider
from docquill.plans import commands as C
from tests.test_units_sources import GO, TS


class DocProvider(Provider):
    """Answers with a fixed sentence naming the target; fails for 'perimeter'."""

    def complete(self, prompt, model, max_tokens, params):
        target = prompt.split("\n", 1)[0]
        if "Rename" in target:
            raise RuntimeError("no answer")
        return Answer(text=f'"Documents {target.split(" for ", 1)[1].rstrip(".")}."')


def make_tree():
    root = tempfile.mkdtemp(prefix="docquill-cmd-")
    files = {"shapes/a.go": GO, "web/b.ts": TS, "web/c.tsx": "export const view = 1\n",
             "web/d.mjs": "export type Alias = {\n  size: number\n  grow(): void\n}\nexport function run() { /* note */\n}\nexport const last = 2\n",
             "big/large.go": "package big\n\nfunc Large() {}\n\nvar text = `" + "word " * 5000 + "`\n", "vendor/v.go": "package v\n\nfunc V() {}\n",
             "pkg/internal/i.go": "package i\n\nfunc I() {}\n", "README.md": "# readme\n"}
    for rel, body in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)) or root, exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(body)
    return root


def test_find(spark):
    root = make_tree()
    got = [(r.path, r.identifier) for r in C.find(spark, root).collect()]
    assert ("shapes/a.go", "func:(*Shape).Rename") in got and ("web/b.ts", "method:Counter.increment") not in got
    assert all(not p.startswith(("vendor/", "pkg/")) for p, _ in got)
    assert ("shapes/a.go", "func:TestArea") not in got and ("shapes/a.go", "func:perimeter") not in got
    assert got == sorted(got)
    ts = {i for p, i in got if p.endswith(".ts")}
    assert ts == {"var:answer", "class:Counter", "iface:Named"}
    assert {i for p, i in got if p == "web/c.tsx"} == {"var:view"}
    assert {i for p, i in got if p == "web/d.mjs"} == {"method:Alias.grow", "func:run", "var:last"}
    every = {r.identifier for r in C.find(spark, root, kinds=None).where("path = 'web/d.mjs'").collect()}
    assert every == {"type:Alias", "prop:Alias.size", "method:Alias.grow", "func:run", "var:last"}
    assert any(i.startswith("type:") for p, i in got if p.endswith(".go"))


def test_generate_and_write(spark):
    root = make_tree()
    out = os.path.join(tempfile.mkdtemp(prefix="docquill-out-"), "patched")
    preview, dead = C.generate(spark, root, DocProvider(), out=out, threads=2)
    after = {r.path: r.after for r in preview.collect()}
    go = after["shapes/a.go"]
    assert "// Documents function \"Box.Get()\".\nfunc (b Box[T]) Get() T {" in go
    assert "\t// Red is documented.\n\tRed = 1\n\t// Documents variable \"Blue\".\n\tBlue, Green = 2, 3" in go
    assert "// Documents type \"" in go
    assert "func (s *Shape) Rename" in go and "Documents function \"(*Shape).Rename()\"" not in go
    ts = after["web/b.ts"]
    assert "/** Documents class \"Counter\". */\nexport class Counter {" in ts
    errors = {r.identifier: r.error for r in dead.collect()}
    assert set(errors) == {"func:(*Shape).Rename", "func:Large"} and "exceeds" in errors["func:Large"]
    written = {r.path: r.text for r in spark.read.parquet(out).collect()}
    assert written["shapes/a.go"] == go


def test_pos_and_minify(spark):
    df = spark.createDataFrame([("b.ts", TS)], "path string, text string")
    from docquill.operators.units import ts_units
    wanted = spark.createDataFrame([("b.ts", "class:Counter"), ("b.ts", "func:nope")], "path string, identifier string")
    found, missing = C.pos(ts_units(df), wanted)
    assert [(r.line, r.col) for r in found.collect()] == [(9, 0)] and missing.count() == 1
    m = C.minify(df, "text", 10).first()
    assert m.tokens <= m.tokens_in and len(m.steps) >= 1
