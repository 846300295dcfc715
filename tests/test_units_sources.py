"""Unit extraction (C1-C6) and sources/sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from docquill.operators.units import (existing_comment, extract_by_rules, go_units, locate_units, rules_table,
                                      ts_units)
from docquill.sources.sinks import findings_json, findings_lines, parse_findings, parse_position
from docquill.sources.tables import read_table, read_tree

GO = """// Package shapes draws.
package shapes

// Area is documented.
func Area(w, h int) int { return w * h }

func perimeter(w, h int) int {
	return 2 * (w + h)
}

type Shape struct {
	Name string
}

func (s *Shape) Rename(n string) {}

func (b Box[T]) Get() T { return b.v }

func TestArea(t *testing.T) {}

const (
	// Red is documented.
	Red = 1
	Blue, Green = 2, 3
)

// Group doc.
var (
	A = 1
)

type Reader interface {
	Read(p []byte) (int, error)
	// Close is documented.
	Close() error
	io.Writer
}
"""

TS = """/** Adds. */
export function add(a: number): number {
  const inner = 1
  return a
}

export const answer = 42, other = 1
const hidden = 3

export class Counter {
  count: number
  #secret = 1
  private hiddenField: string
  /** Increments. */
  increment(): void {
    this.count++
  }
  protected guard() {}
}

export interface Named {
  name: string
}

export type Alias = string
"""


def units_of(df):
    return {r.identifier: r for r in df.collect()}


def test_go_units(spark):
    src = spark.createDataFrame([("a.go", GO)], "path string, text string")
    u = units_of(go_units(src))
    assert sorted(u) == sorted(["func:Area", "func:perimeter", "type:Shape", "func:(*Shape).Rename", "func:Box.Get",
                                "func:TestArea", "var:Red", "var:Blue", "var:A", "type:Reader", "func:Reader.Read",
                                "func:Reader.Close"])
    assert u["func:Area"].documented and not u["func:perimeter"].documented
    assert u["var:Red"].documented and not u["var:Blue"].documented
    assert u["var:A"].documented            # the group's comment covers its specs
    assert u["func:Reader.Close"].documented and not u["func:Reader.Read"].documented
    assert not u["func:perimeter"].exported and u["func:(*Shape).Rename"].exported
    assert (u["func:Area"].line, u["var:Red"].line, u["var:Red"].col) == (4, 22, 1)


def test_ts_units(spark):
    src = spark.createDataFrame([("a.ts", TS)], "path string, text string")
    u = units_of(ts_units(src))
    assert sorted(u) == sorted(["func:add", "var:answer", "class:Counter", "prop:Counter.count",
                                "prop:Counter.#secret", "prop:Counter.hiddenField", "method:Counter.increment",
                                "method:Counter.guard", "iface:Named", "prop:Named.name", "type:Alias"])
    assert u["func:add"].documented and u["method:Counter.increment"].documented
    assert not u["prop:Counter.#secret"].public and not u["method:Counter.guard"].public
    assert u["prop:Counter.count"].public and (u["prop:Counter.count"].line, u["prop:Counter.count"].col) == (10, 2)


def test_existing_comment_and_locate(spark):
    src = spark.createDataFrame([("a.go", GO)], "path string, text string")
    units = go_units(src)
    c = units_of(existing_comment(src, units))
    assert c["func:Area"].comment == "Area is documented." and c["func:Area"].comment_from == 3
    assert c["func:perimeter"].comment is None
    wanted = spark.createDataFrame([("a.go", "func:Area"), ("a.go", "func:Nope"), ("a.go", "bogus")],
                                   "path string, identifier string")
    found, missing = locate_units(units, wanted)
    assert [(r.identifier, r.line, r.col) for r in found.collect()] == [("func:Area", 4, 0)]
    errs = {r.identifier: r.error for r in missing.collect()}
    assert errs == {"func:Nope": "node not found: func:Nope", "bogus": "invalid identifier: bogus"}


def test_extract_by_rules(spark):
    src = spark.createDataFrame([("p", "html", '<a href="x">x</a><a href="y">'), ("q", "text", 'href="z"')],
                                "path string, language string, text string")
    rules = rules_table(spark, [("html", "link", 'href="([^"]*)"', 1)])
    got = sorted((r.path, r.identifier, r.pos) for r in extract_by_rules(src, rules, with_position=True).collect())
    assert got == [("p", "link:x", 0), ("p", "link:y", 1)]


def test_read_tree_and_table(spark):
    root = tempfile.mkdtemp(prefix="docquill-tree-")
    for rel, body in [("a.go", "package a"), ("sub/b.ts", "export const b = 1"), ("sub/c.md", "# c")]:
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(body)
    got = sorted((r.path, r.text) for r in read_tree(spark, root).collect())
    assert got == [("a.go", "package a"), ("sub/b.ts", "export const b = 1"), ("sub/c.md", "# c")]
    assert [r.path for r in read_tree(spark, root, glob="*.go").collect()] == ["a.go"]
    t = read_table(spark, "/root/testdata/sf0.001/documents.parquet", "doc_id", "text", language_col="lang")
    assert t.columns == ["path", "language", "text"] and t.count() == 200


def test_findings_reports(spark):
    f = spark.createDataFrame([("a.go", "func:B"), ("a.go", "func:A")], "path string, identifier string")
    j = findings_json(f).first()
    assert j.findings_json == '["func:A","func:B"]' and j.n_findings == 2
    assert sorted(r.value for r in findings_lines(f).collect()) == ["a.go@func:A", "a.go@func:B"]
    raw = spark.createDataFrame([("[\"x\"]",), ("not json",)], "j string")
    ok, bad = parse_findings(raw, "j")
    assert [r.identifiers for r in ok.collect()] == [["x"]] and bad.first().error.startswith("invalid findings JSON")
    pos = parse_position(spark.createDataFrame([('{"line": 3, "character": 4}',)], "j string"), "j").first()
    assert (pos.line, pos.col, pos.error) == (3, 4, None)


GROUPED = """package p

// Kinds of things.
type (
	// Reader is documented inside the group.
	Reader interface {
		Read() error
		// Close is documented.
		Close() error
		io.Writer
	}
	Point struct {
		X int
		Y int
	}
	ID string
)

type (
	Lone interface {
		Ping() bool
	}
)

var (
	Table = []int{
		1,
		2,
	}
	Other = map[string]int{"a": 1}
)

const (
	A = iota
	B
)
"""


def test_go_groups_nested_bodies_and_interfaces(spark):
    src = spark.createDataFrame([("g.go", GROUPED)], "path string, text string")
    u = units_of(go_units(src))
    assert sorted(u) == sorted(["type:Reader", "func:Reader.Read", "func:Reader.Close", "type:Point", "type:ID",
                                "type:Lone", "func:Lone.Ping", "var:Table", "var:Other", "var:A", "var:B"])
    # the documented group hides its specs and their methods
    assert u["type:Point"].documented and u["func:Reader.Read"].documented
    # an undocumented group: methods stay findable
    assert not u["func:Lone.Ping"].documented and not u["type:Lone"].documented
    assert u["func:Lone.Ping"].owner == "Lone" and u["func:Lone.Ping"].line == 20
    assert not u["var:Table"].documented and u["var:B"].line == 34


def test_bucketed_source_joins_without_moving_texts(spark):
    import io
    from contextlib import redirect_stdout

    from docquill.operators.patch import apply_edits
    from docquill.sources.tables import documents_source, save_bucketed

    src = documents_source(spark, "/root/testdata/sf0.001").select("path", "text")
    table = save_bucketed(src, "docquill_test_bucketed", tempfile.mkdtemp(prefix="docquill-bucket-"))
    edits = src.select("path", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("a").alias("identifier"),
                       F.lit("// x\n").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        preview, _ = apply_edits(table, edits)
        buf = io.StringIO()
        with redirect_stdout(buf):
            preview.explain("formatted")
        plan = buf.getvalue()
        # the bucketed side is scanned in place; only the edits are shuffled
        import re
        assert "Bucketed: true" in plan
        assert len(re.findall(r"^\(\d+\) Exchange\b", plan, flags=re.M)) == 1
        assert preview.where(F.col("after").startswith("// x\n")).count() == src.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
