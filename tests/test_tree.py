"""Reading and writing trees."""

import os

import pytest
from pyspark.sql import functions as F

from docquill.sources import tree
from docquill.sources.tables import read_tree, unreadable_files


@pytest.fixture()
def root(tmp_path):
    root = tmp_path / "in"
    for name, data in {"a.go": b"package a", "_x.go": b"x", ".hid.go": b"h", "sub/deep/b.ts": "ünï".encode(), "sub/bad.go": b"\xff\xfe",
                       "vendor/v.go": b"v", "vendor/in/w.go": b"w", "sub/vendor/u.go": b"u", "note.txt": b"n", "empty.go": b"",
                       "sp ace/c d.go": b"s"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def rows(df):
    return {r["path"]: (r["kind"], r["text"], r["error"]) for r in df.collect()}


def test_every_name_is_a_row(spark, root):
    os.symlink(root, root / "sub" / "loop")
    got = rows(tree.scan_tree(spark, str(root), exclude=["**/vendor"], exts=[".go", ".ts"]))
    assert got == {
        "a.go": ("file", "package a", None), "_x.go": ("file", "x", None), ".hid.go": ("file", "h", None),
        "sub/deep/b.ts": ("file", "ünï", None), "sub/bad.go": ("unreadable", None, "not UTF-8 text"),
        "vendor": ("pruned", None, "excluded"), "sub/vendor": ("pruned", None, "excluded"), "sub/loop": ("skipped", None, "link to a folder"),
        "note.txt": ("skipped", None, "extension"), "empty.go": ("file", "", None), "sp ace/c d.go": ("file", "s", None)}


def test_excluded_folders_are_never_listed(monkeypatch, root):
    listed, real = [], os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda p: (listed.append(os.path.relpath(p, root)), real(p))[1])
    for subtrees in (1, 64):        # tasks walk everything, or the planner does
        monkeypatch.setattr(tree, "SUBTREES", subtrees)
        listed.clear()
        reader = tree.TreeReader({"path": str(root), "exclude": "^(?:(?:[^/]*/)*vendor)$"})
        found = [r[0] for p in reader.partitions() for r in reader.read(p)]
        assert len(found) == len(set(found)) and sorted(listed) == [".", "sp ace", "sub", "sub/deep"]


def test_no_such_folder(spark, tmp_path):
    assert rows(tree.scan_tree(spark, str(tmp_path / "none")))[""][0] == "unreadable"


def test_read_tree_hides_no_name(spark, root):
    assert {r["path"] for r in read_tree(spark, f"file://{root}", glob="*.go").collect()} == {
        "a.go", "_x.go", ".hid.go", "vendor/v.go", "vendor/in/w.go", "sub/vendor/u.go", "empty.go", "sp ace/c d.go"}
    assert [(r["path"], r["error"]) for r in unreadable_files(spark, str(root)).collect()] == [("sub/bad.go", "not UTF-8 text")]


def files(spark, items):
    return spark.createDataFrame(items, "path string, text string").repartition(4)


def listing(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_round_trip(spark, tmp_path):
    items = [(f"d{k % 7}/_e/.f{k}.go", f"text {k}\n" * (k % 3)) for k in range(200)] + [("top", None)]
    out = str(tmp_path / "out")
    tree.write_tree(files(spark, items), out)
    assert rows(tree.scan_tree(spark, out)) == {p: ("file", t or "", None) for p, t in items}
    with pytest.raises(Exception, match="exists"):
        tree.write_tree(files(spark, items[:1]), out)
    tree.write_tree(files(spark, items[:3] * 2), out, overwrite=True)       # equal rows are one file
    assert listing(out) == sorted(p for p, _ in items[:3]) and os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("bad", ["../up", "/abs", "a/../../b", "a//b", "", None, "./a"])
def test_paths_that_leave_the_tree(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a path inside"):
        tree.write_tree(files(spark, [("ok", "1"), (bad, "2")]), str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_a_failed_task_leaves_the_target(spark, tmp_path):
    out = str(tmp_path / "out")
    tree.write_tree(files(spark, [("a", "old")]), out)
    failing = files(spark, [(f"f{k}", str(k)) for k in range(50)]).withColumn(
        "text", F.when(F.col("path") == "f37", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        tree.write_tree(failing, out, overwrite=True)
    with pytest.raises(Exception, match="two texts"):
        tree.write_tree(files(spark, [("same", "1"), ("same", "2")]), out, overwrite=True)
    assert listing(out) == ["a"] and os.listdir(tmp_path) == ["out"]


def test_never_over_its_input(spark, tmp_path):
    for out in (tmp_path, tmp_path / "in" / "x", tmp_path / "in"):
        with pytest.raises(ValueError, match="input location"):
            tree.write_tree(files(spark, [("a", "b")]), str(out), overwrite=True, source_location=f"file://{tmp_path}/in")
