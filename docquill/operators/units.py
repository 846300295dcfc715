"""Extracting named units from texts.

Two forms:

* ``extract_by_rules``: rules (language, kind, pattern, group) meet texts by
  language, and each rule's matches are pulled with ``regexp_extract_all``.
* Line scans for conventionally formatted Go and TypeScript (``go_units``,
  ``ts_units``): the text is split into lines inside the row, every line is
  classified with regexes, and the context a declaration needs (the
  nearest non-blank line above, the enclosing block, brace depth) comes from
  one ``aggregate`` pass over the line array of the same row. Texts are never
  exploded across the cluster for this; only the units found are emitted.

The lines come from the text's tokens: literals and comments are emptied first
(``lexer.hollow``), so nothing inside them is taken for code, and brackets are
counted in code only.

Limits of line scans: declarations that start on one line and name what they
declare on another, several on one line, comments between a comment block and
its declaration, and non-standard indentation are approximated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions import lexer
from docquill.functions._util import col_of, explode_rows, fold
from docquill.functions.identifiers import is_exported


# --------------------------------------------------------------------------
# C4: rule table extraction


def rules_table(spark: SparkSession, rules) -> DataFrame:
    """``extract_rules(language, kind, pattern, grp)`` from a list of tuples."""
    return spark.createDataFrame(list(rules), "language string, kind string, pattern string, grp int")


def _tagger(kind: str):
    return lambda name, i: F.struct(F.lit(kind).alias("kind"), name.alias("name"), i.alias("pos"))


def extract_by_rules(source: DataFrame, rules, text: str = "text",
                     keys=("path",), with_position: bool = False) -> DataFrame:
    """C4: one row per match of any rule of the text's language.

    Output: keys, language, kind, name, identifier (``kind:name``) and, with
    ``with_position``, the match ordinal ``pos`` per (text, rule). A list of
    rules becomes one projection: per rule an array of its matches, chosen by
    the row's language, every pattern a literal that is compiled once. A table
    of rules, of any size, is grouped by language and joined on it.
    """
    keys = list(keys)
    cols = [F.col("m.kind").alias("kind"), F.col("m.name").alias("name")] + ([F.col("m.pos").alias("pos")] if with_position else [])
    if isinstance(rules, DataFrame):
        per_lang = rules.groupBy("language").agg(F.collect_list(F.struct("kind", "pattern", F.col("grp").cast("int").alias("grp"))).alias("_rules"))
        matches = F.flatten(F.transform("_rules", lambda r: F.transform(
            F.regexp_extract_all(F.col(text), r["pattern"], r["grp"]),
            lambda name, i: F.struct(r["kind"].alias("kind"), name.alias("name"), i.alias("pos")))))
        source = source.join(per_lang, "language")
    else:
        empty = F.array().cast("array<struct<kind:string,name:string,pos:int>>")
        per_rule = [F.when(F.col("language") == language, F.transform(
            F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(int(grp))), _tagger(kind)))
            for language, kind, pattern, grp in rules]
        matches = F.flatten(F.filter(F.array(*per_rule), lambda a: a.isNotNull())) if per_rule else empty
    ex = explode_rows(source, matches, [*keys, "language"], value="m")
    return ex.select(*keys, "language", *cols).withColumn("identifier", F.concat(F.col("kind"), F.lit(":"), F.col("name")))


# --------------------------------------------------------------------------
# Line classification helpers (shared by Go and TS scans)



def _lines(text: Column, language: str) -> Column:
    """The lines of a text, literals and comments emptied."""
    return F.split(lexer.hollow(text, language), "\n")


def _is_blank(l: Column) -> Column:
    return F.regexp_like(l, F.lit(r"^\s*$"))


def _comment_features(l: Column, opening: str, closing: str) -> list[Column]:
    """What a line says about comments and brackets, for both states that it
    can be read in: outside a block comment, and inside one."""
    outside = F.regexp_replace(l, r"/\*.*?\*/|//.*$|/\*.*$", "")
    inside = F.regexp_replace(F.regexp_replace(l, r"^.*?\*/", ""), r"/\*.*?\*/|//.*$|/\*.*$", "")
    ends = F.contains(l, F.lit("*/"))
    whole = F.regexp_like(outside, F.lit(r"^\s*$")) & ~_is_blank(l)
    count = lambda c, chars: F.regexp_count(c, F.lit("[" + chars + "]"))
    return [
        _is_blank(l).alias("blank"), whole.alias("whole"), ends.alias("ends"),
        F.regexp_like(inside, F.lit(r"^\s*$")).alias("whole_in"),
        F.regexp_like(F.regexp_replace(l, r"/\*.*?\*/|//.*$", ""), F.lit(r"/\*")).alias("starts"),
        count(outside, opening).alias("o"), count(outside, closing).alias("c"),
        F.when(ends, count(inside, opening)).otherwise(0).alias("o_in"),
        F.when(ends, count(inside, closing)).otherwise(0).alias("c_in"),
    ]


def _comment_state(acc, f):
    """(line is a comment, opens, closes, in a block comment after the line)."""
    inside = acc["in_block"]
    comment = F.when(inside, ~f["ends"] | f["whole_in"]).otherwise(f["whole"])
    return (comment, F.when(inside, f["o_in"]).otherwise(f["o"]), F.when(inside, f["c_in"]).otherwise(f["c"]),
            F.when(inside, ~f["ends"]).otherwise(f["starts"]))


def _scan(lines: Column, features, unit_t: str, start: dict[str, Column], step) -> Column:
    """``fold`` over lines, with the state of the comment lines above."""
    return fold(lines, features, unit_t, {"in_block": F.lit(False), "comment_start": F.lit(-1), "prev_comment": F.lit(False)} | start, step)


def _comment_run(acc, comment: Column, blank: Column, in_block: Column, i: Column) -> dict[str, Column]:
    """State of the comment lines directly above the next line."""
    start = F.when(comment, F.when(acc["comment_start"] >= 0, acc["comment_start"]).otherwise(i)).otherwise(F.lit(-1))
    return {"in_block": in_block, "comment_start": start.cast("int"),
            "prev_comment": F.when(blank & ~comment, acc["prev_comment"]).otherwise(comment)}


# --------------------------------------------------------------------------
# Go

_GO_FUNC = r"^func\s+(?:\(\s*(?:\w+\s+)?(\*?)\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)"
_GO_TYPE_SINGLE = r"^type\s+(\w+)"
_GO_VAR_SINGLE = r"^(?:var|const)\s+(\w+)"
_GO_GROUP_OPEN = r"^(var|const|type)\s*\(\s*$"
_GO_SPEC = r"^\s+([A-Za-z_]\w*)"
_GO_IFACE_OPEN = r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\s*\{\s*$"
_GO_SPEC_IFACE = r"^\s+(\w+)(?:\[[^\]]*\])?\s+interface\s*\{\s*$"
_GO_IFACE_METHOD = r"^\s+(\w+)\s*\("


def go_units(source: DataFrame, text: str = "text", keys=("path",)) -> DataFrame:
    """C1+C2: Go units found by a line scan.

    One row per unit: keys, identifier, kind, owner, name, line, col,
    exported, documented, enclosing_documented. ``documented`` is true when
    the nearest non-blank line above is a comment, or when the enclosing
    declaration is documented: a ``var (``/``const (``/``type (`` group, or a
    singly declared interface for its methods. Methods of an interface
    declared inside a ``type (`` group are reported unless the group itself
    is documented; embedded interfaces are skipped. Inside a group, nested
    bodies (struct fields, multi-line values) are tracked by bracket depth and
    never read as specs.
    """
    keys = list(keys)
    unit_t = ("struct<identifier:string,kind:string,owner:string,name:string,line:int,col:int,comment_from:int,"
              "documented:boolean,enclosing_documented:boolean>")
    start = {
        "block": F.lit(""),              # '', 'var', 'const' or 'type' (open group)
        "block_doc": F.lit(False),       # the group's declaration is documented
        "gdepth": F.lit(0),              # bracket depth inside the group
        "iface": F.lit(""),              # interface whose methods are being read
        "iface_doc": F.lit(False),       # its declaration hides its methods
    }

    def unit(ident, kind, owner, name, i, col, documented, enc, above):
        return F.struct(ident.alias("identifier"), kind.alias("kind"), owner.cast("string").alias("owner"),
                        name.alias("name"), i.cast("int").alias("line"), col.cast("int").alias("col"),
                        above.cast("int").alias("comment_from"), documented.alias("documented"),
                        enc.alias("enclosing_documented"))

    def features(l):
        return F.struct(
            *_comment_features(l, "{(\\[", "})\\]"),
            F.regexp_like(l, F.lit(r"^\}")).alias("close_brace"),
            F.regexp_like(l, F.lit(r"^\)")).alias("close_paren"),
            F.regexp_like(l, F.lit(_GO_FUNC)).alias("func_m"),
            F.regexp_extract(l, _GO_FUNC, 1).alias("recv_ptr"),
            F.regexp_extract(l, _GO_FUNC, 2).alias("recv"),
            F.regexp_extract(l, _GO_FUNC, 3).alias("fname"),
            F.regexp_extract(l, _GO_GROUP_OPEN, 1).alias("group_m"),
            F.regexp_extract(l, _GO_IFACE_OPEN, 1).alias("iface_top"),
            F.regexp_extract(l, _GO_SPEC_IFACE, 1).alias("iface_spec"),
            F.regexp_extract(l, _GO_TYPE_SINGLE, 1).alias("type_m"),
            F.regexp_extract(l, _GO_VAR_SINGLE, 1).alias("var_m"),
            F.regexp_extract(l, _GO_SPEC, 1).alias("spec_m"),
            F.regexp_extract(l, _GO_IFACE_METHOD, 1).alias("meth_m"),
            F.length(F.regexp_extract(l, r"^\s*", 0)).alias("indent"),
        )

    def step(acc, f, i):
        blank = f["blank"]
        comment, opens, closes, in_block = _comment_state(acc, f)
        above = F.when(acc["comment_start"] >= 0, acc["comment_start"]).otherwise(i)
        in_group = acc["block"] != ""
        top = ~in_group & (acc["iface"] == "") & ~acc["in_block"]
        in_top_iface = ~in_group & (acc["iface"] != "")
        top_iface_close = in_top_iface & f["close_brace"]
        group_close = in_group & (acc["gdepth"] == 0) & f["close_paren"]
        at_spec = in_group & (acc["gdepth"] == 0) & ~group_close & ~blank & ~comment
        in_method_zone = (in_top_iface & ~top_iface_close) | (in_group & (acc["iface"] != "") & (acc["gdepth"] == 1))
        func_m, recv_ptr, recv, fname = f["func_m"], f["recv_ptr"], f["recv"], f["fname"]
        func_path = F.when(recv == "", fname).when(recv_ptr == "*", F.concat(F.lit("(*"), recv, F.lit(")."), fname)) \
            .otherwise(F.concat(recv, F.lit("."), fname))
        group_m, iface_top, iface_spec = f["group_m"], f["iface_top"], f["iface_spec"]
        type_m, var_m, spec_m, meth_m, indent = f["type_m"], f["var_m"], f["spec_m"], f["meth_m"], f["indent"]
        doc = acc["prev_comment"]
        none = F.lit(None).cast("string")
        method_enc = F.when(in_group, acc["block_doc"]).otherwise(acc["iface_doc"])
        new_unit = (
            F.when(top & func_m, unit(F.concat(F.lit("func:"), func_path), F.lit("func"),
                                      F.when(recv != "", recv), fname, i, F.lit(0), doc, F.lit(False), above))
            .when(top & (group_m == "") & (type_m != ""),
                  unit(F.concat(F.lit("type:"), type_m), F.lit("type"), none, type_m, i, F.lit(0), doc, F.lit(False), above))
            .when(top & (group_m == "") & (var_m != ""),
                  unit(F.concat(F.lit("var:"), var_m), F.lit("var"), none, var_m, i, F.lit(0), doc, F.lit(False), above))
            .when(at_spec & acc["block"].isin("var", "const") & (spec_m != ""),
                  unit(F.concat(F.lit("var:"), spec_m), F.lit("var"), none, spec_m, i, indent, doc, acc["block_doc"], above))
            .when(at_spec & (acc["block"] == "type") & (spec_m != ""),
                  unit(F.concat(F.lit("type:"), spec_m), F.lit("type"), none, spec_m, i, indent, doc, acc["block_doc"], above))
            .when(in_method_zone & ~blank & ~comment & (meth_m != ""),
                  unit(F.concat(F.lit("func:"), acc["iface"], F.lit("."), meth_m), F.lit("func"), acc["iface"],
                       meth_m, i, indent, doc, method_enc, above))
        )
        new_gdepth = F.when(top & (group_m != ""), F.lit(0)).when(group_close, F.lit(0)) \
            .when(in_group, acc["gdepth"] + opens - closes).otherwise(F.lit(0))
        block = F.when(group_close, F.lit("")).when(top & (group_m != ""), group_m).otherwise(acc["block"])
        block_doc = F.when(top & (group_m != ""), doc).when(group_close, F.lit(False)).otherwise(acc["block_doc"])
        iface = (F.when(top & (iface_top != ""), iface_top)
                 .when(top_iface_close, F.lit(""))
                 .when(at_spec & (iface_spec != ""), iface_spec)
                 .when(in_group & (acc["iface"] != "") & (new_gdepth <= 0), F.lit(""))
                 .when(group_close, F.lit(""))
                 .otherwise(acc["iface"]))
        iface_doc = (F.when(top & (iface_top != ""), doc)
                     .when(at_spec & (iface_spec != ""), acc["block_doc"])
                     .otherwise(acc["iface_doc"]))
        return new_unit, _comment_run(acc, comment, blank, in_block, i) | {
            "block": block, "block_doc": block_doc, "gdepth": new_gdepth.cast("int"), "iface": iface, "iface_doc": iface_doc}

    found = _scan(_lines(F.col(text), "go"), features, unit_t, start, step)
    out = explode_rows(source, found, keys, value="u").select(*keys, "u.*")
    # a multi-name spec yields its first name only: the regex takes the first word.
    out = out.withColumn("exported", is_exported(F.col("identifier")))
    return out.withColumn("documented", F.col("documented") | F.col("enclosing_documented"))


# --------------------------------------------------------------------------
# TypeScript

_TS_DECL = (r"^export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
            r"(function\*?|class|interface|type|const|let|var|enum)\s+(\w+)")
_TS_MEMBER = (r"^\s+((?:(?:public|private|protected|static|readonly|abstract|async|override|declare)\s+)*)"
              r"(#?[\w$]+)\s*(\??)\s*([(<:=;])")


def ts_units(source: DataFrame, text: str = "text", keys=("path",)) -> DataFrame:
    """Exported TypeScript declarations and the public members of
    exported classes, interfaces and type literals, found by a line scan with brace depth.

    Kinds: var (first name of a const/let/var statement), func, class, iface,
    type, method, prop. Nothing inside function bodies is reported. Columns as
    ``go_units`` plus ``public``.
    """
    keys = list(keys)
    unit_t = ("struct<identifier:string,kind:string,owner:string,name:string,line:int,col:int,comment_from:int,"
              "documented:boolean,public:boolean>")
    start = {
        "depth": F.lit(0),
        "owner": F.lit(""),          # exported class, interface or type whose body we are in
        "owner_depth": F.lit(-1),
    }

    def features(l):
        kw = F.regexp_extract(l, _TS_DECL, 1)
        return F.struct(
            *_comment_features(l, "{(\\[", "})\\]"),
            (F.when(kw.isin("function", "function*"), F.lit("func"))
             .when(kw == "class", F.lit("class"))
             .when(kw == "interface", F.lit("iface"))
             .when(kw == "type", F.lit("type"))
             .when(kw.isin("const", "let", "var"), F.lit("var"))).alias("kind"),
            F.regexp_extract(l, _TS_DECL, 2).alias("nm"),
            F.regexp_extract(l, _TS_MEMBER, 1).alias("mods"),
            F.regexp_extract(l, _TS_MEMBER, 2).alias("mname"),
            F.regexp_extract(l, _TS_MEMBER, 4).alias("after"),
            F.regexp_like(l, F.lit(r"^\s*(?:if|for|while|return|switch)\b")).alias("statement"),
            F.length(F.regexp_extract(l, r"^\s*", 0)).alias("col"),
        )

    def step(acc, f, i):
        blank = f["blank"]
        comment, opens, closes, in_block = _comment_state(acc, f)
        above = F.when(acc["comment_start"] >= 0, acc["comment_start"]).otherwise(i)
        depth = acc["depth"]
        kind, nm = f["kind"], f["nm"]
        top_decl = (depth == 0) & kind.isNotNull() & ~acc["in_block"]
        in_owner = (acc["owner"] != "") & (depth == acc["owner_depth"] + 1)
        mods, mname, after = f["mods"], f["mname"], f["after"]
        is_member = in_owner & (mname != "") & ~comment & ~f["statement"]
        is_method = is_member & (after.isin("(", "<")) & (mname != "constructor")
        is_prop = is_member & after.isin(":", "=", ";")
        public = ~(mname.startswith("#") | F.regexp_like(mods, F.lit(r"\b(?:private|protected)\b")))
        col = f["col"]
        doc = acc["prev_comment"]

        def unit(ident, k, owner, name, pub):
            return F.struct(ident.alias("identifier"), k.alias("kind"), owner.cast("string").alias("owner"),
                            name.alias("name"), i.cast("int").alias("line"), col.cast("int").alias("col"),
                            above.cast("int").alias("comment_from"), doc.alias("documented"), pub.alias("public"))

        new_unit = (
            F.when(top_decl, unit(F.concat(kind, F.lit(":"), nm), kind, F.lit(None), nm, F.lit(True)))
            .when(is_method, unit(F.concat(F.lit("method:"), acc["owner"], F.lit("."), mname),
                                  F.lit("method"), acc["owner"], mname, public))
            .when(is_prop, unit(F.concat(F.lit("prop:"), acc["owner"], F.lit("."), mname),
                                F.lit("prop"), acc["owner"], mname, public))
        )
        new_depth = depth + opens - closes
        opens_owner = top_decl & kind.isin("class", "iface", "type") & (opens > closes)
        owner = (F.when(opens_owner, nm)
                 .when((acc["owner"] != "") & (new_depth <= acc["owner_depth"]), F.lit(""))
                 .otherwise(acc["owner"]))
        owner_depth = F.when(opens_owner, depth).when(owner == "", F.lit(-1)).otherwise(acc["owner_depth"])
        return new_unit, _comment_run(acc, comment, blank, in_block, i) | {
            "depth": new_depth.cast("int"), "owner": owner, "owner_depth": owner_depth.cast("int")}

    found = _scan(_lines(F.col(text), "ts"), features, unit_t, start, step)
    return explode_rows(source, found, keys, value="u").select(*keys, "u.*")


# --------------------------------------------------------------------------
# Existing comments and positions


def existing_comment(source: DataFrame, units: DataFrame, text: str = "text", keys=("path",),
                     strip_markers: bool = True) -> DataFrame:
    """The comment block directly above each unit (NULL if none), and the
    line where it starts (``comment_from``; equals ``line`` when none).

    ``units`` with a ``comment_from`` column, as the scans give it, need no
    further look at the lines; else it is taken from a scan of the unit's
    language (``path`` and ``line`` decide). The units of a text are joined to
    it as one array, so a text is copied once, whatever its number of units.
    """
    keys = list(keys)
    if "comment_from" not in units.columns:
        texts = source.select(*keys, text)
        every = go_units(texts, text, keys).select(*keys, "line", "comment_from").unionByName(
            ts_units(texts, text, keys).select(*keys, "line", "comment_from"))
        units = units.join(every.groupBy(*keys, "line").agg(F.min("comment_from").alias("comment_from")), [*keys, "line"], "left")
        units = units.withColumn("comment_from", F.coalesce("comment_from", "line"))
    own = [c for c in units.columns if c not in keys]
    grouped = units.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_units"))
    j = source.select(*keys, F.split(text, "\n").alias("_lines")).join(grouped, keys)
    lines = F.col("_lines")

    def comment_of(u):
        block = F.slice(lines, u["comment_from"] + 1, u["line"] - u["comment_from"])
        if strip_markers:
            block = F.transform(block, lambda l: F.regexp_replace(
                l, r"^\s*\*/\s*$|^\s*(?://+ ?|/\*\*? ?|\*(?!/) ?)|\s*\*/\s*$", ""))
            block = F.filter(block, lambda l: F.length(F.trim(l)) > 0)
        return F.when(u["comment_from"] < u["line"], F.array_join(block, "\n"))

    rows = F.transform("_units", lambda u: F.struct(u.alias("u"), comment_of(u).alias("comment")))
    out = explode_rows(j, rows, keys, value="r")
    return out.select(*keys, *[F.col(f"r.u.{c}").alias(c) for c in own], "r.comment").select(*units.columns, "comment")


def locate_units(units: DataFrame, wanted: DataFrame, keys=("path", "identifier")) -> tuple[DataFrame, DataFrame]:
    """Line and column of each wanted identifier (first match by line);
    ``left_anti`` gives those not found. Invalid kinds are reported as errors."""
    from docquill.functions.identifiers import valid_identifier
    keys = list(keys)
    first = units.groupBy(*keys).agg(F.min_by(F.struct("line", "col"), F.col("line")).alias("pos"))
    found = wanted.join(first, keys, "inner").select(*wanted.columns, "pos.line", "pos.col")
    missing = wanted.join(first, keys, "left_anti").withColumn(
        "error", F.when(~valid_identifier(F.col("identifier")), F.concat(F.lit("invalid identifier: "),
                                                                       F.col("identifier")))
        .otherwise(F.concat(F.lit("node not found: "), F.col("identifier"))))
    return found, missing


# --------------------------------------------------------------------------
# Comments of declarations


def clear_comments(text) -> Column:
    """Go code without the comments of its package clause, declarations
    and the specs of ``var``, ``const`` and ``type`` groups. Comments inside
    bodies, after code, and in raw strings stay."""
    def features(l):
        code = F.regexp_replace(l, r"/\*.*?\*/|//.*$|/\*.*$", "")
        return F.struct(*_comment_features(l, "{(", "})"), l.alias("line"),
                        (F.regexp_count(code, F.lit("`")) % 2 == 1).alias("tick"),
                        F.regexp_like(l, F.lit(r"^(?:var|const|type)\s*\(\s*$")).alias("group"))

    def step(acc, f, i):
        comment, opens, closes, in_block = _comment_state(acc, f)
        raw = acc["raw"]
        depth = F.when(raw, acc["depth"]).otherwise(acc["depth"] + opens - closes)
        drop = comment & ~raw & ((acc["depth"] == 0) | (acc["group"] & (acc["depth"] == 1)))
        state = _comment_run(acc, comment, f["blank"], F.when(raw, F.lit(False)).otherwise(in_block), i)
        return F.when(~drop, f["line"]), state | {
            "depth": depth.cast("int"), "raw": F.when(f["tick"], ~raw).otherwise(raw),
            "group": F.when(acc["depth"] == 0, f["group"]).otherwise(acc["group"])}

    start = {"depth": F.lit(0), "raw": F.lit(False), "group": F.lit(False)}
    return F.array_join(_scan(F.split(col_of(text), "\n"), features, "string", start, step), "\n")
