"""Identifiers of extracted units: ``kind:name`` or ``kind:Owner.name``.

Parsing, formatting, validity and the exported rule are column expressions;
invalid identifiers produce an ``error`` string rather than an exception so
they can be routed to a dead-letter table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquill.functions._util import bind, col_of

# The seven symbol kinds, those that carry an owner, and the
# five kinds the annotate command looks for by default.
KINDS = ["var", "func", "class", "iface", "method", "prop", "type"]
OWNED_KINDS = ["method", "prop"]
DEFAULT_KINDS = ["var", "func", "class", "iface", "method"]


def _second_part(c: Column, sep: str) -> Column:
    """Text between the first and second ``sep``; the whole text if there is none."""
    return F.when(F.instr(c, sep) > 0, F.split_part(c, F.lit(sep), F.lit(2))).otherwise(c)


def parse_identifier(c) -> Column:
    """STRUCT<kind, path, owner, name, error>.

    ``kind`` is the text before the first colon and ``path`` the text up to
    the next one. Methods and properties split ``path`` at the first dot into
    owner and name; both must be non-empty. Unknown kinds are errors.
    """
    c = col_of(c)
    kind = F.split_part(c, F.lit(":"), F.lit(1))
    path = F.split_part(c, F.lit(":"), F.lit(2))
    owned = kind.isin(OWNED_KINDS)
    owner = F.when(owned, F.split_part(path, F.lit("."), F.lit(1)))
    name = F.when(owned, F.split_part(path, F.lit("."), F.lit(2))).otherwise(path)
    error = (
        F.when((kind == "") | (path == ""), F.concat(F.lit("invalid identifier: "), c))
        .when(~kind.isin(KINDS), F.concat(F.lit("unknown kind: "), c))
        .when(owned & ((owner == "") | (name == "")), F.concat(F.lit("invalid owned identifier: "), c))
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, kind).alias("kind"),
        F.when(ok, path).alias("path"),
        F.when(ok, owner).alias("owner"),
        F.when(ok, name).alias("name"),
        error.alias("error"),
    )


def format_identifier(kind, owner, name) -> Column:
    """Inverse of ``parse_identifier`` (no stray space after ``func:``)."""
    kind, owner, name = col_of(kind), col_of(owner), col_of(name)
    path = F.when(kind.isin(OWNED_KINDS), F.concat(owner, F.lit("."), name)).otherwise(name)
    return F.concat(kind, F.lit(":"), path)


def valid_identifier(c) -> Column:
    """True for identifiers that start with one of the seven kind prefixes."""
    return F.regexp_like(col_of(c), F.lit("^(" + "|".join(KINDS) + "):"))


def is_exported(c) -> Column:
    """Take the text after the first colon, then after the first dot. It is
    exported when it is non-empty, not ``_``, and its first byte is unchanged
    by upper-casing: an ASCII byte that is not a lower-case letter. Names that
    start with a multi-byte character are not exported."""
    def rule(name):
        first = F.substring(name, 1, 1)
        return (
            (F.length(name) > 0)
            & (name != "_")
            & (F.octet_length(first) == 1)
            & ~first.between("a", "z")
        )
    # Bound, as lambdas get no common subexpression elimination.
    return bind(_second_part(col_of(c), ":"), lambda path: bind(_second_part(path, "."), rule))


def _quote(c: Column) -> Column:
    """Double-quote a string, escaping backslashes, quotes, newlines, tabs
    and carriage returns (other control characters are left as they are)."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for ch, rep in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def short_name(c) -> Column:
    """Name without kind and owner: ``method:A.b`` gives ``b``."""
    c = col_of(c)
    parts = F.split(c, ":")
    path = F.when(F.size(parts) == 2, F.get(parts, 1)).otherwise(c)
    segs = F.split(path, r"\.")
    return F.when(F.size(segs) == 2, F.get(segs, 1)).otherwise(path)


def target_phrase(c, language) -> Column:
    """How a prompt names its target, per language.

    Go: ``function "f()"``, ``type "T"``, ``variable "v"``; other kinds print
    the quoted identifier. TypeScript adds class, interface (``iface`` or
    ``interface``), method and property with their owner; other kinds print
    the identifier as is. Anything without exactly one colon prints as is.
    """
    c = col_of(c)
    language = col_of(language) if not isinstance(language, str) or language not in ("go", "ts") else F.lit(language)
    parts = F.split(c, ":")
    one_colon = F.size(parts) == 2
    kind = F.get(parts, 0)
    path = F.get(parts, 1)
    segs = F.split(path, r"\.")
    owned = F.size(segs) == 2
    name = F.when(owned, F.get(segs, 1)).otherwise(path)
    owner = F.when(owned, F.get(segs, 0))
    go = (
        F.when(kind == "func", F.concat(F.lit('function "'), path, F.lit('()"')))
        .when(kind == "type", F.concat(F.lit("type "), _quote(path)))
        .when(kind == "var", F.concat(F.lit("variable "), _quote(path)))
        .otherwise(_quote(c))
    )
    ts = (
        F.when(kind == "var", F.concat(F.lit("variable "), _quote(name)))
        .when(kind == "class", F.concat(F.lit("class "), _quote(name)))
        .when(kind.isin("iface", "interface"), F.concat(F.lit("interface "), _quote(name)))
        .when(kind == "func", F.concat(F.lit('function "'), name, F.lit('()"')))
        .when(kind == "method", F.concat(F.lit("method "), _quote(name), F.lit(" of "), _quote(owner)))
        .when(kind == "prop", F.concat(F.lit("property "), _quote(name), F.lit(" of "), _quote(owner)))
        .when(kind == "type", F.concat(F.lit("type "), _quote(name)))
        .otherwise(c)
    )
    phrase = F.when(language == "ts", ts).otherwise(go)
    return F.when(one_colon, phrase).otherwise(c)
