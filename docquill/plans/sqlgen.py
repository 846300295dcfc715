"""DuckDB SQL snippets for the oracle queries.

Each helper returns SQL text computing the same value as the matching
column function, written independently with DuckDB list lambdas and RE2
regexes (no look-around). Used only to build ``oracle_sql()``.
"""

from __future__ import annotations

NL = "chr(10)"


def lit(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)`` pieces."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")"


def render(template: str, slots: dict[str, str]) -> str:
    """Template with ``{slot}`` markers as a SQL concatenation."""
    out = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i) if i >= 0 else -1
        if i < 0 or j < 0 or rest[i + 1:j] not in slots:
            out.append(lit(rest))
            break
        if i > 0:
            out.append(lit(rest[:i]))
        out.append("(" + slots[rest[i + 1:j]] + ")")
        rest = rest[j + 1:]
    return "(" + " || ".join(out) + ")"


def n_tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '\\S+')) AS BIGINT)"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\"'' ')"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def reflow(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, {NL} || {NL}), "
            f"lambda p: replace(replace(p, {NL}, ' '), '  ', ' ')), {NL} || {NL})")


def wrap_line(l: str, width: int) -> str:
    """Greedy byte-width wrap of one line; lines joined by newline."""
    return (f"list_reduce(regexp_extract_all({l}, '\\S+'), lambda acc, x: CASE "
            f"WHEN strlen(regexp_extract(acc, '[^\\n]*$')) + strlen(x) >= {width} THEN acc || {NL} || x "
            f"WHEN acc = '' THEN x ELSE acc || ' ' || x END, '')")


def wrap(x: str, width: int) -> str:
    return f"array_to_string(list_transform(string_split({x}, {NL}), lambda l: {wrap_line('l', width)}), {NL})"


def line_comment(x: str, width: int = 77) -> str:
    w = wrap(reflow(f"replace({x}, '// ', '')"), width)
    return f"array_to_string(list_transform(string_split({w}, {NL}), lambda l: '// ' || l), {NL})"


def para_lines(p: str, max_len: int) -> str:
    """Single-space split wrap by characters; all but the last line keep a
    trailing space, the last is trimmed. Lines joined by newline. Lines are
    separated by chr(30) while building, as words may hold newlines."""
    step = (f"list_reduce(string_split({p}, ' '), lambda acc, x: CASE "
            f"WHEN length(regexp_extract(acc, '[^\\x1e]*$')) + length(x) > {max_len} THEN acc || chr(30) || x || ' ' "
            f"ELSE acc || x || ' ' END, '')")
    last_trimmed = f"regexp_replace({step}, '(^|\\x1e)\\s*([^\\x1e]*?)\\s*$', '\\1\\2')"
    return f"replace({last_trimmed}, chr(30), {NL})"


def wrap_paragraphs(x: str, max_len: int) -> str:
    return (f"array_to_string(list_transform(string_split({x}, {NL} || {NL}), "
            f"lambda p: {para_lines('p', max_len)}), {NL} || {NL})")
