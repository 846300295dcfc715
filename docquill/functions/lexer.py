"""Lexical tokens of Go and TypeScript texts, as native column expressions.

One compiled alternation cuts a text into tokens that cover it without a gap:
comments, literals, single brackets and the code between them. What stands in
a literal or a comment is then never taken for code. All loops of the pattern
are possessive, so a search is linear and needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+"
_STRING = r'"(?:[^"\\\n]++|\\(?s:.))*+"?+'
_RUNE = r"'(?:[^'\\\n]++|\\(?s:.))*+'?+"
_RAW_STRING = r"`[^`]*+`?+"
# A template literal; its ${} parts may hold braces and further templates, two deep.
_INNER = r"`(?:[^`\\]++|\\(?s:.))*+`"
_HOLE = r"\$\{(?:[^{}`]++|" + _INNER + r"|\{(?:[^{}`]++|" + _INNER + r")*+\})*+\}"
_TEMPLATE = r"`(?:[^`\\$]++|\\(?s:.)|" + _HOLE + r"|\$)*+`?+"
# A slash opens a pattern only where no operand stands before it.
_PATTERN = (r"(?<=[=(,:\[!&|?{};+\n][ \t]{0,16}|\breturn[ \t]{1,4}|\A[ \t]{0,16})"
            r"/(?![*/])(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+")
_BRACKET = r"[{}()\[\]]"

COMMENTS = {"go": [_LINE_COMMENT, _BLOCK_COMMENT], "ts": [_LINE_COMMENT, _BLOCK_COMMENT]}
LITERALS = {"go": [_RAW_STRING, _STRING, _RUNE], "ts": [_PATTERN, _TEMPLATE, _STRING, _RUNE]}


def tokens(text: Column, language: str, brackets: bool = True) -> Column:
    """The tokens of ``text`` in order; joined, they are the text. With
    ``brackets`` each bracket is a token of its own, else part of the code."""
    kinds = [*COMMENTS[language], *LITERALS[language]] + ([_BRACKET] if brackets else [])
    code = r"[^/\"'`{}()\[\]]++" if brackets else r"[^/\"'`]++"
    return F.regexp_extract_all(text, F.lit("|".join([*kinds, code, "(?s:.)"])), F.lit(0))


def code_parts(text: Column, language: str) -> Column:
    """The text cut at its literals only: literals, and code with its comments between them."""
    plain = "|".join([*COMMENTS[language], r"[^/\"'`]++"])
    slash = "/" + "".join(f"(?!{m})" for m in ("/", r"\*")) if language == "go" else f"(?!{_PATTERN})/"
    return F.regexp_extract_all(text, F.lit("|".join([*LITERALS[language], f"(?:{plain}|{slash})++", "(?s:.)"])), F.lit(0))


def is_comment(token: Column) -> Column:
    return F.startswith(token, F.lit("//")) | F.startswith(token, F.lit("/*"))


def is_literal(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return first.isin('"', "'", "`") | ((first == "/") & (F.length(token) > 1) & ~is_comment(token))


def _hollow(token: Column) -> Column:
    """A literal or comment with nothing but its marks and its line breaks."""
    breaks = F.regexp_replace(token, r"[^\n]+", "")
    quote = F.substring(token, 1, 1)
    return (F.when(F.startswith(token, F.lit("//")), F.lit("//"))
            .when(F.startswith(token, F.lit("/*")), F.concat(F.lit("/*"), breaks, F.when(F.endswith(token, F.lit("*/")) & (F.length(token) > 3), F.lit("*/")).otherwise("")))
            .otherwise(F.concat(quote, breaks, F.when(F.length(token) > 1, quote).otherwise(""))))


def hollow(text: Column, language: str) -> Column:
    """``text`` with the same lines, whose literals and comments are empty: what
    remains between their marks is code. Places before a line's first literal
    or comment stay the same."""
    each = F.transform(tokens(text, language, brackets=False), lambda t: F.when(is_comment(t) | is_literal(t), _hollow(t)).otherwise(t))
    return F.array_join(each, "")
