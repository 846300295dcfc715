"""Quality rules: a short-circuit cascade of document rules [native].

Every rule is a predicate over a few counts of the whole text. ``order_rules``
estimates each rule's cost (seconds on a sample) and selectivity (share of the
sample that it rejects) and sorts the rules by rejection per cost;
``cascade`` evaluates them in that order and stops at the first that rejects.
The verdict is the same for every order, so the sample affects speed only.

Defined results: a null text counts as empty (no words, rejected by the first
rule); ids may be null, repeated or tied, each row is judged on its own; an
empty table gives an empty result; other columns of the input are kept out of
``measure`` and kept unchanged by ``kept_documents``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions._util import bind, filter_computed
from docquill.llm.common import read, saved

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS = 2000          # bound of the sample that orders the rules


def words_of(text: Column) -> Column:
    """The runs of characters other than the six ASCII spaces."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside any ``width``-word window that the text holds twice or more.

    Window hashes are sorted with their positions, so equal windows are
    neighbours; the covered words are summed over the sorted positions.
    Sorting keeps it at n log n for a text of one repeated word too.
    """
    def covered(pos):
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(pos, start, lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")), lambda a: a["n"])

    def equal_neighbours(s):
        found = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return bind(F.array_sort(F.transform(found, lambda x: x["i"])), covered)

    def windows(wh):
        win = F.transform(F.sequence(F.lit(1), F.size(wh) - (width - 1)),
                          lambda i: F.xxhash64(F.slice(wh, i, F.lit(width))))
        return bind(win, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            bind(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), equal_neighbours)))

    return bind(F.transform(words, lambda w: F.xxhash64(w)),
                lambda wh: F.when(F.size(wh) <= width, F.lit(0)).otherwise(windows(wh))).cast("bigint")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")


@dataclass(frozen=True)
class Rule:
    """A named rejection: counts needed, and a predicate over them."""
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


# Counts by name, as expressions over the text and its words.
COUNTS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("bigint"),
    "word_chars": lambda t, w: F.char_length(F.array_join(w, "")).cast("bigint"),
    "n_symbols": lambda t, w: F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"),
    "n_lines": lambda t, w: F.size(lines_with_words(t)).cast("bigint"),
    "n_dup_lines": lambda t, w: bind(lines_with_words(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    "n_repeat_words": lambda t, w: repeated_words(w),
}

BASE_RULES = [
    Rule("few_words", ("n_words",), lambda c: c["n_words"] < 20),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
]
MORE_RULES = [
    Rule("symbols", ("n_words", "n_symbols"), lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    Rule("word_length", ("n_words", "word_chars"),
         lambda c: (c["word_chars"] > 15 * c["n_words"]) | (c["word_chars"] < 2 * c["n_words"])),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda c: 2 * c["n_dup_lines"] > c["n_lines"]),
]
RULES = BASE_RULES + MORE_RULES


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text",
                rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, best first, as found on a sample.

    The sample is a random share of all rows of about ``rows`` rows. Each rule
    runs alone over it, twice; its cost is the faster run, code already
    compiled, less that of a run without a rule (the job and the words, which
    all rules share). Without rows the given order stays.
    """
    n = docs.count()
    if not n:
        return list(rules)
    sample = saved(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                   .sample(fraction=min(1.0, rows / n), seed=7))
    t, w = F.col("text"), words_of(F.col("text"))

    def timed(bad):
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            got = sample.agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n")).first()
            best = min(best, time.perf_counter() - began)
        return got["bad"] / max(1, got["n"]), best

    _, bare = timed(F.size(w) < 0)
    worth = []
    for k, rule in enumerate(rules):
        share, seconds = timed(rule.rejects({c: COUNTS[c](t, w) for c in rule.needs}))
        worth.append((-share / max(seconds - bare, 1e-3), k))
    return [rules[k] for _, k in sorted(worth)]


def cascade(text: Column, rules: list[Rule]) -> Column:
    """True if no rule rejects; a rule's counts are made only if all before it passed."""
    def verdict(w):
        out, first = None, True
        for rule in rules:
            bad = rule.rejects({c: COUNTS[c](text, w) for c in rule.needs})
            out = F.when(bad, F.lit(False)) if first else out.when(bad, F.lit(False))
            first = False
        return F.lit(True) if out is None else out.otherwise(F.lit(True))
    return bind(words_of(text), verdict)


def measure(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All counts and both verdicts per row: (id, counts, base_failed, kept). A
    row that fails the base is judged; the others go through the cascade of the
    other ``rules``, which makes a rule's counts only where none before it rejects."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.select(id_col, "_text", words_of(F.col("_text")).alias("_words"))
    d = d.select(id_col, "_text", *[make(F.col("_text"), F.col("_words")).alias(c) for c, make in COUNTS.items()])
    counts = {c: F.col(c) for c in COUNTS}
    base = BASE_RULES[0].rejects(counts) | BASE_RULES[1].rejects(counts)
    judged = cascade(F.col("_text"), [r for r in rules if r not in BASE_RULES])
    return d.select(id_col, *COUNTS, base.alias("base_failed"), F.when(base, F.lit(False)).otherwise(judged).alias("kept"))


def kept_documents(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that every rule keeps, all columns unchanged. The rules run as
    a cascade in the order found on a sample, unless an order is given."""
    rules = order_rules(docs, text_col=text_col) if rules is None else rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    return filter_computed(docs, cascade(text, rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return measure(docs, order_rules(docs))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""
