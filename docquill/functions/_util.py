"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def explode_rows(df, arr: Column, keep, pos: str | None = None, value: str = "value"):
    """Rows of ``arr`` per input row (none for an empty or NULL array).

    Uses ``posexplode_outer`` and drops the padding row by its position.
    A plain ``explode`` makes the optimizer infer ``size(arr) > 0`` and push
    it below the projections that build ``arr``, which re-evaluates the whole
    (possibly regex-heavy) expression a second time.
    """
    p = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(arr).alias(p, value)).where(F.col(p).isNotNull())
    return out if pos else out.drop(p)


def filter_computed(df, cond: Column):
    """``df.where(cond)`` for a condition on columns that are costly to
    compute (regex ladders, line scans, edit application).

    A plain filter is pushed below the projection that computes those
    columns, so they would be evaluated twice (in the filter and again in the
    projection). Routing the condition through a generator keeps it above.
    """
    tmp = df.select("*", F.posexplode_outer(F.when(cond, F.array(F.lit(True)))).alias("_fk", "_fv"))
    return tmp.where(F.col("_fk").isNotNull()).drop("_fk", "_fv")


def bind(expr: Column, fn):
    """Evaluate ``expr`` once and pass the value to ``fn`` (a let-binding made
    of a one-element ``transform``). Inside a lambda an outer expression is
    re-evaluated at every call; a bound value is not."""
    return F.get(F.transform(F.array(expr), fn), 0)


# Items that one inner fold takes.
_CHUNK = 256


def fold(items: Column, features, unit_t: str, start: dict[str, Column], step) -> Column:
    """Left fold over the lines or tokens of a text; the array of units (``unit_t``) found.

    ``features(item)`` returns a STRUCT of the item's regex tests; it is
    evaluated once per item in a ``transform`` (lambdas get no common
    subexpression elimination, so tests used in several branches of the fold
    would otherwise run repeatedly). ``step(acc, f, i)`` only combines those
    fields with the running state and returns (unit or NULL, new state).

    A fold copies its whole state at every step. So an inner fold gathers the
    units of ``_CHUNK`` items, and an outer one appends them to all units once
    per chunk.
    """
    none = F.array().cast(f"array<{unit_t}>")
    state = lambda units, s: F.struct(units.alias("units"), *[s[c].alias(c) for c in start])

    def one(acc, p):
        unit, now = step(acc, p["f"], p["i"])
        new = F.filter(F.array(unit), lambda u: u.isNotNull())
        return state(F.concat(acc["units"], new), now)

    def all_items(pairs):
        def chunk(acc, k):
            found = F.aggregate(F.slice(pairs, k * _CHUNK + 1, F.lit(_CHUNK)), state(none, acc), one)
            return bind(found, lambda r: state(F.concat(acc["units"], r["units"]), r))
        chunks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int"))
        return F.aggregate(chunks, state(none, start), chunk, lambda acc: acc["units"])

    def numbered(found):
        idx = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)))
        return bind(F.arrays_zip(found.alias("f"), idx.alias("i")), all_items)

    return bind(F.transform(items, features), numbered)
