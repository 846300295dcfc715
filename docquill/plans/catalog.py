"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the
matching DuckDB oracle SQL where one exists."""

from __future__ import annotations

from docquill.plans import q_annotate, q_code, q_generate, q_literals, q_provider, q_select, q_shrink_patch, q_tree

_MODULES = [q_annotate, q_select, q_shrink_patch, q_code, q_generate, q_literals, q_tree, q_provider]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
