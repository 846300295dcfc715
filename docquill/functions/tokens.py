"""Token counts.

The default counter is native: the number of white-space separated runs
(``regexp_count``), evaluated inside codegen. Only the count is ever used for
decisions, so an exact model tokenizer can be plugged in as an Arrow-batched
pandas UDF whose encoder is built once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquill.functions._util import col_of

WORD_RUN = r"(?U)\S+"


def token_count(c) -> Column:
    """J1, default counter: number of non-white-space runs, as BIGINT."""
    return F.regexp_count(col_of(c), F.lit(WORD_RUN)).cast("bigint")


def exact_counter(make_encoder: Callable[[], Callable[[str], list]]):
    """J1 with a user-supplied tokenizer.

    ``make_encoder`` is a picklable factory returning ``encode(text) -> ids``.
    It runs once per task (iterator UDF), like a per-model encoder cache.
    Returns a function Column -> Column usable wherever ``token_count`` is.
    """
    @F.pandas_udf("bigint")
    def _count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for s in batches:
            yield s.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    from pyspark.sql import SparkSession

    from docquill.session import ship_package
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
    return lambda c: _count(col_of(c))


Counter = Callable[[Column], Column]
