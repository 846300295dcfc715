"""The cascade of quality rules stops at the first rule that rejects."""

import pytest
from pyspark.sql import functions as F

from docquill.llm import quality_rules as Q

WORDS = " ".join(f"word{k}" for k in range(30))


@pytest.fixture()
def broken(monkeypatch):
    """A rule whose count cannot be made."""
    monkeypatch.setitem(Q.COUNTS, "broken", lambda t, w: F.raise_error(F.concat(F.lit("made for "), t)).cast("bigint"))
    return Q.Rule("broken", ("broken",), lambda c: c["broken"] > 0)


def kept(spark, texts, rules):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return [r["doc_id"] for r in Q.kept_documents(df, rules).collect()]


def test_later_rules_are_not_evaluated(spark, broken):
    few, symbols = Q.RULES[0], Q.MORE_RULES[0]
    assert kept(spark, ["too short", None, ""], [few, broken]) == []
    assert kept(spark, ["# " * 40], [symbols, broken]) == []
    with pytest.raises(Exception, match="made for too short"):
        kept(spark, ["too short"], [broken, few])
    with pytest.raises(Exception, match="made for word0"):
        kept(spark, ["too short", WORDS], [few, broken])


def test_the_query_stops_too(spark, broken, monkeypatch):
    monkeypatch.delitem(Q.COUNTS, "broken")
    df = spark.createDataFrame([(1, "too short"), (2, "# " * 40)], "doc_id bigint, text string")
    make = {**Q.COUNTS, "broken": lambda t, w: F.raise_error(t).cast("bigint")}
    counts, Q_COUNTS = dict(Q.COUNTS), Q.COUNTS
    real = Q.cascade

    def cascade(text, rules):       # the count is known to the cascade only
        monkeypatch.setattr(Q, "COUNTS", make)
        out = real(text, rules)
        monkeypatch.setattr(Q, "COUNTS", Q_COUNTS)
        return out

    monkeypatch.setattr(Q, "cascade", cascade)
    got = Q.measure(df, [Q.MORE_RULES[0], broken]).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: False, 2: False} and dict(Q.COUNTS) == counts


def test_any_order_gives_one_verdict(spark):
    texts = [WORDS, "short", "# " * 40, "a\nb\n" * 30, "x" * 500 + " " + WORDS, " ".join(["same words here and there again now"] * 9)]
    both = [kept(spark, texts, rules) for rules in (Q.RULES, Q.RULES[::-1])]
    assert both[0] == both[1] and 0 in both[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.name for r in Q.order_rules(df)) == sorted(r.name for r in Q.RULES)
