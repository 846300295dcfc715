"""Driver contract: entry, catalogue, oracle keys; results independent of partitioning."""

import __spark_entry__ as E
from docquill.sources.tables import load, spread
from tests.conftest import SMOKE


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 200 and set(df.columns) >= {"doc_id", "n_units", "after_md5"}
    assert all(r.n_units == r.n_applied + r.n_failed for r in rows)


def test_every_query_runs_and_oracles_match_names(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SMOKE)
        assert df.columns, name
        df.limit(5).collect()


def test_partitioning_does_not_change_results(spark):
    q = E.queries()["rule_units"]
    base = sorted(map(tuple, q(spark, SMOKE).collect()))
    d1 = load(spark, SMOKE, "pages", rebalance=1)
    d16 = load(spark, SMOKE, "pages", rebalance=16)
    assert d1.rdd.getNumPartitions() == 1 and d16.rdd.getNumPartitions() == 16
    from docquill.operators.units import extract_by_rules, rules_table
    from docquill.plans.q_select import HEAD_RULES, LINK_RULES
    from pyspark.sql import functions as F
    rules = rules_table(spark, LINK_RULES + HEAD_RULES)
    for d in (d1, d16):
        src = d.select("page_id", F.lit("html").alias("language"), F.col("html").alias("text"))
        got = extract_by_rules(src, rules, keys=("page_id",)).select("page_id", "kind", "name", "identifier")
        assert sorted(map(tuple, got.collect())) == base
    assert spread(d1, "page_id", rebalance=False) is d1


def test_annotation_same_for_1_4_16_partitions(spark):
    from pyspark.sql import functions as F
    from docquill.plans import q_annotate as A
    from docquill.sources.tables import load
    results = []
    for n in (1, 4, 16):
        d = load(spark, SMOKE, "documents", rebalance=n)
        src = d.select("doc_id", F.format_string("%s/%d.txt", "source", "doc_id").alias("path"), "text")
        out = A.patch_summary(src, A.annotation_results(spark, SMOKE, src=src))
        results.append(sorted(map(tuple, out.select(sorted(out.columns)).collect())))
    assert results[0] == results[1] == results[2]
