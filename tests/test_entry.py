"""Driver contract: entry runs, every query has a name, oracles only for registered queries."""

from __spark_entry__ import entry, oracle_sql, queries


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "feature", "abs_corr"]
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)


def test_oracles_subset_of_queries():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_smoke_some_queries(spark, sf):
    q = queries()
    for name in ["cl_clean_up_docs", "ev_roc_auc", "rs_best_job_model", "io_from_frame"]:
        assert q[name](spark, sf).count() >= 0
