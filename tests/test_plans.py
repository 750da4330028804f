from citeloom.operators import ledger
from citeloom.plans import citation_queries, ledger_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_sets_are_one_pass(spark, data):
    assert plan(citation_queries.ag03_eval_grouping_sets(spark, data)).count("Expand") == 1


def test_filters_and_columns_reach_the_scan(spark, data):
    p = plan(ledger_queries.ag07_spent_today(spark, data))
    pushed, columns = p.split("PushedFilters:")[1].split("ReadSchema:")
    assert "ts,2024-01-05" in pushed and "event_type" in pushed and "props" not in columns.split("\n")[0]


def test_ranking_keeps_few_rows_per_group(spark, data):
    assert "WindowGroupLimit" in plan(ledger_queries.so04_fragmented_characters(spark, data))


def test_built_ins_only(spark, data):
    for f in (citation_queries.rx01_articles, citation_queries.ev05_page_overlap, ledger_queries.jn06_priced_calls, ledger_queries.ag11_token_audit):
        p = plan(f(spark, data))
        assert "Python" not in p and "Arrow" not in p, f.__name__


def test_skip_join_has_no_cross_product(spark, data):
    p = plan(ledger_queries.pf04_skip_unchanged(spark, data))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert ledger.day() is not None
