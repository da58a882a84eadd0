"""Plan-shape checks: the scale properties the operators are built for."""

import os

import pytest

from quillspark.plans.registry import all_queries

Q = all_queries()


def _plan(spark, small_dir, key):
    return Q[key](spark, small_dir)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    p = _plan(spark, small_dir, "flt-03")
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderpriority), EqualTo(o_orderstatus,F)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in p
    assert "Exchange" not in p


def test_listing_is_top_k_with_scalar_total(spark, small_dir):
    p = _plan(spark, small_dir, "e1-listing")
    assert "TakeOrderedAndProject(limit=15, offset=5" in p
    assert "Subquery" in p and "Window" not in p


def test_pagination_has_no_full_single_partition_window(spark, small_dir):
    p = _plan(spark, small_dir, "win-07")
    # the only single-partition exchange feeds the per-partition summary
    # (one row per sort partition), never the rows themselves
    lines = p.split("\n")
    single = [i for i, ln in enumerate(lines) if "Exchange SinglePartition" in ln]
    assert all("_pid" in "\n".join(lines[i:i + 4]) or "count" in "\n".join(lines[i:i + 4]) for i in single)


@pytest.mark.parametrize("key", ["agg-05", "set-06", "fn-m1", "agg-12", "agg-14"])
def test_no_cross_joins(spark, small_dir, key):
    p = _plan(spark, small_dir, key)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_feed_top_k_is_cut_before_the_shuffle(spark, small_dir):
    p = _plan(spark, small_dir, "snk-04")  # warms the writer path
    from pyspark.sql import functions as F
    from quillspark.plans.tables import table
    from quillspark.sources.sinks import feed_items
    items = feed_items(table(spark, small_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", 10,
                       F.lit("t"), F.lit("l"))
    p = items._jdf.queryExecution().executedPlan().toString()
    assert p.index("Exchange hashpartitioning(o_orderpriority") < p.rindex("WindowGroupLimit")


def test_corpus_build_keeps_every_page_and_joins_authors_once(spark, small_dir):
    from quillspark.operators.search import build_corpus
    from quillspark.plans.search_queries import corpus, corpus_pages
    p = corpus(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert corpus(spark, small_dir).count() == build_corpus(corpus_pages(spark, small_dir)).count()


def test_entry_works_without_a_library_of_the_training_data_queries():
    """A missing library of the training-data operators, or their folder, takes only their own queries away."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for missing in ("public_tokenizers", "corpus_pipeline", "quillspark.llm"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), set(o) - set(q), 'pipeline' in q)"
        out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
        n, m, more, pipeline = out.stdout.split()
        assert int(n) > 150 and int(m) > 150 and more == "set()" and pipeline == "False", out.stderr[-500:]
