"""Plan shape of the core queries: filters reach the parquet scan, scans
read only the needed columns, no Python evaluation and no cartesian product
in the enrichment plans."""
import re

import pytest

from contingo.plans import all_queries

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") \
        if hasattr(df._sc._jvm, "PythonSQLUtils") else plan_text(df)


@pytest.mark.parametrize("name", ["fisher_or", "enrichment_sweep", "enrichment_corrected", "null_baseline",
                                  "cohort_build", "safety_table"])
def test_no_python_no_cartesian(spark, name):
    df = all_queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = plan_text(df)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, (name, bad)


def test_filters_pushed_and_columns_pruned(spark):
    df = all_queries()["cohort_build"](spark, SF)
    text = formatted(df)
    scans = re.findall(r"Scan parquet[^\n]*\n(?:[^\n]*\n){0,12}", text)
    assert scans
    lineitem_scans = [s for s in scans if "l_orderkey" in s or "l_partkey" in s]
    assert any("PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,N)" in s for s in lineitem_scans)
    for s in lineitem_scans:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", s).group(1)
        assert "l_shipdate" not in schema and "l_tax" not in schema and "l_extendedprice" not in schema


@pytest.mark.parametrize("name", ["enrichment_sweep", "enrichment_stratified", "reason_by_phase"])
def test_no_sweep_gathers_in_one_partition(spark, name):
    df = all_queries()[name](spark, SF)
    assert "SinglePartition" not in plan_text(df)


def test_tuples_are_opened_on_the_counts(spark):
    """Entities are counted by comparison and tuple first; what tuples hold is added up above that."""
    plan = plan_text(all_queries()["enrichment_sweep"](spark, SF))
    assert plan.index("sum(n") < plan.rindex("count(1)")


def test_images_are_folded_next_to_their_pair(spark):
    """The arithmetic of the rounds is there once: no filter repeats it, and sizes are read a few times."""
    plan = plan_text(all_queries()["universe_sample"](spark, SF))
    assert plan.count("48271") <= 3 * 4 and "bit_or" in plan


def test_large_families_have_no_window_over_a_family(spark):
    plan = plan_text(all_queries()["fdr_bh_large"](spark, SF))
    whole = [line for line in plan.splitlines() if "Window [" in line and "_part" not in line]
    assert not whole or all("sum(_in" in line or "min(_least" in line for line in whole)
