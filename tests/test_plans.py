"""Plan-shape checks: the properties the design relies on at scale."""

import __spark_entry__ as entry
from actlens.operators import search as srch
from actlens.plans import registry
from actlens.session import materialize

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString() + "\n" + qe.executedPlan().toString()


def test_no_cross_or_nested_loop_joins(spark):
    bad = {}
    for name, fn in entry.queries().items():
        plan = _plan(fn(spark, SF))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross") if k in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_query_prunes_source_partition(spark):
    stored = materialize(registry.labelled(spark, SF), "labelled", partition_by=["source_system"])
    plan = _plan(srch.matches(stored, "housing", "PARLIAMENT", ["Housing"]))
    assert "PartitionFilters: [isnotnull(source_system" in plan and "= PARLIAMENT" in plan


def test_query_filters_source_before_labelling(spark):
    # one filter at the scan, whose first condition (the rest is skipped where it fails) is the source
    df = srch.matches(registry.labelled(spark, SF), "housing", "PARLIAMENT", ["Housing"])
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at_scan = [x for x in lines if "Filter (" in x][-1].split("Filter (", 1)[1]
    assert at_scan.startswith("CASE WHEN ((doc_id")
    assert 0 < at_scan.index("regexp_extract_all" if "regexp_extract_all" in at_scan else "RLIKE")


def test_limit_per_source_is_a_window_group_limit(spark):
    plan = _plan(entry.queries()["limit_per_source"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_label_work_not_in_scan_filter(spark):
    # the keyword scan must run where the rows are spread, never as a filter
    # pushed into the (possibly single-task) source scan
    plan = entry.queries()["label_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "FileScan" in line:
            assert "regexp_extract_all" not in line and "RLIKE" not in line


def test_group_versions_aggregates_before_join(spark):
    plan = _plan(entry.queries()["latest_version"](spark, SF))
    assert "partial_max_by" in plan  # map-side combine per base id
