"""What the physical plans of the catalogue must not hold."""

import pytest

from sheafline.plans.catalog import QUERIES

# queries that run whole jobs while they are built; their plan is only the read back
EAGER = {
    "event_append", "event_pipe", "stream_transform", "stream_tee", "pipe_summary", "event_stream",
    "stream_resume", "daily_refresh", "table_write", "audit_sink", "landed_files_scan",
    "dependency_levels", "shared_append", "shared_read_since", "stored_upsert", "metric_kept",
}
# one row per partition, or one row in all, may meet in a single task
SINGLE = {
    "assign_ids", "query_expand", "resume", "extract_terms", "extract_terms_long", "extract_terms_places",
    "induce_patterns", "extract_by_patterns",
    "requirement_filter", "metric_by_period", "resume_join",
}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_plan(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan
    if name not in SINGLE:
        assert "Exchange SinglePartition" not in plan
    if name != "register_extractor":
        assert "MapInPandas" not in plan
