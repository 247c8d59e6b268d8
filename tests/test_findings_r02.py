"""Findings of FINDINGS_r02.md: a side that grows with the input isn't gathered on the driver."""

import re

import pytest

import __spark_entry__ as entry
from genoframe.operators import joins, masking
from oracle import DATA

NAMES = ["covering_read_count", "unmasked_reads", "altered_genotypes", "masked_reads", "run_counters", "difference_records", "genotype_classes", "altered_genotype_counts", "difference_slice", "covering_counts", "mask_codes", "difference_bounds", "genotype_masks", "masked_cells", "zygosity_changes", "genotype_calls", "pileup_cells", "pileup_counts"]


def join_keys(spark, monkeypatch, name):
    """(kind of join, its left keys) of a query and of all that it checkpoints, where each measured
    side is too large to be broadcast. At this scale the planner takes every side for a small one."""
    frame, seen = type(spark.range(0)), []
    note = lambda df: seen.append(df._jdf.queryExecution().sparkPlan().toString())
    checkpoint = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: (note(df), checkpoint(df, *a, **k))[1])
    for module in (joins, masking):
        monkeypatch.setattr(module, "fits_broadcast", lambda *a: False)
    note(entry.queries()[name](spark, f"{DATA}/sf0.001"))
    return [pair for plan in seen for pair in re.findall(r"(\w+Join) \[(.*?)\], \[", plan)]


@pytest.mark.parametrize("name", NAMES)
def test_large_sides_are_not_broadcast(spark, monkeypatch, name):
    found = join_keys(spark, monkeypatch, name)
    assert any("_salt" in keys for _, keys in found)
    assert {kind for kind, keys in found if "_salt" in keys} == {"SortMergeJoin"}
    assert not [keys for kind, keys in found if kind == "BroadcastHashJoin" and re.fullmatch(r"idx#\d+L?", keys)]


def test_only_heavy_keys_are_cut(spark, monkeypatch):
    """Rows of both sides that go into the merge join: a heavy key's are spread, others stay single."""
    monkeypatch.setattr(joins, "HEAVY_ROWS", 50)
    big = spark.createDataFrame([(k, i) for k, n in ((1, 200), (2, 3), (None, 60)) for i in range(n)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, w string")
    joined = joins.join_checked(big, small, ["k"], "inner", limit=0)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "Join LeftOuter" in plan
    assert sorted(map(tuple, joins._heavy_keys(big, ["k"]).collect()), key=str) == [(1, True), (None, True)]
    counts = {(r.k, r.w): r["count"] for r in joined.groupBy("k", "w").count().collect()}
    assert counts == {(1, "a"): 200, (1, "b"): 200, (2, "c"): 3, (None, "e"): 60}
