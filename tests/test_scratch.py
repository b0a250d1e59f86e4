"""Intermediate tables go when their scope ends; stream state of another run is refused."""

import os

import pytest

import checks
from citeline.session import scratch, settle, shared_folder, shared_path
from citeline.streaming.log import KeyedState

SMALL = "/root/testdata/sf0.001"


def held(spark):
    return set(os.listdir(shared_folder(spark)))


def test_scopes_nest_and_remove_their_own(spark):
    before = held(spark)
    with scratch(spark):
        outer = settle(spark.range(3))
        with scratch(spark):
            inner = settle(spark.range(5))
            assert inner.count() == 5 and len(held(spark) - before) == 2
        assert len(held(spark) - before) == 1 and outer.count() == 3
    assert held(spark) == before


def test_a_failure_leaves_nothing(spark):
    before = held(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        settle(spark.range(3))
        1 / 0
    assert held(spark) == before


def test_a_path_never_written_is_no_fault(spark):
    with scratch(spark):
        shared_path(spark, "none")


def test_without_a_scope_tables_stay(spark):
    kept = settle(spark.range(4))
    with scratch(spark):
        settle(spark.range(2))
    assert kept.count() == 4


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["vector_topk", "ann_topk_cells", "most_asked_daily", "detect_by_weights", "scoped_search"])
def test_a_query_leaves_no_folder(spark, name):
    checks.load()
    before = held(spark)
    with scratch(spark):
        checks.QUERIES[name](spark, SMALL).collect()
        assert held(spark) > before
    assert held(spark) == before


def test_state_of_another_run_is_refused(spark, folder):
    state = KeyedState(spark, f"{folder}/state", "k long, v long")
    row = lambda v: spark.createDataFrame([(1, v)], "k long, v long")
    for batch in range(3):
        state.write(row(batch), batch)
    assert state.read(before=3).first()["v"] == 2
    assert state.read(before=2).first()["v"] == 1  # the last batch again
    assert state.read(before=5).first()["v"] == 2  # batches without rows between
    with pytest.raises(ValueError, match="batch 2"):
        state.read(before=0)
