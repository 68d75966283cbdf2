"""Registered queries against their SQL checks. ALL_QUERIES=1 runs every one, else one or two per family."""

import os

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = ("q2_validate_spans", "w2_align_grid", "s1_read_points_jsonl", "s13_parse_folded", "c3_host_cpu_pct", "c17_group_aggregate", "p4_run_queue_latency",
         "p8_syscalls", "t4_rank", "d1_fit_stats", "d6_ewma", "x1_cusum", "e2_segment_f1", "a5_severity", "h4_group_incidents", "f1_validate_feedback",
         "k5_episodes", "k11_flame_tree", "r2_last_value_and_ewma", "flagship_incidents")


def _names():
    from telemill.plans.catalog import QUERIES

    return sorted(QUERIES) if os.environ.get("ALL_QUERIES") else [q for q in QUICK if q in QUERIES]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from telemill.plans.catalog import ORACLES, QUERIES

    ok, _, why = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok is not False, why


def test_every_oracle_has_a_query():
    from telemill.plans.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
