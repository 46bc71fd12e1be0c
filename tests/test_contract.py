"""Registered queries against their check SQL at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

from changeimpact.plans import contract as library  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "normalize_text", "dedupe_keep_first", "managed_section_merge", "strip_templates", "mention_filters",
    "regex_tables", "forecast_summary", "gate", "gate_hard_only", "gate_triggered", "rank_by_exec_count",
    "verdict_distribution", "unknown_breakdown", "first_examples", "baseline_runs", "cached_rulings", "repairs",
    "best_dataset", "sibling_schemas", "notify_lines", "invalid_changes", "report_lines",
]


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip("no test data")
    return check.views(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check_sql(spark, con, name):
    same, told = check.compare(spark, con, SF_DIR, name)
    assert same, told


def test_every_query_of_the_library_has_check_sql():
    assert set(library.QUERIES) == set(library.ORACLES)
