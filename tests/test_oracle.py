"""A cross-section of the registered queries against their SQL. tools/check.py runs all of them."""

import check
import pytest
from conftest import SF

import catalogue

NAMES = (
    "s07_new_events", "a01_fold", "a02_provenance", "a04_phase_reach", "a06_stage_dwell_in",
    "a07_funnel", "w03_interviews", "x23_activity", "x29_narrate", "n03_nudge_follow_up",
    "x03_normalise_text", "x14_role_from_body", "m02_screen", "m06_run_ladder",
    "r01_embed_lexical", "r04_identify_by_thread", "p01_scrub_text", "t06_dormancy_sweep_all",
)


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    problem, _ = check.compare(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
