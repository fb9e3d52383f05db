"""Registered queries against their SQL twins. ``ALL_QUERIES=1`` runs every one; otherwise a quick share of each topic."""

import os

import pytest
from oracle_check import compare, connect

from foldframe.catalog import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = ("select_chain mask_residues renumber_residues ss_runs cut_mask chain_fragments backbone_torsions best_single_cut best_double_cut pu_contacts compaction_index "
         "distance_histogram top_distances aul_percent merge_candidates partition_measures ambiguity_index turns bridges chain_census dedup_sites scan_compressed "
         "seqres_sequence ss_records fragment_slices").split()
QUERIES, ORACLES = load()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]).startswith("ok")


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) == 113
