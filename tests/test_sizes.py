"""Queries whose SQL has the 500 vectors of the small scales written in, on more vectors: the same SQL text with the number that there is."""

from __future__ import annotations

import types
import warnings
from pathlib import Path

import pytest

from pairwright.plans import queries
from tests.oracle import compare

SF, VECTORS = "/root/testdata/sf0.1", 2000
FIXED = "cassist_pij cassist_pij_trad cassist_pijs cassist_pv gassist_pij gassist_pij_trad gassist_pijs gassist_pv gassist_pv_label null_hist null_hist_classes rank_pij rank_pij_disjoint rank_pv".split()
warnings.filterwarnings("ignore", message=".*advised")


@pytest.fixture(scope="module")
def sql():
    text, was = Path(queries.__file__).read_text(), f"NS, MONTHS = {queries.NS}, {queries.MONTHS}\n"
    assert text.count(was) == 1
    other = types.ModuleType("queries_of_more_vectors")
    exec(compile(text.replace(was, f"NS, MONTHS = {VECTORS}, {queries.MONTHS}\n"), "queries_of_more_vectors", "exec"), other.__dict__)
    return other.ORACLES


@pytest.mark.parametrize("name", FIXED)
def test_results_follow_the_number_of_vectors(spark, sql, name):
    n, differences = compare(queries.QUERIES[name](spark, SF), sql[name], SF)
    assert n and not differences, differences[:3]
