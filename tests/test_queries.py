"""A sample of registered queries against their SQL; tests/compare.py runs all."""

import os
import subprocess
import sys

import pytest

from blendspark.plans import ORACLES, QUERIES

SAMPLE = (
    "recipe_facts", "to_ml", "unit_coverage", "volume_fraction", "parse_lines", "match_taxonomy", "batch_gate", "merge_mappings",
    "ingredient_usage", "manhattan_pairs", "knn_recipes", "tree_emd_pairs", "substitution_weighted_pairs", "blosum_cost", "auc",
)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_sample_matches_sql():
    pytest.importorskip("duckdb")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.pathsep.join(p for p in (root, *sys.path) if p)  # what this process can import, the child can
    run = subprocess.run(
        [sys.executable, "tests/compare.py", "0.001", *SAMPLE], capture_output=True, text=True, timeout=600,
        cwd=root, env={**os.environ, "PYTHONPATH": paths},
    )
    assert "bad: []" in run.stdout, run.stdout + run.stderr[-2000:]
