"""Registered queries do their operator's whole job."""

import inspect

import numpy as np
import pytest

from antecede import queries
from antecede.functions import lasso
from antecede.jobs import inference
from antecede.operators import survival

FOLDER = "/root/testdata/sf0.001"


def test_dag_ranks_keep_every_upward_arc(spark):
    arcs = queries.QUERIES["arcs_tiers"](spark, FOLDER).collect()
    up = [(a.parent, a.child) for a in arcs if int(a.parent[6:]) < int(a.child[6:])]
    assert up
    for name in ("rank_dag_all", "rank_dag_all_exact"):
        rank = {r.gene_id: r["rank"] for r in queries.QUERIES[name](spark, FOLDER).collect()}
        assert all(rank[a] < rank[b] for a, b in up)


@pytest.mark.parametrize("name", ["ccf_inference", "ccf_resampling", "tree_bootstrap", "ccf_confidence", "tree_confidence", "signatures"])
def test_jobs_run_at_their_defaults(spark, monkeypatch, name):
    class Called(Exception):
        pass

    of = inspect.signature(getattr(inference, name))

    def spy(*args, **kwargs):
        raise Called(of.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(inference, name, spy)
    with pytest.raises(Called) as found:
        queries.QUERIES[name](spark, FOLDER)
    given = found.value.args[0]
    for k in ("nsampling", "niterations", "restarts", "folds"):
        assert k not in of.parameters or given.get(k, of.parameters[k].default) == of.parameters[k].default


def test_lasso_path_is_whole():
    assert inspect.signature(survival.select_steps).parameters["count"].default == 100
    rng = np.random.default_rng(2)
    for n, columns, ratio in ((200, 5, 1e-4), (20, 30, 0.01)):
        x = [np.flatnonzero(r) for r in rng.random((n, columns)) < 0.5]
        grid = lasso.lambdas(lasso.Cox(x, columns, rng.permutation(n) + 1.0, np.ones(n), np.ones(n)))
        assert len(grid) == 100 and grid[-1] == pytest.approx(grid[0] * ratio)
