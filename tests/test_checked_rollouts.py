"""Rollouts that are checked sample by sample give the rows of the plans that shuffle poses, and shuffle none."""

import math
import re

import pytest

import __spark_entry__ as entry
from feaslens.catalog import scenes as sc
from feaslens.operators import actions as ac
from feaslens.operators import checked


@pytest.fixture(scope="module")
def scenes(spark, sf):
    return sc.stored(spark, sf)


def same(got, want, keys):
    key = lambda r: tuple(r[k] for k in keys)
    got, want = ({key(r): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        for c, v in row.items():
            g = got[k][c]
            assert g == v or (isinstance(v, float) and g is not None and math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-9)), (k, c, g, v)


@pytest.mark.parametrize("family, moving, dt", [("lattice_base", False, 0.5), ("lattice_extended", True, 0.1)])
def test_candidates(spark, scenes, family, moving, dt):
    agents, states, lanes = scenes
    p = ac.PlannerParams(horizon_s=3.0, dt=dt, ignore_initial_s=0.6)
    obs = ac.obstacle_pose(agents, states, "cv_current" if moving else "oracle_future", p.steps, dt, start=0)
    roll = ac.rollout_lattice(ac.ego_rows(agents), ac.lattice_candidates(spark, family), 3.0, dt)
    got = checked.evaluate_lattice(agents, lanes, family, p, None if moving else obs)
    same(got, ac.evaluate_candidates(roll, obs, lanes, p), ["sample_id", "candidate_id"])


@pytest.mark.parametrize("name", ["AC13_full_lattice", "AC13_evaluate_candidates"])
def test_poses_are_not_shuffled(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("name", ["AC19_label_variants", "AC20_feasibility_audit", "AS12_aligned_features"])
def test_poses_of_actions_are_not_joined(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[(sample_id#\w+, (k|horizon_s|action|_cx)#|horizon_s#)", plan)
