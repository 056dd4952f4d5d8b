"""End-to-end chains: recorded tracks to labelled features, planner outcomes, and score comparison to gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feaslens.functions.geometry import Grid
from feaslens.operators import actions, audit, bootstrap, labels, metrics, occupancy, proximity, samples, scores
from feaslens.session import checkpointed


@dataclass(frozen=True)
class SceneConfig:
    roi: samples.Roi = field(default_factory=samples.Roi)
    grid: Grid = field(default_factory=Grid)
    future_steps: int = 30
    dt: float = 0.1
    horizon_s: float = 3.0
    min_agents: int = 3
    object_types: tuple[str, ...] = ("vehicle",)
    lane_buffer_m: float = 2.0
    rule: str = "original"

    @property
    def times(self) -> list[float]:
        return [self.dt * k for k in range(1, int(self.horizon_s / self.dt + 1e-6) + 1)]


@dataclass(frozen=True)
class Scene:
    agents: DataFrame
    states: DataFrame
    lanes: DataFrame


def extract(tracks: DataFrame, map_lanes: DataFrame, steps: DataFrame, cfg: SceneConfig) -> Scene:
    """Sample tables, written once because every later stage reads them."""
    agents, states = samples.build_samples(tracks, steps, cfg.roi, cfg.future_steps, cfg.min_agents, cfg.object_types)
    agents = checkpointed(agents)
    poses = samples.ego_poses(tracks, steps).join(agents.filter("is_ego").select("sample_id"), "sample_id", "left_semi")
    return Scene(agents, checkpointed(states), checkpointed(samples.lanes_near(poses, map_lanes, cfg.roi)))


def labelled_features(scene: Scene, cfg: SceneConfig) -> DataFrame:
    """One row per sample: proximity, constant-velocity occupancy, kinematics, proximity label and action label."""
    near = proximity.current_proximity(scene.agents)
    kin = proximity.current_kinematics(scene.agents, scene.lanes, cfg.horizon_s, cfg.dt).drop("nearest_agent_closing_speed_mps")
    occ = occupancy.occupancy(occupancy.rasterize_cv(scene.agents, cfg.times, cfg.grid))
    cv = occupancy.occupancy_metrics(occ, occupancy.lane_cells(scene.lanes, cfg.lane_buffer_m, cfg.grid), scene.agents, cfg.times, cfg.grid, "cv_")
    prox = labels.proximity_label(proximity.future_min_distance(scene.states, 2.0)).drop("d_min", "t_at_dmin")
    act = actions.actionability_labels(scene.agents, scene.states, scene.lanes, cfg.horizon_s, cfg.dt, rule=cfg.rule, lane_buffer=cfg.lane_buffer_m)
    ids = scene.agents.filter("is_ego").select("sample_id", "scenario_id")
    out = ids
    for part in (near, kin, cv, prox, act):
        out = out.join(part, "sample_id", "left")
    return out


def planner_outcomes(scene: Scene, params: actions.PlannerParams, family: str = "lattice_base") -> DataFrame:
    """Candidate evaluation to one taxonomy row per sample."""
    spark = scene.agents.sparkSession
    roll = actions.rollout_lattice(actions.ego_rows(scene.agents), actions.lattice_candidates(spark, family), params.horizon_s, params.dt)
    obs = actions.obstacle_pose(scene.agents, scene.states, "oracle_future", params.steps, params.dt, start=0)
    cand = checkpointed(actions.evaluate_candidates(roll, obs, scene.lanes, params))
    ids = scene.agents.filter("is_ego").select("sample_id", "scenario_id")
    lab = labels.planner_labels(cand, samples=ids).join(labels.candidate_flags(cand, samples=ids), "sample_id")
    outcome = labels.derived_reason(labels.failure_taxonomy(lab.join(ids, "sample_id")))
    return labels.finalize_labels(outcome, horizon_s=params.horizon_s, lane_buffer_m=params.lane_buffer_m, family=family)


def compare(features: DataFrame, outcomes: DataFrame, comparisons: Sequence[tuple[str, str]], n_boot: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metric rows, paired deltas and gates of scores against known failures."""
    merged = checkpointed(labels.merge_scores_labels(scores.composite_scores(features), outcomes))
    names = list(dict.fromkeys(s for pair in comparisons for s in pair))
    long = merged.select("known_failure", F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).alias("score")) for n in names])).alias("s")).select("known_failure", "s.*")
    deltas = checkpointed(bootstrap.delta_table(merged, "known_failure", comparisons, "scenario_id", n_boot, seed))
    return metrics.binary_metrics(long, "known_failure", "score", ["score_name"]), deltas, audit.gates(merged, deltas)
