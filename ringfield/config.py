"""The fixed parameters of the map, its analysis and the decision layer."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # Grid: cell size, where it starts to grow, envelope.
    s_min: float = 0.05
    s_max: float = 0.5
    r_knee: float = 10.0
    r_max: float = 100.0
    # Vehicle and hazards.
    height: float = 3.5
    max_slope_deg: float = 15.0
    tau_pothole: float = 0.10
    tau_step: float = 0.08
    tau_conf: int = 96
    ref_fill: float = 0.02
    ref_rings: int = 9
    # Refinement.
    refine_cells: int = 4096
    refine_roughness: float = 0.03
    refine_slope: float = 10.0
    # Traversability weights.
    w_slope: float = 0.30
    w_rough: float = 0.20
    w_step: float = 0.20
    w_class: float = 0.20
    w_overhang: float = 0.10
    max_roughness: float = 0.05
    # Range image and voting.
    image_h: int = 64
    image_w: int = 2048
    fov_up: float = 3.0
    fov_down: float = -25.0
    knn: int = 5
    knn_window: int = 5
    knn_cutoff: float = 1.0
    knn_sigma: float = 1.0
    # Cost raster.
    extent: float = 40.0
    res: float = 0.25
    width: float = 2.5
    # Tracker.
    link: float = 1.5
    min_cells: int = 4
    v_max: float = 30.0
    gate_extra: float = 1.0
    birth_hits: int = 2
    death_misses: int = 3
    horizon: float = 4.0
    predict_steps: int = 5
    q_pos: float = 0.05
    q_vel: float = 0.5
    r_meas: float = 0.5
    p0_pos: float = 1.0
    p0_vel: float = 9.0
    frame_dt: float = 0.1
    # Ground plane and clustering.
    fit_radius: float = 30.0
    ground_tol: float = 0.12
    terrain_tol: float = 0.30
    max_tilt_deg: float = 25.0
    iterations: int = 200
    plane_seed: int = 20260828
    cluster_radius: float = 0.5
    cluster_knn: int = 16
    min_cluster_points: int = 12
    range_bins: tuple[float, ...] = field(default=(0.0, 10.0, 30.0, 60.0, 100.0))


DEFAULT = Config()

#: Class ids and flag bits.
VOID, DRIVABLE, TERRAIN, STATIC, DYNAMIC = range(5)
OCCUPIED, VOID_UNOBSERVED, OVERHANG, NEG_OBSTACLE, STEP, MOVING, REFINED, LOW_CONF = (1, 2, 4, 8, 16, 32, 64, 128)
