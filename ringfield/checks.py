"""SQL fragments for the checks in DuckDB: the ring table, the point views, cells and flags."""

from __future__ import annotations

from .functions.labels import CLASS_OF_LEARNING, DRIVABLE_RAW, DYNAMIC_RAW, LEARNING_OF_RAW, MOVING_RAW, STATIC_RAW, TERRAIN_RAW
from .sources.views import DENSE, DENSE_BASE, DENSE_POLAR, WIDE


def in_list(ids: tuple[int, ...]) -> str:
    return "(" + ", ".join(map(str, ids)) + ")"


def class_case(raw: str) -> str:
    return f"CASE WHEN {raw} IN {in_list(DRIVABLE_RAW)} THEN 1 WHEN {raw} IN {in_list(TERRAIN_RAW)} THEN 2 WHEN {raw} IN {in_list(STATIC_RAW)} THEN 3 WHEN {raw} IN {in_list(DYNAMIC_RAW)} THEN 4 ELSE 0 END"


RINGS = """walk(ring, r_in, s) AS (
  SELECT 0, 0e0, 5e-2 UNION ALL
  SELECT ring + 1, r_in + s, CASE WHEN r_in + s <= 1e1 THEN 5e-2 ELSE least(5e-2 * (r_in + s) / 1e1, 5e-1) END FROM walk WHERE r_in + s < 1e2),
sized AS (SELECT ring, r_in, s, greatest(1, round_even(2 * pi() * r_in / s, 0))::INT AS n_bins FROM walk),
dim_ring AS (SELECT ring::INT AS ring, r_in, r_in + s AS r_out, s, r_in + s / 2 AS r_centre, n_bins, (sum(n_bins) OVER (ORDER BY ring) - n_bins)::INT AS "offset" FROM sized)"""
RING_OF = "CASE WHEN r < 0 OR r > 1e2 OR isnan(r) THEN -1 WHEN r <= 1e1 THEN least(661, floor(r / 5e-2)) ELSE least(661, 200 + floor(ln(r / 1e1) / ln(1.005::DOUBLE))) END"
TURN = "(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi())"


def points(view: str) -> str:
    """CTEs (after WITH RECURSIVE): dim_ring and pts."""
    labelled = f"pts AS (SELECT *, {class_case('raw')} AS cls, {class_case('pred_raw')} AS pred, raw IN {in_list(MOVING_RAW)} AS moving FROM plain)"
    if view == "wide":
        return f"{RINGS}, plain AS ({WIDE}), {labelled}"
    return f"{RINGS}, base AS ({DENSE_BASE}), polar AS ({DENSE_POLAR}), plain AS ({DENSE}), {labelled}"


def projected(view: str) -> str:
    return f"""{points(view)},
radial AS (SELECT *, sqrt(x * x + y * y) AS r FROM pts),
ringed AS (SELECT *, ({RING_OF})::INT AS ring FROM radial),
proj AS (SELECT p.*, d.n_bins, d.s, d.r_centre, greatest(0, least(floor({TURN} * d.n_bins), d.n_bins - 1))::INT AS bin,
  (d."offset" + greatest(0, least(floor({TURN} * d.n_bins), d.n_bins - 1)))::INT AS cell_id FROM ringed p JOIN dim_ring d ON d.ring = p.ring)"""


def cells(view: str) -> str:
    return f"""{projected(view)},
acc AS (SELECT frame_id, cell_id, any_value(ring) AS ring, any_value(bin) AS bin, any_value(n_bins) AS n_bins, any_value(s) AS s, any_value(r_centre) AS r_centre, count(*) AS n, min(z) AS z_min, max(z) FILTER (cls NOT IN (1, 2)) AS z_high,
  count(*) FILTER (cls IN (1, 2)) AS n_ground, min(z) FILTER (cls IN (1, 2)) AS z_low, sum(round(z * 1e6)::BIGINT) FILTER (cls IN (1, 2)) AS gz, sum(round(z * 1e6)::BIGINT * round(z * 1e6)::BIGINT) FILTER (cls IN (1, 2)) AS gzz,
  count(*) FILTER (cls = 0) AS h0, count(*) FILTER (cls = 1) AS h1, count(*) FILTER (cls = 2) AS h2, count(*) FILTER (cls = 3) AS h3, count(*) FILTER (cls = 4) AS h4, bool_or(moving) AS moving
  FROM proj GROUP BY frame_id, cell_id),
fin AS (SELECT *, coalesce(z_low, z_min) AS z_ground, CASE WHEN z_high IS NOT NULL THEN greatest(z_high, coalesce(z_low, z_min)) END AS z_obstacle,
  CASE WHEN n_ground >= 2 THEN greatest((gzz::DOUBLE / n_ground - (gz::DOUBLE / n_ground) * (gz::DOUBLE / n_ground)) / 1e12, 0e0) ELSE 0e0 END AS roughness,
  CASE greatest(h0, h1, h2, h3, h4) WHEN h0 THEN 0 WHEN h1 THEN 1 WHEN h2 THEN 2 WHEN h3 THEN 3 ELSE 4 END AS class_id,
  CASE WHEN n_ground = 0 THEN least(80, trunc(255 * (7e-1 * least(n / 2e2, 1e0) + 3e-1 * n_ground / n))) ELSE trunc(255 * (7e-1 * least(n / 2e2, 1e0) + 3e-1 * n_ground / n)) END::INT AS confidence FROM acc)"""


def edges(view: str) -> str:
    return f"""{cells(view)},
around AS (SELECT ring, n_bins AS n, coalesce(lead(n_bins) OVER w, n_bins) AS n_next, coalesce(lead("offset") OVER w, "offset") AS o_next, coalesce(lag(n_bins) OVER w, n_bins) AS n_prev, coalesce(lag("offset") OVER w, "offset") AS o_prev, "offset" FROM dim_ring WINDOW w AS (ORDER BY ring)),
edges AS (
  SELECT f.*, 'next' AS side, (CASE WHEN f.ring = 661 THEN f.cell_id WHEN f.ring < 200 THEN o_next + least(round_even(bin * n_next::DOUBLE / n_b, 0), n_next - 1) ELSE o_next + bin END)::INT AS neighbour_id FROM (SELECT fin.*, a.n AS n_b, a.n_next, a.o_next, a.n_prev, a.o_prev FROM fin JOIN around a USING (ring)) f
  UNION ALL SELECT f.*, 'prev', (CASE WHEN f.ring = 0 THEN f.cell_id WHEN f.ring <= 200 THEN o_prev + least(round_even(bin * n_prev::DOUBLE / n_b, 0), n_prev - 1) ELSE o_prev + bin END)::INT FROM (SELECT fin.*, a.n AS n_b, a.n_next, a.o_next, a.n_prev, a.o_prev FROM fin JOIN around a USING (ring)) f
  UNION ALL SELECT f.*, 'left', (cell_id - bin + (bin + 1) % n_b)::INT FROM (SELECT fin.*, a.n AS n_b, a.n_next, a.o_next, a.n_prev, a.o_prev FROM fin JOIN around a USING (ring)) f
  UNION ALL SELECT f.*, 'right', (cell_id - bin + (bin - 1 + n_b) % n_b)::INT FROM (SELECT fin.*, a.n AS n_b, a.n_next, a.o_next, a.n_prev, a.o_prev FROM fin JOIN around a USING (ring)) f)"""


def analysed(view: str) -> str:
    """CTE ``ana``: every occupied cell with reference, slope and flags."""
    return f"""{edges(view)},
near AS (SELECT e.frame_id, e.cell_id, max(abs(e.z_ground - c.z_ground)) AS jump, max(c.z_obstacle) AS top, max(CASE WHEN e.side = 'next' THEN degrees(atan(abs(e.z_ground - c.z_ground) / e.s)) END) AS slope
  FROM edges e JOIN fin c ON c.frame_id = e.frame_id AND c.cell_id = e.neighbour_id GROUP BY e.frame_id, e.cell_id),
ringmed AS (SELECT frame_id, ring, count(*) AS n_occ, median(z_ground) AS med, any_value(n_bins) AS n_bins FROM fin GROUP BY frame_id, ring),
usable AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY ring) - 1 AS pos, count(*) OVER (PARTITION BY frame_id) AS n_use FROM ringmed WHERE n_occ >= greatest(1, ceil(2e-2 * n_bins))),
want AS (SELECT m.frame_id, m.ring, m.med, coalesce(any_value(u.n_use), 0) AS n_use, count(u.ring) FILTER (u.ring < m.ring) AS before FROM ringmed m LEFT JOIN usable u ON u.frame_id = m.frame_id GROUP BY m.frame_id, m.ring, m.med),
refs AS (SELECT w.frame_id, w.ring, coalesce((SELECT median(u.med) FROM usable u WHERE u.frame_id = w.frame_id AND u.pos BETWEEN greatest(0, least(w.before - least(9, w.n_use) // 2, w.n_use - least(9, w.n_use))) AND greatest(0, least(w.before - least(9, w.n_use) // 2, w.n_use - least(9, w.n_use))) + least(9, w.n_use) - 1), w.med) AS reference FROM want w),
clear AS (SELECT f.*, coalesce(near.jump, 0e0) AS jump, coalesce(near.slope, 0e0) AS slope, r.reference, coalesce(f.z_obstacle, near.top) - f.z_ground AS clearance FROM fin f LEFT JOIN near USING (frame_id, cell_id) JOIN refs r ON r.frame_id = f.frame_id AND r.ring = f.ring),
ana AS (SELECT *, jump > 8e-2 AS step, reference - z_ground > 1e-1 AS pit, class_id = 1 AND coalesce(clearance > 0 AND clearance < 35e-1, false) AS overhang,
  1 + CASE WHEN class_id = 1 AND coalesce(clearance > 0 AND clearance < 35e-1, false) THEN 4 ELSE 0 END + CASE WHEN reference - z_ground > 1e-1 THEN 8 ELSE 0 END + CASE WHEN jump > 8e-2 THEN 16 ELSE 0 END + CASE WHEN moving THEN 32 ELSE 0 END + CASE WHEN confidence < 96 THEN 128 ELSE 0 END AS flags FROM clear)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


LABELS = f"""labels_dim AS (SELECT i::INT AS raw_id, {class_case('i')} AS cls, i IN {in_list(MOVING_RAW)} AS moving,
  CASE i {' '.join(f'WHEN {k} THEN {v}' for k, v in LEARNING_OF_RAW.items())} ELSE 0 END AS learning_id FROM range(260) t(i))"""
LEARNING = f"learning_dim(learning_id, lcls) AS (VALUES {', '.join(f'({k}, {v})' for k, v in enumerate(CLASS_OF_LEARNING))})"
