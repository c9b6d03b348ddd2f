"""Queries on the sensor design curves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import curves as K

EXPECTED = [("range_accuracy", "tdc"), ("range_accuracy", "total_cfd"), ("range_accuracy", "no_such_term"), ("power_budget", "TOTAL"), ("power_budget", "MARGIN"), ("eye_safety", "worst")]


def _round(df, keep, values, digits=6):
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])


def _parts(spark, d):
    """The brands of the part table as components: a watt for each 1,000 of price, a gram for each unit of size; exact sums."""
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("component"), (F.col("p_retailprice") / 1000).cast("decimal(18,6)").alias("power"), F.col("p_size").cast("long").alias("mass"))


def _results(spark, d):
    """Values of two results as text: range accuracy, and the frame of the budget."""
    accuracy = K.range_error_budget(spark).select(F.lit("range_accuracy").alias("file"), F.col("term").alias("key"), F.format_string("%.4f", "cm").alias("value"))
    return accuracy.unionByName(K.budget(_parts(spark, d)).where("component IN ('TOTAL', 'MARGIN')").select(F.lit("power_budget").alias("file"), F.col("component").alias("key"), F.format_string("%.3f", "power").alias("value")))


QUERIES = {
    "link_budget": lambda spark, d: _round(K.link_budget(spark).withColumn("nanowatt", F.col("power") * 1e9), ["i", F.round("rho", 6).alias("rho")], ["r", "nanowatt", "snr"]),
    "link_budget_rmax": lambda spark, d: _round(K.link_budget_rmax(spark), [F.round("rho", 6).alias("rho"), "pinned"], ["r_max", "snr_100"]),
    "eye_safety": lambda spark, d: _round(K.eye_safety(spark), ["class_1"], ["aperture", "rule1", "rule2", "rule3", "worst"]),
    "range_error_budget": lambda spark, d: _round(K.range_error_budget(spark), ["term"], ["cm"]),
    "snr_sweep_union": lambda spark, d: _round(K.snr_sweeps(spark), ["sweep", "i"], ["x", "snr"]),
    "scan_coverage": lambda spark, d: _round(K.scan_coverage(spark), [], ["r", "spot", "cell", "per_cell", "density"]),
    "budget_rollup": lambda spark, d: _round(K.budget(_parts(spark, d)), ["component"], ["power", "mass"]),
    "audit_left_join": lambda spark, d: K.audit(_results(spark, d), spark.createDataFrame(EXPECTED, "file string, key string")),
    "rx_chain": lambda spark, d: K.rx_chain(spark),
}


def e(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _power(r: str, rho: str, d: str = e(K.D_RX)) -> str:
    return f"({e(K.P_PEAK)} * {rho} * (pi() * {d} * {d} / 4 / (pi() * {r} * {r})) * {e(K.ETA)} * exp(-2 * {e(K.ALPHA)} * {r}))"


def _snr(r: str, rho: str, d: str = e(K.D_RX), sun: str = e(K.E_SUN), n: str = "4e0") -> str:
    i = f"({e(K.R_LAM)} * {_power(r, rho, d)})"
    back = f"({rho} * {sun} * {e(K.FILTER_BW * K.THETA_RX**2)} * (pi() * {d} * {d} / 4) * {e(K.ETA)} / 4)"
    return f"({e(K.R_F * K.GAIN * 0.98)} * {i} / sqrt({e(K.SHOT)} * ({i} + {e(K.R_LAM)} * {back} + {e(K.I_DARK)}) + {e(K.THERMAL)}) * sqrt({n}))"


def _grid(lo: float, hi: float, n: int) -> str:
    return f"(SELECT i, {e(lo)} + ({e(hi)} - {e(lo)}) * i / {n - 1} AS x FROM range({n}) t(i))"


_c4 = "pow(1e1, 2e-3 * 205)"
_ael = f"(7e-4 * {_c4} * pow(5e-9, 75e-2))"
_pulses = "(2e5 / (ceil(radians(30) / 5e-3) * ceil(radians(20) / 5e-3)) * 10)"
_energy = "(19e-9 * least(pow(7e-3 / (x + 5e-4), 2), 1e0))"
_limit = f"({e(K.SIGMAS)} * sqrt(({e(K.SHOT)} * ({e(K.R_LAM)} * {_power('1e2', '1e-1')} + {e(K.R_LAM)} * (1e-1 * {e(K.E_SUN * K.FILTER_BW * K.THETA_RX**2 * math.pi * K.D_RX**2 / 4 * K.ETA / 4)}) + {e(K.I_DARK)}) + {e(K.THERMAL)}) / 4))"
_width = e(math.sqrt(K.SIGMA_PULSE**2 + K.TAU**2))
_budget = f"""SELECT unnest(['tdc', 'jitter', 'walk_threshold', 'walk_cfd', 'total_threshold', 'total_cfd']) AS term, unnest([t, j, w, w / 100, sqrt(t * t + j * j + w * w), sqrt(t * t + j * j + w * w / 1e4)]) AS cm FROM (
  SELECT {e(K.C_LIGHT)} * 5e-11 / sqrt(12) / 2 * 100 AS t, {e(K.C_LIGHT)} * ({e(2.2 * K.TAU)} / {_snr('1e2', '1e-1')}) / 2 * 100 AS j, {e(K.C_LIGHT)} * (max(c) - min(c)) / 4 * 100 AS w
  FROM (SELECT -{_width} * sqrt(2 * ln(a / {_limit})) AS c FROM (SELECT {e(K.R_F * K.GAIN * K.R_LAM * 0.98)} * {_power('r', 'rho')} AS a FROM (VALUES (1e1), (25e0), (5e1), (75e0), (1e2)) x(r), (VALUES (1e-1), (9e-1)) y(rho)) WHERE a > {_limit}))"""
_watts = "(SELECT coalesce(p_brand, 'UNNAMED') AS component, CAST(p_retailprice / 1000 AS DECIMAL(18, 6)) AS power, CAST(p_size AS BIGINT) AS mass FROM part)"
_sums = "coalesce(sum(power), 0)::DOUBLE AS power, coalesce(sum(mass), 0)::DOUBLE AS mass"
_all = f"SELECT component, {_sums} FROM {_watts} GROUP BY component UNION ALL SELECT 'TOTAL', {_sums} FROM {_watts} UNION ALL SELECT 'LIMIT', 25e0, 15e2 UNION ALL SELECT 'MARGIN', 25e0 - power, 15e2 - mass FROM (SELECT {_sums} FROM {_watts})"
_sweep = lambda name, lo, hi, steps, **k: f"SELECT '{name}' AS sweep, i, round(x, 6) AS x, round({_snr('1e2', **{'rho': '1e-1', **k})}, 6) AS snr FROM {_grid(lo, hi, steps)}"
ORACLES = {
    "link_budget": f"SELECT i, round(rho, 6) AS rho, round(x, 6) AS r, round({_power('x', 'rho')} * 1e9, 6) AS nanowatt, round({_snr('x', 'rho')}, 6) AS snr FROM {_grid(1.0, 400.0, 4000)}, (SELECT (k * 2 + 1) / 1e1 AS rho FROM range(5) t(k))",
    "link_budget_rmax": f"SELECT round(rho, 6) AS rho, coalesce(abs(max(x) FILTER (s >= 6) - 400) < 399e0 / 3999 * 15e-1, false) AS pinned, round(coalesce(max(x) FILTER (s >= 6), 0), 6) AS r_max, round({_snr('1e2', 'rho')}, 6) AS snr_100 FROM (SELECT *, {_snr('x', 'rho')} AS s FROM {_grid(1.0, 400.0, 4000)}, (SELECT (k * 2 + 1) / 1e1 AS rho FROM range(5) t(k))) GROUP BY rho",
    "eye_safety": f"SELECT worst <= 1 AS class_1, round(x, 6) AS aperture, round(r1, 6) AS rule1, round(r2, 6) AS rule2, round(r3, 6) AS rule3, round(worst, 6) AS worst FROM (SELECT *, greatest(r1, r2, r3) AS worst FROM (SELECT x, {_energy} / {_ael} AS r1, {_energy} * {_pulses} / 10 / (39e-4 * {_c4}) AS r2, {_energy} / (greatest(pow({_pulses}, -25e-2), 4e-1) * {_ael}) AS r3 FROM {_grid(0.01, 0.08, 15)}))",
    "range_error_budget": f"SELECT term, round(cm, 6) AS cm FROM ({_budget})",
    "snr_sweep_union": " UNION ALL ".join([_sweep("reflectivity", 0.1, 0.9, 60, rho="x"), _sweep("aperture_m", 0.015, 0.08, 60, d="x"), _sweep("sunlight", 0.0, 1.5, 60, sun="x"), _sweep("accumulation", 1.0, 16.0, 16, n="x")]),
    "scan_coverage": f"SELECT round(x, 6) AS r, round(spot, 6) AS spot, round(cell, 6) AS cell, round(pow(cell / spot, 2), 6) AS per_cell, round(1 / (spot * spot), 6) AS density FROM (SELECT x, 5e-3 * x AS spot, least(greatest(5e-2, 5e-3 * x), 5e-1) AS cell FROM {_grid(2.0, 150.0, 500)} WHERE i % 10 = 0)",
    "budget_rollup": f"SELECT component, round(power, 6) AS power, round(mass, 6) AS mass FROM ({_all})",
    "audit_left_join": f"WITH have AS (SELECT 'range_accuracy' AS file, term AS key, printf('%.4f', cm) AS value FROM ({_budget}) UNION ALL SELECT 'power_budget', component, printf('%.3f', power) FROM ({_all}) WHERE component IN ('TOTAL', 'MARGIN')) SELECT file, key, coalesce(value, 'MISSING') AS value FROM (VALUES {', '.join(map(repr, EXPECTED))}) w(file, key) LEFT JOIN have USING (file, key)",
}
