"""Sensor design curves: generated parameter grids and column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Physical constants and the design point.
C_LIGHT, Q_E, K_B = 299792458.0, 1.602176634e-19, 1.380649e-23
R_MAX, R_KNEE, S_MIN, S_MAX, PITCH = 100.0, 10.0, 0.05, 0.50, 0.005
WAVE_NM, PULSE, P_PEAK, PRF, N_ACC, T_GROUP = 905.0, 5.0e-9, 3.8, 200e3, 4, 5.0e-6
D_TX, DIV_TX, RHO_NOM, ALPHA = 0.050, 0.005, 0.1, 0.2e-3
D_RX, ETA, FILTER_BW, THETA_RX, E_SUN = 0.050, 0.80, 20.0, 0.005, 0.6
R_LAM, GAIN, K_EFF, I_DARK = 0.50, 100.0, 0.02, 1.0e-9
BAND, R_F, I_N, TEMP = 200e6, 1.0e3, 3.0e-12, 300.0
CFD_FRACTION, CFD_DELAY, TDC_LSB, SIGMAS = 0.70, 4.0e-9, 50e-12, 5.0
AZ_DEG, EL_DEG, MASS_LIMIT, POWER_LIMIT, SNR_NEED, DT_SIM, N_SAMPLES = 30.0, 20.0, 1500.0, 25.0, 6.0, 50e-12, 16384
V_SAT, R_CAL, RESPONSE = 2.0, 50.0, 400
# Derived.
SIGMA_PULSE, TAU = PULSE / 2.35482, 1 / (2 * math.pi * BAND)
ENB, EXCESS = 1.57 * BAND, K_EFF * GAIN + (2 - 1 / GAIN) * (1 - K_EFF)
SHOT, THERMAL = (R_F * GAIN) ** 2 * 2 * Q_E * EXCESS * ENB, R_F**2 * (I_N**2 * ENB + 4 * K_B * TEMP * ENB / R_F)


def received(r: Column, rho: Column, d_rx: Column) -> Column:
    """Peak power from a diffuse target larger than the spot."""
    return P_PEAK * rho * (math.pi * d_rx * d_rx / 4 / (math.pi * r * r)) * ETA * F.exp(-2 * ALPHA * r)


def snr(r: Column, rho: Column, d_rx: Column, sun: Column, n_acc: Column) -> Column:
    """Amplitude signal-to-noise ratio after accumulating pulses."""
    i = R_LAM * received(r, rho, d_rx)
    back = rho * sun * FILTER_BW * THETA_RX**2 * (math.pi * d_rx * d_rx / 4) * ETA / 4
    return R_F * GAIN * i * 0.98 / F.sqrt(SHOT * (i + R_LAM * back + I_DARK) + THERMAL) * F.sqrt(n_acc)


def grid(spark: SparkSession, lo: float, hi: float, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (lo + (hi - lo) * F.col("id") / (n - 1)).alias(name))


def link_budget(spark: SparkSession) -> DataFrame:
    rho = spark.range(5).select(((F.col("id") * 2 + 1) / 10).alias("rho"))
    g = grid(spark, 1.0, 400.0, 4000, "r").crossJoin(F.broadcast(rho))  # 4,000 x 5 parameters, whatever the data
    c = (F.lit(D_RX), F.lit(E_SUN), F.lit(float(N_ACC)))
    return g.select("i", "rho", "r", received(F.col("r"), F.col("rho"), c[0]).alias("power"), snr(F.col("r"), F.col("rho"), *c).alias("snr"))


def link_budget_rmax(spark: SparkSession) -> DataFrame:
    """The largest range of the sweep with enough signal, and whether that is the sweep's edge."""
    far = link_budget(spark).groupBy("rho").agg(F.max(F.when(F.col("snr") >= SNR_NEED, F.col("r"))).alias("r_max"))
    return far.select("rho", F.coalesce("r_max", F.lit(0.0)).alias("r_max"), (F.abs(F.col("r_max") - 400.0) < 399.0 / 3999 * 1.5).alias("pinned"), snr(F.lit(R_MAX), F.col("rho"), F.lit(D_RX), F.lit(E_SUN), F.lit(float(N_ACC))).alias("snr_100"))


def eye_safety(spark: SparkSession) -> DataFrame:
    """Class 1 ratios by exit aperture: single pulse, mean power, pulse train."""
    c4 = 10 ** (0.002 * (WAVE_NM - 700))
    ael = 7e-4 * c4 * PULSE**0.75
    n_dir = math.ceil(math.radians(AZ_DEG) / PITCH) * math.ceil(math.radians(EL_DEG) / PITCH)
    pulses = N_ACC * PRF / (n_dir * N_ACC) * 10.0
    c5 = max(pulses**-0.25, 0.4)
    d = grid(spark, 0.010, 0.080, 15, "aperture")
    e = P_PEAK * PULSE * F.least(F.pow(7e-3 / (F.col("aperture") + DIV_TX * 0.1), F.lit(2.0)), F.lit(1.0))
    rules = d.select("aperture", (e / ael).alias("rule1"), (e * pulses / 10 / (3.9e-3 * c4)).alias("rule2"), (e / (c5 * ael)).alias("rule3"))
    return rules.withColumn("worst", F.greatest("rule1", "rule2", "rule3")).withColumn("class_1", F.col("worst") <= 1)


def range_error_budget(spark: SparkSession) -> DataFrame:
    """Terms of the range error at 100 m in centimetres, and their sums in quadrature."""
    one = spark.range(1).select(snr(F.lit(R_MAX), F.lit(RHO_NOM), F.lit(D_RX), F.lit(E_SUN), F.lit(float(N_ACC))).alias("s"), received(F.lit(R_MAX), F.lit(RHO_NOM), F.lit(D_RX)).alias("p"))
    back = RHO_NOM * E_SUN * FILTER_BW * THETA_RX**2 * math.pi * D_RX**2 / 4 * ETA / 4
    limit = SIGMAS * F.sqrt((SHOT * (R_LAM * F.col("p") + R_LAM * back + I_DARK) + THERMAL) / N_ACC)
    cases = spark.createDataFrame([(float(r), rho) for r in (10, 25, 50, 75, 100) for rho in (0.1, 0.9)], "r double, rho double")
    amp = R_F * GAIN * R_LAM * received(F.col("r"), F.col("rho"), F.lit(D_RX)) * 0.98
    width = math.sqrt(SIGMA_PULSE**2 + TAU**2)
    walk = cases.crossJoin(F.broadcast(one.select(limit.alias("limit")))).where(amp > F.col("limit")).agg((F.max(-width * F.sqrt(2 * F.log(amp / F.col("limit")))) - F.min(-width * F.sqrt(2 * F.log(amp / F.col("limit"))))).alias("span"))
    tdc = C_LIGHT * TDC_LSB / math.sqrt(12) / 2 * 100
    t = one.crossJoin(F.broadcast(walk)).select((C_LIGHT * (2.2 * TAU / F.col("s")) / 2 * 100).alias("jitter"), (C_LIGHT * F.col("span") / 2 / 2 * 100).alias("walk"))
    root = lambda w: F.sqrt(tdc * tdc + F.col("jitter") * F.col("jitter") + w * w)
    rows = (("tdc", F.lit(tdc)), ("jitter", F.col("jitter")), ("walk_threshold", F.col("walk")), ("walk_cfd", 0.01 * F.col("walk")), ("total_threshold", root(F.col("walk"))), ("total_cfd", root(0.01 * F.col("walk"))))
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("term"), v.alias("cm")) for k, v in rows])).alias("x")).select("x.*")


def snr_sweeps(spark: SparkSession) -> DataFrame:
    """Four sweeps at 100 m, one under the other: reflectivity, aperture, sunlight, accumulation (196 rows)."""
    point = {"rho": F.lit(RHO_NOM), "d": F.lit(D_RX), "sun": F.lit(E_SUN), "n": F.lit(float(N_ACC))}

    def one(name: str, key: str, lo: float, hi: float, steps: int) -> DataFrame:
        p = {**point, key: F.col("x")}
        return grid(spark, lo, hi, steps, "x").select(F.lit(name).alias("sweep"), "i", "x", snr(F.lit(R_MAX), p["rho"], p["d"], p["sun"], p["n"]).alias("snr"))

    return one("reflectivity", "rho", 0.1, 0.9, 60).unionByName(one("aperture_m", "d", 0.015, 0.080, 60)).unionByName(one("sunlight", "sun", 0.0, 1.5, 60)).unionByName(one("accumulation", "n", 1.0, 16.0, 16))


def scan_coverage(spark: SparkSession) -> DataFrame:
    r = F.col("r")
    cell, spot = F.least(F.greatest(F.lit(S_MIN), 0.005 * r), F.lit(S_MAX)), PITCH * r
    return grid(spark, 2.0, 150.0, 500, "r").where("i % 10 = 0").select("r", spot.alias("spot"), cell.alias("cell"), F.pow(cell / spot, F.lit(2.0)).alias("per_cell"), (1 / (spot * spot)).alias("density"))


def budget(parts: DataFrame, power_limit: float = POWER_LIMIT, mass_limit: float = MASS_LIMIT) -> DataFrame:
    """Power and mass of each component (``parts``: component, power, mass), their totals, the limits and the margins left.

    A component of several rows has their sum. Nulls count as nothing; a null component is called UNNAMED.
    Without parts the totals are 0.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("power", "mass")]
    each = parts.groupBy(F.coalesce("component", F.lit("UNNAMED")).alias("component")).agg(*sums)
    total = each.agg(*sums)  # one row, also without parts
    row = lambda name, power, mass: F.struct(F.lit(name).alias("component"), power.cast("double").alias("power"), mass.cast("double").alias("mass"))
    limit = F.lit(power_limit), F.lit(mass_limit)
    frame = total.select(F.explode(F.array(row("TOTAL", F.col("power"), F.col("mass")), row("LIMIT", *limit), row("MARGIN", limit[0] - F.col("power"), limit[1] - F.col("mass")))).alias("x")).select("x.*")
    return each.select("component", F.col("power").cast("double"), F.col("mass").cast("double")).unionByName(frame)


def audit(have: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (file, key) pairs with the value (string) that the results ``have`` hold there, or MISSING."""
    return expected.select("file", "key").join(have.select("file", "key", "value"), ["file", "key"], "left").select("file", "key", F.coalesce("value", F.lit("MISSING")).alias("value"))


RX_DDL = "r double, detected long, bias_threshold_cm double, jitter_threshold_cm double, threshold_cm double, bias_cfd_cm double, jitter_cfd_cm double, cfd_cm double"


def rx_chain(spark: SparkSession, shots: int = 100, seed: int = 12345) -> DataFrame:
    """Receiver Monte Carlo: noisy echoes at 19 ranges, timed by threshold and by constant fraction, 100 shots each.

    The noise of every sample follows the signal there; each pulse saturates, and N_ACC pulses are averaged before they are
    timed. Both timings are corrected by their offset at a clean echo from 50 m. Bias, jitter and their root sum of squares
    are in cm. One group for each range; noise from a seeded NumPy generator, so the statistics, not the draws, are
    comparable with other generators.
    """
    import numpy as np
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = float(g["r"].iloc[0])
        rng = np.random.default_rng([seed, int(r * 10)])
        n, lag = N_SAMPLES, int(round(CFD_DELAY / DT_SIM))
        t = np.arange(n) * DT_SIM
        decay = np.exp(-t[:RESPONSE] / TAU)
        answer = np.fft.rfft(decay / decay.sum(), 2 * n)
        filtered = lambda x: np.fft.irfft(np.fft.rfft(x, 2 * n) * answer, 2 * n)[..., :n]
        power = lambda at: P_PEAK * RHO_NOM * (D_RX**2 / 4 / at**2) * ETA * np.exp(-2 * ALPHA * at)
        current = lambda at: np.maximum(R_LAM * filtered(power(at) * np.exp(-0.5 * ((t - 2 * at / C_LIGHT) / SIGMA_PULSE) ** 2)), 0)
        back = RHO_NOM * E_SUN * FILTER_BW * THETA_RX**2 * np.pi * D_RX**2 / 4 * ETA / 4
        noise = lambda i: np.sqrt(SHOT * (i + R_LAM * back + I_DARK) + THERMAL)
        limit = SIGMAS * noise(R_LAM * power(R_MAX)) / np.sqrt(N_ACC)

        def times(v: np.ndarray) -> tuple[float, float]:
            """The first rise through the threshold, and the first fall through zero of the constant fraction after it."""
            up = np.flatnonzero((v[:-1] < limit) & (v[1:] >= limit))
            if not len(up):
                return np.nan, np.nan
            i = up[0]
            c = CFD_FRACTION * v - np.concatenate([np.zeros(lag), v[:-lag]])
            down = i + np.flatnonzero((c[i:-1] > 0) & (c[i + 1 :] <= 0))[:1]
            return (i + (limit - v[i]) / (v[i + 1] - v[i])) * DT_SIM, (down[0] + c[down[0]] / (c[down[0]] - c[down[0] + 1])) * DT_SIM if len(down) else np.nan

        offset = np.array(times(R_F * GAIN * current(R_CAL))) - 2 * R_CAL / C_LIGHT
        flow = current(r)
        clean, sigma = R_F * GAIN * flow, noise(flow)
        found = []
        for _ in range(shots):
            white = filtered(rng.normal(size=(N_ACC, n)))
            white /= white.std(axis=1, ddof=1, keepdims=True)
            found.append(times(np.clip(clean + white * sigma, -V_SAT, V_SAT).mean(axis=0)))
        off = C_LIGHT * np.round((np.array(found) - offset) / TDC_LSB) * TDC_LSB / 2 - r
        row = {"r": r, "detected": int(np.isfinite(off[:, 0]).sum())}
        for k, name in enumerate(("threshold", "cfd")):
            e = off[np.isfinite(off[:, k]), k] * 100
            bias, jitter = (float(e.mean()), float(e.std(ddof=1))) if len(e) > 1 else (None, None)
            row |= {f"bias_{name}_cm": bias, f"jitter_{name}_cm": jitter, f"{name}_cm": None if bias is None else float(np.hypot(bias, jitter))}
        return pd.DataFrame([row])

    ranges = spark.range(19).select((10.0 + 5.0 * F.col("id")).alias("r"))
    return ranges.groupBy("r").applyInPandas(run, RX_DDL)
