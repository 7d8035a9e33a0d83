"""Scenario grids and simulated series of known tail index and extremal index."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BURN_IN = 2_000
ORDER = 99
#: Scenario grids.
FAMILIES = ("frechet_max_ar", "moving_maxima_q99", "pareto_additive_ar1")
STRESS = "student_t_abs_moving_maxima_q99"
EVI_XI = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
EVI_THETA = (0.01, 0.1, 0.5, 1.0)
EI_XI = (0.01, 0.5, 1.0, 5.0)
EI_THETA = (0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0)
STRESS_XI = (0.1, 0.3, 1.0)
STRESS_THETA = (0.1, 0.5, 1.0)
SCENARIO = "scenario string, benchmark_set string, family string, xi_true double, theta_true double, phi double, n_obs int, reps int, seed long"


def order_of(family: str) -> int | None:
    """Order of a moving-maxima family, None for others; only order 99 is known."""
    m = re.fullmatch(r"(?:student_t_abs_)?moving_maxima_q(\d+)", family)
    if m and int(m[1]) != ORDER:
        raise ValueError(f"Unsupported moving-maxima order: {family}")
    return int(m[1]) if m else None


def phi_of(family: str, theta: float, xi: float) -> float:
    """Construction parameter that gives the extremal index ``theta``."""
    q = order_of(family)
    if q is None:
        return (1 - theta) ** xi
    theta = min(max(theta, 1 / (q + 1)), 1.0)
    lo, hi = 0.0, 1.0
    if np.isclose(theta, 1.0) or np.isclose(theta, 1 / (q + 1)):
        return float(not np.isclose(theta, 1.0))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 / np.sum(mid ** np.arange(q + 1.0)) > theta else (lo, mid)
    return ((lo + hi) / 2) ** xi


def theta_of(family: str, phi: float, xi: float) -> float:
    q = order_of(family)
    x = phi ** (1 / xi)
    return 1 - x if q is None else float(1 / np.sum(x ** np.arange(q + 1.0)))


def seed_of(scenario: str, master: int = 7) -> int:
    """Seed of a scenario by its name, the same in every workflow."""
    return int.from_bytes(hashlib.blake2b(f"{master}::{scenario}".encode(), digest_size=8).digest(), "little") % 2**32


def scenarios(spark: SparkSession, families=FAMILIES, xis=EVI_XI, thetas=EVI_THETA, n_obs: int = 365, reps: int = 100, label: str = "universal") -> DataFrame:
    rows = []
    for family, theta, xi in itertools.product(families, thetas, xis):
        name = f"{label}_{family}_xi{xi:.2f}_theta{theta:.2f}"
        rows.append((name, label, family, float(xi), float(theta), float(phi_of(family, theta, xi)), n_obs, reps, seed_of(name)))
    return spark.createDataFrame(rows, SCENARIO)


def draw(family: str, xi: float, phi: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """One series after burn-in."""
    q = order_of(family)
    size = n + BURN_IN + (q or 0)
    if family.startswith("student"):
        e = np.abs(rng.standard_t(1 / xi, size))
    else:
        u = np.clip(rng.random(size), np.finfo(float).tiny, 1 - 1e-16)
        e = (1 - u) ** -xi if family.startswith("pareto") else (-np.log(u)) ** -xi
    if q is not None:
        weights = phi ** np.arange(q, -1.0, -1.0)
        return (np.lib.stride_tricks.sliding_window_view(e, q + 1) * weights).max(axis=1)[BURN_IN : BURN_IN + n]
    out, last = np.empty(size), 0.0
    add = family.startswith("pareto")
    for i, v in enumerate(e):
        last = phi * last + v if add else max(phi * last, v)
        out[i] = last
    return out[BURN_IN:]


def simulate(table: DataFrame) -> DataFrame:
    """(scenario, rep, series_id, pos, value) of a scenario table: one task row per replicate, not per scenario."""

    each = table.withColumn("rep", F.explode(F.sequence(F.lit(0), F.col("reps") - 1))).repartition(F.xxhash64("scenario", "rep"))
    out = "scenario string, rep int, series_id string, pos long, value double"

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                x = draw(r.family, r.xi_true, r.phi, r.n_obs, np.random.default_rng([r.seed, r.rep]))
                yield pd.DataFrame({"scenario": r.scenario, "rep": r.rep, "series_id": f"{r.scenario}#{r.rep}", "pos": np.arange(len(x)), "value": x})

    return each.mapInPandas(run, out)


def default_evi(spark: SparkSession, n_obs: int = 365, reps: int = 100) -> DataFrame:
    """Severity grid: the whole range of tail indices on a few extremal indices."""
    return scenarios(spark, FAMILIES, EVI_XI, EVI_THETA, n_obs, reps)


def default_ei(spark: SparkSession, n_obs: int = 365, reps: int = 100) -> DataFrame:
    """Persistence grid: the whole range of extremal indices on a few tail indices."""
    return scenarios(spark, FAMILIES, EI_XI, EI_THETA, n_obs, reps)


def stress(spark: SparkSession, n_obs: int = 365, reps: int = 100) -> DataFrame:
    """Slowly converging family for the appendix."""
    return scenarios(spark, (STRESS,), STRESS_XI, STRESS_THETA, n_obs, reps, "stress")


def expected_groups(table: DataFrame) -> dict[str, list]:
    """Distinct attributes of a scenario table, sorted: the contract that results on it must meet."""
    names = ("family", "xi_true", "theta_true", "n_obs")
    row = table.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in names)).first()
    return {c: list(row[c]) for c in names}
