"""Small weighted least-squares fits on per-group tables of at most a few dozen points (T4)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def least_squares(f, jac, p0, x, y, w, lo=None, hi=None, steps: int = 200):
    """Damped Gauss-Newton for sum w (y - f)^2 inside a box; returns parameters and the
    inverse normal matrix."""
    p = np.array(p0, dtype=float)
    lo = np.full(len(p), -np.inf) if lo is None else np.array(lo, dtype=float)
    hi = np.full(len(p), np.inf) if hi is None else np.array(hi, dtype=float)
    cost = float(np.sum(w * (y - f(x, *p)) ** 2))
    lam = 1e-3
    for _ in range(steps):
        J = jac(x, *p)
        r = y - f(x, *p)
        A, g = J.T @ (J * w[:, None]), J.T @ (w * r)
        free = ~(((p <= lo) & (g < 0)) | ((p >= hi) & (g > 0)))
        if not free.any():
            break
        Af = A[np.ix_(free, free)]
        step = np.zeros_like(p)
        step[free] = np.linalg.solve(Af + lam * np.diag(np.maximum(np.diag(Af), 1e-12)), g[free])
        q = np.clip(p + step, lo, hi)
        new = float(np.sum(w * (y - f(x, *q)) ** 2))
        if math.isfinite(new) and new <= cost:
            done = np.max(np.abs(q - p)) < 1e-12 * (1 + np.max(np.abs(p)))
            p, cost, lam = q, new, max(lam / 5, 1e-12)
            if done:
                break
        else:
            lam *= 5
            if lam > 1e12:
                break
    J = jac(x, *p)
    return p, np.linalg.pinv(J.T @ (J * w[:, None])), cost


def _cdf(x, b):
    return 1.0 - np.exp(-b * x)


def _cdf_jac(x, b):
    return (x * np.exp(-b * x))[:, None]


def _pdf(x, b):
    return b * np.exp(-b * x)


def _pdf_jac(x, b):
    return ((1.0 - b * x) * np.exp(-b * x))[:, None]


def _sat(k, a, b):
    return a * (1.0 - np.exp(-b * k))


def _sat_jac(k, a, b):
    return np.stack([1.0 - np.exp(-b * k), a * k * np.exp(-b * k)], axis=1)


def fit_exp_cdf(points: DataFrame, keys: list[str]) -> DataFrame:
    """1 - exp(-b x) to a dwell CDF (columns x, cdf, count), sigma = 1/sqrt(count), absolute:
    tau and its error in milliseconds per group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        w = pdf["count"].to_numpy(float) + 1e-10
        p, cov, _ = least_squares(_cdf, _cdf_jac, [1.0], pdf["x"].to_numpy(float), pdf["cdf"].to_numpy(float), w)
        b = p[0]
        out = pdf[keys].head(1).copy()
        out["rate"] = b
        out["tau_ms"] = 1000.0 / b if b > 0 else np.nan
        out["tau_err_ms"] = math.sqrt(cov[0, 0]) / b**2 * 1000.0 if b > 0 else np.nan
        return out

    return _per_group(points, keys, one, "rate double, tau_ms double, tau_err_ms double")


def fit_exp_pdf(points: DataFrame, keys: list[str]) -> DataFrame:
    """b exp(-b x) to a density (columns x, density), unweighted; error from the residuals."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x = pdf["x"].to_numpy(float)
        p, cov, cost = least_squares(_pdf, _pdf_jac, [1.0], x, pdf["density"].to_numpy(float), np.ones(len(x)))
        b = p[0]
        s2 = cost / (len(x) - 1) if len(x) > 1 else np.nan
        out = pdf[keys].head(1).copy()
        out["rate"] = b
        out["tau_ms"] = 1000.0 / b if b > 0 else np.nan
        out["tau_err_ms"] = math.sqrt(cov[0, 0] * s2) / b**2 * 1000.0 if b > 0 else np.nan
        return out

    return _per_group(points, keys, one, "rate double, tau_ms double, tau_err_ms double")


def fit_saturation(curve: DataFrame, keys: list[str]) -> DataFrame:
    """alpha (1 - exp(-beta K)), alpha in [0, 1], beta in [0, 10], weights = den_pairs; weighted
    R2 and the prediction at K = 11."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["frac_dynamic"]).sort_values("k")
        k, y = pdf["k"].to_numpy(float), pdf["frac_dynamic"].to_numpy(float)
        w = pdf["den_pairs"].to_numpy(float)
        w = np.where(w > 0, w, 1.0)
        (a, b), _, sse = least_squares(
            _sat, _sat_jac, [min(1.0, max(0.01, y.max())), 0.5], k, y, w, [0.0, 0.0], [1.0, 10.0]
        )
        mean = np.sum(w * y) / np.sum(w)
        tot = np.sum(w * (y - mean) ** 2)
        out = pdf[keys].head(1).copy()
        out["alpha"], out["beta"], out["pred_11"] = a, b, float(_sat(11.0, a, b))
        out["r2"] = 1.0 - sse / tot if tot > 0 else np.nan
        out["sse"] = sse
        return out

    return _per_group(curve, keys, one, "alpha double, beta double, pred_11 double, r2 double, sse double")


def _per_group(df: DataFrame, keys: list[str], fn, cols: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + cols
    return df.groupBy(*keys).applyInPandas(fn, schema)
