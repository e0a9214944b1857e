"""The master-curve fit r = A * F(q / Qs), F(x) = x / (1 + abs(x)**alpha)**(beta / alpha), by bounded least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

LOW, HIGH = np.array([1e-12, 1e-12, 0.05, 0.05]), np.array([np.inf, np.inf, 10.0, 10.0])


def model(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    x = q / p[1]
    return p[0] * x / (1 + np.abs(x) ** p[2]) ** (p[3] / p[2])


def fit_master(q: np.ndarray, r: np.ndarray, sigma: np.ndarray | None = None, steps: int = 400) -> np.ndarray:
    """(A, Qs, alpha, beta, rmse); all NaN with fewer points than parameters. Levenberg-Marquardt steps clipped to the bounds, from several starts."""
    ok = np.isfinite(q) & np.isfinite(r)
    q, r = q[ok], r[ok]
    if len(q) < 4:
        return np.full(5, np.nan)
    w = np.ones(len(q))
    if sigma is not None and (np.isfinite(sigma) & (sigma > 0)).any():
        s = sigma[ok]
        w = 1 / np.where(np.isfinite(s) & (s > 0), s, np.nanmax(sigma))
    scale, best = max(np.abs(r).max(), 1e-300), None
    for alpha, beta in ((1.2, 1.3), (2.0, 0.7), (0.7, 0.5)):
        p = np.clip(np.array([scale * 2, max(np.percentile(np.abs(q), 80), 1e-9), alpha, beta]), LOW, HIGH)
        damp, res = 1e-2, w * (r - model(q, p))
        for _ in range(steps):
            logp = np.log(p)
            jac = np.stack([w * (model(q, np.exp(logp + 1e-6 * e)) - model(q, np.exp(logp - 1e-6 * e))) / 2e-6 for e in np.eye(4)], 1)
            h = jac.T @ jac
            step = np.linalg.solve(h + damp * (np.diag(np.diag(h)) + 1e-12 * np.trace(h) * np.eye(4) + 1e-300 * np.eye(4)), jac.T @ res)
            new = np.clip(np.exp(logp + np.clip(step, -1, 1)), LOW, HIGH)
            nres = w * (r - model(q, new))
            if nres @ nres < res @ res:
                done = res @ res - nres @ nres < 1e-14 * (res @ res)
                p, res, damp = new, nres, max(damp / 3, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if best is None or res @ res < best[0]:
            best = (res @ res, p)
    p = best[1]
    return np.append(p, np.sqrt(np.mean((r - model(q, p)) ** 2)))


def master_fits(curves: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, A, Qs, alpha, beta, rmse) of each group of (by, mean_q, mean_r, sd_r, n) rows; a group holds one curve's bins."""
    import pandas as pd

    def run(key, pdf):
        s = (pdf.sd_r / np.sqrt(pdf.n)).to_numpy(float)
        a = fit_master(pdf.mean_q.to_numpy(float), pdf.mean_r.to_numpy(float), s)
        return pd.DataFrame([[key[0], *a]], columns=[by, "A", "Qs", "alpha", "beta", "rmse"])

    return curves.groupBy(by).applyInPandas(run, f"{by} {curves.schema[by].dataType.simpleString()}, A double, Qs double, alpha double, beta double, rmse double")
