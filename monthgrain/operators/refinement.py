"""Bounded least-squares refinement of additive damped smoothing, for many fits at once.

A fit has ``4 + 2 + season`` unknowns: the four smoothing parameters and the start level, trend and seasonal offsets. One
fold over the months carries the state of every fit together with its derivatives in all unknowns, so the residuals and their
Jacobian cost one pass and no difference quotients. Steps are Levenberg-Marquardt: a step is kept only where it lowers the
squared error, so no fit ever ends above the point it started from. A fit stops by itself, whatever shares its block.

Bounds (``BOUNDS``) hold for the smoothing parameters only; the seasonal weight also stays below one minus the level weight. A
parameter that sits on a bound and would leave it is held there for the step.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# the kernel travels with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHA, BETA, GAMMA, PHI, LEVEL, TREND, FIRST_OFFSET = range(7)
#: Lower and upper bound of alpha, beta, gamma and phi.
BOUNDS = np.array([(1e-4, 0.9999), (1e-4, 0.9999), (1e-4, 0.9999), (0.8, 0.98)])
#: Relative gain of a kept step below which a fit is finished.
TOLERANCE = 1e-8
#: Damping beyond which no step lowers the error any more.
MAX_DAMPING = 1e10


def _within(p: np.ndarray) -> np.ndarray:
    p[:, :4] = np.clip(p[:, :4], BOUNDS[:, 0], BOUNDS[:, 1])
    p[:, GAMMA] = np.minimum(p[:, GAMMA], 1.0 - p[:, ALPHA])
    return p


def fold(y: np.ndarray, n: np.ndarray, p: np.ndarray, season: int, slopes: bool = True):
    """Residuals of the first ``n`` months of every row of ``y`` and, with ``slopes``, their derivatives.

    Shapes: ``(fits, months)`` and ``(fits, months, unknowns)``; both are zero from month ``n`` on, where ``y`` may hold anything finite.
    """
    alpha, beta, gamma, phi = (p[:, k] for k in range(4))
    level, trend = p[:, LEVEL].copy(), p[:, TREND].copy()
    offsets = [p[:, FIRST_OFFSET + k].copy() for k in range(season)]
    unknowns = p.shape[1]
    errors = np.zeros(y.shape)
    jacobian = np.zeros((*y.shape, unknowns)) if slopes else None
    if slopes:
        unit = np.eye(unknowns)
        d_level, d_trend = np.tile(unit[LEVEL], (len(y), 1)), np.tile(unit[TREND], (len(y), 1))
        d_offsets = [np.tile(unit[FIRST_OFFSET + k], (len(y), 1)) for k in range(season)]
    for i in range(y.shape[1]):
        slot, used = i % season, i < n
        drift = phi * trend
        error = y[:, i] - (level + drift + offsets[slot])
        errors[:, i] = np.where(used, error, 0.0)
        if slopes:
            d_drift = phi[:, None] * d_trend
            d_drift[:, PHI] += trend
            d_error = -(d_level + d_drift + d_offsets[slot])
            jacobian[:, i] = np.where(used[:, None], d_error, 0.0)
            d_level = d_level + d_drift + alpha[:, None] * d_error
            d_level[:, ALPHA] += error
            d_trend = d_drift + (alpha * beta)[:, None] * d_error
            d_trend[:, ALPHA] += beta * error
            d_trend[:, BETA] += alpha * error
            d_offsets[slot] = d_offsets[slot] + gamma[:, None] * d_error
            d_offsets[slot][:, GAMMA] += error
        level = level + drift + alpha * error
        trend = drift + alpha * beta * error
        offsets[slot] = offsets[slot] + gamma * error
    return errors, jacobian


def paths(y: np.ndarray, n: np.ndarray, p: np.ndarray, horizon: int, season: int) -> np.ndarray:
    """Forecasts of the ``horizon`` months that follow month ``n`` of every fit."""
    alpha, beta, gamma, phi = (p[:, k] for k in range(4))
    level, trend = p[:, LEVEL].copy(), p[:, TREND].copy()
    offsets = p[:, FIRST_OFFSET:].copy()
    out = np.zeros((len(y), horizon))
    for i in range(y.shape[1]):
        slot = i % season
        drift = phi * trend
        error = y[:, i] - (level + drift + offsets[:, slot])
        level, trend = level + drift + alpha * error, drift + alpha * beta * error
        offsets[:, slot] += gamma * error
        done = np.flatnonzero(n == i + 1)
        if done.size:
            damp, power = np.zeros(done.size), np.ones(done.size)
            for h in range(horizon):
                power = power * phi[done]
                damp = damp + power
                out[done, h] = level[done] + trend[done] * damp + offsets[done, (i + 1 + h) % season]
    return out


def _step(errors: np.ndarray, jacobian: np.ndarray, p: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """Damped Gauss-Newton step of every fit; parameters that press against a bound are held."""
    slope = np.matmul(errors[:, None, :], jacobian)[:, 0]
    normal = np.matmul(jacobian.transpose(0, 2, 1), jacobian)
    four = p[:, :4]
    top = np.broadcast_to(BOUNDS[:, 1], four.shape).copy()
    top[:, GAMMA] = np.minimum(top[:, GAMMA], 1.0 - p[:, ALPHA])
    held = np.zeros(p.shape, bool)
    held[:, :4] = ((four <= BOUNDS[:, 0]) & (slope[:, :4] > 0)) | ((four >= top) & (slope[:, :4] < 0))
    normal[held] = 0.0
    normal.transpose(0, 2, 1)[held] = 0.0
    slope[held] = 0.0
    diagonal = np.einsum("kii->ki", normal)
    diagonal += np.where(diagonal > 0, damping[:, None] * diagonal, 1.0)
    return np.linalg.solve(normal, -slope[:, :, None])[:, :, 0]


def refine(y: np.ndarray, n: np.ndarray, start: np.ndarray, season: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Unknowns and squared error of every fit after at most ``steps`` trial steps from ``start``."""
    p = start.copy()
    errors, jacobian = fold(y, n, p, season)
    sse = np.square(errors).sum(axis=1)
    damping = np.full(len(y), 1e-3)
    open_ = np.flatnonzero(sse > 0)
    errors, jacobian = errors[open_], jacobian[open_]
    for _ in range(steps):
        if not open_.size:
            break
        tried = _within(p[open_] + _step(errors, jacobian, p[open_], damping[open_]))
        new_errors, new_jacobian = fold(y[open_], n[open_], tried, season)
        new = np.square(new_errors).sum(axis=1)
        better = new < sse[open_]  # false for what is not a number
        small = better & (sse[open_] - new <= TOLERANCE * sse[open_])
        won = open_[better]
        p[won], sse[won] = tried[better], new[better]
        errors[better], jacobian[better] = new_errors[better], new_jacobian[better]
        damping[open_] = np.where(better, np.maximum(damping[open_] / 5.0, 1e-9), damping[open_] * 5.0)
        go_on = ~small & (damping[open_] <= MAX_DAMPING) & (sse[open_] > 0)
        open_, errors, jacobian = open_[go_on], errors[go_on], jacobian[go_on]
    return p, sse
