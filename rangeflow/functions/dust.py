"""Dust along beams: a soft return of the strongest sample, worked out batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _erf(x: np.ndarray) -> np.ndarray:
    """``columns.erf`` of an array."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def soft_return(puffs: list[tuple[float, float, float, float]], samples: int) -> Callable:
    """``tau, best, step`` of distance and side: optical depth on the way, and the strongest of ``samples`` with its number, the nearest of equals.

    A puff is its distance, width, depth and side.  Samples are held for one batch of beams, so they are neither shuffled nor sorted.
    """

    def strongest(d: pd.Series, side: pd.Series) -> pd.DataFrame:
        x, y = d.to_numpy(float), side.to_numpy(float)
        beside = [a * np.exp(-(((y - m) / 0.5) ** 2)) * 0.5 for _, _, a, m in puffs]

        def depth(upto: np.ndarray) -> np.ndarray:
            return sum(w * (_erf((upto - c) / s) - _erf(np.float64((0.0 - c) / s))) for w, (c, s, _, _) in zip(beside, puffs))

        before, best, step = depth(x * 0.0), np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
        for k in range(1, samples + 1):
            after = depth(x * k / samples)
            gain = np.round((after - before) * np.exp(-before), 9)
            step[gain > best] = k
            best, before = np.fmax(gain, best), after
        return pd.DataFrame({"tau": before, "best": best, "step": step})

    strongest.__annotations__ = {"d": pd.Series, "side": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(strongest, "tau double, best double, step long")
