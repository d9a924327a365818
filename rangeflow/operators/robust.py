"""Ordered folds of one frame's few bins or one recording's frames, in NumPy: gating, best paths, linking, placement.

Points are aggregated to bins by Spark first, so a call sees some hundred rows at most.
"""

from __future__ import annotations

import numpy as np


def gated_chain(x: np.ndarray, y: np.ndarray, gate: float, memory: int = 4) -> np.ndarray:
    """Accept values from near to far while they lie within ``gate`` of the line through the last accepted."""
    taken: list[int] = []
    out = np.zeros(len(x), bool)
    for k in range(len(x)):
        last = taken[-memory:]
        if len(last) >= 2:
            slope, at = np.polyfit(x[last], y[last], 1)
            guess = slope * x[k] + at
        elif last:
            guess = y[last[0]]
        else:
            guess = y[k]
        if abs(y[k] - guess) <= gate:
            taken.append(k)
            out[k] = True
    return out


def best_path(cost: np.ndarray, change: float) -> np.ndarray:
    """Least-cost path through rows of candidates (Viterbi) with a squared price on changes of candidate."""
    n, m = cost.shape
    step = change * (np.arange(m)[:, None] - np.arange(m)[None, :]) ** 2
    total, back = cost[0].copy(), np.zeros((n, m), int)
    for k in range(1, n):
        via = total[None, :] + step
        back[k] = np.argmin(via, 1)
        total = cost[k] + via[np.arange(m), back[k]]
    path = [int(np.argmin(total))]
    for k in range(n - 1, 0, -1):
        path.append(int(back[k][path[-1]]))
    return np.array(path[::-1])


def link(frames: list[list[tuple[float, float]]], gate: float, max_gap: int, numbers: list[int] | None = None) -> list[list[int]]:
    """Track ids of detections by frame: per frame, pairs of track and detection by ascending distance.

    ``numbers``: the frames' numbers, where some without detections are left out.  A track unseen for more than
    ``max_gap`` frames is lost.
    """
    tracks: list[dict] = []
    out = []
    for f, found in zip(numbers if numbers is not None else range(len(frames)), frames, strict=True):
        live = [t for t in tracks if f - t["seen"] <= max_gap]
        pairs = sorted((np.hypot(t["d"] - d, t["l"] - s), t["id"], k) for t in live for k, (d, s) in enumerate(found))
        ids: list[int] = [-1] * len(found)
        used: set[int] = set()
        for distance, tid, k in pairs:
            if distance > gate:
                break
            if ids[k] < 0 and tid not in used:
                ids[k] = tid
                used.add(tid)
        for k, (d, s) in enumerate(found):
            if ids[k] < 0:
                ids[k] = len(tracks)
                tracks.append({"id": ids[k], "d": d, "l": s, "seen": f})
            else:
                tracks[ids[k]].update(d=d, l=s, seen=f)
        out.append(ids)
    return out


def spaced(wanted: np.ndarray, least: float, redraws: int = 20) -> np.ndarray:
    """Positions drawn in turn; one too near an earlier one is shifted by the golden section, up to ``redraws`` times, else left out."""
    out: list[float] = []
    for x in wanted:
        for _ in range(redraws + 1):
            if all(abs(x - y) >= least for y in out):
                out.append(float(x))
                break
            x = (x + 0.618 * 300) % 300
    return np.array(out)
