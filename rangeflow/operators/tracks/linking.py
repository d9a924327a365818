"""Linking of components over frames into static objects, under the sensor's own motion.

A component has a place ahead (``d``), across (``l``) and up (``h``), and a kind that links must share.  What stands still keeps ``d`` plus the
position of its frame, so places are compared in that; gates widen with distance and with frames between.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

COMPONENTS = "array<struct<c:long,d:double,l:double,h:double,r:double,kind:string>>"
OUT = "c long, track long, gap long"


@dataclass(frozen=True)
class LinkRules:
    """Gates as (at once, a metre of distance, a frame between) along the track, (at once, a metre) across and up."""

    along: tuple[float, float, float] = (1.5, 0.01, 0.3)
    across: tuple[float, float] = (0.6, 0.006)
    up: tuple[float, float] = (0.6, 0.005)
    price: float = 0.05
    least_distance: float = 5.0
    max_gap: int = 25


#: Columns of a track: its number, last frame, place (``d`` with its frame's position, ``l``, ``h``) and the number of its kind.
ID, FRAME, AT, SIDE, UP, KIND = range(6)


def new_links() -> dict:
    return {"next": 0, "tracks": np.empty((0, 6)), "kinds": {}}


def link_step(state: dict, frame: int, position: float, components: list[dict], rules: LinkRules = LinkRules()) -> list[dict]:
    """One frame: every pair of a track and a component in its gate, the cheapest first, each track and component once.

    Components are taken by range ``r``, then ``c``; those left begin tracks in that order.  Tracks unseen for more than ``max_gap`` frames are
    forgotten, so the state does not grow with the recording.
    """
    found = sorted(components, key=lambda c: (c["r"], c["c"]))
    kinds = state["kinds"]
    rows = [(0, frame, c["d"] + position, c["l"], c["h"], kinds.setdefault(c["kind"], len(kinds))) for c in found]
    seen, ahead = np.array(rows, np.float64).reshape(-1, 6), np.array([c["d"] for c in found], np.float64)
    gaps = frame - state["tracks"][:, FRAME]
    live = state["tracks"][(gaps >= 1) & (gaps <= rules.max_gap)]
    gap, expected = frame - live[:, FRAME], live[:, AT] - position
    distance = np.fmax(rules.least_distance, expected)
    gates = rules.along[0] + rules.along[1] * distance + rules.along[2] * gap, rules.across[0] + rules.across[1] * distance, rules.up[0] + rules.up[1] * distance
    # the gate along the track leaves few pairs, so the others are tried on those only
    t, k = np.nonzero((np.abs(ahead - expected[:, None]) < gates[0][:, None]) & (seen[:, KIND] == live[:, KIND, None]))
    off = np.abs(ahead[k] - expected[t]), np.abs(seen[k, SIDE] - live[t, SIDE]), np.abs(seen[k, UP] - live[t, UP])
    inside = (off[1] < gates[1][t]) & (off[2] < gates[2][t])
    t, k, price = t[inside], k[inside], (off[0] + off[1] + off[2] + rules.price * gap[t])[inside]
    cheapest = np.lexsort((k, live[t, ID], price))
    of, taken = [-1] * len(found), set()
    for i, j in zip(t[cheapest].tolist(), k[cheapest].tolist()):
        if of[j] < 0 and i not in taken:
            of[j] = i
            taken.add(i)
    out = []
    for j, (c, i) in enumerate(zip(found, of)):
        if i < 0:
            seen[j, ID] = state["next"]
            state["next"] += 1
            out.append({"c": c["c"], "track": int(seen[j, ID]), "gap": 0})
        else:
            seen[j, ID] = live[i, ID]
            out.append({"c": c["c"], "track": int(live[i, ID]), "gap": int(gap[i])})
    state["tracks"] = np.concatenate([np.delete(live, sorted(taken), 0), seen])
    return out
