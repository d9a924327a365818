"""Sequential folds over a stream's frames, in plain Python and without Spark.

A frame is ``{"i", "stamp", "unknown", "hits": [{"det", "d", "l", "score", "cls"}]}``.  State is a plain
dict of numbers, strings and lists, so that it can be kept as JSON between micro-batches.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FilterRules:
    """Single-source temporal filter."""

    back: float = 8.0
    ahead: float = 2.5
    side: float = 1.2
    near: tuple[int, int] = (2, 3)
    far: tuple[int, int] = (3, 4)
    far_from: float = 100.0
    max_misses: int = 3


@dataclass(frozen=True)
class FusionRules:
    """Evidence of several detectors."""

    gain: tuple[tuple[str, float], ...] = (("d1", 2.0), ("d2", 1.2), ("d3", 1.0))
    floor: tuple[tuple[str, float], ...] = (("d1", 0.3),)
    votes: tuple[tuple[str, float], ...] = (("d1", 0.3), ("d2", 0.3), ("d3", 1.01))
    dust: float = -1.5
    weak_class: float = 0.5
    together: float = 0.6
    together_score: float = 0.3
    miss: float = -0.8
    low: float = -2.0
    high: float = 6.0
    back: float = 8.0
    ahead: float = 2.5
    side: float = 1.2
    join_d: float = 3.5
    join_l: float = 1.2
    window: int = 5
    near_frames: int = 2
    near_llr: float = 3.0
    far_from: float = 120.0
    far_frames: int = 4
    far_llr: float = 4.0
    keep_llr: float = 1.2
    max_misses: int = 8
    vote: float = 0.3
    still: float = 0.85
    far_vote_from: float = 0.0  # from here few points of a moving sensor add evidence without a vote; 0: nowhere
    far_vote_points: int = 8
    plate_background: float = 0.5
    weak_votes: bool = True
    compact_extent: float = 1.0
    compact_points: int = 3
    compact_pixels: int = 4
    compact_background: float = 0.8
    straddle_background: float = 0.5
    compact_attached: float = 0.1
    pair: tuple[float, float] = (1.5, 0.5)
    alone: tuple[float, float] = (2.5, 2.0)
    single_far_frames: int = 0  # 0: one detector alone never confirms far off
    strong_frames: int = 0  # 0: one detector alone never confirms near by
    strong_score: float = 0.5
    strong_llr: float = 5.0
    dust_score: float = 0.5
    max_d: float = float("inf")


def is_reset(last: int | None, stamp: int | None, back_ns: int = 1_000_000, gap_ns: int = 1_500_000_000) -> bool:
    """Whether a stamp begins a new sequence; a missing one never does."""
    return last is not None and stamp is not None and (stamp - last < -back_ns or stamp - last > gap_ns)


def new_state() -> dict:
    return {"frame": 0, "next": 0, "last": None, "tracks": []}


def _before(state: dict, frame: dict, back_ns: int, gap_ns: int) -> bool:
    """Advance the frame counter and the time; tracks go at a reset, counters stay."""
    reset = is_reset(state["last"], frame["stamp"], back_ns, gap_ns)
    if reset:
        state["tracks"] = []
    if frame["stamp"] is not None:
        state["last"] = frame["stamp"]
    state["frame"] += 1
    return reset


def _nearest(track: dict, hits: list[dict], free: list[int], back: float, ahead: float, side: float) -> int | None:
    """The free hit of least cost within a track's gate, the first of equals."""
    best, cost = None, None
    for k in free:
        dd, dl = hits[k]["d"] - track["d"], abs(hits[k]["l"] - track["l"])
        if -back <= dd <= ahead and dl <= side and (cost is None or abs(dd) + dl < cost):
            best, cost = k, abs(dd) + dl
    return best


def filter_step(state: dict, frame: dict, rules: FilterRules = FilterRules(), back_ns: int = 1_000_000, gap_ns: int = 1_500_000_000) -> dict:
    """One frame of the temporal filter: greedy association, confirmation by n of m, coasting by misses."""
    reset = _before(state, frame, back_ns, gap_ns)
    hits = [] if frame["unknown"] else sorted(frame["hits"], key=lambda h: h["d"])
    free = list(range(len(hits)))
    now = state["frame"]
    for t in sorted(state["tracks"], key=lambda t: t["d"]):
        k = _nearest(t, hits, free, rules.back, rules.ahead, rules.side)
        if k is None:
            t["misses"] += 1
            continue
        free.remove(k)
        t["d"], t["l"], t["misses"] = hits[k]["d"], hits[k]["l"], 0
        t["seen"].append(now)
    for k in free:
        state["tracks"].append({"id": state["next"], "d": hits[k]["d"], "l": hits[k]["l"], "misses": 0, "seen": [now]})
        state["next"] += 1
    state["tracks"] = [t for t in state["tracks"] if t["misses"] <= rules.max_misses]
    confirmed = []
    for t in state["tracks"]:
        need, of = rules.far if t["d"] >= rules.far_from else rules.near
        t["seen"] = [f for f in t["seen"] if f > now - max(rules.near[1], rules.far[1])]
        if not t["misses"] and sum(f > now - of for f in t["seen"]) >= need:
            confirmed.append(t)
    best = min(confirmed, key=lambda t: (t["d"], t["id"]), default=None)
    status = "unknown" if frame["unknown"] else "detected" if best else "clear"
    told = len(confirmed) if status == "detected" else 0
    return {"reset": reset, "status": status, "distance": best["d"] if best and status == "detected" else None, "tracks": len(state["tracks"]), "confirmed": told, "coasting": 0}


def _within(a: dict, b: dict, reach: tuple[float, float]) -> bool:
    return abs(a["d"] - b["d"]) <= reach[0] and abs(a["l"] - b["l"]) <= reach[1]


def weighed(frame: dict, rules: FusionRules) -> list[dict]:
    """A frame's hits with the scores they vote by.

    Hits may tell more than place and score: ``n`` points, ``size`` (largest extent), ``n_ring``, ``n_bg`` and
    ``attached`` of beam groups, and the flags ``plate``, ``weak``, ``compact``, ``straddle`` and ``rejected`` of
    clusters; a frame may tell ``still``, how much of the scene stands.  Without these a hit votes by its own score.
    Rejected clusters are no hits unless a rule lets them vote.
    """
    standing = frame.get("still", 0.0) >= rules.still
    every = [dict(h) for h in frame["hits"]]
    clusters, beams = [h for h in every if h["det"] == "d1"], [h for h in every if h["det"] == "d2" and h["cls"] == "obstacle"]
    share = lambda h: h.get("n_bg", 0) / max(h.get("n_ring", 0), 1)

    def no_vote(h: dict) -> bool:
        return 0 < rules.far_vote_from <= h["d"] and not standing and h.get("n", 1 << 30) < rules.far_vote_points

    voters = [b for b in beams if b["score"] >= rules.vote]
    taken = {id(h) for h in every if not h.get("rejected")}
    for h in clusters:
        if h.get("rejected"):
            if h.get("weak") and rules.weak_votes and standing and any(_within(h, b, (rules.ahead, rules.side)) for b in voters):
                h["score"] = rules.vote
                taken.add(id(h))
        elif no_vote(h) or (h.get("plate") and not any(share(b) >= rules.plate_background and _within(h, b, (rules.ahead, rules.side)) for b in voters)):
            h["score"] = 0.0
    # a small cluster and a small group in free space at one place both vote, if the cluster stands alone
    free = [b for b in beams if b.get("n", 0) >= rules.compact_pixels and b.get("size", 9.0) <= rules.compact_extent and b.get("n_ring", 0) > 0 and b.get("attached", 1.0) <= rules.compact_attached]
    for h in clusters:
        small = h.get("compact") if h.get("rejected") else not h.get("weak") and h.get("n", 0) >= rules.compact_points and h.get("size", 9.0) <= rules.compact_extent
        if not small or no_vote(h):
            continue
        least = rules.straddle_background if h.get("straddle") else rules.compact_background
        mates = [b for b in free if share(b) >= least and _within(h, b, rules.pair)]
        others = [o for o in clusters if o is not h and _within(h, o, rules.alone)]
        if not mates or any(o.get("size", 0.0) > rules.compact_extent or (o.get("n", 0) >= rules.compact_points and not _within(h, o, rules.pair)) for o in others):
            continue
        for x in (h, *mates):
            x["score"] = max(x["score"], rules.vote)
        taken.add(id(h))
    return [h for h in every if id(h) in taken]


def fusion_step(state: dict, frame: dict, rules: FusionRules = FusionRules(), back_ns: int = 1_000_000, gap_ns: int = 1_500_000_000, clear_allowed: bool = True) -> dict:
    """One frame of the fusion filter: per track at most one hit a detector, log-likelihood evidence,
    confirmation near by two voting detectors and far by persistence, coasting while evidence lasts.

    ``confirmed`` counts the reported tracks with a hit of the first detector, ``coasting`` those without, which are
    reported where they were last seen; tracks beyond ``max_d`` are not reported.
    """
    reset = _before(state, frame, back_ns, gap_ns)
    now = state["frame"]
    hits = weighed(frame, rules)
    by = {x: [h for h in hits if h["det"] == x] for x in ("d1", "d2", "d3")}
    free = {x: list(range(len(v))) for x, v in by.items()}
    gain, floor, votes = dict(rules.gain), dict(rules.floor), dict(rules.votes)
    given: dict[int, dict[str, dict]] = {}
    for t in sorted(state["tracks"], key=lambda t: t["d"]):
        mine: dict[str, dict] = {}
        for x in ("d1", "d3", "d2"):
            k = _nearest(t, by[x], free[x], rules.back, rules.ahead, rules.side)
            if k is not None:
                free[x].remove(k)
                mine[x] = by[x][k]
        given[t["id"]] = mine
    born: list[dict] = []
    for x in ("d1", "d2"):  # the third detector never begins a track
        for k in free[x]:
            h = by[x][k]
            near = next((t for t in born if x not in given[t["id"]] and abs(t["d"] - h["d"]) <= rules.join_d and abs(t["l"] - h["l"]) <= rules.join_l), None)
            if near is None:
                near = {"id": state["next"], "d": h["d"], "l": h["l"], "llr": 0.0, "misses": 0, "recent": [], "confirmed": False, "cls": "obstacle", "exact": False}
                state["next"] += 1
                born.append(near)
                given[near["id"]] = {}
            given[near["id"]][x] = h
    state["tracks"] += born
    for t in state["tracks"]:
        mine = given[t["id"]]
        if mine:
            delta = 0.0
            for x, h in mine.items():
                g = gain[x] * max(floor.get(x, 0.0), min(1.0, h["score"]))
                delta += rules.dust if h["cls"] == "dust" else g * (rules.weak_class if h["cls"] in ("hanging", "structure") else 1.0)
            if sum(h["score"] >= rules.together_score and h["cls"] != "dust" for h in mine.values()) >= 2:
                delta += rules.together
            t["llr"], t["misses"] = max(rules.low, min(rules.high, t["llr"] + delta)), 0
            lead = mine.get("d1") or mine.get("d2")
            if lead is not None or not t["exact"]:
                h = lead or mine["d3"]
                t["d"], t["l"] = h["d"], h["l"]
                t["exact"] = t["exact"] or lead is not None
            t["cls"] = (mine.get("d2") or mine.get("d1") or mine.get("d3"))["cls"]
            if "d3" in mine and mine["d3"]["cls"] == "dust" and mine["d3"]["score"] >= rules.dust_score:
                t["cls"] = "dust"
            voting = sorted(x for x, h in mine.items() if h["score"] >= votes[x] and h["cls"] != "dust")
            t["recent"].append([now, sorted(mine), voting])
        else:
            t["llr"], t["misses"] = max(rules.low, t["llr"] + rules.miss), t["misses"] + 1
        t["recent"] = [r for r in t["recent"] if r[0] > now - rules.window]
        frames = sum(1 for r in t["recent"] if "d1" in r[1] or "d2" in r[1])
        voters = {x for r in t["recent"] for x in r[2]}
        strong = 0 < rules.strong_frames <= frames and t["llr"] >= rules.strong_llr and max((h["score"] for h in mine.values()), default=0.0) >= rules.strong_score
        alone = 0 < rules.single_far_frames <= frames
        if t["cls"] == "dust":
            t["confirmed"] = False
        elif t["confirmed"]:
            t["confirmed"] = t["llr"] >= rules.keep_llr and frames >= 1
        elif t["d"] >= rules.far_from:
            t["confirmed"] = strong or (frames >= rules.far_frames and t["llr"] >= rules.far_llr and (len(voters) >= 2 or alone))
        else:
            t["confirmed"] = strong or (frames >= rules.near_frames and len(voters) >= 2 and t["llr"] >= rules.near_llr)
    state["tracks"] = [t for t in state["tracks"] if t["llr"] > rules.low and t["misses"] <= rules.max_misses]
    told = [t for t in state["tracks"] if t["confirmed"] and t["d"] <= rules.max_d]
    best = min(told, key=lambda t: (t["d"], t["id"]), default=None)
    status = "detected" if best else "unknown" if frame["unknown"] or not clear_allowed else "clear"
    seen = sum("d1" in given[t["id"]] and not given[t["id"]]["d1"].get("rejected", False) for t in told)
    return {"reset": reset, "status": status, "distance": best["d"] if best else None, "tracks": len(state["tracks"]), "confirmed": seen, "coasting": len(told) - seen}
