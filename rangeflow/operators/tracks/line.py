"""The line model over frames: fits that are smoothed while little moves, frozen while nothing does, held where a fit fails.

A frame is ``{"stamp", "still", "b", "reach"}`` (``b`` and ``reach`` null where no fit was found); ``still`` is the share of the image that did
not change.  State is a plain dict, of numbers and two short lists, so batch and stream share the step.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

OUT = "source string, b double, reach double, extended boolean, reset boolean"


@dataclass(frozen=True)
class LineRules:
    """Shares, counts of frames, and stamps in the unit of the input's (nanoseconds by default)."""

    static: float = 0.9
    quasi: float = 0.8
    warm_up: int = 5
    smooth: int = 5
    hold: int = 1_000_000_000
    back: int = 1_000_000
    gap: int = 1_500_000_000
    straight: float = 1.0e-4
    keep_straight: float = 1.5e-4
    far_reach: float = 141.0


def new_line() -> dict:
    return {"last": None, "static": [], "quasi": [], "frozen": None, "held": None, "extended": False}


def _middle(models: list[tuple[float, float]]) -> tuple[float, float]:
    return median(m[0] for m in models), median(m[1] for m in models)


def line_step(state: dict, frame: dict, rules: LineRules = LineRules()) -> dict:
    """One frame: ``source`` tells where the model is from (fit, smoothed, frozen, held, none).

    A time jump forgets everything.  Of a stop the median of the first ``warm_up`` models is frozen until something moves; while little moves,
    a fit is smoothed by up to ``smooth - 1`` before it.  A model is held for ``hold`` after its frame.  The reach is extended while
    the bend stays under ``straight``, or under ``keep_straight`` once it is extended; a frame without a model leaves that as it is.
    """
    stamp, last = frame["stamp"], state["last"]
    reset = last is not None and stamp is not None and (stamp - last < -rules.back or stamp - last > rules.gap)
    if reset:
        state.update(new_line())
    if stamp is not None:
        state["last"] = stamp
    still = frame["still"] or 0.0
    fit = None if frame["b"] is None or frame["reach"] is None else (frame["b"], frame["reach"])
    if still < rules.static:
        state["static"], state["frozen"] = [], None
    model, source = state["frozen"], "frozen"
    if model is not None:
        state["quasi"] = []
    elif fit is not None:
        little = still >= rules.quasi
        model, source = fit, "fit"
        if little and len(state["quasi"]) >= 2:
            model, source = _middle([*state["quasi"], fit]), "smoothed"
        state["quasi"] = [*state["quasi"], fit][-max(1, rules.smooth - 1) :] if little else []
        if still >= rules.static:
            state["static"] = [*state["static"], model]
            if len(state["static"]) >= rules.warm_up:
                state["frozen"] = model = _middle(state["static"])
                source = "frozen"
    if model is not None:
        state["held"] = (*model, stamp)
        state["extended"] = abs(model[0]) < (rules.keep_straight if state["extended"] else rules.straight)
        if state["extended"]:
            model = (model[0], max(model[1], rules.far_reach))
    else:
        held = state["held"]
        fresh = held is not None and stamp is not None and held[2] is not None and 0 <= stamp - held[2] <= rules.hold
        model, source = ((held[0], held[1]), "held") if fresh else ((None, None), "none")
    return {"source": source, "b": model[0], "reach": model[1], "extended": state["extended"], "reset": reset}
