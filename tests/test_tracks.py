"""State machine scenarios, and batch against stream."""

from rangeflow.operators.tracks.core import FusionRules, filter_step, fusion_step, is_reset, new_state, weighed
from rangeflow.plans import state_queries as q

SF = "/root/testdata/sf0.001"
D1 = {"det": "d1", "l": 0.0, "score": 0.8, "cls": "obstacle"}
D2 = {"det": "d2", "l": 0.0, "score": 0.8, "cls": "obstacle"}


def run(step, frames):
    state, out = new_state(), []
    for k, hits in enumerate(frames):
        unknown = hits is None
        out.append(step(state, {"i": k, "stamp": k * 100_000_000, "unknown": unknown, "hits": hits or []}))
    return [(r["status"], r["distance"]) for r in out], state


def both(d):
    return [D1 | {"d": d}, D2 | {"d": d}]


def test_two_detectors_confirm_and_coast():
    out, _ = run(fusion_step, [both(50.0), both(50.0), [], [], both(49.0)])
    assert [s for s, _ in out] == ["clear", "detected", "detected", "detected", "detected"]
    assert out[-1][1] == 49.0


def test_weak_or_single_evidence_stays_clear():
    assert {s for s, _ in run(fusion_step, [[D2 | {"d": 60.0, "score": 0.05}]] * 12)[0]} == {"clear"}
    assert {s for s, _ in run(fusion_step, [[D2 | {"d": 70.0, "score": 0.9}]] * 12)[0]} == {"clear"}
    assert {s for s, _ in run(fusion_step, [[D1 | {"d": 80.0, "score": 0.4}, D2 | {"d": 80.0, "score": 0.05}]] * 8)[0]} == {"clear"}


def test_dust_does_not_confirm():
    out, _ = run(fusion_step, [[D2 | {"d": 50.0, "cls": "dust"}]] * 2 + [both(50.0)] * 3)
    assert out[1][0] == "clear" and out[-1][0] == "detected"
    assert {s for s, _ in run(fusion_step, [[D2 | {"d": 40.0, "cls": "dust"}]] * 10)[0]} == {"clear"}


def test_tracks_end_and_unknown_frames_coast():
    out, state = run(fusion_step, [both(50.0)] * 2 + [[]] * 12)
    assert out[-1][0] == "clear" and not state["tracks"]
    assert run(fusion_step, [both(50.0)] * 2 + [None])[0][-1][0] == "detected"
    assert run(fusion_step, [None])[0][-1][0] == "unknown"


def test_far_few_points_and_plates_do_not_vote():
    far = FusionRules(far_vote_from=120.0)
    hit = D1 | {"d": 150.0, "n": 5}
    assert weighed({"hits": [hit]}, far)[0]["score"] == 0 and weighed({"hits": [hit], "still": 0.9}, far)[0]["score"] == 0.8
    assert weighed({"hits": [hit | {"n": 8}]}, far)[0]["score"] == 0.8 and weighed({"hits": [hit]}, FusionRules())[0]["score"] == 0.8
    plate = D1 | {"d": 50.0, "plate": True}
    shadow = D2 | {"d": 51.0, "n_ring": 10, "n_bg": 6}
    assert weighed({"hits": [plate]}, FusionRules())[0]["score"] == 0
    assert weighed({"hits": [plate, shadow]}, FusionRules())[0]["score"] == 0.8 and weighed({"hits": [plate, shadow | {"n_bg": 4}]}, FusionRules())[0]["score"] == 0


def test_weak_and_compact_clusters_vote_with_support():
    weak = D1 | {"d": 150.0, "score": 0.1, "weak": True, "rejected": True}
    seen = D2 | {"d": 150.5}
    assert [h["det"] for h in weighed({"hits": [weak, seen]}, FusionRules())] == ["d2"]
    got = weighed({"hits": [weak, seen], "still": 1.0}, FusionRules())
    assert [h["score"] for h in got if h["det"] == "d1"] == [0.3]
    small = D1 | {"d": 40.0, "score": 0.15, "n": 6, "size": 0.4}
    group = D2 | {"d": 40.3, "score": 0.1, "n": 8, "size": 0.4, "n_ring": 10, "n_bg": 9, "attached": 0.0}
    assert [h["score"] for h in weighed({"hits": [small, group]}, FusionRules())] == [0.3, 0.3]
    dust = D1 | {"d": 42.0, "n": 100, "size": 2.5}
    assert [h["score"] for h in weighed({"hits": [small, group, dust]}, FusionRules())][:2] == [0.15, 0.1]
    assert weighed({"hits": [small, group | {"attached": 0.5}]}, FusionRules())[0]["score"] == 0.15
    edge = small | {"rejected": True, "compact": True, "straddle": True}
    assert len(weighed({"hits": [edge, group | {"n_bg": 6}]}, FusionRules())) == 2 and len(weighed({"hits": [edge | {"straddle": False}, group | {"n_bg": 6}]}, FusionRules())) == 1


def test_one_detector_confirms_only_if_allowed():
    far = [[D1 | {"d": 150.0, "score": 1.0}]] * 8
    assert {s for s, _ in run(fusion_step, far)[0]} == {"clear"}
    alone = lambda s, f: fusion_step(s, f, FusionRules(single_far_frames=4))
    assert run(alone, far)[0][-1][0] == "detected"
    near = [[D2 | {"d": 60.0, "score": 1.0}]] * 9
    strong = lambda s, f: fusion_step(s, f, FusionRules(strong_frames=5))
    assert {s for s, _ in run(fusion_step, near)[0]} == {"clear"} and run(strong, near)[0][-1][0] == "detected"


def test_third_detector_makes_dust():
    dust = {"det": "d3", "d": 50.0, "l": 0.0, "score": 0.9, "cls": "dust"}
    assert {s for s, _ in run(fusion_step, [[*both(50.0), dust]] * 6)[0]} == {"clear"}
    assert run(fusion_step, [[*both(50.0), dust | {"score": 0.2}]] * 8)[0][-1][0] == "detected"


def test_write_back_counts_candidates_and_coasting():
    state = new_state()
    step = lambda k, hits, **o: fusion_step(state, {"i": k, "stamp": k * 10**8, "unknown": False, "hits": hits}, **o)
    step(0, both(50.0))
    out = step(1, both(50.0))
    assert (out["confirmed"], out["coasting"]) == (1, 0)
    out = step(2, [])
    assert (out["status"], out["distance"], out["confirmed"], out["coasting"]) == ("detected", 50.0, 0, 1)
    out = step(3, both(50.0), rules=FusionRules(max_d=40.0))
    assert (out["status"], out["confirmed"], out["tracks"]) == ("clear", 0, 1)
    assert step(4, [], clear_allowed=False)["status"] == "detected"


def test_third_detector_never_begins_a_track():
    _, state = run(fusion_step, [[{"det": "d3", "d": 30.0, "l": 0.0, "score": 1.0, "cls": "obstacle"}]] * 5)
    assert not state["tracks"]


def test_filter_confirms_near_and_far():
    near = [[D1 | {"d": 50.0}], [], [D1 | {"d": 48.0}]]
    assert [s for s, _ in run(filter_step, near)[0]] == ["clear", "clear", "detected"]
    far = [[D1 | {"d": 150.0}]] * 3
    assert [s for s, _ in run(filter_step, far)[0]] == ["clear", "clear", "detected"]
    assert [s for s, _ in run(filter_step, [None])[0]] == ["unknown"]


def test_resets():
    s = 1_000_000_000
    stamps = [0, s // 10, -10 * s, -10 * s + s // 10, None, -10 * s + s // 5, -5 * s]
    last, got = None, []
    for t in stamps:
        got.append(is_reset(last, t))
        last = last if t is None else t
    assert got == [False, False, True, False, False, False, True]


def test_reset_keeps_counters():
    state = new_state()
    filter_step(state, {"i": 0, "stamp": 0, "unknown": False, "hits": [D1 | {"d": 9.0}]})
    out = filter_step(state, {"i": 1, "stamp": -10**12, "unknown": False, "hits": []})
    assert out["reset"] and not state["tracks"] and state["next"] == 1 and state["frame"] == 2


def test_batch_equals_stream(spark):
    for a, b in (("temporal_filter", "temporal_filter_stream"), ("fusion_tracks", "fusion_tracks_stream")):
        x, y = (sorted(map(str, q.QUERIES[n](spark, SF).collect())) for n in (a, b))
        assert x == y
