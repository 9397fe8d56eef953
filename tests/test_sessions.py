"""Synthetic sessions with values that follow by hand from the definitions."""

import json

import pytest
from pyspark.sql import functions as F

from strideframe.plans import sessions
from strideframe.sources.sessions import read_sessions, session_registry

AXES = {"tableLocalForward": {"x": 0.0, "y": 0.0, "z": 1.0}, "tableLocalRight": {"x": 1.0, "y": 0.0, "z": 0.0}}


def stamp(i):
    return f"2000-01-01T00:00:0{i // 10}.{(i % 10) * 100:03d}"


def synthetic(root, bom=False):
    assignments = []
    for label in ("S1", "S2", "U1", "U2"):
        folder = root / label
        folder.mkdir()
        left = [{"x": -0.137, "y": 0.0, "z": i * 0.005} for i in range(11)]
        right = [{"x": 0.137, "y": 0.0, "z": i * 0.005} for i in range(11)]
        samples = [
            {"time": stamp(i), "hasLeft": True, "hasRight": True, "leftTableLocalPosition": left[i],
             "rightTableLocalPosition": right[i], "leftInLeftZone": True, "rightInRightZone": True}
            for i in range(11)
        ]
        episode = {"startTime": stamp(0), "endTime": stamp(10), "hand": "Left",
                   "samples": [{"time": stamp(i), "tableLocalPosition": left[i]} for i in range(11)]}
        transfer = {"sessionId": label, "grabSessions": [episode]}
        zones = {
            f"push{side}Zone": {"width": 0.028, "length": 0.056, "tableLocalCenter": {"x": x, "y": 0.0, "z": 0.0}, **AXES}
            for side, x in (("Left", -0.137), ("Right", 0.137))
        }
        action = {"startTime": stamp(0), "endTime": stamp(10), "usedLeft": True, "usedRight": True,
                  "isSingleHand": False, "samples": samples}
        push = {"sessionId": label, "pushCycleCount": 1, "pushCycles": [action], **zones,
                "needleSafetyEvents": [{"time": stamp(10)}, {"time": "2000-01-01T00:00:09"}] if label == "U1" else []}
        meta = {"sessionId": label if label != "U2" else "other", "endReason": "Completed", "isPartialSession": False,
                "isSimulated": label.startswith("S")}
        files = {"phase1_grab": transfer, "phase2_push": push, "phase3_return": transfer, "session_meta": meta}
        for name, data in files.items():
            text = json.dumps(data, indent=1)
            (folder / f"{name}.json").write_text(text, encoding="utf-8-sig" if bom else "utf-8")
        assignments.append(f"{label}={folder}")
    return assignments


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    sources = session_registry(synthetic(tmp_path_factory.mktemp("sessions"), bom=True), ["U1=Researcher-operated"])
    return sessions.analyse(read_sessions(spark, sources))


def test_session_summary(outputs):
    rows = {r.session: r for r in outputs["summary"].collect()}
    assert set(rows) == {"S1", "S2", "U1", "U2"}
    assert rows["U1"].profile == "Researcher-operated"
    for r in rows.values():
        assert r.completed and r.p2_recorded_action_count == 1 == r.p2_basic_bilateral_action_count
        assert r.p2_recorded_activity_span_s == 1.0 and r.p2_recorded_frequency_per_min == pytest.approx(60)
        assert r.p1_recorded_grasp_episodes == r.p1_distinct_transfer_attempts == 1
        assert r.p3_path_efficiency_mean == pytest.approx(1) and r.p3_path_efficiency_median == pytest.approx(1)
        assert r.p2_inter_action_gap_n == 0 and r.p2_inter_action_gap_mean_s is None
        assert r.p2_action_duration_mean_s == 1.0 and r.p2_action_duration_sd_s is None
        assert r.p2_separation_error_pooled_m == pytest.approx(0, abs=1e-12)
        assert r.p2_mean_hand_separation_pooled_m == pytest.approx(0.274)
        assert r.p2_bilateral_adherence_pooled == 1.0
        assert r.p2_mean_bilateral_signed_forward_displacement_mean_m == pytest.approx(0.05)
        assert not r.p2_mean_bilateral_signed_forward_displacement_cv_interpretable
        assert r.p2_higher_order_action_count == 1 and r.p2_higher_order_hand_action_count == 2
        assert r.cue_center_separation_m == pytest.approx(0.274)
    assert [rows[k].session_id_consistent for k in ("S1", "S2", "U1", "U2")] == [True, True, True, False]
    assert (rows["U1"].p2_needle_events_raw, rows["U1"].p2_needle_events_action_linked) == (2, 1)
    assert rows["U1"].p2_needle_events_bilateral_action_linked == 1 and rows["S1"].p2_needle_events_raw == 0
    assert len(outputs["summary"].columns) == 118


def test_action_and_hand_rows(outputs):
    action = outputs["actions"].where("session = 'S1'").first()
    assert action.n_samples == action.n_paired_samples == 11
    assert action.directional_consistency_cosine == pytest.approx(1)
    assert action.mean_bilateral_path_speed_m_s == pytest.approx(0.05)
    assert action.left_lateral_excursion_m == pytest.approx(0, abs=1e-12)
    hands = outputs["hands"].where("session = 'S1'").collect()
    assert sorted(h.hand for h in hands) == ["Left", "Right"]
    for h in hands:
        assert h.path_length_m == pytest.approx(0.05) == h.net_displacement_m
        assert h.higher_order_eligible and h.speed_variability_m_s == pytest.approx(0, abs=1e-9)
        assert h.jerk_rms_m_s3 == pytest.approx(0, abs=1e-6)
        assert h.direction_change_rate_deg_s == pytest.approx(0, abs=1e-4)


def test_profiles_and_qa(outputs):
    assert outputs["profiles"].count() == 4 * 101
    assert outputs["profiles"].agg(F.max(F.abs("bilateral_midpoint_lateral_displacement_mm"))).first()[0] == pytest.approx(0, abs=1e-9)
    assert {r.eligible_bilateral_actions for r in outputs["profile_summary"].collect()} == {1}
    qa = outputs["qa"].where("session = 'U2'").first()
    assert not qa.four_session_ids_consistent and qa.p2_all_samples_paired and qa.p2_push_list_count == 1
    assert qa.task_axes.forward_unit_vector == [0.0, 0.0, 1.0]
    assert outputs["transfers"].count() == 8


def test_registry_rejects_bad_mappings(tmp_path):
    good = synthetic(tmp_path)
    for bad in (good[:3], [*good, good[0]], ["S1"], ["S1="]):
        with pytest.raises(ValueError):
            session_registry(bad)
    with pytest.raises(ValueError, match="X, which is no session"):
        session_registry(good, ["X=text"])
    with pytest.raises(ValueError, match="S2 has no folder.*Q is no session"):
        session_registry({"S1": "a", "Q": "b"}, labels=["S1", "S2"])
    assert session_registry({"A": "hdfs://x/y"}, {"A": "text"}, labels=None)[0].profile == "text"
    (tmp_path / "S1" / "session_meta.json").unlink()
    with pytest.raises(FileNotFoundError):
        session_registry(good)


def test_mismatched_axes_fail(spark, tmp_path):
    assignments = synthetic(tmp_path)
    path = tmp_path / "S2" / "phase2_push.json"
    data = json.loads(path.read_text())
    data["pushRightZone"]["tableLocalForward"] = {"x": 1.0, "y": 0.0, "z": 0.0}
    path.write_text(json.dumps(data))
    tables = read_sessions(spark, session_registry(assignments))
    with pytest.raises(Exception, match="forward axes of the two zones disagree"):
        sessions.check_axes(sessions.geometry(tables["p2"])).collect()
