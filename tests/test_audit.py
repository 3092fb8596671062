"""The audit of record files in one call, and what it refuses."""

import json

import pytest

from spanlens import audit


def files(tmp_path, **over):
    rows = [{"id": str(i), "s": 10 - i, "x": i < 4, "y": i % 3 == 0} for i in range(10)]
    parts = {
        "outputs": [{"id": r["id"]} for r in rows],
        "surface": [{"id": r["id"], "surface_disagreement": "yes" if r["x"] else "no"} for r in rows],
        "semantic": [{"id": r["id"], "label_a": int(r["y"]), "label_b": 0} for r in rows],
        "scores": [{"id": r["id"], "route_score": r["s"]} for r in rows],
    } | over
    for name, part in parts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"records": part}))
    return [str(tmp_path / f"{name}.json") for name in ("outputs", "surface", "semantic", "scores")]


def test_audit_by_hand(spark, tmp_path):
    one, many = audit.audit(spark, *files(tmp_path), budgets="0.2,3")
    s = one.first()
    assert (s.n, s.n_surface, s.n_semantic, s.auc_surface) == (10, 4, 4, 1.0)
    # Positives at 0, 3, 6, 9 of ten by falling score: 12 of 24 pairs are won.
    assert s.auc_semantic == pytest.approx(0.5) and s.kappa_pair == pytest.approx(1 / 6) and s.kappa_sides is None and s.status == "FAIL"
    got = {r.budget: (r.routed, r.n_semantic, r.n_surface, r.n_both) for r in many.collect()}
    assert got == {2: (2, 1, 2, 0), 3: (3, 1, 3, 0), 4: (4, 2, 4, 0)}
    low = audit.summary(audit.contract(spark, *files(tmp_path), lower=True)).first()
    assert low.auc_surface == 0.0 and low.status == "PASS"


def test_audit_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="no common id"):
        audit.audit(spark, *files(tmp_path, scores=[{"id": "z", "score": 1}]))
    with pytest.raises(Exception, match="duplicate id"):  # noqa: B017, PT011
        audit.audit(spark, *files(tmp_path, outputs=[{"id": "1"}, {"id": "1"}]))
    with pytest.raises(Exception, match="not a boolean label"):  # noqa: B017, PT011
        audit.audit(spark, *files(tmp_path, surface=[{"id": "1", "label": "perhaps"}]))
    with pytest.raises(Exception, match="no label in"):  # noqa: B017, PT011
        audit.audit(spark, *files(tmp_path, surface=[{"id": "1", "label": None}, {"id": "2", "label": 1}]))
    with pytest.raises(ValueError, match="none of"):
        audit.audit(spark, *files(tmp_path, scores=[{"id": "1", "points": 1}]))
