"""Hand-made panels with known traps."""

import pandas as pd
import pytest
from dense import fit

from speccurve import SpecCurveJob, interaction_curves, manual_design, spec_curve, subgroup_curves
from speccurve.plans.inspect import effect_report, null_patterns, sample_report

COLUMNS = "firm string, ind string, tm int, y double, x double, z double"


def job(design, **more):
    return SpecCurveJob(y="y", x="x", firm="firm", ind="ind", time="tm", designs=(),
                        extra_designs=(design,), **more)


def one(spark, rows, design, **more):
    frame = spark.createDataFrame(rows, COLUMNS)
    got = spec_curve(frame, job(design, **more)).collect()
    assert len(got) == 1
    pdf = pd.DataFrame(rows, columns=["firm", "ind", "tm", "y", "x", "z"])
    return got[0], fit(pdf, "y", ["x"], design.fe, design.clusters)


def test_singleton_cascade(spark):
    """A chain: removing its end makes the next row a singleton."""
    rows = [("a", "i", 1, 1.0, 2.0, 0.0)]
    rows += [("a", "i", 2, 2.0, 1.0, 0.0), ("b", "i", 2, 4.0, 3.0, 0.0)]
    rows += [("b", "i", 3, 1.0, 5.0, 0.0), ("c", "i", 3, 2.0, 2.5, 0.0)]
    core = [(f, "i", t, float(v), float((3 * v + len(f) * t) % 7), 0.0)
            for v, (f, t) in enumerate((f, t) for f in ("p", "q", "r") for t in (7, 8, 9))]
    row, want = one(spark, rows + core, manual_design(["firm", "tm"], []))
    assert row["obs"] == want["obs"] == 9
    assert abs(row["coef"] - want["coef"]) < 1e-9 and row["df_resid"] == want["df_resid"]


def test_two_components(spark):
    rows = [(f, "i", t, float((5 * n) % 11), float((7 * n) % 13), 0.0)
            for n, (f, t) in enumerate([(f, t) for f in "ab" for t in (1, 2, 3)]
                                       + [(f, t) for f in "cd" for t in (4, 5, 6)])]
    design = manual_design(["firm", "tm"], [])
    row, want = one(spark, rows, design)
    assert (row["obs"], row["df_resid"]) == (12, want["df_resid"])
    assert abs(row["se"] - want["se"]) < 1e-9
    frame = spark.createDataFrame(rows, COLUMNS)
    assert {r["components"] for r in effect_report(frame, job(design)).collect()} == {2}


def test_skipped_models_have_a_status(spark):
    flat = [(f, "i", t, float(n * n % 7), 1.0 if f == "a" else 2.0, 0.0)
            for n, (f, t) in enumerate((f, t) for f in "ab" for t in range(4))]
    row, want = one(spark, flat, manual_design(["firm"], []))
    assert want is None and row["status"] == "x_collinear" and row["coef"] is None
    single = [("a", "i", 1, 1.0, 2.0, 0.0), ("b", "i", 2, None, 1.0, 0.0)]
    row, _ = one(spark, single, manual_design([], []))
    assert row["status"] == "too_few_rows" and row["obs"] == 1
    few = [("a", "i", t, float(t), float(t * t), 0.0) for t in (1, 2)]
    row, want = one(spark, few, manual_design([], []))
    assert want is None and row["status"] == "no_degrees_of_freedom"
    alone = [("a", "i", t, float(t % 3), float(t * t), 0.0) for t in range(6)]
    row, want = one(spark, alone, manual_design([], ["firm"]))
    assert want is None and row["status"] == "one_cluster"
    empty = [("a", "i", 1, None, None, 0.0)]
    assert one(spark, empty, manual_design(["firm"], []))[0]["status"] == "too_few_rows"


def test_interacted_keys(spark):
    """Parts are not glued together, and a null part drops the row."""
    keys = [("a_b", 1), ("a", 1), ("a_b", 2), ("a", 2)] * 3
    rows = [("f", i, t, float(n * 7 % 5), float(n * 3 % 8), 0.0) for n, (i, t) in enumerate(keys)]
    rows.append(("f", None, 1, 9.0, 9.0, 0.0))
    design = manual_design([("ind", "tm")], [])
    row, want = one(spark, rows, design)
    assert row["obs"] == want["obs"] == 12 and row["df_resid"] == want["df_resid"] == 12 - 1 - 3
    frame = spark.createDataFrame(rows, COLUMNS)
    assert effect_report(frame, job(design)).first()["levels"] == 4


def test_nan_is_missing(spark):
    rows = [("f", "i", t, float(t * t % 7), float(t) if t != 3 else float("nan"), None)
            for t in range(8)]
    frame = spark.createDataFrame(rows, COLUMNS)
    settings = job(manual_design([], []), test=("z",))
    sizes = {r["bits"]: r["obs"] for r in sample_report(frame, settings).collect()}
    assert sizes == {0: 7, 1: 0}
    found = {tuple(r["missing"]): r["rows"] for r in null_patterns(frame, settings).collect()}
    assert found == {("z",): 7, ("x", "z"): 1}
    status = {r["bits"]: r["status"] for r in spec_curve(frame, settings).collect()}
    assert status == {0: "ok", 1: "too_few_rows"}


def test_no_model_survives(spark):
    frame = spark.createDataFrame([], COLUMNS)
    got = spec_curve(frame, job(manual_design(["firm", "tm"], ["firm"]))).collect()
    assert [r["status"] for r in got] == ["too_few_rows"]


def test_subgroups_and_interaction(spark):
    rows = [(f, "i", t, float((n * n) % 17), float((n * 5) % 11), float(n % 6) if n % 7 else None)
            for n, (f, t) in enumerate((f, t) for f in "abcdef" for t in range(8))]
    frame = spark.createDataFrame(rows, COLUMNS)
    pdf = pd.DataFrame(rows, columns=["firm", "ind", "tm", "y", "x", "z"])
    design = manual_design(["firm"], ["firm"])
    settings = job(design, group_by_none=("z",))
    got = {r["group_value"]: r for r in subgroup_curves(frame, settings).collect()}
    ranked = pdf.dropna(subset=["z"]).sort_values(["z", "firm", "y", "x"])
    cut = (len(ranked) + 1) // 2
    for half, part in ((0, ranked.iloc[:cut]), (1, ranked.iloc[cut:])):
        want = fit(part, "y", ["x"], design.fe, design.clusters)
        assert got[half]["grouping_variable"] == "z[by_none]"
        assert got[half]["obs"] == want["obs"]
        assert abs(got[half]["coef"] - want["coef"]) < 1e-9
        assert abs(got[half]["se"] - want["se"]) < 1e-9
    pdf["xz"] = pdf.x * pdf.z
    row = interaction_curves(frame, settings).first()
    want = fit(pdf, "y", ["xz", "x"], design.fe, design.clusters)
    assert row["x"] == "c.x#c.z" and row["controls_all"] == [] and row["control_stats"] == []
    assert abs(row["coef"] - want["coef"]) < 1e-9 and abs(row["se"] - want["se"]) < 1e-9

@pytest.mark.parametrize("rounds, status", [(2000, "ok"), (2, "not_converged")])
def test_slow_absorption_is_exact_or_says_so(spark, rounds, status):
    """A chain of firms and periods, each linked with its neighbours only."""
    cells = [(i, t) for i in range(9) for t in (i, i + 1, i + 1, i + 1)]
    rows = [(f"f{i}", "i", t, float((n * 7) % 11), float((n * n + t) % 13), 0.0)
            for n, (i, t) in enumerate(cells)]
    frame = spark.createDataFrame(rows, COLUMNS)
    pdf = pd.DataFrame(rows, columns=["firm", "ind", "tm", "y", "x", "z"])
    design = manual_design(["firm", "tm"], [])
    settings = job(design, sweep_levels=1, absorb_rounds=rounds, drop_singletons=False)
    row = spec_curve(frame, settings).first()
    assert row["status"] == status
    if status == "ok":
        want = fit(pdf, "y", ["x"], design.fe, design.clusters)
        assert abs(row["coef"] - want["coef"]) < 1e-10
    else:
        assert row["coef"] is None
