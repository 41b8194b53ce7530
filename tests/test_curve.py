"""The engine against one dense regression per model."""

from dataclasses import replace

import numpy as np
import pytest
from dense import fit
from pyspark.sql import functions as F

from speccurve import CATALOG, SpecCurveJob, manual_design, spec_curve
from speccurve.functions.tdist import two_sided_p
from speccurve.operators import scale
from workload.panels import panel as build_panel

JOB = SpecCurveJob(
    y=("y",),
    x=("x",),
    must=("c_tax", ["c_size", "c_sbal"]),
    test=("c_cbal", ["c_retail", "x2"]),
    firm="firm",
    ind="ind",
    time="tm",
    region="region",
    designs=("no_absorb_robust", "ab_firm_time_cl_firm"),
)


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return build_panel(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def frame(panel):
    return panel.toPandas()


def check(result, frame, job, designs):
    rows = result.collect()
    by_tag = {d.tag: d for d in designs}
    assert len(rows) == job.model_count * len(designs) * len(job.y) * len(job.x)
    for row in rows:
        design = by_tag[row["spec_tag"]]
        must, test, bits = [], [], row["bits"]
        for slot in job.must_slots:
            must.append(slot[bits % len(slot)])
            bits //= len(slot)
        full = True
        for slot in job.test_slots:
            digit = bits % (len(slot) + 1)
            bits //= len(slot) + 1
            full &= digit > 0
            if digit:
                test.append(slot[digit - 1])
        required = job.must_names if job.inference == "full" else ()
        want = fit(
            frame,
            row["y"],
            [row["x"], *must, *test],
            design.fe,
            design.clusters,
            job.drop_singletons,
            job.inference,
            required,
        )
        if want is None:
            assert row["status"] != "ok" and row["coef"] is None
            continue
        if np.isnan(want["se"]):
            assert row["status"] == "vcov_not_psd"
            continue
        assert row["status"] == "ok"
        assert row["is_full"] == full
        assert row["obs"] == want["obs"]
        assert row["df_resid"] == want["df_resid"]
        assert row["controls_all"] == sorted(want["kept"])
        assert row["controls_test"] == sorted(set(want["kept"]) & set(test))
        np.testing.assert_allclose(row["coef"], want["coef"], rtol=1e-6)
        np.testing.assert_allclose(row["se"], want["se"], rtol=1e-6)
        np.testing.assert_allclose(row["within_r2"], want["within_r2"], rtol=1e-5, atol=1e-10)
        p = two_sided_p(want["coef"] / want["se"], want["df_t"])[0]
        np.testing.assert_allclose(row["p_value"], p, rtol=1e-5)
        for level, alpha in (("99", 0.01), ("95", 0.05), ("90", 0.1)):
            t = (row[f"ci{level}_hi"] - row["coef"]) / row["se"]
            np.testing.assert_allclose(two_sided_p(t, want["df_t"])[0], alpha, rtol=1e-8)
        for stat in row["control_stats"]:
            np.testing.assert_allclose(stat["coef"], want["coefs"][stat["name"]], rtol=1e-5)
            np.testing.assert_allclose(stat["se"], want["ses"][stat["name"]], rtol=1e-5)
        assert [s["name"] for s in row["control_stats"]] == [
            c for c in must + test if c in want["kept"]
        ]


def test_default_job(panel, frame):
    check(spec_curve(panel, JOB), frame, JOB, JOB.active_designs)


@pytest.mark.parametrize("inference, full_run", [("nested", True), ("full", False)])
def test_every_design(panel, frame, inference, full_run):
    job = replace(
        JOB, must=("c_size",), test=("c_cbal",), designs=tuple(CATALOG)[:: 1 if full_run else 4],
        inference=inference,
    )
    check(spec_curve(panel.where("firm < 20"), job), frame[frame.firm < 20], job,
          job.active_designs)


def test_singletons_and_manual_designs(panel, frame):
    designs = (
        manual_design(["cell"], ["home"], "cell_home"),
        manual_design(["cell", "tm"], [], "cell_tm"),
        manual_design(["firm"], ["firm", "tm"], "firm_two"),
        manual_design([], [("firm", "tm")], "pair_cluster"),
        manual_design(["firm", ("ind", "tm")], ["home"], "firm_home"),
    )
    for drop in (True, False):
        job = replace(
            JOB, must=("c_size",), test=("c_tax",), designs=(), extra_designs=designs,
            drop_singletons=drop,
        )
        check(spec_curve(panel.where("firm < 40"), job), frame[frame.firm < 40], job, designs)


def test_several_outcomes_and_waves(panel, frame):
    job = replace(JOB, y=("y", "y2"), x=("x", "x2"), must=("c_tax",), test=("c_size", "c_retail"),
                  samples_per_wave=2)
    check(spec_curve(panel, job), frame, job, job.active_designs)


def test_large_table_paths(panel, frame, monkeypatch):
    """Shuffle joins and the split of hot levels give the same."""
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(scale, "HOT_LEVEL_ROWS", 30)
    job = replace(JOB, must=("c_size",), test=(), designs=("ab_firm_time_cl_firm",))
    check(spec_curve(panel.where("firm < 20"), job), frame[frame.firm < 20], job,
          job.active_designs)


def test_iterative_absorption(panel, frame):
    job = replace(JOB, must=(), test=(), designs=("ab_firm_time_cl_firm",), sweep_levels=3)
    check(spec_curve(panel.where("firm < 20"), job), frame[frame.firm < 20], job,
          job.active_designs)


def test_model_blocks_and_many_variables(panel, frame, monkeypatch):
    import speccurve.operators.lattice as lattice
    import speccurve.operators.moments as moments
    import speccurve.plans.curve as curve

    monkeypatch.setattr(curve, "MODELS_PER_TASK", 2)
    monkeypatch.setattr(moments, "COMPILED_SUMS", 0)
    for module in (lattice, moments):
        monkeypatch.setattr(module, "MOMENT_BYTES", 8 * 36 * 36 * 3)
        monkeypatch.setattr(module, "CHUNK_VALUES", 500)
    job = replace(JOB, test=("c_cbal", "x2"))
    check(spec_curve(panel, job), frame, job, job.active_designs)


def test_several_bitmap_words(panel, frame, monkeypatch):
    import speccurve.operators.panel as panel_module

    monkeypatch.setattr(panel_module, "WORD_BITS", 1)
    job = replace(JOB, must=(), test=("c_size", "c_retail"), designs=("no_absorb_robust",))
    check(spec_curve(panel, job), frame, job, job.active_designs)


def test_clustered_by_the_one_effect_copies_no_rows(panel, frame, monkeypatch):
    """With and without singletons, against dense regressions."""
    monkeypatch.setattr("speccurve.plans.curve.expand", None)
    thin = panel.withColumn("firm", F.expr("CASE WHEN x < 3 THEN 10000 + y ELSE firm END"))
    data = frame.assign(firm=frame["firm"].where(frame["x"] >= 3, 10000 + frame["y"]))
    design = manual_design(["firm"], ["firm"], "own")
    for drop in (True, False):
        job = replace(JOB, designs=(), extra_designs=(design,), drop_singletons=drop)
        check(spec_curve(thin, job), data, job, [design])
