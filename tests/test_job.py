"""Job checks, catalog, labels and the t distribution: no estimation."""

import numpy as np
import pytest

from speccurve import CATALOG, SpecCurveJob, manual_design
from speccurve.catalog import catalog_frame, fe_pair_clusters
from speccurve.functions.labels import path_label, signed_star, star_label
from speccurve.functions.tdist import quantile, two_sided_p
from speccurve.operators.grid import control_layout, model_grid


def test_slots_split_names_and_count_models():
    job = SpecCurveJob(y="a b", x="x", must=("s l", ["roa", "roe"]),
                       test=("cash growth", ["p", "q"], ["u v w"]))
    assert job.y == ("a", "b")
    assert job.must_slots == (("s",), ("l",), ("roa", "roe"))
    assert job.test_slots == (("cash",), ("growth",), ("p", "q"), ("u", "v", "w"))
    assert job.model_count == 2 * 2 * 2 * 3 * 4
    assert job.matrix_names == ["roa", "roe", "cash", "growth", "p", "q", "u", "v", "w"]


@pytest.mark.parametrize(
    "settings",
    [
        dict(must=("a a",)),
        dict(test=(["a", "a"],)),
        dict(must=("a",), test=("a",)),
        dict(test=([],)),
        dict(test=("",)),
        dict(test=(3,)),
        dict(order="size"),
        dict(designs=("nope",)),
        dict(inference="other"),
        dict(group_by_time=("z", "z")),
        dict(y=()),
    ],
)
def test_bad_jobs(settings):
    with pytest.raises(ValueError):
        SpecCurveJob(**{"y": "y", "x": "x", **settings})


def test_panel_checks(spark):
    frame = spark.createDataFrame(
        [(1.0, 2.0, "f", 1, "t")], "y double, x double, code string, year int, z string"
    )
    SpecCurveJob(y="y", x="x").validate(frame)
    with pytest.raises(ValueError, match="missing"):
        SpecCurveJob(y="y", x="q").validate(frame)
    with pytest.raises(ValueError, match="numeric"):
        SpecCurveJob(y="y", x="x", group_by_time=("z",)).validate(frame)
    with pytest.raises(ValueError):
        manual_design(["code"], ["a", "b", "c"])
    with pytest.raises(ValueError):
        fe_pair_clusters(["code"])


def test_groupings_keep_scope_order():
    job = SpecCurveJob(y="y", x="x", group=("w",), group_by_ind_time=("z",), group_by_none=("z",))
    assert job.groupings == [("by_ind_time", "z"), ("by_ind_time", "w"), ("by_none", "z")]


def test_catalog():
    assert len(CATALOG) == 17
    design = CATALOG["ab_firm_indtime_regiontime_cl_firm"]
    assert design.name == "absorb_firm_indtime_regiontime_vce_cluster_firm"
    assert design.needs_region
    assert sum(d.needs_region for d in CATALOG.values()) == 7
    without = SpecCurveJob(y="y", x="x", designs=tuple(CATALOG)).active_designs
    assert len(without) == 10
    resolved = design.resolve({"firm": "id", "ind": "sic", "time": "yr", "region": "st"})
    assert resolved.fe_label() == "id, sic^yr, st^yr"
    assert CATALOG["no_absorb_robust"].cluster_label() == "robust"


def test_catalog_frame_matches_designs(spark):
    rows = {r["spec_tag"]: r for r in catalog_frame(spark, CATALOG.values()).collect()}
    for tag, design in CATALOG.items():
        assert rows[tag]["display"] == design.display()
        assert rows[tag]["fe_label"] == design.fe_label()
        assert rows[tag]["cluster_label"] == design.cluster_label()
        assert rows[tag]["needs_region"] == design.needs_region


def test_grid_equals_enumeration(spark):
    job = SpecCurveJob(y="y", x="x", must=("m", ["a", "b"]), test=("c", ["d", "e"]))
    rows = model_grid(spark, job).orderBy("bits").collect()
    assert len(rows) == job.model_count == 12
    for bits, row in enumerate(rows):
        assert row["must"] == ["m", "ab"[bits % 2]]
        want = ["c"] if bits // 2 % 2 else []
        want += [[], ["d"], ["e"]][bits // 4]
        assert row["test"] == want
        assert row["is_full"] == (len(want) == 2)
    empty = model_grid(spark, SpecCurveJob(y="y", x="x")).collect()
    assert [(r["must"], r["test"], r["is_full"]) for r in empty] == [([], [], True)]


def test_layout(spark):
    job = SpecCurveJob(y="y", x="x", must=("m", ["a", "b"]), test=("c", ["d", "e"]))
    rows = {r["control"]: r for r in control_layout(spark, job).collect()}
    assert rows["m"]["row"] is None and rows["a"]["row"] == 0 and rows["e"]["row"] == 4
    assert (rows["b"]["group_label"], rows["b"]["group_start"], rows["b"]["group_end"]) == (
        "1 of 2", 0, 1)
    assert (rows["d"]["group_label"], rows["d"]["group_start"]) == ("0/1 of 2", 3)


def test_labels(spark):
    frame = spark.createDataFrame(
        [(0.0, 0.005), (-1.0, 0.03), (2.0, 0.07), (1.0, 0.5), (-1.0, None)],
        "coef double, p double",
    )
    star = signed_star("coef", "p")
    assert [r[0] for r in frame.select(star_label(star)).collect()] == ["+3", "-2", "+1", "0", "0"]
    names = spark.createDataFrame([("a b//c",), ("__x__",), ("???",), ("año-1",)], "n string")
    assert [r[0] for r in names.select(path_label("n")).collect()] == [
        "a_b_c", "x", "spec", "año-1"]


def test_t_distribution():
    # Published two-sided table values.
    table = {(1, 0.05): 12.7062, (10, 0.05): 2.2281, (24, 0.01): 2.7969, (120, 0.1): 1.6577}
    for (df, alpha), t in table.items():
        np.testing.assert_allclose(quantile(1 - alpha / 2, df)[0], t, atol=6e-5)
    np.testing.assert_allclose(two_sided_p(2.0, 10)[0], 0.0733880, atol=1e-7)
    for df in (1, 2, 7, 499, 1999, 2001, 1e5, 1e9):
        t = quantile(0.975, df)
        np.testing.assert_allclose(two_sided_p(t, df), 0.05, rtol=1e-9)
    # Both formulas agree where they meet.
    low, high = two_sided_p([0.5, 2.0, 6.0], 2000), two_sided_p([0.5, 2.0, 6.0], 2000.0001)
    np.testing.assert_allclose(low, high, rtol=1e-6)
    assert two_sided_p(0.0, 5)[0] == 1.0
