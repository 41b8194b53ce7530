"""Reports, ranking, splitting and storage on small fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from speccurve import SpecCurveJob
from speccurve.operators import scale
from speccurve.operators.components import component_counts
from speccurve.plans import report
from speccurve.plans.hetero import median_split
from speccurve.sources.panels import read_panel
from speccurve.sources.results import (
    SAVED,
    curve_metadata,
    read_curve,
    read_manifest,
    read_metadata,
    read_results,
    saved_order,
    to_saved,
    write_grid,
    write_manifest,
    write_metadata,
    write_results,
    write_significance,
)
from workload.panels import order_models
from workload.reports import JOB


@pytest.fixture(scope="module")
def models(spark, sf_dir):
    return order_models(spark, sf_dir).persist()


def test_positions_by_range_equal_window(spark, models, monkeypatch):
    order = [F.col("obs"), F.col("bits")]
    small = scale.positions(models, report.CURVE, order).select("bits", "pos").collect()
    monkeypatch.setattr(scale, "WINDOW_ROWS", 5)
    large = scale.positions(models, report.CURVE, order).select("bits", "pos").collect()
    assert sorted(small) == sorted(large)


def test_run_lengths_across_blocks(models, monkeypatch):
    curve = report.curve_table(models)
    key = ["y", "x", "spec_tag", "control", "start", "len", "grey"]
    whole = sorted(report.run_lengths(curve, JOB.matrix_names).select(*key).collect())
    for size in (1, 2, 7):
        monkeypatch.setattr(report, "RUN_BLOCK", size)
        cut = sorted(report.run_lengths(curve, JOB.matrix_names).select(*key).collect())
        assert cut == whole
    cells = sum(r["len"] for r in whole)
    assert cells == models.select(F.sum(F.size("controls_test"))).first()[0]


def test_median_split_one_large_group(spark, monkeypatch):
    random.seed(3)
    rows = [(0, random.randint(0, 3), i) for i in range(101)]
    frame = spark.createDataFrame(rows, "sid long, z int, i int").repartition(7)
    want = {i: int(n >= 51) for n, (_, _, i) in enumerate(sorted(rows))}
    for limit in (1000, 3):
        monkeypatch.setattr(scale, "WINDOW_ROWS", limit)
        got = median_split(frame, ["sid"], [F.col("z"), F.col("i")]).collect()
        assert {r["i"]: r["half"] for r in got} == want


def test_components_of_chains_and_islands(spark):
    edges = [(0, i, i // 2) for i in range(40)] + [(0, i, (i + 1) // 2) for i in range(40)]
    edges += [(0, 100, 100), (0, 101, 101), (1, 5, 5)]
    frame = spark.createDataFrame(edges, "sid long, f0 int, f1 int")
    got = {r["sid"]: r["components"] for r in component_counts(frame, 2).collect()}
    assert got == {0: 3, 1: 1}


def test_attach_paths(spark, monkeypatch):
    rows = spark.range(200).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    levels = rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.sum("id").alias("s"))
    want = sorted(scale.attach(rows, levels, ["k"], 10).collect())
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(scale, "HOT_LEVEL_ROWS", 20)
    assert sorted(scale.attach(rows, levels, ["k"], 10).collect()) == want
    assert len(want) == 200


def test_best_model_rules(models):
    curve = report.curve_table(models)
    assert report.best_model(curve, JOB, stars=(0, 1, 2)).count() == 0
    top = curve.where("p_value < 0.01")
    full = {tuple(r) for r in top.where("is_full").select(*report.CURVE).distinct().collect()}
    best = {tuple(r) for r in report.best_model(curve, JOB).select(*report.CURVE).collect()}
    every = {tuple(r) for r in top.select(*report.CURVE).distinct().collect()}
    assert best == every - full


def test_no_sign_change_no_marker(models):
    positive = report.curve_table(models.where("coef > 0"))
    assert report.closest_to_zero(positive).count() == 0


def test_axis_of_a_single_value(spark, models):
    one = models.where("bits = 1").withColumns({"ci99_lo": F.lit(2.0), "ci99_hi": F.lit(2.0)})
    row = report.axis_ranges(one).first()
    assert (row["axis_lo"], row["axis_hi"]) == (1.0, 3.0)
    assert row["ticks"] == [3.0, 2.5, 2.0, 1.5, 1.0]


def test_filter_state_names(models):
    with pytest.raises(ValueError):
        report.filter_curve(models, {"a": "other"})


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_results_round_trip(spark, models, tmp_path, kind):
    path = str(tmp_path / "results")
    write_results(models, path, kind)
    back = read_results(spark, path, kind)
    columns = [c for c in models.columns if c != "controls_all" and c != "controls_test"]
    want = sorted(map(repr, models.select(*columns).collect()))
    assert sorted(map(repr, back.select(*columns).collect())) == want
    assert report.run_summary(back).count() == 4
    halves = models.withColumns({"grouping_variable": F.lit("z"), "group_value": F.lit(1)})
    write_results(halves, path, kind)
    assert read_results(spark, path, kind).where("group_value = 1").count() == models.count()


def test_saved_csv_tolerates_gaps(spark, tmp_path):
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "coef,se,t_value,p_value,df_resid,ci99_lo,ci99_hi,ci95_lo,ci95_hi,ci90_lo,ci90_hi,"
        "controls_test,controls_all,control_stats,is_full,obs\n"
        '1.5,1,1.5,0.2,9,0,3,0,3,0,3,"[""a""]","[""a"",""m""]",not json,True,12\n'
    )
    row = read_results(spark, str(folder), "csv").first()
    assert row["coef"] == 1.5 and row["obs"] == 12 and row["is_full"] is True
    assert row["controls_all"] == ["a", "m"] and row["control_stats"] == []
    assert row["adj_r2"] is None


def test_significance_file_only_with_rows(spark, models, tmp_path):
    none = report.significance_table(models.where("p_value > 0.5"), JOB)
    assert not write_significance(none, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    some = report.significance_table(models, JOB)
    assert write_significance(some, str(tmp_path / "some"))
    p = [r["p_value"] for r in some.collect()]
    assert p == sorted(p)


def test_grid_manifest_metadata(spark, tmp_path):
    write_grid(spark, JOB, str(tmp_path / "grid"))
    grid = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "grid"))
    assert grid.count() == JOB.model_count
    write_manifest(spark, JOB, str(tmp_path / "job"))
    assert read_manifest(spark, str(tmp_path / "job"))["firm"] == "firm"
    write_metadata(spark, JOB, str(tmp_path / "meta"))
    back = read_metadata(spark, str(tmp_path / "meta"))
    assert back.count() == curve_metadata(spark, JOB).count() == 8
    group = back.first()["matrix_alt_groups"][0]
    assert (group["start"], group["end"], group["label"]) == (2, 3, "0/1 of 2")
    assert group["names"] == ["c", "d"]


def test_report_from_a_file_and_its_metadata(spark, models, tmp_path):
    write_metadata(spark, JOB, str(tmp_path / "meta"))
    meta = read_metadata(spark, str(tmp_path / "meta")).orderBy("y", "x", "spec_tag").first()
    own = models.where(
        (F.col("y") == meta["y"]) & (F.col("x") == meta["x"])
        & (F.col("spec_tag") == meta["spec_tag"])
    )
    path = str(tmp_path / "curve")
    to_saved(own).select(*SAVED).coalesce(1).write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    back = read_curve(spark, path, meta)
    for asked in (None, "p"):
        order = saved_order(meta, asked)
        assert order == (asked or JOB.order)
        column = "p_value" if asked else "coef"
        placed = [report.curve_table(t, order).orderBy("pos") for t in (back, own)]
        got, want = ([r[column] for r in t.collect()] for t in placed)
        assert got == want and len(got) == own.count() > 0
    assert report.significance_table(back, JOB).count() == own.where("p_value < 0.10").count()


def test_panel_formats(spark, tmp_path):
    data = pd.DataFrame({"firm": ["a", "b", "c"], "year": [1, 2, 3], "y": [1.5, None, 2.0]})
    folder = tmp_path / "panel.dta"
    folder.mkdir()
    for part in (0, 1):
        data.to_stata(folder / f"p{part}.dta", write_index=False)
    stata = read_panel(spark, str(folder))
    assert stata.count() == 6 and stata.where("y is null").count() == 2
    assert dict(stata.dtypes) == {"firm": "string", "year": "bigint", "y": "double"}
    data.to_csv(tmp_path / "panel.csv", index=False)
    assert dict(read_panel(spark, str(tmp_path / "panel.csv")).dtypes)["y"] == "double"
    data.to_parquet(tmp_path / "panel.pq")
    assert read_panel(spark, str(tmp_path / "panel.pq")).count() == 3
    with pytest.raises(ValueError, match="unsupported"):
        read_panel(spark, "panel.xlsx")


def test_group_stars_of_missing_models(models):
    sub = models.where("bits < 50").withColumns(
        {"group_value": F.lit(0), "grouping_variable": F.lit("z[by_none]")}
    )
    table = report.significance_table(models.where("bits < 50"), JOB, subgroups=sub,
                                      interactions=models.where("bits < 9"))
    rows = table.collect()
    assert {r["Group1"] for r in rows if r["GroupingVariable"]} == {"0"}
    assert all(r["Group0"] != "" for r in rows if r["GroupingVariable"])
    assert {r["Specs"] for r in rows} == {models.where("bits < 50").count()}


def test_job_defaults():
    assert SpecCurveJob(y="y", x="x").designs == ("ab_firm_time_cl_firm",)
