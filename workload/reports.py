"""Report queries over the orders read as a result table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from speccurve import SpecCurveJob
from speccurve.catalog import catalog_frame
from speccurve.functions.labels import path_label
from speccurve.operators.grid import control_layout
from speccurve.operators.scale import attach, checkpoint_folder
from speccurve.plans import report
from speccurve.sources.panels import read_panel
from speccurve.sources.results import read_results, write_results
from workload.panels import MODELS_SQL, PANEL_SQL, order_models, panel

JOB = SpecCurveJob(
    y=("y0", "y1"), x=("x0", "x1"), must=("m",), test=("a", "b", ["c", "d"]),
    firm="firm", ind="ind", time="tm", region="region",
    designs=("ab_firm_time_cl_firm", "no_absorb_robust"),
)
CURVE = "y, x, spec_tag"
STAR = (
    "(CASE WHEN p_value < 0.01 THEN 3 WHEN p_value < 0.05 THEN 2 "
    "WHEN p_value < 0.10 THEN 1 ELSE 0 END)"
)
SIGNED = f"({STAR} * CASE WHEN coef < 0 THEN -1 ELSE 1 END)"
LABEL = (
    "CASE WHEN {s} > 0 THEN '+' || CAST({s} AS VARCHAR) WHEN {s} < 0 THEN CAST({s} AS VARCHAR) "
    "ELSE '0' END"
)
CONTROLS = (
    "concat_ws(', ', 'm', CASE WHEN in_a THEN 'a' END, CASE WHEN in_b THEN 'b' END, "
    "CASE WHEN in_c THEN 'c' END, CASE WHEN in_d THEN 'd' END)"
)
FULL = "(in_a AND in_b AND (in_c OR in_d))"
TESTS = "(CAST(in_a AS INT) + CAST(in_b AS INT) + CAST(in_c AS INT) + CAST(in_d AS INT))"
SIGNED_P = "(CASE WHEN coef < 0 THEN -1.0 ELSE 1.0 END / greatest(p_value, 2.2250738585072014e-308))"
WITH = f"WITH r AS ({MODELS_SQL}) "
PLACED = (
    f"WITH r0 AS ({MODELS_SQL}), r AS (SELECT *, row_number() OVER "
    f"(PARTITION BY {CURVE} ORDER BY coef, bits) - 1 AS pos FROM r0) "
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


_HISTOGRAM = ", ".join(
    f"count(*) FILTER (WHERE {SIGNED} = {v}) AS {n}"
    for v, n in ((3, "plus3"), (2, "plus2"), (1, "plus1"),
                 (-1, "minus1"), (-2, "minus2"), (-3, "minus3"))
)
_DESIGN = (
    "CASE WHEN spec_tag = 'no_absorb_robust' THEN '{}' ELSE '{}' END"
)
_SIG = (
    f"{SIGNED} AS \"Star\", round(coef, 6) AS coef, round(p_value, 6) AS p_value, "
    f"round(t_value, 6) AS t_value, obs, y AS \"Y\", x AS \"X\", {CONTROLS} AS \"Controls\", "
    f"{_DESIGN.format('', 'firm, tm')} AS \"FE\", {_DESIGN.format('robust', 'firm')} AS cluster"
)


@query(
    "significance_table",
    WITH + f"SELECT {_SIG}, '' AS \"GroupingVariable\", '' AS \"Group0\", '' AS \"Group1\", "
    "(SELECT count(*) FROM r) AS \"Specs\" FROM r WHERE p_value < 0.10",
)
def significance_table(spark, sf_dir):
    return report.significance_table(order_models(spark, sf_dir), JOB)


def _halves(models):
    """Both halves of two grouping variables, made from the models."""
    names = F.explode(F.array(F.lit("z[by_time]"), F.lit("w[by_none]")))
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    halves = models.select("*", names.alias("grouping_variable")).select(
        "*", half.alias("group_value")
    )
    stronger = (F.col("group_value") == 0) == (F.col("grouping_variable") == "z[by_time]")
    p = F.when(stronger, F.col("p_value") / 2).otherwise(F.col("p_value") * 2)
    return halves.withColumn("p_value", p)


_HALF_STARS = SIGNED.replace("p_value", "hp")
_GROUPED = (
    f"h AS (SELECT *, {_HALF_STARS} AS star FROM (SELECT *, CASE WHEN (half = 0) = (gv = 'z[by_time]') "
    "THEN p_value / 2 ELSE p_value * 2 END AS hp FROM r, (VALUES (0), (1)) t(half), "
    "(VALUES ('z[by_time]'), ('w[by_none]')) u(gv))), "
    f"k AS (SELECT {CURVE}, gv, {CONTROLS} AS controls, "
    "max_by(star, bits) FILTER (WHERE half = 0) AS star0, "
    "max_by(star, bits) FILTER (WHERE half = 1) AS star1 "
    f"FROM h GROUP BY {CURVE}, gv, controls) "
)


@query(
    "significance_with_groups",
    WITH.rstrip() + ", " + _GROUPED
    + f"SELECT s.*, g.gv AS \"GroupingVariable\", {LABEL.format(s='k.star0')} AS \"Group0\", "
    f"{LABEL.format(s='k.star1')} AS \"Group1\", (SELECT count(*) FROM r) AS \"Specs\" "
    f"FROM (SELECT {_SIG} FROM r WHERE p_value < 0.10) s CROSS JOIN "
    "(VALUES ('z[by_time]'), ('w[by_none]')) g(gv) LEFT JOIN k ON k.y = s.\"Y\" AND "
    "k.x = s.\"X\" AND k.gv = g.gv AND k.controls = s.\"Controls\" AND "
    "k.spec_tag = CASE WHEN s.cluster = 'robust' THEN 'no_absorb_robust' "
    "ELSE 'ab_firm_time_cl_firm' END",
)
def significance_with_groups(spark, sf_dir):
    models = order_models(spark, sf_dir)
    return report.significance_table(models, JOB, subgroups=_halves(models))


@query("star_counts", WITH + f"SELECT y, x, {_HISTOGRAM} FROM r GROUP BY y, x")
def star_counts(spark, sf_dir):
    return report.star_counts(order_models(spark, sf_dir))


@query(
    "run_summary",
    WITH + "SELECT y, x, count(*) AS n_specs, count(*) FILTER (WHERE p_value < 0.10) AS n_sig, "
    f"{_HISTOGRAM} FROM r GROUP BY y, x",
)
def run_summary(spark, sf_dir):
    return report.run_summary(order_models(spark, sf_dir))


_PAGE_P = "sign(coef) / greatest(p_value, 1e-300)"
for _order, _key in (
    ("coef", "coef"), ("p", SIGNED_P), ("signed_p", _PAGE_P), ("obs", "obs")
):

    @query(
        f"curve_by_{_order}",
        WITH + f"SELECT {CURVE}, bits, coef, p_value, obs, row_number() OVER (PARTITION BY {CURVE} "
        f"ORDER BY {_key}, bits) - 1 AS pos, {STAR} AS star, {TESTS} = 0 AS is_no_test FROM r",
    )
    def curve(spark, sf_dir, order=_order):
        placed = report.curve_table(order_models(spark, sf_dir), order)
        return placed.select(
            "y", "x", "spec_tag", "bits", "coef", "p_value", "obs", "pos", "star", "is_no_test"
        )


@query(
    "run_lengths",
    PLACED.rstrip() + ", c AS ("
    + " UNION ALL ".join(
        f"SELECT {CURVE}, pos, '{n}' AS control FROM r WHERE in_{n}" for n in "abcd"
    )
    + f"), i AS (SELECT *, pos - row_number() OVER (PARTITION BY {CURVE}, control ORDER BY pos) "
    f"AS island FROM c), g AS (SELECT {CURVE}, control, min(pos) AS start, count(*) AS len "
    f"FROM i GROUP BY {CURVE}, control, island) SELECT {CURVE}, control, start, len, "
    f"max(len) OVER (PARTITION BY {CURVE}) AS max_len, "
    f"round(pow(len / max(len) OVER (PARTITION BY {CURVE}), 0.6), 6) AS shade FROM g",
)
def run_lengths(spark, sf_dir):
    placed = report.curve_table(order_models(spark, sf_dir), "coef")
    return report.run_lengths(placed, JOB.matrix_names).select(
        "y", "x", "spec_tag", "control", "start", "len", "max_len",
        F.round("shade", 6).alias("shade"),
    )


@query(
    "closest_to_zero",
    PLACED + f"SELECT {CURVE}, bits, pos, coef FROM (SELECT *, row_number() OVER (PARTITION BY "
    f"{CURVE} ORDER BY abs(coef), pos) AS n, min(coef) OVER (PARTITION BY {CURVE}) AS lo, "
    f"max(coef) OVER (PARTITION BY {CURVE}) AS hi FROM r) WHERE n = 1 AND lo < 0 AND hi > 0",
)
def closest_to_zero(spark, sf_dir):
    return report.closest_to_zero(report.curve_table(order_models(spark, sf_dir)))


@query(
    "best_model",
    PLACED + f"SELECT {CURVE}, bits, pos, tests AS test_count, p_value FROM (SELECT *, {TESTS} AS "
    f"tests, row_number() OVER (PARTITION BY {CURVE} ORDER BY {TESTS} DESC, p_value, pos) AS n, "
    f"bool_or({FULL} AND spec_tag <> 'no_absorb_robust') OVER (PARTITION BY {CURVE}) AS f FROM r "
    "WHERE p_value < 0.01) WHERE n = 1 AND NOT f",
)
def best_model(spark, sf_dir):
    """A run in which no model of one design is full."""
    models = order_models(spark, sf_dir).withColumn(
        "is_full", F.col("is_full") & (F.col("spec_tag") != "no_absorb_robust")
    )
    return report.best_model(report.curve_table(models), JOB)


@query(
    "guide_positions",
    PLACED + f"SELECT {CURVE}, guide, count(*) AS models, min(pos) AS first, max(pos) AS last "
    f"FROM (SELECT {CURVE}, pos, 'full' AS guide FROM r WHERE {FULL} UNION ALL "
    f"SELECT {CURVE}, pos, 'no_test' FROM r WHERE {TESTS} = 0 UNION ALL "
    f"SELECT {CURVE}, pos, 'closest_to_zero' FROM (SELECT *, row_number() OVER (PARTITION BY "
    f"{CURVE} ORDER BY abs(coef), pos) AS n, min(coef) OVER (PARTITION BY {CURVE}) AS lo, "
    f"max(coef) OVER (PARTITION BY {CURVE}) AS hi FROM r) WHERE n = 1 AND lo < 0 AND hi > 0 "
    f"UNION ALL SELECT {CURVE}, pos, 'best' FROM (SELECT *, row_number() OVER (PARTITION BY "
    f"{CURVE} ORDER BY {TESTS} DESC, p_value, pos) AS n, bool_or({FULL}) OVER (PARTITION BY "
    f"{CURVE}) AS f FROM r WHERE p_value < 0.01) WHERE n = 1 AND NOT f) GROUP BY {CURVE}, guide",
)
def guide_positions(spark, sf_dir):
    placed = report.curve_table(order_models(spark, sf_dir))
    return report.guide_positions(placed, JOB).groupBy("y", "x", "spec_tag", "guide").agg(
        F.count("*").alias("models"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )


@query(
    "always_in_top",
    WITH + f"SELECT {CURVE}, control, total AS models FROM ("
    + " UNION ALL ".join(
        f"SELECT {CURVE}, '{n}' AS control, count(*) AS total, "
        f"count(*) FILTER (WHERE {'true' if n == 'b' else f'in_{n}'}) AS used FROM r "
        f"WHERE p_value < 0.01 GROUP BY {CURVE}"
        for n in "abcd"
    )
    + ") WHERE used = total",
)
def always_in_top(spark, sf_dir):
    """A run in which every model has the control b."""
    models = order_models(spark, sf_dir).withColumn(
        "controls_all", F.array_union("controls_all", F.array(F.lit("b")))
    )
    return report.always_in_top(models, JOB)


@query(
    "common_controls",
    WITH + f"SELECT {CURVE}, concat_ws(',', 'm', 'a', CASE WHEN "
    "bool_and(in_b) THEN 'b' END, CASE WHEN bool_and(in_c) THEN 'c' END, CASE WHEN "
    f"bool_and(in_d) THEN 'd' END) AS controls FROM r GROUP BY {CURVE}",
)
def common_controls(spark, sf_dir):
    """A run in which every model has the control a."""
    models = order_models(spark, sf_dir).withColumn(
        "controls_all", F.array_union("controls_all", F.array(F.lit("a")))
    )
    found = report.common_controls(models, list("mabcd"))
    return found.withColumn("controls", F.array_join("controls", ","))


@query(
    "obs_statistics",
    WITH + f"SELECT {CURVE}, count(*) AS n, round(avg(obs), 6) AS mean, "
    "round(stddev_pop(obs), 6) AS std, min(obs) AS min, "
    + ", ".join(
        f"round(quantile_cont(obs, {q}), 6) AS {n}"
        for n, q in (("p1", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))
    )
    + f", max(obs) AS max FROM r GROUP BY {CURVE}",
)
def obs_statistics(spark, sf_dir):
    found = report.obs_stats(order_models(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "p1", "p25", "p50", "p75", "p99")}
    return found.withColumns(rounded)


@query(
    "obs_deviation",
    WITH + f"SELECT {CURVE}, bits, obs, round(obs - avg(obs) OVER (PARTITION BY {CURVE}), 6) "
    "AS deviation FROM r",
)
def obs_deviation(spark, sf_dir):
    found = report.obs_deviation(order_models(spark, sf_dir))
    return found.select(
        "y", "x", "spec_tag", "bits", "obs", F.round("deviation", 6).alias("deviation")
    )


@query(
    "axis_ranges",
    WITH + f"SELECT {CURVE}, obs_min, round(obs_mean, 6) AS obs_mean, obs_max, n_star3, n_star2, "
    "n_star1, n_full, coef_min, coef_max, round(lo - pad, 6) AS axis_lo, "
    "round(hi + pad, 6) AS axis_hi, round(obs_min - opad, 6) AS obs_axis_lo, "
    "round(obs_max + opad, 6) AS obs_axis_hi, "
    "round(hi + pad - (hi - lo + 2 * pad) / 4, 6) AS second_tick FROM (SELECT *, "
    "CASE WHEN lo = hi THEN 1.0 ELSE (hi - lo) * CAST(0.09 AS double) END AS pad, "
    "CASE WHEN obs_min = obs_max THEN 1.0 ELSE (obs_max - obs_min) * CAST(0.06 AS double) END AS opad FROM ("
    f"SELECT {CURVE}, min(coef - 2.5 * se) AS lo, max(coef + 2.5 * se) AS hi, "
    "min(obs) AS obs_min, avg(obs) AS obs_mean, max(obs) AS obs_max, "
    + ", ".join(f"count(*) FILTER (WHERE {STAR} = {k}) AS n_star{k}" for k in (3, 2, 1))
    + f", count(*) FILTER (WHERE {FULL}) AS n_full, min(coef) AS coef_min, max(coef) AS coef_max "
    f"FROM r GROUP BY {CURVE}))",
)
def axis_ranges(spark, sf_dir):
    found = report.axis_ranges(order_models(spark, sf_dir))
    names = ["obs_mean", "axis_lo", "axis_hi", "obs_axis_lo", "obs_axis_hi"]
    return found.withColumns(
        {n: F.round(n, 6) for n in names} | {"second_tick": F.round(F.col("ticks")[1], 6)}
    ).drop("ticks")


@query(
    "control_filters",
    WITH + " UNION ALL ".join(
        f"SELECT '{name}' AS filter, {CURVE}, bits FROM r WHERE {where}"
        for name, where in (
            ("a_sig", "in_a AND p_a < 0.10"),
            ("a_nonsig_b_absent", "in_a AND p_a >= 0.10 AND NOT in_b"),
            ("c_nonsig", "in_c"),
            ("stars_3_2", "p_value < 0.05"),
        )
    ),
)
def control_filters(spark, sf_dir):
    models = order_models(spark, sf_dir)
    filters = {
        "a_sig": ({"a": "sig"}, None),
        "a_nonsig_b_absent": ({"a": "nonsig", "b": "absent"}, None),
        "c_nonsig": ({"c": "nonsig"}, None),
        "stars_3_2": (None, (3, 2)),
    }
    out = None
    for name, (states, stars) in filters.items():
        part = report.filter_curve(models, states, stars).select(
            F.lit(name).alias("filter"), "y", "x", "spec_tag", "bits"
        )
        out = part if out is None else out.unionByName(part)
    return out


_A_STAR = "(CASE WHEN p_a < 0.01 THEN 3 WHEN p_a < 0.05 THEN 2 WHEN p_a < 0.10 THEN 1 ELSE 0 END)"
_A_SIGNED = f"({_A_STAR} * CASE WHEN coef_a < 0 THEN -1 ELSE 1 END)"


@query(
    "control_matrix",
    PLACED + " UNION ALL ".join(
        f"SELECT {CURVE}, bits, pos, CAST({i} AS INTEGER) AS row, '{n}' AS control, {inc} AS "
        f"included, CAST({star} AS INTEGER) AS star FROM r"
        for i, (n, inc, star) in enumerate(
            [("m", "TRUE", SIGNED), ("a", "in_a", f"CASE WHEN in_a THEN {_A_SIGNED} END"),
             ("b", "in_b", "NULL"), ("c", "in_c", "NULL"), ("d", "in_d", "NULL")]
        )
    ),
)
def control_matrix(spark, sf_dir):
    placed = report.curve_table(order_models(spark, sf_dir))
    return report.control_matrix(placed, JOB, significance=True)


def _badge(coef, star):
    return (
        f"CASE WHEN {star} = 0 THEN CASE WHEN {coef} < 0 THEN '0-' ELSE '0+' END ELSE "
        f"{LABEL.format(s=star)} END"
    )


@query(
    "model_detail",
    WITH + " UNION ALL ".join(
        f"SELECT {CURVE}, bits, '{n}' AS control, '{k}' AS kind, replace({CONTROLS}, ', ', ' ') "
        f"AS copy_text, {badge} AS badge, {coef} AS coef, {stars} AS stars FROM r"
        for n, k, badge, coef, stars in [
            ("m", "must", _badge("coef", SIGNED), "coef",
             f"CASE WHEN {STAR} = 0 THEN '.' ELSE repeat('*', {STAR}) END"),
            ("a", "test", f"CASE WHEN in_a THEN {_badge('coef_a', _A_SIGNED)} ELSE '' END",
             "CASE WHEN in_a THEN coef_a END",
             f"CASE WHEN in_a THEN CASE WHEN {_A_STAR} = 0 THEN '.' ELSE repeat('*', {_A_STAR}) "
             "END END"),
            *[(n, "test", f"CASE WHEN in_{n} THEN '--' ELSE '' END", "NULL", "NULL")
              for n in "bcd"],
        ]
    ),
)
def model_detail(spark, sf_dir):
    found = report.model_detail(order_models(spark, sf_dir), JOB)
    return found.select("y", "x", "spec_tag", "bits", "control", "kind", "copy_text", "badge",
                        "coef", "stars")


@query("curve_choices", WITH + f"SELECT {CURVE}, count(*) AS models FROM r WHERE y = 'y1' "
       f"GROUP BY {CURVE}")
def curve_choices(spark, sf_dir):
    return report.curve_choices(order_models(spark, sf_dir), y="y1")


@query(
    "choose_curve",
    WITH + "SELECT y, x, spec_tag, models FROM (SELECT y, x, spec_tag, count(*) AS models, "
    "row_number() OVER (PARTITION BY y ORDER BY CASE WHEN x = 'x0' THEN 0 ELSE 1 END, "
    "CASE WHEN spec_tag = 'ab_firm_time_cl_firm' THEN 1 ELSE 2 END) AS n FROM r "
    "WHERE y = 'y1' GROUP BY y, x, spec_tag) WHERE n = 1",
)
def choose_curve(spark, sf_dir):
    """Neither the regressor nor the design asked for is there."""
    return report.choose_curve(
        order_models(spark, sf_dir), JOB, "y1", x="absent", spec_tag="absent"
    )


@query(
    "design_labels",
    WITH + "SELECT spec_tag, count(*) AS models, " + _DESIGN.format(
        "noabsorb vce(robust) Std.Err.=Robust",
        "absorb(firm tm) vce(cluster firm) Std.Err.=cluster(firm)",
    )
    + " AS display, 'y0_' || spec_tag AS folder FROM r GROUP BY spec_tag",
)
def design_labels(spark, sf_dir):
    models = order_models(spark, sf_dir).groupBy("spec_tag").agg(
        F.count("*").alias("models"), F.count("*").alias("n_rows")
    )
    labels = catalog_frame(spark, JOB.active_designs)
    # One label row per design of the job.
    joined = models.join(F.broadcast(labels), "spec_tag")
    folder = path_label(F.concat(F.lit("/y0 #"), "spec_tag"))
    return joined.select("spec_tag", "models", "display", folder.alias("folder"))


@query(
    "control_layout",
    f"WITH p AS ({PANEL_SQL}) SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS control, '{k}' AS kind, CAST({r} AS INTEGER) AS row, {g} AS group_label, "
        f"count({c}) AS present FROM p"
        for c, k, r, g in (
            ("c_tax", "must", "NULL", "NULL"), ("c_size", "must", 0, "'1 of 2'"),
            ("c_sbal", "must", 1, "'1 of 2'"), ("c_cbal", "test", 2, "NULL"),
            ("c_retail", "test", 3, "'0/1 of 2'"), ("x2", "test", 4, "'0/1 of 2'"),
        )
    ) + ")",
)
def layout(spark, sf_dir):
    """The controls of a job, their place and how often they are present."""
    job = SpecCurveJob(y="y", x="x", must=("c_tax", ["c_size", "c_sbal"]),
                       test=("c_cbal", ["c_retail", "x2"]), firm="firm", ind="ind", time="tm")
    names = job.must_names + job.test_names
    counts = panel(spark, sf_dir).agg(*[F.count(n).alias(n) for n in names])
    present = counts.unpivot([], names, "control", "present").withColumn("n_rows", F.lit(1))
    found = attach(control_layout(spark, job), present, ["control"], len(names))
    return found.select("control", "kind", "row", "group_label", "present")


_ROUND_TRIP = (
    f"SELECT {CURVE}, bits, coef, p_value, obs, {CONTROLS} AS controls, {FULL} AS is_full, "
    "CAST(CASE WHEN in_a THEN 2 ELSE 1 END AS INTEGER) AS stats FROM r"
)


def _scratch(spark) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


for _kind in ("parquet", "csv"):

    @query(f"results_round_trip_{_kind}", WITH + _ROUND_TRIP)
    def round_trip(spark, sf_dir, kind=_kind):
        path = _scratch(spark)
        write_results(order_models(spark, sf_dir), path, kind)
        back = read_results(spark, path, kind)
        ordered = F.filter(
            F.array(*map(F.lit, "mabcd")), lambda n: F.array_contains("controls_all", n)
        )
        return back.select("y", "x", "spec_tag", "bits", "coef", "p_value", "obs",
                           F.array_join(ordered, ", ").alias("controls"), "is_full",
                           F.size("control_stats").alias("stats"))


@query(
    "panel_from_csv",
    f"WITH p AS ({PANEL_SQL}) SELECT ind, count(*) AS n, count(c_size) AS sizes, "
    "round(sum(y), 2) AS sum_y, min(tm) AS first_year FROM p GROUP BY ind",
)
def panel_from_csv(spark, sf_dir):
    path = _scratch(spark) + ".csv"
    source = panel(spark, sf_dir)
    source.write.option("header", True).csv(path)
    back = read_panel(spark, path, source.schema)
    return back.groupBy("ind").agg(
        F.count("*").alias("n"), F.count("c_size").alias("sizes"),
        F.round(F.sum("y"), 2).alias("sum_y"), F.min("tm").alias("first_year"),
    )
