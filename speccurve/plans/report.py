"""Reports on a result table: tables, curves, guides and filters.

Every function takes results as :func:`speccurve.spec_curve` returns them or
as :func:`speccurve.sources.results.read_results` reads them back.  A curve is
the set of models of one (y, x, spec_tag).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speccurve.catalog import catalog_frame
from speccurve.functions.labels import (
    badge,
    control_stat,
    controls_in_order,
    controls_text,
    curve_order,
    signed_star,
    star_label,
    star_level,
    star_text,
)
from speccurve.job import SpecCurveJob
from speccurve.operators.scale import attach, positions

CURVE = ["y", "x", "spec_tag"]
RUN_BLOCK = 100_000


def estimated(results: DataFrame) -> DataFrame:
    """Models that were estimated."""
    return results.where("status = 'ok'") if "status" in results.columns else results


def skipped_models(results: DataFrame) -> DataFrame:
    """Number of models per curve and status."""
    return results.groupBy(*CURVE, "status").agg(F.count("*").alias("models"))


# -- significance table and summaries ---------------------------------------


def significance_table(
    results: DataFrame,
    job: SpecCurveJob,
    subgroups: DataFrame | None = None,
    interactions: DataFrame | None = None,
) -> DataFrame:
    """Models significant at 10 %, ordered by rounded p.

    With subgroup results the main rows appear once per grouping variable,
    with the stars of both halves; interaction rows are added at the end.
    ``Specs`` is the number of base models of the whole run.
    """
    base = estimated(results)
    total = base.count()
    rows = _significance_rows(base, job)
    parts = []
    if subgroups is None:
        parts.append(_with_groups(rows))
    else:
        parts.append(_starred(rows, subgroups))
    if interactions is not None:
        parts.append(_with_groups(_significance_rows(estimated(interactions), job)))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    columns = (
        "Star coef p_value t_value obs Y X Controls FE cluster "
        "GroupingVariable Group0 Group1 Specs"
    ).split()
    return (
        table.withColumn("Specs", F.lit(total).cast("long"))
        .orderBy("p_value", "Y", "X", "spec_tag", "bits", "GroupingVariable")
        .select(*columns)
    )


def _significance_rows(base: DataFrame, job: SpecCurveJob) -> DataFrame:
    designs = catalog_frame(base.sparkSession, job.active_designs).select(
        "spec_tag", F.col("fe_label").alias("FE"), F.col("cluster_label").alias("cluster")
    )
    names = job.must_names + job.test_names
    # The catalog side has one row per enabled design.
    return (
        base.where("p_value < 0.10")
        .join(F.broadcast(designs), "spec_tag")
        .select(
            signed_star("coef", "p_value").alias("Star"),
            F.round("coef", 6).alias("coef"),
            F.round("p_value", 6).alias("p_value"),
            F.round("t_value", 6).alias("t_value"),
            "obs",
            F.col("y").alias("Y"),
            F.col("x").alias("X"),
            controls_text(names).alias("Controls"),
            "FE",
            "cluster",
            "spec_tag",
            "bits",
            F.sort_array("controls_all").alias("controls_key"),
        )
    )


def _with_groups(rows: DataFrame) -> DataFrame:
    blank = {name: F.lit("") for name in ("GroupingVariable", "Group0", "Group1")}
    return rows.withColumns(blank).drop("controls_key")


def group_stars(subgroups: DataFrame) -> DataFrame:
    """Stars of both halves per model and grouping variable, one row per
    control set (models that keep the same controls share it)."""
    return (
        estimated(subgroups)
        .groupBy(*CURVE, "grouping_variable", F.sort_array("controls_all").alias("controls_key"))
        .pivot("group_value", [0, 1])
        .agg(F.max_by(signed_star("coef", "p_value"), "bits"))
        .withColumnsRenamed({"0": "star0", "1": "star1"})
    )


def _starred(rows: DataFrame, subgroups: DataFrame) -> DataFrame:
    labels = [r[0] for r in subgroups.select("grouping_variable").distinct().collect()]
    repeated = rows.withColumn(
        "GroupingVariable", F.explode(F.array(*map(F.lit, sorted(labels))))
    )
    stars = group_stars(subgroups).select(
        F.col("y").alias("Y"),
        F.col("x").alias("X"),
        "spec_tag",
        F.col("grouping_variable").alias("GroupingVariable"),
        "controls_key",
        "star0",
        "star1",
    )
    joined = repeated.join(
        stars, ["Y", "X", "spec_tag", "GroupingVariable", "controls_key"], "left"
    )
    return joined.withColumns(
        {"Group0": star_label(F.col("star0")), "Group1": star_label(F.col("star1"))}
    ).drop("star0", "star1", "controls_key")


def _star_columns() -> list[Column]:
    star = signed_star("coef", "p_value")
    names = {3: "plus3", 2: "plus2", 1: "plus1", -1: "minus1", -2: "minus2", -3: "minus3"}
    return [F.count_if(star == value).alias(name) for value, name in names.items()]


def star_counts(results: DataFrame) -> DataFrame:
    """Signed-star histogram per y and x."""
    return estimated(results).groupBy("y", "x").agg(*_star_columns())


def run_summary(results: DataFrame) -> DataFrame:
    """Models, significant models and the star histogram per y and x."""
    return estimated(results).groupBy("y", "x").agg(
        F.count("*").alias("n_specs"),
        F.count_if(F.col("p_value") < 0.10).alias("n_sig"),
        *_star_columns(),
    )


# -- the curve ---------------------------------------------------------------


def curve_table(results: DataFrame, order: str = "coef") -> DataFrame:
    """Estimated models with their place ``pos`` in the ordered curve."""
    placed = positions(estimated(results), CURVE, curve_order(order))
    return placed.withColumns(
        {
            "star": star_level("p_value"),
            "is_no_test": F.size("controls_test") == 0,
        }
    )


def run_lengths(curve: DataFrame, controls: list[str]) -> DataFrame:
    """Runs of consecutive models that include a control: start, len, grey.

    Places are cut into blocks of ``RUN_BLOCK``; runs are found inside blocks
    and those that touch a block border are joined afterwards, so a curve of
    any length never meets in one task.
    """
    included = curve.select(
        *CURVE, "pos", F.explode(controls_in_order(controls)).alias("control")
    ).withColumn("block", F.expr(f"pos div {RUN_BLOCK}"))
    run = [*CURVE, "control"]
    inside = Window.partitionBy(*run, "block").orderBy("pos")
    pieces = (
        included.withColumn("island", F.col("pos") - F.row_number().over(inside))
        .groupBy(*run, "block", "island")
        .agg(F.min("pos").alias("start"), F.count("*").alias("len"))
        .withColumn("after", F.col("start") + F.col("len"))
    )
    touches = (F.col("start") % RUN_BLOCK == 0) | (F.col("after") % RUN_BLOCK == 0)
    closed = pieces.where(~touches).select(*run, "start", "len")
    # At most two rows per control and block.
    border = Window.partitionBy(*run).orderBy("start")
    opened = pieces.where(touches).withColumn(
        "fresh",
        F.coalesce((F.lag("after").over(border) != F.col("start")).cast("int"), F.lit(1)),
    )
    joined = (
        opened.withColumn("island", F.sum("fresh").over(border))
        .groupBy(*run, "island")
        .agg(F.min("start").alias("start"), F.sum("len").alias("len"))
        .select(*run, "start", "len")
    )
    runs = closed.unionByName(joined)
    longest = runs.groupBy(*CURVE).agg(
        F.max("len").alias("max_len"), F.count("*").alias("n_rows")
    )
    shade = F.pow(F.col("len") / F.col("max_len"), F.lit(0.6))
    return (
        attach(runs, longest, CURVE, curve.select(*CURVE).distinct().count())
        .withColumn("shade", shade)
        .withColumn("grey", F.rint(200 - 200 * F.col("shade")).cast("int"))
    )


def control_matrix(curve: DataFrame, job: SpecCurveJob, significance: bool = False) -> DataFrame:
    """Model x control: included or not, and the control's signed stars.

    Shows the varying controls, or in significance mode all of them.
    """
    names = job.must_names + job.test_names if significance else job.matrix_names
    names = list(dict.fromkeys(names))
    cells = curve.select(
        *CURVE,
        "bits",
        "pos",
        "controls_all",
        "control_stats",
        F.posexplode(F.array(*map(F.lit, names))).alias("row", "control"),
    )
    stat = control_stat(F.col("control"))
    return cells.select(
        *CURVE,
        "bits",
        "pos",
        "row",
        "control",
        F.array_contains("controls_all", F.col("control")).alias("included"),
        F.when(stat.isNotNull(), signed_star(stat["coef"], stat["p_value"])).alias("star"),
    )


def closest_to_zero(curve: DataFrame) -> DataFrame:
    """Per curve the model nearest to zero, only where signs differ."""
    nearest = F.min_by(
        F.struct("bits", "pos", "coef"), F.struct(F.abs("coef"), "pos")
    ).alias("m")
    found = curve.groupBy(*CURVE).agg(nearest, F.min("coef").alias("lo"), F.max("coef").alias("hi"))
    return found.where("lo < 0 and hi > 0").select(*CURVE, "m.*")


def best_model(curve: DataFrame, job: SpecCurveJob, stars=(0, 1, 2, 3)) -> DataFrame:
    """Per curve the three-star model with most optional controls, then the
    smallest p, then the first; none where a three-star model is full or
    three-star models are hidden."""
    top = curve.where(star_level("p_value") == 3)
    if 3 not in stars:
        top = top.where(F.lit(False))
    optional = F.array(*map(F.lit, job.test_names)).cast("array<string>")
    count = F.size(F.array_intersect("controls_all", optional))
    best = F.min_by(
        F.struct("bits", "pos", count.alias("test_count"), "p_value"),
        F.struct(-count, "p_value", "pos"),
    ).alias("m")
    found = top.groupBy(*CURVE).agg(best, F.bool_or("is_full").alias("any_full"))
    return found.where("not any_full").select(*CURVE, "m.*")


def guide_positions(curve: DataFrame, job: SpecCurveJob) -> DataFrame:
    """Places of the guide models: full, without optional controls, best,
    closest to zero."""

    def named(rows, kind):
        return rows.select(*CURVE, "bits", "pos", F.lit(kind).alias("guide"))

    parts = [
        named(curve.where("is_full"), "full"),
        named(curve.where("size(controls_test) = 0"), "no_test"),
        named(best_model(curve, job), "best"),
        named(closest_to_zero(curve), "closest_to_zero"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def always_in_top(results: DataFrame, job: SpecCurveJob) -> DataFrame:
    """Optional controls present in every three-star model of a curve."""
    top = estimated(results).where(star_level("p_value") == 3)
    optional = controls_in_order(job.test_names)
    # One count per curve and control; the total is the row marked null.
    counted = (
        top.select(*CURVE, F.explode(F.array_append(optional, F.lit(None))).alias("control"))
        .groupBy(*CURVE, "control")
        .agg(F.count("*").alias("models"))
    )
    totals = counted.where("control is null").select(*CURVE, F.col("models").alias("total"))
    return (
        counted.where("control is not null")
        .join(totals, CURVE)
        .where("models = total")
        .select(*CURVE, "control", "models")
    )


def common_controls(results: DataFrame, names: list[str]) -> DataFrame:
    """Controls present in every model of a curve."""
    counts = [
        F.min(F.array_contains("controls_all", n).cast("int")).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    found = estimated(results).groupBy(*CURVE).agg(*counts)
    flags = [F.when(F.col(f"c{i}") == 1, F.lit(n)) for i, n in enumerate(names)]
    return found.select(*CURVE, F.array_compact(F.array(*flags)).alias("controls"))


# -- statistics over models --------------------------------------------------


def obs_stats(results: DataFrame) -> DataFrame:
    """Mean, population std, min, percentiles (interpolated) and max of the
    observations over the models of a curve.

    Percentiles come from distributed row numbers, not from a per-curve list.
    """
    placed = positions(estimated(results), CURVE, [F.col("obs"), F.col("bits")])
    sizes = placed.groupBy(*CURVE).agg(
        F.count("*").alias("n_rows"),
        F.count("*").alias("n"),
        F.avg("obs").alias("mean"),
        F.stddev_pop("obs").alias("std"),
        F.min("obs").alias("min"),
        F.max("obs").alias("max"),
    )
    joined = attach(placed.select(*CURVE, "pos", "obs"), sizes, CURVE, sizes.count())
    quantiles = {"p1": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}
    aggregates = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        weight = (
            F.when(F.col("pos") == F.floor(at), 1 - (at - F.floor(at)))
            .when(F.col("pos") == F.floor(at) + 1, at - F.floor(at))
        )
        aggregates.append(F.sum(weight * F.col("obs")).alias(name))
    columns = ["n", "mean", "std", "min", "max"]
    found = joined.groupBy(*CURVE).agg(*[F.first(c).alias(c) for c in columns], *aggregates)
    return found.select(*CURVE, "n", "mean", "std", "min", *quantiles, "max")


def obs_deviation(results: DataFrame) -> DataFrame:
    """Distance of each model's observations from the mean of its curve."""
    rows = estimated(results)
    means = rows.groupBy(*CURVE).agg(F.avg("obs").alias("mean_obs"), F.count("*").alias("n_rows"))
    joined = attach(rows.select(*CURVE, "bits", "obs"), means, CURVE, means.count())
    return joined.withColumn("deviation", F.col("obs") - F.col("mean_obs"))


def axis_ranges(results: DataFrame) -> DataFrame:
    """Coefficient and observation axes of each curve with their padding."""
    found = estimated(results).groupBy(*CURVE).agg(
        F.min("ci99_lo").alias("lo"),
        F.max("ci99_hi").alias("hi"),
        F.min("obs").alias("obs_min"),
        F.avg("obs").alias("obs_mean"),
        F.max("obs").alias("obs_max"),
        F.count_if(star_level("p_value") == 3).alias("n_star3"),
        F.count_if(star_level("p_value") == 2).alias("n_star2"),
        F.count_if(star_level("p_value") == 1).alias("n_star1"),
        F.count_if("is_full").alias("n_full"),
        F.min("coef").alias("coef_min"),
        F.max("coef").alias("coef_max"),
    )

    def padded(lo, hi, share):
        pad = F.when(F.col(lo) == F.col(hi), 1.0).otherwise((F.col(hi) - F.col(lo)) * share)
        return F.col(lo) - pad, F.col(hi) + pad

    axis_lo, axis_hi = padded("lo", "hi", 0.09)
    obs_lo, obs_hi = padded("obs_min", "obs_max", 0.06)
    found = found.withColumns(
        {"axis_lo": axis_lo, "axis_hi": axis_hi, "obs_axis_lo": obs_lo, "obs_axis_hi": obs_hi}
    ).drop("lo", "hi")
    step = (F.col("axis_hi") - F.col("axis_lo")) / 4
    return found.withColumn("ticks", F.array(*[F.col("axis_hi") - step * j for j in range(5)]))


# -- exploring ---------------------------------------------------------------


def filter_curve(results: DataFrame, states: dict[str, str] | None = None, stars=None) -> DataFrame:
    """Keep models by the state of controls (``sig``, ``nonsig``, ``absent``,
    all must hold) and by star level."""
    out = estimated(results)
    for name, state in (states or {}).items():
        stat = control_stat(F.lit(name))
        level = F.coalesce(star_level(stat["p_value"]), F.lit(0))
        inside = F.array_contains("controls_all", name)
        if state == "sig":
            out = out.where(stat.isNotNull() & (level > 0))
        elif state == "nonsig":
            out = out.where(inside & (stat.isNull() | (level == 0)))
        elif state == "absent":
            out = out.where(~inside)
        else:
            raise ValueError("a control state is sig, nonsig or absent")
    if stars is not None:
        out = out.where(star_level("p_value").isin(*stars))
    return out


def curve_choices(results: DataFrame, y=None, x=None) -> DataFrame:
    """Available curves; narrows to an outcome and a regressor when given."""
    out = results
    if y is not None:
        out = out.where(F.col("y") == y)
    if x is not None:
        out = out.where(F.col("x") == x)
    return out.groupBy(*CURVE).agg(F.count("*").alias("models"))


def choose_curve(results: DataFrame, job: SpecCurveJob, y: str, x=None, spec_tag=None) -> DataFrame:
    """The curve to show for an outcome: the wanted regressor and design where
    they exist for it, otherwise the first of the job."""

    def rank(column, wanted, names):
        place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
        return F.when(F.col(column) == F.lit(wanted), 0).otherwise(place)

    tags = [d.tag for d in job.active_designs]
    order = F.struct(rank("x", x, job.x), rank("spec_tag", spec_tag, tags))
    found = curve_choices(results, y).groupBy("y").agg(
        F.min_by(F.struct("x", "spec_tag", "models"), order).alias("m")
    )
    return found.select("y", "m.*")


def model_detail(results: DataFrame, job: SpecCurveJob) -> DataFrame:
    """One row per model and listed control: mandatory ones that are included,
    then every optional one, with badge, coefficient and p (blank when the
    control is not in the model) and the text of all included controls."""
    names = job.must_names + [n for n in job.test_names if n not in job.must_names]
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("control"), F.lit(k).alias("kind"))
            for k, group in (("must", job.must_names), ("test", job.test_names))
            for n in group
        ]
    )
    extra = F.array_except("controls_all", F.array(*map(F.lit, names)))
    must = F.filter(
        F.array(*map(F.lit, job.must_names)).cast("array<string>"),
        lambda n: F.array_contains("controls_all", n),
    )
    test = F.filter(
        F.array(*map(F.lit, job.test_names)).cast("array<string>"),
        lambda n: F.array_contains("controls_all", n),
    )
    rows = estimated(results).select(
        *CURVE,
        "bits",
        "controls_all",
        "control_stats",
        F.array_join(F.concat(must, extra, test), " ").alias("copy_text"),
        F.posexplode(listed).alias("place", "listed"),
    )
    included = F.array_contains("controls_all", F.col("listed.control"))
    stat = control_stat(F.col("listed.control"))
    shown = rows.where((F.col("listed.kind") == "test") | included)
    return shown.select(
        *CURVE,
        "bits",
        "place",
        "listed.control",
        "listed.kind",
        "copy_text",
        F.when(included, badge(stat)).otherwise("").alias("badge"),
        F.when(included, stat["coef"]).alias("coef"),
        F.when(included, stat["p_value"]).alias("p_value"),
        F.when(included & stat.isNotNull(), star_text(stat["p_value"])).alias("stars"),
    )


def match_by_controls(curve: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Put another curve's estimate beside each model with the same outcome,
    regressor, design and controls (the interaction panel below a curve).

    The regressor of ``other`` is its ``plain_x`` where it has that column, as
    interaction curves do.  If it has a ``grouping_variable``, estimates are
    matched within each: a curve that has none gets a row for each of them.
    """
    by = ["y", "x", "spec_tag", "controls_key"]
    if "plain_x" in other.columns:
        other = other.withColumn("x", F.col("plain_x"))
    if "grouping_variable" in other.columns:
        by.append("grouping_variable")
        if "grouping_variable" not in curve.columns:
            found = other.select("y", "x", "spec_tag", "grouping_variable").distinct()
            curve = curve.join(found, ["y", "x", "spec_tag"], "left")
    side = (
        estimated(other.withColumn("controls_key", F.sort_array("controls_all")))
        .groupBy(*by)
        .agg(F.max_by(F.struct("coef", "p_value", "ci95_lo", "ci95_hi", "obs"), "bits").alias(name))
    )
    return curve.withColumn("controls_key", F.sort_array("controls_all")).join(side, by, "left")
