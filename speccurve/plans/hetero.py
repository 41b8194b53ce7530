"""Heterogeneity: subgroup curves by median split, and interaction curves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.job import SpecCurveJob
from speccurve.operators.scale import attach, cached, durable, positions
from speccurve.plans.curve import Focus, run

# Shares of rows on both sides of the middle that are put in order, and the
# accuracy of the percentiles around them: a rank is off by 1/accuracy at most.
BAND, PERCENTILE_ACCURACY = 0.0005, 10_000


def grouping_label(variable: str, scope: str) -> str:
    return f"{variable}[{scope}]"


def median_split(
    rows: DataFrame, part: list[str], order: list, out: str = "half"
) -> DataFrame:
    """0 for the lower and 1 for the upper half of each part, in ``order``; the
    extra row of an odd part goes to the lower half.

    The first column of ``order``, a number, decides for all rows but those near
    the middle: approximate percentiles give a band around it, exact counts tell
    whether the middle is in it, and only the rows of the band are put in order.
    A part whose band misses the middle is ordered as a whole.  The place of a
    row comes from :func:`positions`, which spreads one large part over many tasks.
    """
    rows = cached(rows.withColumn("_lead", order[0]))
    middle = F.percentile_approx("_lead", [0.5 - BAND, 0.5 + BAND], PERCENTILE_ACCURACY)
    bands = durable(
        rows.groupBy(*part).agg(F.count("*").alias("n_rows"), middle.alias("_band")).select(
            *part, "n_rows", F.expr("(n_rows + 1) div 2").alias("_half"),
            F.col("_band")[0].alias("_lo"), F.col("_band")[1].alias("_hi"),
        )
    )
    n_parts = bands.count()
    # Missing values come first.
    under = F.col("_lead").isNull() | (F.col("_lead") < F.col("_lo"))
    over = F.col("_lead") > F.col("_hi")
    counts = attach(rows.select(*part, "_lead"), bands, part, n_parts).groupBy(*part).agg(
        F.count("*").alias("n_rows"), F.first("_half").alias("_half"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.sum(under.cast("long")).alias("_under"),
        F.sum(F.coalesce(over, F.lit(False)).cast("long")).alias("_over"),
    )
    inside = (F.col("_under") <= F.col("_half")) & (
        F.col("n_rows") - F.col("_over") >= F.col("_half")
    )
    counts = durable(
        counts.withColumn("_inside", inside).withColumn(
            "_under", F.when(F.col("_inside"), F.col("_under")).otherwise(0)
        ).drop("_over")
    )
    side = F.when(F.col("_inside") & under, 0).when(F.col("_inside") & over, 1)
    told = attach(rows, counts, part, n_parts).withColumn(out, side)
    helpers = ["_lead", "_half", "_lo", "_hi", "_under", "_inside"]
    placed = positions(told.where(F.col(out).isNull()), part, order, "_pos")
    near = placed.withColumn(
        out, (F.col("_pos") + F.col("_under") >= F.col("_half")).cast("int")
    ).drop("_pos")
    return told.where(F.col(out).isNotNull()).unionByName(near).drop(*helpers)


@dataclass(frozen=True)
class MedianSplit:
    """Divides each settled sample at the median of a variable within a scope.

    Rows without the variable join neither half.  Ties follow the firm and
    then the remaining columns, so the split does not depend on row order.
    """

    keys: tuple[str, ...]
    scope: tuple[str, ...]

    def __call__(self, rows: DataFrame) -> DataFrame:
        part = ["sid"] + [f"s_{c}" for c in self.scope]
        values = [c for c in rows.columns if c.startswith("v")]
        values.sort(key=lambda c: int(c[1:]))
        ties = [f"s_{c}" for c in self.keys if c not in self.scope]
        order = [F.col(c) for c in ["z0"] + ties + values]
        halves = median_split(rows.where(F.col("z0").isNotNull()), part, order)
        return halves.withColumn("sid", F.expr("sid * 2 + half")).drop("half")


def subgroup_curves(panel: DataFrame, job: SpecCurveJob) -> DataFrame:
    """Every model of the job estimated again in both halves of its sample,
    for every grouping variable of the job."""
    job.validate(panel)
    focus = {name: Focus(name, name) for name in job.x}
    parts = []
    for scope, variable in job.groupings:
        within = {
            "by_ind_time": (job.ind, job.time),
            "by_time": (job.time,),
            "by_none": (),
        }[scope]
        split = MedianSplit((job.firm, *within), within)
        curves = run(panel, job, focus, split=split, groups=(variable,))
        parts.append(
            curves.withColumn("grouping_variable", F.lit(grouping_label(variable, scope)))
        )
    return _union(parts)


def interaction_curves(panel: DataFrame, job: SpecCurveJob) -> DataFrame:
    """The job with x * z as the regressor of interest, z each grouping
    variable; x stays in the model, z alone does not.  ``plain_x`` names x."""
    job.validate(panel)
    parts = []
    for scope, variable in job.groupings:
        focus, products = {}, []
        for x in job.x:
            name = f"{x}#{variable}"
            focus[x] = Focus(name, f"c.{x}#c.{variable}", (x,))
            products.append((name, x, variable))
        curves = run(panel, job, focus, products=products)
        plain = F.create_map(*[F.lit(v) for x, f in focus.items() for v in (f.label, x)])
        curves = curves.withColumn("plain_x", F.element_at(plain, F.col("x")))
        parts.append(
            curves.withColumn("grouping_variable", F.lit(grouping_label(variable, scope)))
        )
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("the job names no grouping variable")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
