"""Column expressions for stars, badges, labels and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest p used as a divisor, by Python's float minimum in the
# table order and by the page's own floor.
TABLE_P_FLOOR = 2.2250738585072014e-308
PAGE_P_FLOOR = 1e-300


def star_level(p) -> Column:
    """0 to 3 stars: p below 0.10, 0.05, 0.01."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.01, 3).when(p < 0.05, 2).when(p < 0.10, 1).otherwise(0)


def signed_star(coef, p) -> Column:
    """Star level with the sign of the coefficient; zero counts as positive."""
    coef = F.col(coef) if isinstance(coef, str) else coef
    return star_level(p) * F.when(coef < 0, -1).otherwise(1)


def star_label(star: Column) -> Column:
    """``+3``, ``-2``, ``0``; ``0`` for a missing model."""
    return (
        F.when(star > 0, F.concat(F.lit("+"), star.cast("string")))
        .when(star < 0, star.cast("string"))
        .otherwise("0")
    )


def star_text(p) -> Column:
    level = star_level(p)
    return F.when(level == 0, ".").otherwise(F.repeat(F.lit("*"), level))


def badge(stat: Column) -> Column:
    """Label of a control: signed stars, ``0+``/``0-``, ``--`` without statistics."""
    star = signed_star(stat["coef"], stat["p_value"])
    zero = F.when(stat["coef"] < 0, "0-").otherwise("0+")
    return F.when(stat.isNull(), "--").when(star == 0, zero).otherwise(star_label(star))


def path_label(name) -> Column:
    """A name reduced to letters, digits, ``-`` and single ``_``."""
    name = F.col(name) if isinstance(name, str) else name
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
    clean = F.trim(F.regexp_replace(clean, "_+", "_"), F.lit("_"))
    return F.when(clean == "", "spec").otherwise(clean)


def controls_in_order(names: list[str]) -> Column:
    """The included controls in the order of the job."""
    everything = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return F.filter(everything, lambda n: F.array_contains("controls_all", n))


def controls_text(names: list[str]) -> Column:
    ordered = controls_in_order(names)
    return F.when(F.size(ordered) == 0, "(none)").otherwise(F.array_join(ordered, ", "))


def control_stat(name) -> Column:
    """Statistics of one control of a model, null when it has none."""
    found = F.filter("control_stats", lambda s: s["name"] == name)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0)))


def curve_order(order: str) -> list[Column]:
    """Sort keys of a curve, ending in the model number."""
    if order == "coef":
        return [F.col("coef"), F.col("bits")]
    if order == "obs":
        return [F.col("obs"), F.col("bits")]
    if order in ("p", "signed_p"):
        floor = TABLE_P_FLOOR if order == "p" else PAGE_P_FLOOR
        zero = 1 if order == "p" else 0
        sign = F.when(F.col("coef") < 0, -1.0).when(F.col("coef") > 0, 1.0).otherwise(float(zero))
        return [sign / F.greatest("p_value", F.lit(floor)), F.col("bits")]
    raise ValueError(f"unknown order {order}")
