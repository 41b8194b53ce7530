"""Specification curves over panel DataFrames of any size.

Public entry points: :class:`SpecCurveJob`, :func:`spec_curve`,
:func:`subgroup_curves`, :func:`interaction_curves` and the reporting
functions of :mod:`speccurve.plans.report`.
"""

from speccurve.catalog import CATALOG, Design, manual_design
from speccurve.job import SpecCurveJob
from speccurve.plans.curve import spec_curve
from speccurve.plans.hetero import interaction_curves, subgroup_curves

__all__ = [
    "CATALOG",
    "Design",
    "SpecCurveJob",
    "interaction_curves",
    "manual_design",
    "spec_curve",
    "subgroup_curves",
]
