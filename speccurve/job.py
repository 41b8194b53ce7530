"""The job description: what is estimated, on which columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from speccurve.catalog import CATALOG, Design

SCOPES = ("by_ind_time", "by_time", "by_none")
# Accepted spellings of the curve order.
ORDERS = {"coef": "coef", "p": "p", "signed_p": "p", "obs": "obs"}


def split_names(items, what: str) -> tuple[str, ...]:
    """Flat list of names; one item may hold several, separated by blanks."""
    names: list[str] = []
    for item in [items] if isinstance(items, str) else (items or ()):
        if not isinstance(item, str) or not item.split():
            raise ValueError(f"{what} holds an empty or non-string name")
        names += item.split()
    return tuple(names)


def control_slots(items, what: str) -> tuple[tuple[str, ...], ...]:
    """Slots of a control list: a string gives one slot per name, a list or
    tuple gives one slot of mutually exclusive names."""
    slots: list[tuple[str, ...]] = []
    for item in items or ():
        if isinstance(item, str):
            slots += [(n,) for n in split_names([item], what)]
        elif isinstance(item, (list, tuple)):
            if not item:
                raise ValueError(f"{what} holds an empty group")
            slots.append(split_names(item, what))
        else:
            raise ValueError(f"{what} accepts strings and lists of strings only")
    flat = [n for slot in slots for n in slot]
    repeated = sorted({n for n in flat if flat.count(n) > 1})
    if repeated:
        raise ValueError(f"{what} repeats {', '.join(repeated)}")
    return tuple(slots)


@dataclass(frozen=True)
class SpecCurveJob:
    """A specification-curve job.

    ``must`` and ``test`` are control lists: a nested list is a group of
    alternatives (exactly one of a mandatory group, at most one of an optional
    one).  ``inference`` is ``"nested"`` or ``"full"`` (how effects count in
    the degrees of freedom, see README).
    """

    y: tuple[str, ...]
    x: tuple[str, ...]
    must: tuple = ()
    test: tuple = ()
    firm: str = "code"
    ind: str | None = "ind"
    time: str = "year"
    region: str | None = None
    designs: tuple[str, ...] = ("ab_firm_time_cl_firm",)
    extra_designs: tuple[Design, ...] = ()
    drop_singletons: bool = True
    inference: str = "nested"
    order: str = "coef"
    group_by_ind_time: tuple[str, ...] = ()
    group_by_time: tuple[str, ...] = ()
    group_by_none: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    # Physical limits; results do not depend on them.
    samples_per_wave: int = 32
    rows_per_wave: int = 4_000_000_000
    sweep_levels: int = 1000
    # Rounds of the alternating updates; models of a sample that is not settled
    # then get the status ``not_converged``.
    absorb_rounds: int = 2000
    must_slots: tuple = field(init=False)
    test_slots: tuple = field(init=False)

    def __post_init__(self):
        def put(name, value):
            object.__setattr__(self, name, value)

        for name in ("y", "x"):
            put(name, split_names(getattr(self, name), name))
            if not getattr(self, name):
                raise ValueError(f"{name} is empty")
        put("must_slots", control_slots(self.must, "must"))
        put("test_slots", control_slots(self.test, "test"))
        overlap = sorted(set(self.must_names) & set(self.test_names))
        if overlap:
            raise ValueError(f"listed as mandatory and optional: {', '.join(overlap)}")
        if self.order not in ORDERS:
            raise ValueError(f"order must be one of {', '.join(ORDERS)}")
        if self.inference not in ("nested", "full"):
            raise ValueError("inference must be 'nested' or 'full'")
        unknown = [t for t in self.designs if t not in CATALOG]
        if unknown:
            raise ValueError(f"unknown designs: {', '.join(unknown)}")
        for design in self.extra_designs:
            if len(design.clusters) > 2:
                raise ValueError("at most two cluster variables are supported")
        for scope, names in self._scoped().items():
            if len(set(names)) != len(names):
                raise ValueError(f"grouping variables of scope {scope} repeat a name")
        # Models are numbered over all outcomes, regressors and both halves.
        if self.model_count * len(self.y) * len(self.x) * 2 >= 2**62:
            raise ValueError("the model grid does not fit a 64-bit number")

    def wave_size(self, rows: int) -> int:
        """Samples estimated together: each holds up to every row of the panel."""
        return max(1, min(self.samples_per_wave, self.rows_per_wave // max(rows, 1)))

    def _scoped(self) -> dict[str, tuple[str, ...]]:
        return {
            "by_ind_time": tuple(self.group_by_ind_time) + tuple(self.group),
            "by_time": tuple(self.group_by_time),
            "by_none": tuple(self.group_by_none),
        }

    @property
    def groupings(self) -> list[tuple[str, str]]:
        """(scope, variable) pairs, in scope order."""
        return [(s, v) for s, names in self._scoped().items() for v in names]

    @property
    def must_names(self) -> list[str]:
        return [n for slot in self.must_slots for n in slot]

    @property
    def test_names(self) -> list[str]:
        return [n for slot in self.test_slots for n in slot]

    @property
    def matrix_names(self) -> list[str]:
        """Controls that vary between models, in display order."""
        varying = [n for slot in self.must_slots if len(slot) > 1 for n in slot]
        return varying + self.test_names

    @property
    def model_count(self) -> int:
        """Models of one curve (one y, x and design)."""
        return prod(len(s) for s in self.must_slots) * prod(
            len(s) + 1 for s in self.test_slots
        )

    @property
    def roles(self) -> dict[str, str | None]:
        return {"firm": self.firm, "ind": self.ind, "time": self.time, "region": self.region}

    @property
    def active_designs(self) -> list[Design]:
        """Enabled designs with their columns; those that need a region
        column are left out when the job names none."""
        chosen = [
            CATALOG[t] for t in self.designs if self.region or not CATALOG[t].needs_region
        ]
        return [d.resolve(self.roles) for d in chosen] + list(self.extra_designs)

    @property
    def key_columns(self) -> list[str]:
        terms = [t for d in self.active_designs for t in d.fe + d.clusters]
        return list(dict.fromkeys(c for t in terms for c in t))

    def validate(self, panel: DataFrame) -> None:
        """Check the job against the columns and types of a panel."""
        numeric = list(self.y) + list(self.x) + self.must_names + self.test_names
        groups = [v for _, v in self.groupings]
        scope_keys = []
        for scope, _ in self.groupings:
            scope_keys += {
                "by_ind_time": [self.ind, self.time],
                "by_time": [self.time],
                "by_none": [],
            }[scope] + [self.firm]
        wanted = numeric + self.key_columns + groups + scope_keys
        absent = [c for c in dict.fromkeys(wanted) if c not in panel.columns]
        if absent:
            raise ValueError(f"missing columns: {', '.join(absent)}")
        for name in groups:
            if not isinstance(panel.schema[name].dataType, T.NumericType):
                raise ValueError(f"grouping variable {name} must be numeric")
