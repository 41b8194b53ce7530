"""The estimation plan: from a panel and a job to one row per model."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.catalog import Design
from speccurve.job import SpecCurveJob
from speccurve.operators.absorb import absorb
from speccurve.operators.grid import pair_grid
from speccurve.operators.lattice import lattice_samples, level_samples, samples_at_once
from speccurve.operators.moments import gram_matrices, model_moments, score_tensors
from speccurve.operators.panel import Panel, prepare
from speccurve.operators.samples import Facts, expand, settle
from speccurve.operators.scale import cached, dropped, durable
from speccurve.operators.solve import (
    RESULT_SCHEMA,
    SOLVED_SCHEMA,
    DesignFacts,
    Finisher,
    solve_models,
)

# Models of one sample finished in one task.
MODELS_PER_TASK = 4096


@dataclass(frozen=True)
class Focus:
    """The regressor of interest of one x: its variable, its label and the
    regressors that enter the model without being reported as controls."""

    variable: str
    label: str
    before: tuple[str, ...] = ()


@dataclass(frozen=True)
class Absorption:
    """Designs that absorb the same effects on the same complete cases;
    ``keepers`` are those that keep singletons."""

    fe: tuple[tuple[str, ...], ...]
    needs: frozenset[str]
    droppers: tuple[Design, ...]
    keepers: tuple[Design, ...]

    @property
    def designs(self) -> tuple[Design, ...]:
        return self.droppers + self.keepers


def absorptions(job: SpecCurveJob, panel: Panel) -> list[Absorption]:
    """Group the designs of a job: same effects and the same effect and
    cluster columns with missing values."""
    found: dict[tuple, tuple[list, list]] = {}
    for design in job.active_designs:
        drops = bool(design.fe) and job.drop_singletons
        # Two-way clustered models keep their singletons in nested mode.
        if job.inference == "nested" and len(design.clusters) == 2:
            drops = False
        columns = {c for term in design.fe + design.clusters for c in term}
        needs = frozenset(c for c in columns if c in panel.bits)
        droppers, keepers = found.setdefault((design.fe, needs), ([], []))
        (droppers if drops else keepers).append(design)
    return [Absorption(*key, tuple(d), tuple(k)) for key, (d, k) in found.items()]


def spec_curve(panel: DataFrame, job: SpecCurveJob) -> DataFrame:
    """Every model of the job: all y, x, designs and admissible control sets.

    Models that cannot be estimated stay in the result with a ``status`` other
    than ``ok`` and null statistics.
    """
    job.validate(panel)
    focus = {name: Focus(name, name) for name in job.x}
    return run(panel, job, focus)


def run(
    panel: DataFrame,
    job: SpecCurveJob,
    focus: dict[str, Focus],
    products=(),
    split=None,
    groups=(),
) -> DataFrame:
    """Estimate a job.  ``split(rows, panel)`` may divide each settled sample
    in two; the result then carries ``group_value``."""
    made = {name for name, _, _ in products}
    wanted = list(job.y) + [f.variable for f in focus.values()]
    wanted += [b for f in focus.values() for b in f.before] + job.must_names + job.test_names
    variables = [v for v in dict.fromkeys(wanted) if v not in made]
    keys = list(dict.fromkeys(job.key_columns + _scope_columns(split)))
    prepared = prepare(panel, variables, keys, groups, products)
    spark = panel.sparkSession
    done = None
    grids: dict[frozenset, tuple] = {}
    for absorption in absorptions(job, prepared):
        if absorption.needs not in grids:
            grids[absorption.needs] = model_table(spark, job, prepared, focus, absorption.needs)
        models, masks = grids[absorption.needs]
        # Without effects the rows are read once for many samples, see lattice; with
        # one effect that every design is clustered by, too.
        own = len(absorption.fe) == 1 and all(d.clusters == absorption.fe for d in absorption.designs)
        summed = split is None and (own or not absorption.fe)
        size = samples_at_once(len(prepared.variables)) if summed else job.wave_size(
            prepared.n_rows
        )
        for at in range(0, len(masks), size):
            wave = masks[at : at + size]
            if summed:
                part = (_levelled if own else _summed)(prepared, job, focus, absorption, models, wave)
            else:
                part = _wave(prepared, job, focus, absorption, models, wave, split)
            done = part if done is None else done.unionByName(part)
    dropped(prepared.source)
    if done is None:
        extra = ", group_value int" if split else ""
        return spark.createDataFrame([], RESULT_SCHEMA + extra)
    return done


def _scope_columns(split) -> list[str]:
    return list(split.keys) if split else []


def model_table(spark, job: SpecCurveJob, panel: Panel, focus, needs: frozenset):
    """Models with their masks, and the distinct masks.

    Model: ``mid`` numbers (y, x, bits); ``order`` is the column order of the
    rank test; ``m0..`` is the bitmap of the variables the model needs.
    """
    pairs = list(product(job.y, focus.values()))
    where = {name: i for i, name in enumerate(panel.variables)}

    def index(name):
        return F.lit(where[name]).cast("int")

    def per_pair(values, kind="int"):
        return F.element_at(
            F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("pair") + 1).cast("int")
        )

    grid = pair_grid(spark, job, index, len(pairs))
    before = F.element_at(
        F.array(*[F.array(*[index(b) for b in f.before]).cast("array<int>") for _, f in pairs]),
        (F.col("pair") + 1).cast("int"),
    )
    controls = F.concat("must", "test")
    first = F.concat(F.array("fi"), controls)
    last = F.concat("before", controls, F.array("fi"))
    grid = grid.withColumns(
        {
            "yi": per_pair([where[y] for y, _ in pairs]),
            "fi": per_pair([where[f.variable] for _, f in pairs]),
            "before": before,
        }
    ).withColumn("order", F.when(F.size("before") == 0, first).otherwise(last))
    always = set(needs)
    if job.inference == "full":
        always |= set(job.must_names)
    masks = {}
    for word in range(panel.words):
        fixed = panel.mask(always)[word]
        mask = F.lit(fixed).cast("long")
        for i, name in enumerate(panel.variables):
            bit = panel.mask([name])[word]
            if bit and not bit & fixed:
                used = F.array_contains("order", i) | (F.col("yi") == i)
                mask = mask.bitwiseOR(F.when(used, F.lit(bit)).otherwise(F.lit(0)).cast("long"))
        masks[f"m{word}"] = mask
    grid = grid.withColumns(masks).drop("before", "pair", "bits")
    if not panel.bits:
        return grid, [(0,)]
    found = grid.select(*masks).distinct().collect()
    return grid, sorted(tuple(r) for r in found)


def _wave(panel, job, focus, absorption, models, masks, split) -> DataFrame:
    """Results of the models of a few samples, written to the checkpoint folder.

    When no sample holds a singleton, the designs that drop and those that keep
    them use the same rows and are estimated together.
    """
    spark = panel.rows.sparkSession
    setup = Setup(absorption, panel, job.sweep_levels)
    columns = setup.columns(panel) + [f"v{j}" for j in range(len(panel.variables))]
    extra = [panel.key((c,)).alias(f"s_{c}") for c in _scope_columns(split)]
    extra += [f"z{i}" for i in range(len(panel.groups))]
    wave_models = _models_of(panel, models, masks)
    if split:
        both = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
        wave_models = wave_models.select("*", both).withColumns(
            {"mid": F.expr("mid * 2 + half"), "sid": F.expr("sid * 2 + half")}
        ).drop("half")

    every = expand(panel, masks, columns + extra, setup.coded(panel))
    done = None
    for designs, drop in ((absorption.droppers, True), (absorption.keepers, False)):
        if not designs:
            continue
        held = []
        rows, facts, removed = settle(
            every, setup.n_effects, setup.cluster_ids, setup.pairs, drop
        )
        if split:
            helpers = [c for c in rows.columns if c.startswith(("s_", "z"))]
            rows = cached(split(rows).drop(*helpers))
            held.append(rows)
            rows, facts, within = settle(
                rows, setup.n_effects, setup.cluster_ids, setup.pairs, drop
            )
            removed = removed or within
        alike = drop and not removed
        if removed and not split:
            # Joins stand between the panel and these rows; without them the
            # rows are a projection of the stored panel and are not stored again.
            rows = cached(rows)
            held.append(rows)
        used = absorption.designs if alike else designs
        part = _estimate(panel, job, focus, setup, used, wave_models, rows, facts, bool(split))
        done = part if done is None else done.unionByName(part)
        for table in held:
            table.unpersist()
        if alike:
            break
    return done


def _models_of(panel: Panel, models: DataFrame, masks) -> DataFrame:
    """The models of some samples; ``sid`` is the place of the mask."""
    words = [f"m{w}" for w in range(panel.words)]
    samples = models.sparkSession.createDataFrame(
        [(*mask, sid) for sid, mask in enumerate(masks)],
        ", ".join(f"{w} long" for w in words) + ", sid long",
    )
    # One row for each of the samples estimated together.
    return models.join(F.broadcast(samples), words).drop(*words)


def _summed(panel, job, focus, absorption, models, masks) -> DataFrame:
    """Results of the models of many samples without effects, from sums by
    pattern of missing values."""
    setup = Setup(absorption, panel, None)
    kinds, _ = _kinds(setup, absorption.designs)
    clusters = {f"c{j}": panel.key(term) for j, term in enumerate(setup.clusters)}
    tensors, facts, grams, means, table = lattice_samples(panel, masks, kinds, clusters)
    solved = _solved(_models_of(panel, models, masks), grams, facts)
    finisher = _finisher(
        panel, job, focus, setup, absorption.designs, facts, grams, {}, set(), False
    )
    result = durable(_finish(solved, tensors, finisher, means))
    solved.unpersist()
    dropped(table)
    return result


def _levelled(panel, job, focus, absorption, models, masks) -> DataFrame:
    """The same for one effect by which the designs are clustered."""
    setup = Setup(absorption, panel, None)
    tensors, grams, kept, left, table = level_samples(panel, masks, 1, absorption.fe[0])
    done = None
    for designs, facts in ((absorption.droppers, left), (absorption.keepers, kept)):
        if designs:
            own = {sid: grams[sid] for sid in facts}
            solved = _solved(_models_of(panel, models, masks), own, facts)
            finisher = _finisher(
                panel, job, focus, setup, designs, facts, own, dict.fromkeys(facts, 1), set(),
                False,
            )
            part = durable(_finish(solved, tensors, finisher, {}))
            solved.unpersist()
            done = part if done is None else done.unionByName(part)
    dropped(table)
    return done


class Setup:
    """Numbering of the effects and clusters of one absorption."""

    def __init__(self, absorption: Absorption, panel: Panel, limit: int | None):
        """Keys with at most ``limit`` levels get short codes; None: no key does."""
        self.fe = absorption.fe
        self.n_effects = len(absorption.fe)
        designs = absorption.designs
        self.clusters = list(dict.fromkeys(t for d in designs for t in d.clusters))
        self.cluster_ids = list(range(len(self.clusters)))
        self.pairs = list(
            dict.fromkeys(
                tuple(sorted(self.ids(d))) for d in designs if len(d.clusters) == 2
            )
        )

        terms = {f"f{k}": t for k, t in enumerate(self.fe)}
        terms |= {f"c{j}": t for j, t in enumerate(self.clusters)}
        self.codes = {
            name: None if limit is None else panel.code(term, limit)
            for name, term in terms.items()
        }
        self.terms = terms

    def ids(self, design: Design) -> list[int]:
        return [self.clusters.index(t) for t in design.clusters]

    def columns(self, panel: Panel) -> list:
        """Keys with too many levels for a code table, as they are."""
        return [
            panel.key(term).alias(name)
            for name, term in self.terms.items()
            if self.codes[name] is None
        ]

    def coded(self, panel: Panel) -> dict:
        return {
            name: (panel.key(term), self.codes[name][0])
            for name, term in self.terms.items()
            if self.codes[name] is not None
        }

    @property
    def level_counts(self) -> dict[int, int]:
        """Levels of the effects that are coded."""
        found = {k: self.codes[f"f{k}"] for k in range(self.n_effects)}
        return {k: code[1] for k, code in found.items() if code is not None}


def _estimate(panel, job, focus, setup, designs, models, rows, facts, halved) -> DataFrame:
    n_vars = len(panel.variables)
    residuals, components, loose = absorb(
        rows, setup.n_effects, n_vars, facts, setup.level_counts, job.sweep_levels,
        job.absorb_rounds,
    )
    keep = ["sid"] + [f"c{j}" for j in setup.cluster_ids] + [f"v{j}" for j in range(n_vars)]
    residuals = cached(residuals.select(*keep))
    grams = gram_matrices(residuals, n_vars)
    solved = _solved(models, grams, facts)
    kinds, _ = _kinds(setup, designs)
    finisher = _finisher(
        panel, job, focus, setup, designs, facts, grams, components, loose, halved
    )
    tensors = score_tensors(residuals, kinds, n_vars, len(facts))
    result = durable(_finish(solved, tensors, finisher, {}))
    for table in (solved, residuals):
        table.unpersist()
    return result


def _solved(models: DataFrame, grams, facts) -> DataFrame:
    shared = models.sparkSession.sparkContext.broadcast((grams, {s: f.n for s, f in facts.items()}))
    columns = ["mid", "sid", "yi", "fi", "must", "test", "is_full", "order"]
    return cached(models.select(*columns).mapInPandas(_solver(shared), SOLVED_SCHEMA))


def _finisher(
    panel, job, focus, setup, designs, facts, grams, components, loose, halved
) -> Finisher:
    place = {name: i for i, name in enumerate(panel.variables)}
    return Finisher(
        inference=job.inference,
        designs=_kinds(setup, designs)[1],
        facts={
            sid: [
                _design_facts(d, setup, fact, components.get(sid, 0), sid not in loose)
                for d in designs
            ]
            for sid, fact in facts.items()
        },
        grams=grams,
        names=panel.variables,
        labels={place[f.variable]: f.label for f in focus.values()},
        scale=panel.scale,
        hidden={place[f.variable]: {place[b] for b in f.before} for f in focus.values()},
        models=job.model_count,
        halves=2 if halved else 1,
        outcomes=len(job.y),
    )


def _solver(shared):
    def solve(batches):
        grams, sizes = shared.value
        yield from solve_models(batches, grams, sizes)

    return solve


def _kinds(setup: Setup, designs):
    """Number every clustering of the designs; 0 is robust."""
    kinds: dict[int, list[str]] = {}
    names = []
    for design in designs:
        ids = setup.ids(design)
        if not ids:
            kinds[0] = []
            used = ()
        elif len(ids) == 1:
            kinds[ids[0] + 1] = [f"c{ids[0]}"]
            used = (ids[0] + 1,)
        else:
            both = 1 + len(setup.clusters) + setup.pairs.index(tuple(sorted(ids)))
            for j in ids:
                kinds[j + 1] = [f"c{j}"]
            kinds[both] = [f"c{j}" for j in ids]
            used = (ids[0] + 1, ids[1] + 1, both)
        names.append((design.name, design.tag, used))
    return kinds, names


def _design_facts(
    design, setup: Setup, fact: Facts, components: int, settled: bool
) -> DesignFacts:
    ids = setup.ids(design)
    # Without effects the intercept is the one absorbed level.
    absorbed = sum(fact.levels.values()) - components if setup.fe else 1
    counted = absorbed
    if ids and setup.fe:
        counted = sum(
            n for k, n in fact.levels.items() if not any((k, j) in fact.nested for j in ids)
        )
    groups = [fact.clusters[(j,)] for j in ids]
    if len(ids) == 2:
        groups.append(fact.clusters[tuple(sorted(ids))])
    return DesignFacts(fact.n, absorbed, counted, tuple(groups), settled)


def _finish(solved: DataFrame, tensors: DataFrame, finisher: Finisher, means: dict) -> DataFrame:
    """The result rows: models meet the score tensors of their sample.

    A sample with many models is dealt over several tasks, each with a copy of
    the sample's tensors.
    """
    # One row per sample of the wave.
    sizes = F.broadcast(
        solved.groupBy("sid").agg(F.ceil(F.count("*") / MODELS_PER_TASK).cast("int").alias("n"))
    )
    left = solved.join(sizes, "sid").withColumn(
        "block", F.pmod(F.xxhash64("mid"), F.col("n")).cast("int")
    ).drop("n")
    right = tensors.join(sizes, "sid").select(
        "sid", "kind", "row", "part", F.explode(F.expr("sequence(0, n - 1)")).alias("block")
    )
    shared = solved.sparkSession.sparkContext.broadcast((finisher, means))

    def finish(models: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        finisher, means = shared.value
        models = models.drop(columns="block")
        models["kinds"], models["parts"] = None, None
        sid = int(models["sid"].iloc[0]) if len(models) else None
        # A sample without rows has no facts.
        if sid in finisher.facts and len(parts):
            found = {
                int(kind): np.vstack(own.sort_values("row")["part"].to_numpy())
                for kind, own in parts.groupby("kind")
            }
            models["kinds"], models["parts"] = model_moments(
                models, found, len(finisher.names), means.get(sid)
            )
        return next(iter(finisher([models])))

    schema = RESULT_SCHEMA + (", group_value int" if finisher.halves == 2 else "")
    keys = ("sid", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(finish, schema)
