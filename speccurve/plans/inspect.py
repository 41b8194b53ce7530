"""What a job will run on: missing values, samples, effects - no estimation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.job import SpecCurveJob
from speccurve.operators.components import connected_components
from speccurve.operators.panel import Panel, prepare
from speccurve.operators.samples import expand, settle
from speccurve.plans.curve import Focus, Setup, absorptions, model_table


def _prepared(panel: DataFrame, job: SpecCurveJob) -> Panel:
    job.validate(panel)
    names = list(dict.fromkeys([*job.y, *job.x, *job.must_names, *job.test_names]))
    return prepare(panel, names, job.key_columns)


def null_patterns(panel: DataFrame, job: SpecCurveJob) -> DataFrame:
    """missing, rows: every combination of missing columns and its row count."""
    prepared = _prepared(panel, job)
    flags = []
    for name in prepared.bits:
        mask = prepared.mask([name])
        word = next(w for w, m in enumerate(mask) if m)
        hit = F.col(f"p{word}").bitwiseAND(F.lit(mask[word]).cast("long")) != 0
        flags.append(F.when(hit, F.lit(name)))
    missing = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return prepared.rows.groupBy(missing.alias("missing")).agg(F.count("*").alias("rows"))


def _settled(panel: DataFrame, job: SpecCurveJob):
    prepared = _prepared(panel, job)
    focus = {name: Focus(name, name) for name in job.x}
    for absorption in absorptions(job, prepared):
        models, masks = model_table(
            panel.sparkSession, job, prepared, focus, absorption.needs
        )
        setup = Setup(absorption, prepared, job.sweep_levels)
        size = job.wave_size(prepared.n_rows)
        for at in range(0, len(masks), size):
            wave = masks[at : at + size]
            every = expand(prepared, wave, setup.columns(prepared), setup.coded(prepared))
            for designs, drop in ((absorption.droppers, True), (absorption.keepers, False)):
                if designs:
                    rows, facts, _ = settle(
                        every, setup.n_effects, setup.cluster_ids, [], drop
                    )
                    yield prepared, setup, designs, models, wave, rows, facts


def sample_report(panel: DataFrame, job: SpecCurveJob) -> DataFrame:
    """spec_tag, y, x, bits, must, test, is_full, obs: the sample of every model."""
    spark = panel.sparkSession
    out = None
    for prepared, _, designs, models, wave, _, facts in _settled(panel, job):
        words = [f"m{w}" for w in range(prepared.words)]
        sizes = spark.createDataFrame(
            [(*m, facts[s].n if s in facts else 0) for s, m in enumerate(wave)],
            ", ".join(f"{w} long" for w in words) + ", obs long",
        )
        names = F.array(*map(F.lit, prepared.variables))

        def named(column):
            return F.transform(column, lambda i: F.element_at(names, i + 1))

        tags = F.explode(F.array(*[F.lit(d.tag) for d in designs]))
        # At most samples_per_wave rows on the broadcast side.
        part = models.join(F.broadcast(sizes), words).select(
            tags.alias("spec_tag"),
            F.element_at(names, F.col("yi") + 1).alias("y"),
            F.element_at(names, F.col("fi") + 1).alias("x"),
            F.expr(f"mid % {job.model_count}").alias("bits"),
            named("must").alias("must"),
            named("test").alias("test"),
            "is_full",
            "obs",
        )
        out = part if out is None else out.unionByName(part)
    return out


def effect_report(panel: DataFrame, job: SpecCurveJob) -> DataFrame:
    """One row per design, sample and effect: rows, levels, nested in a
    cluster of the design or not, and components of the level graph."""
    spark = panel.sparkSession
    found = []
    for _, setup, designs, _, _, rows, facts in _settled(panel, job):
        parts = connected_components(rows, setup.n_effects) if setup.fe else {}
        for design in designs:
            ids = setup.ids(design)
            for sid, fact in facts.items():
                for k, term in enumerate(setup.fe):
                    nested = any((k, j) in fact.nested for j in ids)
                    found.append(
                        (design.tag, sid, "^".join(term), fact.n, fact.levels[k], nested,
                         parts.get(sid))
                    )
    return spark.createDataFrame(
        found,
        "spec_tag string, sample long, effect string, rows long, levels long, "
        "nested boolean, components int",
    )
