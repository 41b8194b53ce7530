"""Absorption of fixed effects: none, one, or several at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.operators.components import across, connected_components, linked_counts
from speccurve.operators.samples import Facts
from speccurve.operators.scale import (
    HOT_LEVEL_ROWS, attach, cached, dropped, durable, sum_arrays,
)

# Relative cutoff of the pseudo-inverse of the level equations.
RANK_CUTOFF = 1e-10
# What residuals may leave in a level on average, in units of the variables'
# spreads: the solution is taken from SETTLED on and given up above LOOSE.
SETTLED = 1e-12
LOOSE = 1e-8
# Cells one task of a product handles.
CELLS_PER_TASK = 250_000


def absorb(
    rows: DataFrame,
    n_effects: int,
    n_vars: int,
    facts: dict[int, Facts],
    coded: dict[int, int],
    sweep_levels: int,
    rounds: int,
) -> tuple[DataFrame, dict[int, int], set[int]]:
    """Residuals of every variable after projecting out all effects.

    ``coded`` gives the number of levels of every effect whose key is a running
    number.  Returns the rows with ``v0..`` replaced by their residuals, the number
    of connected components of the level graph per sample (0 without effects), and
    the samples whose effects were not settled after ``rounds`` rounds.
    """
    values = [f"v{j}" for j in range(n_vars)]
    if n_effects == 0:
        means = _means(rows, ["sid"], values)
        return (
            _subtract(rows, means, ["sid"], values, len(facts)), dict.fromkeys(facts, 0), set()
        )
    sizes = [max((f.levels[k] for f in facts.values()), default=0) for k in range(n_effects)]
    main = int(np.argmax(sizes))
    n_main = sum(f.levels[main] for f in facts.values())
    keys = ["sid", f"f{main}"]
    if n_effects == 1:
        return (
            _subtract(rows, _means(rows, keys, values), keys, values, n_main),
            dict.fromkeys(facts, 1),
            set(),
        )
    rest = [k for k in range(n_effects) if k != main]
    n_levels = sum(coded.get(k, sweep_levels + 1) for k in rest)
    if n_levels > sweep_levels:
        effects, components, loose = _conjugate(rows, n_effects, main, values, rounds)
        for k in rest:
            found = sum(f.levels[k] for f in facts.values())
            rows = _subtract(rows, effects[k], ["sid", f"f{k}"], values, found)
        return (
            _subtract(rows, _means(rows, keys, values), keys, values, n_main), components, loose
        )
    # The levels of the minor effects are stacked: one number for each.
    offset = 0
    for k in rest:
        rows = rows.withColumn(f"i{k}", F.col(f"f{k}") + F.lit(offset))
        offset += coded[k]
    effects = durable(_sweep(rows, main, rest, values, n_levels))
    # The level graph is a star around the first effect, see README.
    if main == 0 or n_effects == 2:
        parts = effects.where("level < 0").select("sid", F.element_at("effect", 1)).collect()
        components = {r[0]: int(r[1]) for r in parts}
    else:
        components = connected_components(rows, n_effects)
    table = effects.where("level >= 0")
    for k in rest:
        named = table.select("sid", F.col("level").alias(f"i{k}"), F.col("effect").alias("_e"))
        # At most samples_per_wave x sweep_levels rows.
        rows = rows.join(F.broadcast(named), ["sid", f"i{k}"]).withColumns(
            {v: F.col(v) - F.col("_e")[j] for j, v in enumerate(values)}
        ).drop("_e")
    return _subtract(rows, _means(rows, keys, values), keys, values, n_main), components, set()


def _means(rows: DataFrame, keys, values) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[F.avg(v).alias(f"_m{v}") for v in values]
    )


def _subtract(rows: DataFrame, means: DataFrame, keys, values, n_levels: int) -> DataFrame:
    joined = attach(rows, means, keys, n_levels)
    return joined.withColumns({v: F.col(v) - F.col(f"_m{v}") for v in values}).drop(
        *[f"_m{v}" for v in values]
    )


def _sweep(
    rows: DataFrame, main: int, rest, values, n_levels: int
) -> DataFrame:
    """Level effects of the minor effects, exactly and without iterating.

    The main effect is eliminated level by level: with N_f the row counts of
    the minor levels inside main level f and S_f the value sums, the minor
    effects solve (D'D - sum N_f N_f'/n_f) a = D'V - sum N_f S_f'/n_f.
    Rows are first added up per (main, minor levels) cell; the sums over f are
    formed per task and then added.
    """
    n_vars = len(values)
    index = [f"i{k}" for k in rest]
    cells = rows.groupBy("sid", f"f{main}", *index).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(v).alias(v) for v in values]
    )
    # At most one entry per combination of minor levels, never one per row.
    blocks = cells.groupBy("sid", f"f{main}").agg(
        F.collect_list(
            F.struct(*index, "n", F.array(*values).alias("sums"))
        ).alias("cells")
    ).select("sid", "cells")
    width = 2 * n_levels + n_vars

    def partial(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sids = batch.column("sid").to_numpy()
            lists = batch.column("cells")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            levels = [flat.field(name).to_numpy() for name in index]
            n = flat.field("n").to_numpy()
            sums = flat.field("sums").flatten().to_numpy().reshape(-1, n_vars)
            ends = np.cumsum(sizes)
            step = max(1, 2_000_000 // n_levels)
            for sid in np.unique(sids):
                total = totals.setdefault(int(sid), np.zeros((n_levels, width)))
                own = np.flatnonzero(sids == sid)
                for at in range(0, len(own), step):
                    take = own[at : at + step]
                    pick = np.concatenate(
                        [np.arange(ends[g] - sizes[g], ends[g]) for g in take]
                    )
                    owner = np.repeat(np.arange(len(take)), sizes[take])
                    _add_cells(
                        total, owner, len(take), [lv[pick] for lv in levels], n[pick], sums[pick]
                    )
        for sid, total in totals.items():
            filled = np.flatnonzero(total[:, : 2 * n_levels].any(axis=1))
            yield pa.RecordBatch.from_pydict(
                {
                    "sid": pa.array(np.full(len(filled), sid), pa.int64()),
                    "level": pa.array(filled, pa.int64()),
                    "part": pa.array(list(total[filled]), pa.list_(pa.float64())),
                }
            )

    partials = blocks.mapInArrow(partial, "sid long, level long, part array<double>")
    equations = sum_arrays(partials, ["sid", "level"], "part")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = pdf["level"].to_numpy()
        block = np.vstack(pdf["part"].to_numpy())
        inner = block[:, :n_levels][:, levels]
        shared = block[:, n_levels : 2 * n_levels][:, levels]
        right = block[:, 2 * n_levels :]
        roots, vectors = np.linalg.eigh(inner - shared)
        use = roots > RANK_CUTOFF * max(roots[-1], 1e-300)
        basis = vectors[:, use]
        effect = basis @ ((basis.T @ right) / roots[use, None])
        linked = _count_linked(shared > 0)
        out = pd.DataFrame({"sid": int(pdf["sid"].iloc[0]), "level": np.r_[levels, -1]})
        out["effect"] = list(effect) + [np.array([float(linked), float(use.sum())])]
        return out

    # One group is at most sweep_levels rows of fixed width.
    return equations.groupBy("sid").applyInPandas(
        solve, "sid long, level long, effect array<double>"
    )


def _add_cells(total, owner, n_owner, levels, n, sums):
    n_levels = total.shape[0]
    counts = np.zeros(n_owner * n_levels)
    for level in levels:
        counts += np.bincount(owner * n_levels + level, weights=n, minlength=counts.size)
    counts = counts.reshape(n_owner, n_levels)
    size = np.bincount(owner, weights=n, minlength=n_owner)
    value = np.column_stack(
        [np.bincount(owner, weights=sums[:, j], minlength=n_owner) for j in range(sums.shape[1])]
    )
    share = counts / size[:, None]
    for first in levels:
        for second in levels:
            total[:, :n_levels] += np.bincount(
                first * n_levels + second, weights=n, minlength=n_levels**2
            ).reshape(n_levels, n_levels)
        for j in range(sums.shape[1]):
            total[:, 2 * n_levels + j] += np.bincount(
                first, weights=sums[:, j], minlength=n_levels
            )
    total[:, n_levels : 2 * n_levels] += counts.T @ share
    total[:, 2 * n_levels :] -= share.T @ value


def _count_linked(adjacent: np.ndarray) -> int:
    """Number of connected components of a small symmetric adjacency matrix."""
    todo = np.ones(len(adjacent), dtype=bool)
    count = 0
    while todo.any():
        count += 1
        front = np.zeros(len(adjacent), dtype=bool)
        front[np.argmax(todo)] = True
        while front.any():
            todo &= ~front
            front = adjacent[front].any(axis=0) & todo
    return count


def _numbered_cells(rows: DataFrame, n_effects: int, values):
    """Cells (a number for each effect's level, row count, value sums) and, per
    effect, its levels: sid, f, number, rows.  A number stands for one level of
    one sample."""
    keys = [f"f{k}" for k in range(n_effects)]
    cells = cached(
        rows.groupBy("sid", *keys).agg(
            F.count("*").cast("double").alias("n"), *[F.sum(v).alias(v) for v in values]
        )
    )
    numbered, levels = cells, {}
    for k, f in enumerate(keys):
        levels[k] = durable(
            cells.groupBy("sid", f).agg(F.sum("n").cast("long").alias("n_rows")).withColumn(
                f"i{k}", F.monotonically_increasing_id()
            )
        )
        numbered = attach(numbered, levels[k], ["sid", f], levels[k].count()).drop(f)
    numbered = durable(numbered.drop("sid"))
    cells.unpersist()
    return numbered, levels


class _LevelEquations:
    """The equations of the minor levels, the main effect eliminated.

    ``apply`` takes value sums per cell, takes out the means of the main levels
    and adds up what is left by minor level.
    """

    def __init__(self, cells: DataFrame, main: int, rest: list[int], values, sizes):
        self.cells, self.main, self.rest, self.values = cells, main, rest, values
        self.sizes = sizes

    def _without_main(self, cells: DataFrame) -> DataFrame:
        key = f"i{self.main}"
        n = F.sum("n")
        means = cells.groupBy(key).agg(
            n.cast("long").alias("n_rows"), *[(F.sum(v) / n).alias(f"_m{v}") for v in self.values]
        )
        joined = attach(cells, means, [key], self.sizes[self.main])
        return joined.withColumns(
            {v: F.col(v) - F.col("n") * F.col(f"_m{v}") for v in self.values}
        ).drop(*[f"_m{v}" for v in self.values])

    def apply(self, cells: DataFrame) -> DataFrame:
        """k, i and the sums of every minor level."""
        ends = [
            F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("i")) for k in self.rest
        ]
        every = self._without_main(cells).select(
            F.explode(F.array(*ends)).alias("_e"), *self.values
        )
        return every.groupBy("_e.k", "_e.i").agg(*[F.sum(v).alias(v) for v in self.values])

    def times(self, state: DataFrame, prefix: str) -> DataFrame:
        """``state`` (k, i, n_rows, ...) with the equations' matrix times its
        columns ``prefix`` + variable, as columns named like the variables."""
        cells = self.cells.drop(*self.values)
        total = {v: F.lit(0.0) for v in self.values}
        for k in self.rest:
            own = state.where(F.col("k") == k).select(
                F.col("i").alias(f"i{k}"), "n_rows",
                *[F.col(f"{prefix}{v}").alias(f"_{k}{v}") for v in self.values],
            )
            cells = attach(cells, own, [f"i{k}"], self.sizes[k])
            total = {v: total[v] + F.col(f"_{k}{v}") for v in self.values}
        product = self.apply(cells.withColumns({v: F.col("n") * total[v] for v in self.values}))
        return state.join(product, ["k", "i"])

    def close(self) -> None:
        """Nothing is held."""


class _PairEquations(_LevelEquations):
    """The same for two effects.  The cells are held twice, dealt by the level of
    either effect, so a product shuffles sums per level and never the cells."""

    def __init__(self, cells: DataFrame, main: int, rest: list[int], values, sizes):
        super().__init__(cells, main, rest, values, sizes)
        self.here, self.there = f"i{rest[0]}", f"i{main}"
        # Sums are dealt over as many tasks, so they meet the cells where they are.
        workers = cells.sparkSession.sparkContext.defaultParallelism
        self.parts = max(workers, -(-cells.count() // CELLS_PER_TASK))
        narrow = cells.select(self.here, self.there, "n")
        self.by_here = cached(narrow.repartition(self.parts, self.here))
        self.by_there = cached(narrow.repartition(self.parts, self.there))
        for held in (self.by_here, self.by_there):
            held.count()

    def times(self, state: DataFrame, prefix: str) -> DataFrame:
        n = F.col("n")
        own = state.select(
            F.col("i").alias(self.here), *[F.col(f"{prefix}{v}").alias(v) for v in self.values]
        )
        means = across(self.by_here, own, self.here, self.there, self.parts).agg(
            *[(F.sum(n * F.col(v)) / F.sum(n)).alias(v) for v in self.values]
        )
        taken = across(self.by_there, means, self.there, self.here, self.parts).agg(
            *[F.sum(n * F.col(v)).alias(v) for v in self.values]
        ).withColumnRenamed(self.here, "i")
        return state.join(taken.hint("shuffle_hash"), "i").withColumns(
            {v: F.col("n_rows") * F.col(f"{prefix}{v}") - F.col(v) for v in self.values}
        )

    def close(self) -> None:
        for held in (self.by_here, self.by_there):
            held.unpersist()


def _conjugate(
    rows: DataFrame, n_effects: int, main: int, values, rounds: int
) -> tuple[dict[int, DataFrame], dict[int, int], set[int]]:
    """Level effects of the minor effects by conjugate gradients, for any number
    of levels, the components of the level graph per sample, and the samples that
    are not settled after ``rounds`` rounds.

    The main effect is eliminated level by level; the other levels' equations
    are solved for all variables at once, each level scaled by its rows.  They
    are singular but consistent, which the method bears.  A round joins the
    search direction to the cells and adds up twice; one table is written.  It
    ends when what the residuals leave in a level, on average, is below
    SETTLED, counted anew from the solution and not from the recurrence.
    """
    cells, levels = _numbered_cells(rows, n_effects, values)
    rest = [k for k in range(n_effects) if k != main]
    found = {
        k: table.agg(F.count("*").alias("n"), F.max("n_rows").alias("most")).first()
        for k, table in levels.items()
    }
    # A hot level must not hold the cells of a third of the rows in one task.
    paired = n_effects == 2 and all(row["most"] <= HOT_LEVEL_ROWS for row in found.values())
    equations = (_PairEquations if paired else _LevelEquations)(
        cells, main, rest, values, {k: row["n"] for k, row in found.items()}
    )
    if paired:
        components = linked_counts(
            equations.by_here, equations.by_there, equations.here, equations.there,
            levels[rest[0]].select("sid", F.col(f"i{rest[0]}").alias("i")), equations.parts,
        )
    else:
        components = connected_components(rows, n_effects)
    stacked = None
    for k in rest:
        one = levels[k].select("sid", F.lit(k).alias("k"), F.col(f"i{k}").alias("i"), "n_rows")
        stacked = one if stacked is None else stacked.unionByName(one)
    right = durable(
        stacked.join(equations.apply(cells), ["k", "i"]).withColumns(
            {f"b{v}": F.col(v) for v in values}
        ).drop(*values)
    )
    if paired:
        dropped(cells)  # held in two other tables
    solution = right.withColumns({f"x{v}": F.lit(0.0) for v in values})
    left = 0
    while True:
        # The true residual of the solution so far; zero at first.
        right_sides = [f"b{v}" for v in values]
        if left:
            state = equations.times(solution, "x").join(
                right.select("k", "i", *right_sides), ["k", "i"]
            ).withColumns({f"r{v}": F.col(f"b{v}") - F.col(v) for v in values}).drop(*values)
        else:
            state = solution.withColumns({f"r{v}": F.col(f"b{v}") for v in values})
        state = durable(state.drop(*right_sides))
        if left:
            dropped(solution)
        size, worst = _sizes(state, values)
        open_ = {s for s, w in worst.items() if w > SETTLED}
        if not open_ or left >= rounds:
            break
        solution, left = _descend(equations, state, values, size, worst, left, rounds)
    equations.close()
    dropped(right)
    effects = {
        k: levels[k].drop("n_rows").join(
            state.where(F.col("k") == k).select(
                F.col("i").alias(f"i{k}"), "n_rows", *[F.col(f"x{v}").alias(f"_m{v}") for v in values]
            ),
            f"i{k}",
        ).drop(f"i{k}")
        for k in rest
    }
    return effects, components, {s for s, w in worst.items() if w > LOOSE}


def _sizes(state: DataFrame, values):
    """Per sample: the scaled squares of the residuals, and their largest mean."""
    found = state.groupBy("sid").agg(
        *[F.sum(F.col(f"r{v}") ** 2 / F.col("n_rows")).alias(f"s{v}") for v in values],
        F.max(F.greatest(*[F.abs(F.col(f"r{v}")) / F.col("n_rows") for v in values], F.lit(0.0)))
        .alias("worst"),
    )
    # One row per sample of the wave.
    rows = found.collect()
    return (
        {r["sid"]: np.array([r[f"s{v}"] for v in values]) for r in rows},
        {r["sid"]: r["worst"] for r in rows},
    )


def _per_sample(state: DataFrame, numbers: dict[int, np.ndarray], values, name: str) -> DataFrame:
    data = [(sid, *map(float, x)) for sid, x in numbers.items()]
    schema = "sid long, " + ", ".join(f"{name}{v} double" for v in values)
    table = state.sparkSession.createDataFrame(data, schema)
    return state.join(F.broadcast(table), "sid")


def _descend(equations, state, values, size, worst, done, rounds):
    """Rounds of conjugate gradients from the residuals of ``state`` on.  Only the
    table of the last round is kept."""
    last = state
    state = state.withColumns({f"p{v}": F.col(f"r{v}") / F.col("n_rows") for v in values})
    while done < rounds and any(w > SETTLED / 4 for w in worst.values()):
        done += 1
        met = durable(equations.times(state, "p"))
        dropped(last)
        last = met
        curves = met.groupBy("sid").agg(
            *[F.sum(F.col(f"p{v}") * F.col(v)).alias(v) for v in values]
        ).collect()
        step = {}
        for row in curves:
            bend = np.array([row[v] for v in values])
            step[row["sid"]] = np.divide(
                size[row["sid"]], bend, out=np.zeros(len(bend)), where=bend > 0
            )
        moved = _per_sample(met, step, values, "a").withColumns(
            {f"x{v}": F.col(f"x{v}") + F.col(f"a{v}") * F.col(f"p{v}") for v in values}
            | {f"r{v}": F.col(f"r{v}") - F.col(f"a{v}") * F.col(v) for v in values}
        )
        before = size
        size, worst = _sizes(moved, values)
        turn = {
            sid: np.divide(now, before[sid], out=np.zeros(len(now)), where=before[sid] > 0)
            for sid, now in size.items()
        }
        drop = [f"{c}{v}" for v in values for c in ("", "a", "t")]
        state = _per_sample(moved, turn, values, "t").withColumns(
            {f"p{v}": F.col(f"r{v}") / F.col("n_rows") + F.col(f"t{v}") * F.col(f"p{v}")
             for v in values}
        ).drop(*drop)
    keep = [c for c in state.columns if not c.startswith(("p", "r"))]
    state = durable(state.select(*keep))
    dropped(last)
    return state, done
