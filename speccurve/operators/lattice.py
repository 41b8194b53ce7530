"""Samples without effects as sums over the patterns of missing values.

A sample is the rows whose pattern of missing values has no bit in common with
the sample's mask, so every sum over it is a sum over patterns.  Rows are read
once and added up by pattern, or by pattern and cluster; the sums of all samples
follow from those.  For sums by cluster the rows are dealt and sorted by cluster, so
what is shuffled are rows, narrow and once, and no cross-products; only the rows of
very large clusters are added up where they are.  One absorbed effect that is the
cluster too is done alike, without its means.  Means are taken out afterwards: with a constant among the
variables, centred cross-products are combinations of plain ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.operators.moments import (
    CHUNK_VALUES, MOMENT_BYTES, TENSOR_SCHEMA, tensor_batch, triangle,
)
from speccurve.operators.panel import Panel
from speccurve.operators.samples import Facts
from speccurve.operators.scale import HOT_LEVEL_ROWS, durable, sum_arrays

# The kind of the plain cross-products of a sample.
PLAIN = -1
# Rows of a very large cluster in the sample that finds those.
HOT_SEEN = 100


def samples_at_once(n_vars: int) -> int:
    """Samples whose moments one task can hold."""
    width = (n_vars + 1) * (n_vars + 2) // 2
    return max(1, MOMENT_BYTES // (8 * width * width))


def admitted(patterns: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """masks x patterns: 1 where the pattern's rows are in the mask's sample."""
    met = (patterns[None, :, :] & masks[:, None, :]) == 0
    return met.all(axis=2).astype(float)


def _products(n_vars: int) -> list:
    """Sums of the products of a constant and the variables, by the triangle."""
    names = [F.lit(1.0), *[F.col(f"v{j}") for j in range(n_vars)]]
    return [F.sum(names[a] * names[b]) for a, b in zip(*triangle(n_vars + 1))]


def lattice_sums(
    panel: Panel, masks: list[tuple[int, ...]], kinds: dict[int, list[str]], clusters: dict
) -> DataFrame:
    """sid, kind, row, part: PLAIN cross-products (row 0) and, for each of
    ``kinds``, the sums of ``score_tensors`` of a constant and the variables;
    the row after the last holds the number of clusters.  ``sid`` is the place
    of the mask, ``clusters`` names the key columns."""
    n_vars = len(panel.variables)
    width = (n_vars + 1) * (n_vars + 2) // 2
    words = [f"p{w}" for w in range(panel.words)]
    masks_array = np.array(masks, np.int64).reshape(len(masks), len(words))
    sums = [c.alias(f"g{i}") for i, c in enumerate(_products(n_vars))]
    flat = F.array(*[f"g{i}" for i in range(width)])
    plain = panel.rows.groupBy(*words).agg(*sums).select(
        *words, F.lit(PLAIN).cast("long").alias("kind"), F.lit(0).cast("long").alias("row"),
        flat.alias("part"),
    )
    if 0 in kinds:
        plain = plain.unionByName(_row_tensors(panel, words, n_vars, width))

    def over_masks(pdf: pd.DataFrame) -> pd.DataFrame:
        fits = admitted(pdf[words].to_numpy(np.int64), masks_array)
        return pd.DataFrame({
            "sid": np.arange(len(masks)), "kind": pdf["kind"].iloc[0], "row": pdf["row"].iloc[0],
            "part": list(fits @ np.vstack(pdf["part"].to_numpy())),
        })

    # One group holds a row of the matrix for every pattern that occurs.
    union = plain.groupBy("kind", "row").applyInPandas(over_masks, TENSOR_SCHEMA)
    for kind, keys in kinds.items():
        if kind:
            named = {k: clusters[k] for k in keys}
            union = union.unionByName(_cluster_tensors(panel, masks_array, kind, named, False))
    return union


def _cluster_tensors(
    panel: Panel, masks: np.ndarray, kind: int, named: dict, centred: bool
) -> DataFrame:
    """sid, kind, row, part: the sums of ``score_tensors`` over the clusters that the
    columns ``named`` give, with or without (``centred``) the constant; then a row of
    the number of clusters or, if ``centred``, a row of the cross-products added up and
    one with the rows, the clusters of one row and all clusters."""
    n_vars = len(panel.variables)
    words, values = [f"p{w}" for w in range(panel.words)], [f"v{j}" for j in range(n_vars)]
    rows = panel.rows.select(
        *words, *values, *[c.alias(k) for k, c in named.items()]
    ).dropna(subset=list(named))
    work = _ClusterWork(kind, n_vars, masks, centred)
    # The parts of a struct are compared one by one.
    parts, flat = [], []
    for k in named:
        inner = getattr(rows.schema[k].dataType, "names", [])
        parts += [f"{k}_{i}" for i in range(len(inner))] or [k]
        flat += [F.col(k)[n].alias(f"{k}_{i}") for i, n in enumerate(inner)] or [F.col(k)]
    hot = _hot(rows, list(named), panel.n_rows)
    cold = rows if hot is None else rows.join(F.broadcast(hot), list(named), "left_anti")
    dealt = cold.select(*words, *values, *flat).repartition(*parts).sortWithinPartitions(*parts)
    union = dealt.mapInArrow(work.of_rows(words, values, parts), TENSOR_SCHEMA)
    if hot is not None:
        sums = [c.alias(f"g{i}") for i, c in enumerate(_products(n_vars))]
        cells = rows.join(F.broadcast(hot), list(named)).groupBy(*words, *named).agg(*sums)
        flat = F.array(*[f"g{i}" for i in range(len(sums))])
        # At most one entry per pattern in a cluster, however many rows it has.
        blocks = cells.groupBy(*named).agg(
            F.collect_list(F.struct(*words, flat.alias("sums"))).alias("cells")
        ).select("cells")
        union = union.unionByName(blocks.mapInArrow(work.of_cells(words), TENSOR_SCHEMA))
    return sum_arrays(union, ["sid", "kind", "row"], "part")


def _hot(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame | None:
    """Clusters that have about ``HOT_LEVEL_ROWS`` rows or more, by a sample, or
    None: it only decides which way their sums are formed."""
    if n_rows <= HOT_LEVEL_ROWS:
        return None
    seen = rows.select(*keys).sample(min(1.0, 2 * HOT_SEEN / HOT_LEVEL_ROWS), seed=0)
    hot = durable(seen.groupBy(*keys).count().where(F.col("count") >= HOT_SEEN).select(*keys))
    return None if hot.isEmpty() else hot


def _row_tensors(panel: Panel, words, n_vars: int, width: int) -> DataFrame:
    """words, kind, row, part of kind 0, per pattern of missing values."""
    names = [f"v{j}" for j in range(n_vars)]
    row, col = triangle(n_vars + 1)

    def partial(batches):
        totals: dict[tuple, np.ndarray] = {}

        def done():
            for pattern, total in totals.items():
                yield tensor_batch({**dict(zip(words, pattern)), "kind": 0}, total)

        for batch in batches:
            data = np.column_stack(
                [np.ones(batch.num_rows)] + [batch.column(v).to_numpy() for v in names]
            )
            seen, of = np.unique(
                np.column_stack([batch.column(w).to_numpy() for w in words]), axis=0,
                return_inverse=True,
            )
            of = of.reshape(-1)
            for i, pattern in enumerate(map(tuple, seen.tolist())):
                part = data[of == i]
                total = totals.setdefault(pattern, np.zeros((width, width)))
                step = max(1, CHUNK_VALUES // width)
                for at in range(0, len(part), step):
                    flat = part[at : at + step][:, row] * part[at : at + step][:, col]
                    total += flat.T @ flat
            if len(totals) * width * width * 8 > MOMENT_BYTES:
                yield from done()
                totals = {}
        yield from done()

    schema = ", ".join(f"{w} long" for w in words) + ", kind long, row long, part array<double>"
    parts = panel.rows.select(*words, *names).mapInArrow(partial, schema)
    keys = [*words, "kind", "row"]
    return sum_arrays(parts, keys, "part")


class _ClusterWork:
    """Per mask, sums over clusters of products of their cross-products.

    A cluster comes as cells: a pattern of missing values, and sums of the products
    of a constant and the variables.  ``centred`` takes the cluster's means out.
    """

    def __init__(self, kind: int, n_vars: int, masks: np.ndarray, centred: bool):
        self.kind, self.masks, self.centred = kind, masks, centred
        self.row, self.col = triangle(n_vars + 1)
        self.inner = np.flatnonzero(self.row > 0) if centred else np.arange(len(self.row))
        width = len(self.inner)
        self.step = max(1, CHUNK_VALUES // (len(masks) * len(self.row)))
        self.shape = (len(masks), width + 1 + centred, width)

    def begin(self) -> None:
        self.total, self.held = np.zeros(self.shape), []
        self.patterns: dict[tuple, int] = {}
        self.fits = np.empty((len(self.masks), 0))

    def numbers(self, patterns: np.ndarray) -> np.ndarray:
        """A running number for each pattern, its column of ``fits``."""
        seen, of = np.unique(patterns, axis=0, return_inverse=True)
        fresh = [i for i, p in enumerate(map(tuple, seen.tolist())) if p not in self.patterns]
        for i in fresh:
            self.patterns[tuple(seen[i].tolist())] = len(self.patterns)
        self.fits = np.column_stack([self.fits, admitted(seen[fresh], self.masks)])
        known = np.array([self.patterns[p] for p in map(tuple, seen.tolist())], np.int64)
        return known[of.reshape(-1)]

    def cluster(self, patterns: np.ndarray, sums: np.ndarray) -> None:
        self.held.append(self.fits[:, patterns] @ sums)
        if len(self.held) == self.step:
            self.add()

    def add(self) -> None:
        if not self.held:
            return
        grams = np.stack(self.held, axis=1)
        self.held.clear()
        # The first product is that of the constant with itself: the rows.
        n, width = grams[:, :, 0], self.shape[2]
        if self.centred:
            means = grams[:, :, self.row == 0][:, :, 1:] / np.maximum(n, 1)[:, :, None]
            a, b = self.row[self.inner] - 1, self.col[self.inner] - 1
            grams = grams[:, :, self.inner] - n[:, :, None] * means[:, :, a] * means[:, :, b]
            # A row alone leaves nothing, not even what rounding would.
            grams[n <= 1] = 0.0
            self.total[:, width] += grams.sum(axis=1)
            for i, count in enumerate((n, n == 1, n > 0)):
                self.total[:, width + 1, i] += count.sum(axis=1)
        else:
            self.total[:, width, 0] += (n > 0).sum(axis=1)
        self.total[:, :width] += np.matmul(grams.transpose(0, 2, 1), grams)

    def end(self):
        self.add()
        for sid in range(len(self.masks)):
            if self.total[sid].any():
                yield tensor_batch({"sid": sid, "kind": self.kind}, self.total[sid])

    def of_cells(self, words: list[str]):
        """From lists of cells."""

        def run(batches):
            self.begin()
            for batch in batches:
                lists = batch.column(0)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                of = self.numbers(np.column_stack([flat.field(w).to_numpy() for w in words]))
                sums = flat.field("sums").flatten().to_numpy().reshape(len(of), -1)
                for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                    self.cluster(of[lo:hi], sums[lo:hi])
            yield from self.end()

        return run

    def of_rows(self, words: list[str], values: list[str], keys: list[str]):
        """From rows sorted by cluster.  A cluster may reach over batches: its cells
        so far are held, and the values by which its variables are shifted."""

        def run(batches):
            self.begin()
            last, shift, held = None, None, (np.empty(0, np.int64), None)
            step = max(1, CHUNK_VALUES // len(self.row))
            for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
                size = batch.num_rows
                new = np.zeros(size, bool)
                new[0] = last is None or last != [batch.column(k)[0].as_py() for k in keys]
                for k in keys:
                    column = batch.column(k)
                    # Nulls are rows that no sample admits.
                    other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
                    new[1:] |= other.to_numpy(zero_copy_only=False)
                last = [batch.column(k)[size - 1].as_py() for k in keys]
                if new[0] and len(held[0]):
                    self.cluster(*held)
                    held = (np.empty(0, np.int64), None)
                data = np.column_stack([batch.column(v).to_numpy() for v in values])
                starts = np.flatnonzero(np.r_[True, new[1:]])
                owner = np.cumsum(np.r_[False, new[1:]])
                if self.centred:
                    middle = np.add.reduceat(data, starts) / np.diff(np.r_[starts, size])[:, None]
                    if not new[0]:
                        middle[0] = shift
                    data, shift = data - middle[owner], middle[-1]
                data = np.column_stack([np.ones(size), data])
                of = self.numbers(np.column_stack([batch.column(w).to_numpy() for w in words]))
                order = np.lexsort((of, owner))
                of, owner = of[order], owner[order]
                cells = np.flatnonzero(
                    np.r_[True, (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])]
                )
                flat = data[order][:, self.row] * data[order][:, self.col]
                sums, of, owner = np.add.reduceat(flat, cells), of[cells], owner[cells]
                bounds = np.searchsorted(owner, np.arange(len(starts) + 1))
                for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                    own = of[lo:hi], sums[lo:hi]
                    if i == 0 and len(held[0]):
                        own = _together(held, own)
                    if i == len(starts) - 1:
                        held = own
                    else:
                        self.cluster(*own)
            if len(held[0]):
                self.cluster(*held)
            yield from self.end()

        return run


def _together(one, two):
    """The cells of two parts of a cluster, one for each pattern."""
    patterns, of = np.unique(np.r_[one[0], two[0]], return_inverse=True)
    sums = np.zeros((len(patterns), two[1].shape[1]))
    np.add.at(sums, of, np.vstack([one[1], two[1]]))
    return patterns, sums


def lattice_samples(
    panel: Panel, masks: list[tuple[int, ...]], kinds: dict[int, list[str]], clusters: dict
):
    """Score tensors, and per sample its facts, the centred cross-products and
    the means; these three come to the driver (variables squared a sample)."""
    n_vars = len(panel.variables)
    width = (n_vars + 1) * (n_vars + 2) // 2
    table = durable(lattice_sums(panel, masks, kinds, clusters))
    row, col = triangle(n_vars + 1)
    facts, grams, means = {}, {}, {}
    small = table.where((F.col("kind") == PLAIN) | (F.col("row") == width))
    for found in sorted(small.collect(), key=lambda r: r["kind"]):
        sid, kind = found["sid"], found["kind"]
        if kind != PLAIN:
            if sid in facts:
                ids = tuple(sorted(int(c[1:]) for c in kinds[kind]))
                facts[sid].clusters[ids] = int(found["part"][0])
            continue
        full = np.zeros((n_vars + 1, n_vars + 1))
        full[row, col] = full[col, row] = found["part"]
        n = full[0, 0]
        if n > 0:
            facts[sid] = Facts(n=round(n))
            means[sid] = full[0, 1:] / n
            grams[sid] = full[1:, 1:] - n * np.outer(means[sid], means[sid])
    return table.where((F.col("kind") != PLAIN) & (F.col("row") < width)), facts, grams, means, table


def level_samples(panel: Panel, masks: list[tuple[int, ...]], kind: int, term: tuple[str, ...]):
    """For one effect that is the cluster too, its means taken out: score tensors,
    the cross-products per sample, and the facts with and without singletons."""
    width = len(triangle(len(panel.variables))[0])
    masks_array = np.array(masks, np.int64).reshape(len(masks), panel.words)
    table = durable(
        _cluster_tensors(panel, masks_array, kind, {"c0": panel.key(term)}, True)
    )
    row, col = triangle(len(panel.variables))
    kept, dropped_, grams = {}, {}, {}
    for found in table.where(F.col("row") >= width).collect():
        sid, part = found["sid"], np.array(found["part"])
        if found["row"] == width:
            grams[sid] = np.zeros((len(panel.variables),) * 2)
            grams[sid][row, col] = grams[sid][col, row] = part
            continue
        n, lone, levels = (round(x) for x in part[:3])
        # As in ``settle``, a row that is all of its sample stays.
        for facts, gone in ((kept, 0), (dropped_, lone if n > 1 else 0)):
            if n > gone:
                left = levels - gone
                facts[sid] = Facts(n - gone, {0: left}, {(0,): left}, {(0, 0)})
    return table.where(F.col("row") < width), grams, kept, dropped_, table
