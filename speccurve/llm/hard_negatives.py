"""Hard negatives of anchor vectors by segment summary filtering.

A vector is cut into equal segments, and for each the mean and the deviation
are stored, for 1, 4, 16, ... segments.  The inner product of two segments of m
numbers is m times the product of the means, give or take m times the product
of the deviations; the sum over the segments bounds the score of two vectors on
both sides.  The search starts with one segment, leaves out the vectors whose
upper bound is below what is certain already (the k-th largest lower bound) or
whose bounds miss the window asked for, refines the rest by more segments, and
scores exactly what is left.  Scores are whole numbers, so a bound may be off by
rounding and still never leaves out a result.

The anchors meet all vectors in blocks: vectors are dealt over blocks by a hash
of the row, whatever their label, so a hot label is spread; each pair of blocks
offers the best few of each anchor, and the best of these offers stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speccurve.llm.common import ship
from speccurve.llm.common import stored

# Rows of a block of vectors and of a block of anchors.
BLOCK_ROWS = 8192
# Numbers in the shortest segment that is summed up.
LEAST_SEGMENT = 4
# Scores below this are exact in double arithmetic.
EXACT = 2.0**52

_ROWS = "rid long, vec_id long, label long, dims int, v array<double>, s array<double>"


def segment_bounds(dims: int) -> list[np.ndarray]:
    """Bounds of the segments of each level, from one segment on."""
    out, parts = [], 1
    while dims and (parts == 1 or dims // parts >= LEAST_SEGMENT):
        out.append(np.linspace(0, dims, parts + 1).astype(int))
        parts *= 4
    return out


def summaries(values: np.ndarray) -> np.ndarray:
    """Of each row, for all levels: sqrt(m) times the means of its segments, then
    sqrt(m) times the deviations; so products need no further factor."""
    parts = []
    for bounds in segment_bounds(values.shape[1]):
        size = np.diff(bounds)
        mean = np.add.reduceat(values, bounds[:-1], axis=1) / size
        apart = values - np.repeat(mean, size, axis=1)
        spread = np.sqrt(np.add.reduceat(apart * apart, bounds[:-1], axis=1))
        parts += [mean * np.sqrt(size), spread]
    return np.hstack(parts) if parts else np.zeros((len(values), 0))


def summarised(df: DataFrame) -> DataFrame:
    """rid, vec_id, label, dims, v, s: the rows with a number of their own and
    their segment summaries, written once.

    ``df`` has vec_id, label and v, an array of whole numbers.
    """
    ship(df.sparkSession)
    numbered = df.select(
        F.monotonically_increasing_id().alias("rid"), "vec_id",
        F.col("label").cast("long").alias("label"), F.size("v").alias("dims"),
        F.col("v").cast("array<double>").alias("v"),
    )

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == d))
                made = summaries(_matrix(own.column(4), d))
                yield pa.RecordBatch.from_arrays([*own.columns, _lists(made)], names=names)

    names = [part.split()[0] for part in _ROWS.split(", ")]
    return stored(numbered.mapInArrow(run, _ROWS), "summaries")


def _matrix(lists, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), width)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel())
    )


class _Block:
    """The vectors of a block with their summaries by level."""

    def __init__(self, table: pa.Table, rows: str):
        order = np.argsort(table.column(f"{rows}rid").to_numpy())
        table = table.take(pa.array(order)).combine_chunks()
        get = lambda name: table.column(f"{rows}{name}").combine_chunks()
        self.table = table
        self.rid = get("rid").to_numpy()
        self.vec_id = get("vec_id").to_numpy()
        self.label = get("label").to_numpy()
        self.dims = int(get("dims")[0].as_py())
        self.v = _matrix(get("v"), self.dims)
        summed = get("s")
        flat = _matrix(summed, len(summed[0]))
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        self.levels, lo = [], 0
        for bounds in segment_bounds(self.dims):
            k = len(bounds) - 1
            self.levels.append((flat[:, lo : lo + k], flat[:, lo + k : lo + 2 * k]))
            lo += 2 * k


def _bounds(anchors: _Block, a: int, level: int, rows: _Block, take: np.ndarray):
    """Lower and upper bounds of the scores of one anchor with some rows."""
    mean, spread = (part[take] for part in rows.levels[level])
    own_mean, own_spread = (part[a] for part in anchors.levels[level])
    middle, reach = mean @ own_mean, spread @ own_spread
    # Room for rounding: scores are whole numbers.
    reach += 0.25 + 1e-12 * anchors.norm[a] * rows.norm[take]
    return middle - reach, middle + reach


def _kth(values: np.ndarray, k: int) -> float:
    if len(values) < k:
        return -np.inf
    return float(np.partition(values, len(values) - k)[len(values) - k])


def _scores(rows: _Block, take: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact scores; beyond doubles, by Python's whole numbers."""
    own = rows.v[take]
    if len(own) == 0 or np.abs(own).max(initial=0) * np.abs(v).sum() < EXACT / 128:
        return own @ v
    whole = [int(x) for x in v]
    found = [sum(int(x) * y for x, y in zip(row, whole)) for row in own]
    return np.array([min(max(f, -(2**63)), 2**63 - 1) for f in found], object)


def _first(rows: _Block, take: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """The k best of ``take``: by score, ties by the smaller vec_id, then the row."""
    order = sorted(
        range(len(take)),
        key=lambda i: (-scores[i], rows.vec_id[take[i]], rows.rid[take[i]]),
    ) if scores.dtype == object else np.lexsort((rows.rid[take], rows.vec_id[take], -scores))
    return list(order[:k])


def _best(anchors: _Block, rows: _Block, k: int):
    """Anchor, row and score of the k best rows of an anchor's label."""
    for a in range(len(anchors.rid)):
        take = np.flatnonzero(
            (rows.label == anchors.label[a]) & (rows.vec_id != anchors.vec_id[a])
        )
        for level in range(len(anchors.levels)):
            if len(take) <= k:
                break
            low, high = _bounds(anchors, a, level, rows, take)
            take = take[high >= _kth(low, k)]
        scores = _scores(rows, take, anchors.v[a])
        for i in _first(rows, take, scores, k):
            yield a, take[i], scores[i]


def _within(anchors: _Block, rows: _Block, windows, k: int, low_share: int, high_share: int):
    """Anchor, row, score and positive score of the k best rows of other labels
    for every window of an anchor."""
    for a in range(len(anchors.rid)):
        take = np.flatnonzero(rows.label != anchors.label[a])
        # Whole scores with low_share * positive <= 100 * score <= high_share * positive.
        spans = [(p, -(-low_share * p // 100), high_share * p // 100) for p in windows[a]]
        spans = [span for span in spans if span[1] <= span[2]]
        if not spans:
            continue
        for level in range(len(anchors.levels)):
            low, high = _bounds(anchors, a, level, rows, take)
            stay = np.zeros(len(take), bool)
            for _, least, most in spans:
                sure = low[(low >= least) & (high <= most)]
                stay |= (high >= max(least, _kth(sure, k))) & (low <= most)
            take = take[stay]
        scores = _scores(rows, take, anchors.v[a])
        for p, least, most in spans:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for i in _first(rows, take[inside], scores[inside], k):
                yield a, take[inside[i]], scores[inside[i]], p


def _dealt(rows: DataFrame, own: Column, others: int, prefix: str) -> DataFrame:
    """Every row once for each block of the other side."""
    every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    named = rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns],
                        own.alias("own"), every.alias("other"))
    pair = ("own", "other") if prefix == "a_" else ("other", "own")
    return named.select(
        *[f"{prefix}{c}" for c in rows.columns], F.col(f"{prefix}dims").alias("dims"),
        F.col(pair[0]).alias("anchor_block"), F.col(pair[1]).alias("row_block"),
    )


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, search, schema: str):
    """``search`` on every pair of a block of anchors and one of rows."""
    a_blocks, r_blocks = -(-n_anchors // BLOCK_ROWS) or 1, -(-n_rows // BLOCK_ROWS) or 1
    keys = ["dims", "anchor_block", "row_block"]
    # By place and not by content: equal vectors are dealt like all others.
    left = _dealt(anchors, F.pmod(F.xxhash64("rid"), F.lit(a_blocks)).cast("int"), r_blocks, "a_")
    right = _dealt(rows, F.pmod(F.xxhash64("rid"), F.lit(r_blocks)).cast("int"), a_blocks, "r_")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            found = []
        else:
            found = search(_Block(one, "a_"), _Block(two, "r_"))
        columns = list(zip(*found)) or [[] for _ in names]
        return pa.table({n: pa.array([int(x) for x in c], pa.int64())
                         for n, c in zip(names, columns, strict=True)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _top(found: DataFrame, part: list[str], k: int, score: str, number: str) -> DataFrame:
    """The first k of each group, with their place from 1."""
    order = Window.partitionBy(*part).orderBy(F.desc(score), number, "r_rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_share: int = 50,
    high_share: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``df`` has vec_id, label and v (an array of whole numbers); ``is_anchor`` is
    true for the anchors.  The score of two rows is their inner product; higher
    ones come first, ties by smaller vec_id.  The positives of an anchor are its
    first ``positives`` rows of the same label, all if there are fewer; the
    negatives of both are the first ``negatives`` rows of another label with
    ``low_share`` * positive_score <= 100 * negative_score <= ``high_share`` *
    positive_score, which leaves none to a positive score below 0.

    Rows with a null vec_id, label, vector or component take no part.  Repeated
    rows count each; an anchor does not meet rows with its own vec_id.  Vectors
    meet those of the same length only, empty ones with a score of 0; scores
    beyond 64 bits are cut to them.  Other columns are ignored; an empty table
    gives no rows.  A third of all rows may have one label or one vector.
    """
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    valid = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = summarised(valid)
    anchors = stored(rows.where(is_anchor), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()

    best = _met(
        anchors, rows, n_anchors, n_rows,
        lambda a, r: [(a.rid[i], a.vec_id[i], r.rid[j], r.vec_id[j], s)
                      for i, j, s in _best(a, r, positives)],
        "a_rid long, anchor_id long, r_rid long, positive_id long, positive_score long",
    )
    best = stored(
        _top(best, ["a_rid"], positives, "positive_score", "positive_id").select(
            "a_rid", "anchor_id", "positive_id", "positive_score"
        ),
        "positives",
    )
    # At most ``positives`` different scores of an anchor.
    windows = best.groupBy("a_rid").agg(F.collect_set("positive_score").alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("a_rid", "rid"), "rid")
    schema = "a_rid long, r_rid long, negative_id long, negative_score long, positive_score long"

    def inside(a: _Block, r: _Block):
        lists = a.table.column("a_windows").to_pylist()
        found = _within(a, r, lists, negatives, low_share, high_share)
        return [(a.rid[i], r.rid[j], r.vec_id[j], s, p) for i, j, s, p in found]

    met = _met(asked, rows, n_anchors, n_rows, inside, schema)
    chosen = _top(met, ["a_rid", "positive_score"], negatives, "negative_score", "negative_id")
    return best.join(chosen, ["a_rid", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
