"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q that no neighbour extends.
The dictionary names every factor of 1, 2, 4, ... words: equal factors of a text
have equal names, and the name of 2l words is that of the two names of l words
it is made of.  Inside a run the factors of l words, q <= l < 2q, come back
after q words and not before, so their next occurrences are q apart: an
arithmetic progression, that begins at each word of the run's first part.  Next
occurrences within 2l words propose periods; the stretch of words that propose
the same one is extended by the length of the factor.  A period q is taken at
the one length l with l / 2 < q <= l, so no run is found twice.

A factor that occurs once has no longer factor that repeats, so the longer
lengths look at what repeats only, and most texts are done after a few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import map_texts

# A run has this many words and this many periods at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4


def find_runs(
    words: np.ndarray, ends: np.ndarray, least_words: int, least_periods: int
) -> np.ndarray:
    """start, length, period of the runs of many texts behind each other.

    ``words`` are numbers (equal words of a text have equal ones, words of
    several texts differ), ``ends`` is the end of the text of each word.  Rows
    are sorted by start and period.  Two periods at least are needed for the
    progression to show a run's smallest period; from three on it always does.
    """
    n = len(words)
    found = []
    name = np.full(n, -1, np.int64)
    gap = np.zeros(n, np.int64)
    at, keys, size = np.arange(n), words, 1
    while len(at):
        order = np.argsort(keys, kind="stable")
        place, sorted_keys = at[order], keys[order]
        first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        # Next occurrences of the same factor, within twice its length.
        step = place[1:] - place[:-1]
        near = ~first[1:] & (step <= 2 * size)
        gap[:] = 0
        gap[place[:-1][near]] = step[near]
        found.append(_stretches(gap, size, least_words, least_periods))
        # Factors that repeat are named and joined to factors of twice the length.
        alone = first & np.r_[first[1:], True]
        names = np.cumsum(first) - 1
        name[:] = -1
        name[place[~alone]] = names[~alone]
        rest = np.flatnonzero(name >= 0)
        rest = rest[rest + 2 * size <= ends[rest]]
        rest = rest[name[rest + size] >= 0]
        at, keys = rest, name[rest] * np.int64(n + 1) + name[rest + size]
        size *= 2
    runs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(gap: np.ndarray, size: int, least_words: int, least_periods: int) -> np.ndarray:
    """Runs from stretches of words whose factor comes back after the same gap."""
    at = np.flatnonzero((gap > size // 2) & (gap <= size))
    if not len(at):
        return np.empty((0, 3), np.int64)
    period = gap[at]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(at)])
    period = period[start]
    length = count + size - 1 + period
    good = length >= np.maximum(least_words, least_periods * period)
    return np.column_stack([at[start], length, period])[good]


def periodic_runs(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """key, runs, collapsed for every row; ``runs`` are (start, length, period)
    by start, then period, counted in words from 0.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text.  Runs have
    ``least_words`` words and ``least_periods`` periods (3 or more) at least;
    ``collapsed`` are the words, joined by one space, without those that stand
    in a run after its first period.  A null or empty text has no runs and
    collapses to nothing; a very long text is handled alone, in memory of some
    ten times its size.  Rows that repeat a key, and null keys, are rows of
    their own; ``keep`` names columns to hand on, others are not in the way.
    An empty table gives no rows.  Nothing is shuffled.
    """
    if least_periods < 3:
        raise ValueError("a run has three periods or more")
    kind = df.schema[key].dataType.simpleString()
    kinds = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    narrow = df.select(
        F.col(key).alias("key"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(text).alias("text"),
    )
    lists = ["start array<bigint>", "length array<bigint>", "period array<bigint>"]

    def start():
        def work(columns):
            *kept, texts = columns
            split = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            stop = np.cumsum(sizes)
            number = {w: i for i, w in enumerate({w: None for ws in split for w in ws})}
            codes = np.fromiter(
                (number[w] for ws in split for w in ws), np.int64, int(sizes.sum())
            )
            owner = np.repeat(np.arange(len(split)), sizes)
            runs = find_runs(
                codes + owner * max(len(number), 1), np.repeat(stop, sizes), least_words,
                least_periods,
            )
            texts = _collapsed(split, stop, runs)
            of = owner[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
            offsets = pa.array(np.searchsorted(of, np.arange(len(split) + 1)).astype(np.int32))
            begin = (stop - sizes)[of]
            values = (runs[:, 0] - begin, runs[:, 1], runs[:, 2])
            return [
                *kept, *[pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in values],
                pa.array(texts, pa.string()),
            ]

        return work

    columns = ["key", *[f"k{i}" for i in range(len(keep))]]
    schema = ", ".join([f"key {kind}", *kinds, *lists, "collapsed string"])
    made = map_texts(narrow, [*columns, "text"], schema, start)
    return made.select(
        F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.arrays_zip("start", "length", "period").alias("runs"), "collapsed",
    )


def _collapsed(split: list[list[bytes]], stop: np.ndarray, runs: np.ndarray) -> list[str]:
    """The texts without the words of a run after its first period."""
    edge = np.zeros(int(stop[-1]) + 1 if len(stop) else 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge)[:-1] > 0
    some = set(np.searchsorted(stop, runs[:, 0], side="right").tolist())
    out = []
    for i, words in enumerate(split):
        if i in some:
            own = gone[int(stop[i]) - len(words) : int(stop[i])]
            words = [w for w, g in zip(words, own.tolist(), strict=True) if not g]
        out.append(b" ".join(words).decode())
    return out
