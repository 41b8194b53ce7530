"""Benchmark decontamination: a prefix-filtered set join, in columns only.

A window is a run of WINDOW words of an item, or all words of a shorter item;
its set holds its runs of SHINGLE words.  A document window equal to it shares
the whole set, so a prefix of one shingle is enough to find it, and the rarest
makes the fewest candidates.  A candidate says where the window would lie
(positional bound) and that it must lie inside the text (length bound); then
the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speccurve.llm.common import BROADCAST_BYTES, stored

WINDOW = 10
SHINGLE = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ASCII that is neither digit nor letter.
_APART = "".join(
    chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha())
)
# Key of the one row that every document has besides its shingles.
_EVERY = 0


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), _UPPER + _APART, _UPPER.lower() + " " * len(_APART)
    )
    return F.array_remove(F.split(plain, " "), "")


def _shingle(words: str, at: Column, size: int) -> Column:
    parts = [F.get(words, at + k if k else at) for k in range(size)]
    return F.xxhash64(F.lit(size), *parts)


def _windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """words, n, items of every distinct window."""
    split = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    return (
        split.where(F.size("w") > 0)
        .select("item", "w", size.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - size))
                .alias("at"))
        .select("item", F.expr("slice(w, at + 1, n)").alias("words"), "n")
        .groupBy("words", "n")
        .agg(F.collect_set("item").alias("items"))
    )


def _spread(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """h of every shingle of every document, its place ``p``, and the words."""
    at = F.col("p")
    rows = docs.select(
        "*", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("p", "word")
    )
    hashes = [_shingle("words", at, s) for s in sizes]
    last = F.col("word") == ""
    hashes[0] = F.when(last, F.lit(_EVERY).cast("long")).otherwise(hashes[0])
    if len(hashes) == 1:
        return rows.withColumn("h", hashes[0])
    return rows.withColumn("h", F.explode(F.array(*hashes)))


def decontaminate(
    df: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] = (),
    window: int = WINDOW,
) -> DataFrame:
    """key, n_words, n_hit, items, spans for every document.

    ``spans`` are the sorted [from, to) word places of occurrences, ``n_hit``
    the words inside any of them, ``items`` the items (as sorted strings) with
    an occurrence.  A null text has no words, and neither has an item of marks
    only; without items nothing is hit.  Every row, repeated or not, and with a
    null key too, has a result of its own; an empty table gives no rows.
    ``keep`` names columns to hand on, other columns are not in the way.

    Documents are read twice: to count how often the shingles of the items
    occur, and to find the rarest of each window.  Only counts and occurrences
    are shuffled.  The windows' table is broadcast where its counted size
    allows; beyond that the join is shuffled, with the words around a shingle.
    """
    windows = stored(_windows(items, item, item_text, window), "windows")
    n_windows = windows.count()
    sizes = sorted({min(r[0], SHINGLE) for r in windows.select("n").distinct().collect()})
    sizes = sizes or [SHINGLE]
    small = n_windows * (window * 32 + 100) <= BROADCAST_BYTES
    mark = F.broadcast if small else (lambda table: table)

    size = F.least("n", F.lit(SHINGLE))
    sets = windows.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset")
    )
    hashed = F.lit(None).cast("long")
    for s in sizes:
        hashed = F.when(size == s, _shingle("words", F.col("offset"), s)).otherwise(hashed)
    sets = sets.withColumn("h", hashed)

    docs = df.select(words_of(F.col(text)).alias("words"))
    wanted = sets.select("h").distinct()
    counts = (
        _spread(docs, sizes).select("h").join(mark(wanted), "h", "left_semi")
        .groupBy("h").agg(F.count("*").alias("frequency"))
    )
    # A window with a shingle that occurs nowhere occurs nowhere.
    rarest = Window.partitionBy("words").orderBy("frequency", "h", "offset")
    prefix = (
        sets.join(counts, "h", "left")
        .withColumn("frequency", F.coalesce("frequency", F.lit(0)))
        .withColumn("rank", F.row_number().over(rarest))
        .where("rank = 1 AND frequency > 0")
        .select("h", F.col("words").alias("w"), "n", "items", "offset")
    )
    everyone = df.sparkSession.range(1).select(
        F.lit(_EVERY).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("w"),
        F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("items"),
        F.lit(0).alias("offset"),
    )
    prefix = stored(prefix.unionByName(everyone), "prefix")

    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate((key, *keep))]
    named = [f"_k{i}" for i in range(len(kept))]
    docs = df.select(
        *kept, F.monotonically_increasing_id().alias("_row"), words_of(F.col(text)).alias("words")
    )
    found = _spread(docs, sizes)
    if not small:
        # The words that any window over this shingle can touch.
        reach = window - 1
        found = found.withColumn("size", F.size("words")).withColumn(
            "words",
            F.slice("words", F.greatest(F.col("p") - reach, F.lit(0)) + 1, F.lit(2 * window)),
        ).withColumn("shift", F.greatest(F.col("p") - reach, F.lit(0)))
    else:
        found = found.withColumn("size", F.size("words")).withColumn("shift", F.lit(0))
    every = (F.col("word") == "") & F.col("w").isNull()
    start = F.col("p") - F.col("offset")
    inside = (
        F.col("w").isNotNull()
        & (start >= 0)
        & (start + F.col("n") <= F.col("size"))
        & (F.slice("words", F.greatest(start - F.col("shift") + 1, F.lit(1)), F.col("n"))
           == F.col("w"))
    )
    span = F.struct(
        start.cast("long").alias("from"), (start + F.col("n")).cast("long").alias("to")
    )
    hits = (
        found.join(mark(prefix), "h")
        .where(every | inside)
        .select(
            "_row", *named, "items",
            F.when(every, F.col("p")).cast("long").alias("n_words"),
            F.when(~every, span).alias("span"),
        )
        .groupBy("_row", *named)
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    covered = F.expr(
        "aggregate(spans, named_struct('hit', 0L, 'reach', 0L), (a, x) -> named_struct("
        "'hit', a.hit + greatest(0L, x.to - greatest(x.from, a.reach)), "
        "'reach', greatest(a.reach, x.to)), a -> a.hit)"
    )
    return hits.select(
        *[F.col(n).alias(c) for n, c in zip(named, (key, *keep), strict=True)],
        "n_words", covered.alias("n_hit"), "items", "spans",
    )
