"""From a raw panel to the narrow table every estimation step reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speccurve.deploy import ship
from speccurve.operators.scale import dropped, durable

WORD_BITS = 62
SPREAD_ROWS = 200_000


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null: both mean missing."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


@dataclass
class Panel:
    """The prepared panel.

    ``rows`` holds the variables ``v0..`` (centred, divided by their standard
    deviation), the keys ``k0..``, the raw grouping columns ``z0..`` and the
    bitmap of missing variables ``p0..``.  Only variables that do have missing
    values own a bit.
    """

    rows: DataFrame
    source: DataFrame
    variables: list[str]
    keys: list[str]
    groups: list[str]
    n_rows: int
    mean: list[float]
    scale: list[float]
    bits: dict[str, int]
    codes: dict[tuple[str, ...], tuple[DataFrame, int] | None] = field(default_factory=dict)

    @property
    def words(self) -> int:
        return max(1, -(-len(self.bits) // WORD_BITS))

    def mask(self, names) -> tuple[int, ...]:
        """Bitmap of the named variables or keys, one number per word."""
        out = [0] * self.words
        for name in names:
            if name in self.bits:
                out[self.bits[name] // WORD_BITS] |= 1 << self.bits[name] % WORD_BITS
        return tuple(out)

    def code(self, term: tuple[str, ...], limit: int) -> tuple[DataFrame, int] | None:
        """Running numbers for the levels of a term (columns ``level``,
        ``code``) and their count, or None beyond ``limit`` levels."""
        if term not in self.codes:
            parts = [f"k{self.keys.index(name)}" for name in term]
            levels = self.rows.dropna(subset=parts).select(self.key(term).alias("level"))
            found = levels.distinct().limit(limit + 1).collect()
            table = None
            if len(found) <= limit:
                kind = T.StructType(
                    [levels.schema["level"], T.StructField("code", T.LongType())]
                )
                numbered = enumerate(sorted(r[0] for r in found))
                data = [(level, code) for code, level in numbered]
                table = (self.rows.sparkSession.createDataFrame(data, kind), len(data))
            self.codes[term] = table
        return self.codes[term]

    def key(self, term: tuple[str, ...]) -> Column:
        parts = [F.col(f"k{self.keys.index(name)}") for name in term]
        return parts[0] if len(parts) == 1 else F.struct(*parts)


def prepare(
    panel: DataFrame, variables: list[str], keys: list[str], groups=(), products=()
) -> Panel:
    """Select, cast, and measure the columns of a job in one pass.

    ``products`` are (name, a, b): a variable that is the product of two
    columns, used by interaction curves.
    """
    ship(panel.sparkSession)
    made = {name: number(panel, a) * number(panel, b) for name, a, b in products}
    names = list(variables) + list(made)
    columns = [made.get(n, None) if n in made else number(panel, n) for n in names]
    source = durable(
        panel.select(
            *[c.alias(f"v{i}") for i, c in enumerate(columns)],
            *[present(panel, n).alias(f"k{i}") for i, n in enumerate(keys)],
            *[number(panel, n).alias(f"z{i}") for i, n in enumerate(groups)],
        )
    )
    stats = source.withColumn("_part", F.spark_partition_id()).agg(
        F.count("*").alias("n"),
        F.approx_count_distinct("_part").alias("parts"),
        *[F.count(f"k{i}").alias(f"k{i}") for i in range(len(keys))],
        *[
            f(f"v{i}").alias(f"{label}{i}")
            for i in range(len(names))
            for label, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))
        ],
    ).first()
    total = stats["n"]
    workers = panel.sparkSession.sparkContext.defaultParallelism
    if stats["parts"] < workers and total > SPREAD_ROWS:
        # A few big input splits would leave cores idle in every later step.
        spread = durable(source.repartition(workers))
        dropped(source)
        source = spread
    holed = [n for i, n in enumerate(names) if stats[f"n{i}"] < total]
    holed += [n for i, n in enumerate(keys) if stats[f"k{i}"] < total and n not in holed]
    bits = {n: i for i, n in enumerate(holed)}
    mean = [stats[f"m{i}"] or 0.0 for i in range(len(names))]
    scale = [stats[f"s{i}"] or 1.0 for i in range(len(names))]

    def missing(name):
        holes = [F.col(f"v{names.index(name)}").isNull()] if name in names else []
        holes += [F.col(f"k{keys.index(name)}").isNull()] if name in keys else []
        return holes[0] | holes[-1]

    words = []
    for word in range(max(1, -(-len(bits) // WORD_BITS))):
        flags = [
            F.when(missing(n), F.lit(1 << b % WORD_BITS)).otherwise(F.lit(0)).cast("long")
            for n, b in bits.items()
            if b // WORD_BITS == word
        ]
        total_bits = F.lit(0).cast("long")
        for flag in flags:
            total_bits = total_bits + flag
        words.append(total_bits.alias(f"p{word}"))
    rows = source.select(
        *[
            F.coalesce((F.col(f"v{i}") - mean[i]) / scale[i], F.lit(0.0)).alias(f"v{i}")
            for i in range(len(names))
        ],
        *[f"k{i}" for i in range(len(keys))],
        *[f"z{i}" for i in range(len(groups))],
        *words,
    )
    return Panel(rows, source, names, list(keys), list(groups), total, mean, scale, bits)
