"""The model grid: every admissible choice of controls, as integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve.job import SpecCurveJob


def choice_columns(
    job: SpecCurveJob, bits: str, value: Callable[[str], Column] = F.lit
) -> dict[str, Column]:
    """Decode a model number: lists of chosen mandatory and optional controls.

    The number is read in mixed radix, mandatory slots first; a mandatory slot
    of g names has radix g, an optional one radix g + 1 with digit 0 for "none".
    """
    stride = 1
    must, test, zero_digits = [], [], []
    for slot in job.must_slots:
        digit = F.expr(f"({bits} div {stride}) % {len(slot)}")
        must.append(F.element_at(F.array(*map(value, slot)), (digit + 1).cast("int")))
        stride *= len(slot)
    for slot in job.test_slots:
        digit = F.expr(f"({bits} div {stride}) % {len(slot) + 1}")
        names = F.array(*map(value, slot))
        test.append(F.when(digit > 0, F.element_at(names, F.greatest(digit, F.lit(1)).cast("int"))))
        zero_digits.append((digit == 0).cast("int"))
        stride *= len(slot) + 1
    kind = "array<string>" if value is F.lit else "array<int>"
    return {
        "must": F.array(*must).cast(kind),
        "test": F.array_compact(F.array(*test)).cast(kind),
        "is_full": sum(zero_digits, F.lit(0)) == 0,
    }


def _partitions(spark: SparkSession, rows: int) -> int:
    return max(1, min(spark.sparkContext.defaultParallelism * 4, rows // 2048 + 1))


def model_grid(spark: SparkSession, job: SpecCurveJob) -> DataFrame:
    """bits, must, test, is_full: one row per model of a curve."""
    total = job.model_count
    ids = spark.range(0, total, 1, _partitions(spark, total)).withColumnRenamed("id", "bits")
    return ids.withColumns(choice_columns(job, "bits"))


def pair_grid(
    spark: SparkSession, job: SpecCurveJob, value: Callable[[str], Column], pairs: int
) -> DataFrame:
    """The grid repeated for every (y, x) pair: ``mid`` is pair * models + bits."""
    total = job.model_count
    ids = spark.range(0, total * pairs, 1, _partitions(spark, total * pairs))
    ids = ids.select(
        F.col("id").alias("mid"),
        F.expr(f"id % {total}").alias("bits"),
        F.expr(f"id div {total}").alias("pair"),
    )
    return ids.withColumns(choice_columns(job, "bits", value))


def control_layout(spark: SparkSession, job: SpecCurveJob) -> DataFrame:
    """One row per control: role, slot, place in the matrix, group label.

    ``row`` is the place among the controls that vary between models (null for
    a plain mandatory control); ``place`` counts mandatory before optional.
    """
    rows, place, row = [], 0, 0
    for kind, slots in (("must", job.must_slots), ("test", job.test_slots)):
        for number, slot in enumerate(slots):
            varies = kind == "test" or len(slot) > 1
            label = None
            if len(slot) > 1:
                label = f"{'1' if kind == 'must' else '0/1'} of {len(slot)}"
            first = row
            for name in slot:
                rows.append(
                    (
                        name,
                        kind,
                        number,
                        place,
                        row if varies else None,
                        label,
                        first if label else None,
                        first + len(slot) - 1 if label else None,
                    )
                )
                place += 1
                row += varies
    return spark.createDataFrame(
        rows,
        "control string, kind string, slot int, place int, row int, "
        "group_label string, group_start int, group_end int",
    )
