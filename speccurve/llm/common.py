"""Helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve import deploy
from speccurve.operators.scale import dropped, shared_folder, stored  # noqa: F401

# A side of a join is broadcast only if its counted rows times its width fit.
BROADCAST_BYTES = 32 << 20
# Text handled at once by a Python task; longer texts are handled one by one.
SLICE_BYTES = 4 << 20
# Bytes of rows sent to Python at once.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the bytes of a batch on its
    way to Python where the session has not: rows are whole texts here."""
    deploy.ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default
        spark.conf.set(name, BATCH_BYTES)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its counted size is small."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


_KEPT: dict[tuple[type, bytes], object] = {}


def per_worker(kind: type, model: bytes):
    """``kind(model)``, made once per Python process, which runs many tasks."""
    key = kind, hashlib.sha256(model).digest()
    if key not in _KEPT:
        _KEPT[key] = kind(model)
    return _KEPT[key]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str,
    start: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
) -> DataFrame:
    """Apply a function to slices of bounded size of some columns, by Arrow.

    The last of ``columns`` is the text that sets the size of a slice.
    ``start`` runs once per task and returns the function; its result has the
    arrays of ``schema``, in any number of rows.
    """
    ship(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        work = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(len(columns) - 1)
            for lo, hi in text_slices(text):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(work(part.columns), names=names)

    return df.select(*columns).mapInArrow(run, schema)


def text_slices(text: pa.Array):
    """Bounds of runs of rows with some 4 MB of text; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield lo, at
            lo, held = at, 0
        held += size + 64
    yield lo, len(sizes)
