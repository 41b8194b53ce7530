"""Building blocks that keep one hot key, level or curve off a single task."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A table is broadcast only when its row count times its width stays below.
BROADCAST_BYTES = 64 << 20
# A level with more rows than this is joined by broadcast, never by shuffle.
HOT_LEVEL_ROWS = 2_000_000
# Largest group handed to one window task.
WINDOW_ROWS = 500_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


# Spark's setting: delete what a query shuffled when it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there, so
    that later steps survive lost executors and never run ``df`` again.  What was
    shuffled for it is deleted at once, not when the driver collects its garbage."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads now."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``stored``, or a checkpoint where Parquet does not hold the columns.  Rows
    may come back in another order."""
    names = {name.lower() for name in df.columns}
    if len(names) < len(df.columns) or "void" in df.schema.simpleString():
        checkpoint_folder(df.sparkSession)
        return df.checkpoint()
    return stored(df, "table")


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fits_broadcast(rows: int, columns: int) -> bool:
    return rows * (columns + 2) * 16 <= BROADCAST_BYTES


def attach(rows: DataFrame, levels: DataFrame, keys: list[str], n_levels: int) -> DataFrame:
    """Inner join of ``rows`` with one row per level.

    ``levels`` carries ``n_rows``, the number of rows of each level.  A small
    table (``n_levels`` counted beforehand) is broadcast.  Otherwise levels
    above ``HOT_LEVEL_ROWS`` rows - at most total / ``HOT_LEVEL_ROWS`` of them -
    are broadcast and only the rest is shuffled, so no task gets a hot level.
    """
    if fits_broadcast(n_levels, len(levels.columns)):
        return rows.join(F.broadcast(levels.drop("n_rows")), keys)
    hot = levels.where(F.col("n_rows") > HOT_LEVEL_ROWS).drop("n_rows")
    cold = levels.where(F.col("n_rows") <= HOT_LEVEL_ROWS).drop("n_rows")
    hot_rows = rows.join(F.broadcast(hot), keys)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(
        cold.hint("shuffle_merge"), keys
    )
    return hot_rows.unionByName(cold_rows)


def without(rows: DataFrame, gone: DataFrame, keys: list[str], n_gone: int) -> DataFrame:
    """Anti join.  Keys in ``gone`` occur once each; a hot key on the row side
    is split by the adaptive skew join when the table is too big to broadcast."""
    table = F.broadcast(gone) if fits_broadcast(n_gone, len(keys)) else gone
    return rows.join(table, keys, "left_anti")


def sum_arrays(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Element-wise sum of equally long arrays per (integer) key.

    The input holds one partial array per task and key, so it grows with the
    tasks.  Keys are sorted before they reach Python, which holds one Arrow batch
    and the sum of the key it is at, however many arrays there are.
    """

    def add(batches):
        last, total = None, None

        def record(ids, sums):
            columns = {k: pa.array(ids[:, i], pa.int64()) for i, k in enumerate(keys)}
            columns[column] = pa.array(list(sums), pa.list_(pa.float64()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([batch.column(k).to_numpy() for k in keys])
            values = batch.column(column).flatten().to_numpy().reshape(len(ids), -1)
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            heads, sums = ids[starts], np.add.reduceat(values, starts, axis=0)
            if last is not None:
                if (heads[0] == last).all():
                    sums[0] += total
                else:
                    yield record(last[None, :], total[None, :])
            if len(heads) > 1:
                yield record(heads[:-1], sums[:-1])
            last, total = heads[-1], sums[-1].copy()
        if last is not None:
            yield record(last[None, :], total[None, :])

    schema = ", ".join([f"{k} long" for k in keys] + [f"{column} array<double>"])
    spread = df.select(*[F.col(k).cast("long").alias(k) for k in keys], column)
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def _ordered(df: DataFrame, order) -> tuple[DataFrame, list[str]]:
    names = [f"_o{i}" for i in range(len(order))]
    return df.withColumns(dict(zip(names, order))), names


def positions(df: DataFrame, part: list[str], order: list, out: str = "pos") -> DataFrame:
    """0-based row number within ``part`` in ascending ``order``.

    Small groups use a window.  When some group exceeds ``WINDOW_ROWS`` the
    table is sorted by range partitioning, so one group spreads over many
    tasks; a row number is the offset of its partition plus its place in it.
    """
    largest = df.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
    df, names = _ordered(df, order)
    if largest <= WINDOW_ROWS:
        window = Window.partitionBy(*part).orderBy(*names)
        return df.withColumn(out, (F.row_number().over(window) - 1).cast("long")).drop(*names)
    # The last key spreads rows that agree in everything else.
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*part, *names, "_tie"]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Numbered before they are written: files are not read in their order.
    ranged = durable(ranged.withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_row", 33))
    # One row per group and range partition.
    pieces = ranged.groupBy(*part, "_part").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_size")
    )
    before = Window.partitionBy(*part).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    pieces = pieces.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return (
        ranged.join(pieces.drop("_size"), part + ["_part"])
        .withColumn(out, F.col("_row") - F.col("_first") + F.col("_offset"))
        .drop("_row", "_part", "_first", "_offset", "_tie", *names)
    )
