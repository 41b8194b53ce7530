"""Reading panels: Parquet, CSV and Stata files."""

from __future__ import annotations

import io
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str | None = None):
    """A panel by the suffix of ``path``.  A CSV schema may be given to spare
    the pass that infers it; a ``.dta`` path may be a directory of parts."""
    suffix = PurePath(path.rstrip("/")).suffix.lower()
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix == ".csv":
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        if schema is None:
            return reader.option("inferSchema", True).csv(path)
        return reader.schema(schema).csv(path)
    if suffix == ".dta":
        return read_stata(spark, path, schema)
    raise ValueError(f"unsupported panel format {suffix or path!r}")


def read_stata(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stata files, one task per file; the schema comes from the first file."""
    files = spark.read.format("binaryFile").load(path)

    def frames(batches):
        for batch in batches:
            for content in batch["content"]:
                # Read in pieces, so a task holds one piece of a file.
                with pd.read_stata(
                    io.BytesIO(content), chunksize=200_000, convert_categoricals=False
                ) as pieces:
                    yield from pieces

    if schema is None:
        first = files.orderBy("path").limit(1)

        def head(batches):
            for batch in batches:
                for content in batch["content"]:
                    with pd.read_stata(
                        io.BytesIO(content), chunksize=1000, convert_categoricals=False
                    ) as pieces:
                        kinds = next(iter(pieces)).dtypes
                        yield pd.DataFrame(
                            {"name": list(kinds.index), "kind": [k.kind for k in kinds]}
                        )

        # Pandas type letters and their Spark types.
        kinds = {"i": "bigint", "u": "bigint", "f": "double", "b": "boolean", "M": "timestamp"}
        found = first.select("content").mapInPandas(head, "name string, kind string").collect()
        schema = ", ".join(f"`{r['name']}` {kinds.get(r['kind'], 'string')}" for r in found)
    return files.select("content").mapInPandas(frames, schema)
