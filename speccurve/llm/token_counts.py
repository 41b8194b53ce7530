"""Token totals by source, language and tokenizer version, kept by signed deltas."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve.llm.common import map_texts, per_worker

GROUP = ("source", "lang", "tokenizer")
_NAME = re.compile(r"[A-Za-z0-9._-]+")


class _Ranks:
    """Counts tokens by a file of byte-pair ranks; ``model`` is a pattern, a zero
    byte and the file."""

    def __init__(self, model: bytes) -> None:
        import tiktoken

        pattern, ranks = model.split(b"\x00", 1)
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern.decode(), special_tokens={},
            mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())},
        )

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def count_tokens(
    df: DataFrame,
    version: str,
    ranks: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """key, source, lang, tokenizer (``version``), n_tokens of every whole text.

    ``ranks`` is a file of byte-pair ranks.  A null text has no tokens; null
    sources and languages stay; every row counts, repeated or not.
    """
    with open(ranks, "rb") as file:
        blob = df.sparkSession.sparkContext.broadcast(pattern.encode() + b"\x00" + file.read())

    def start():
        encoder = per_worker(_Ranks, blob.value)

        def work(columns):
            sizes = [encoder.count(x) if x else 0 for x in columns[-1].to_pylist()]
            return [*columns[:-1], pa.array(np.array(sizes, np.int64))]

        return work

    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(
        F.col(key).alias("k"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col(text).alias("t"),
    )
    counted = map_texts(
        narrow, ["k", "source", "lang", "t"], f"k {kind}, source string, lang string, n_tokens long",
        start,
    )
    return counted.select(
        F.col("k").alias(key), "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens"
    )


def signed(counts: DataFrame, sign: int | Column) -> DataFrame:
    """Counted documents as changes: 1 to insert them, -1 to delete them.  A
    revised document is a deletion of its old count and an insertion of the new."""
    return counts.withColumn("sign", F.lit(sign) if isinstance(sign, int) else sign)


class TokenTotals:
    """Totals in a folder all executors share: ``base`` and one folder per batch.

    A batch is added up to a few rows before it is written, and Spark's marker
    of a finished write is its commit.  A batch with the name of a finished one
    is not written again, and one that broke off is written anew, so it counts
    once however often it is sent.  Totals are sums, so batches may come in any
    order.  ``compact`` folds finished batches into a new base that names them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )

    def _children(self, name: str) -> list[str]:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return []
        return sorted(
            s.getPath().getName() for s in self._fs.listStatus(path)
            if self._fs.exists(self._path(f"{s.getPath()}/_SUCCESS"))
        )

    def _base(self) -> DataFrame | None:
        bases = self._children("base")
        return self.spark.read.parquet(f"{self.folder}/base/{bases[-1]}") if bases else None

    def _folded(self) -> set[str]:
        base = self._base()
        if base is None:
            return set()
        names = base.select(F.explode("batches").alias("name")).distinct().collect()
        return {r["name"] for r in names}

    def committed(self) -> set[str]:
        """The names of the finished batches."""
        return set(self._children("batches")) | self._folded()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (GROUP, n_tokens, sign); False if the batch is there already."""
        if not _NAME.fullmatch(batch):
            raise ValueError("a batch is named with letters, digits, '.', '_' and '-'")
        if batch in self.committed():
            return False
        delta = changes.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"),
            F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"),
        )
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        return True

    def _rows(self) -> DataFrame | None:
        base, folded = self._base(), self._folded()
        paths = [
            f"{self.folder}/batches/{b}" for b in self._children("batches") if b not in folded
        ]
        parts = [] if base is None else [base.drop("batches")]
        if paths:
            parts.append(self.spark.read.parquet(*paths))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def totals(self) -> DataFrame:
        """GROUP, n_docs, n_tokens; groups with nothing left are not there."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame(
                [], "source string, lang string, tokenizer string, n_docs long, n_tokens long"
            )
        return (
            rows.groupBy(*GROUP)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 OR n_tokens <> 0")
        )

    def compact(self) -> None:
        """One base instead of many batches; a break before its end changes nothing."""
        names = sorted(self.committed())
        number = len(self._children("base"))
        (
            self.totals().withColumn("batches", F.array(*map(F.lit, names)).cast("array<string>"))
            .coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/base/{number:08d}")
        )
