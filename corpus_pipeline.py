"""A corpus from raw documents to token ids: stages of the operators of ``speccurve.llm``.

Every stage takes the table ``documents`` (doc_id, text, lang, source, n_chars)
and, but for the last, returns its columns.  Rows are left out by a list of
keys, with a hash of the text where a key may stand for several rows; the list
is broadcast if its counted size is small, so texts are not shuffled then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve.llm import decontaminate, language, near_dup, paragraphs, pieces
from speccurve.llm.common import maybe_broadcast, shared_folder, stored
from speccurve.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_HASH = "_hash_of_text"


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias(_HASH))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The hashed ``docs`` whose doc_id and hash are not in ``gone``; nulls are equal."""
    gone = stored(
        gone.select(F.col("doc_id").alias("_id"), F.col(_HASH).alias("_gone")).distinct(), "gone"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(_HASH) == F.col("_gone"))
    gone = maybe_broadcast(gone, gone.count(), 24)
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without an accepted language: no letters, or none likely enough."""
    hashed = _hashed(docs)
    judged = language.identify(
        hashed, declared=F.col("lang"), host=F.col("source"), keep=(_HASH,)
    )
    return _without(hashed, judged.where("NOT accepted"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest key.

    Of rows that repeat a key one stays.  Rows with a null key are in no group.
    """
    found = stored(near_dup.near_duplicates(docs), "components")
    gone = found.where("doc_id <> component").select("doc_id").distinct()
    gone = stored(gone, "gone")
    left = docs.select(*COLUMNS).join(
        maybe_broadcast(gone, gone.count(), 16), "doc_id", "left_anti"
    )
    twice = stored(
        found.where("doc_id = component").groupBy("doc_id").count().where("count > 1")
        .select("doc_id"),
        "twice",
    )
    n = twice.count()
    if not n:
        return left.select(*COLUMNS)
    marked = maybe_broadcast(twice, n, 16)
    some = left.join(marked, "doc_id", "left_semi").select(*COLUMNS)
    one = some.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return left.join(marked, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and passages within and across lines go from all documents but
    the first; a document of nothing else goes with them.  Null texts stay, equal
    rows lose the same words, an empty table gives no rows."""
    cut = paragraphs.cut_repeats(docs, keep=("lang", "source", "n_chars"))
    changed = (F.size("removed") > 0) | (F.size("spans") > 0)
    return (
        cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")))
        .select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents with a window of a benchmark item."""
    hashed = _hashed(docs)
    found = decontaminate.decontaminate(
        hashed, table(spark, sf_dir, "benchmark"), keep=(_HASH,)
    )
    return _without(hashed, found.where("n_hit > 0"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the text they decode to."""
    coded = pieces.encode_pieces(
        docs.select(*COLUMNS), vocabulary("piece_bpe_32k.model"), keep=("lang", "source", "n_chars")
    )
    return coded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
# Models and hashes have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
