"""Language of a document: text, declared language, address and host together."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import map_texts, maybe_broadcast, stored

# Labelled documents of each language that the text model is fitted on (about).
SAMPLE = 1500
BUCKETS = 1 << 15
# Character triples that count as independent evidence; a longer text counts no more.
EVIDENCE = 40
# Documents' worth of the parent's prior in the prior of a host or suffix.
PARENT = 20.0
# Posterior from which a language is accepted.
ACCEPTED = 0.6

_LETTER = re.compile(r"[^\W\d_]")


def _triples(text: str) -> np.ndarray:
    """Bucket of every three bytes in a row of the lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15)


def _text_model(labelled: DataFrame, label: str, text: str, sample: int):
    """Languages and the log of each bucket's share, from about ``sample``
    documents of each language, chosen by a hash of the text."""
    usable = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(text, label), F.lit(1_000_000)) / 1e6
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col(label) == name, min(1.0, sample / counts[name])).otherwise(share)
    chosen = usable.where(draw < share).select(F.col(label).alias("l"), F.col(text).alias("t"))

    def start():
        def work(columns):
            total: dict[str, np.ndarray] = {}
            for name, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
                part = np.bincount(_triples(text), minlength=BUCKETS)
                total[name] = total[name] + part if name in total else part
            names, at, n = [], [], []
            for name, part in total.items():
                used = np.flatnonzero(part)
                names += [name] * len(used)
                at.append(used)
                n.append(part[used])
            none = [np.empty(0, np.int64)]
            return [
                pa.array(names, pa.string()), pa.array(np.concatenate(at or none).astype(np.int64)),
                pa.array(np.concatenate(n or none).astype(np.int64)),
            ]

        return work

    rows = (
        map_texts(chosen, ["l", "t"], "l string, at long, n long", start)
        .groupBy("l", "at").agg(F.sum("n").alias("n")).toPandas()
    )
    table = np.full((max(len(languages), 1), BUCKETS), 0.5)
    where = {name: k for k, name in enumerate(languages)}
    table[rows["l"].map(where).to_numpy(np.int64), rows["at"].to_numpy(np.int64)] += rows["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)


def _evidence(df: DataFrame, text: str, others: list[str], model: np.ndarray) -> DataFrame:
    """The columns ``others``, n_triples and the log-likelihoods ll of each text."""
    blob = df.sparkSession.sparkContext.broadcast(model)
    n_languages = model.shape[1]

    def start():
        table = blob.value

        def work(columns):
            texts = columns[-1].to_pylist()
            sizes = np.zeros(len(texts), np.int64)
            found = np.zeros((len(texts), n_languages))
            for i, text in enumerate(texts):
                if text and _LETTER.search(text):
                    at = _triples(text)
                    sizes[i] = len(at)
                    for lo in range(0, len(at), 1 << 18):
                        found[i] += table[at[lo : lo + (1 << 18)]].sum(axis=0, dtype=float)
            offsets = np.arange(0, n_languages * len(texts) + 1, n_languages, dtype=np.int32)
            ll = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            return [*columns[:-1], pa.array(sizes), ll]

        return work

    kinds = {c: df.schema[c].dataType.simpleString() for c in others}
    schema = ", ".join([f"{c} {kinds[c]}" for c in others] + ["n_triples long", "ll array<double>"])
    return map_texts(df, [*others, text], schema, start)


# Each step below is a projection of its own: an expression that names another one
# several times would hold as many copies of it, and copies of copies.


def _softmax(rows: DataFrame, scores: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names``: the shares of exp of the columns ``scores``."""
    each = range(len(scores))
    top = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    rows = rows.withColumn("_top", top)
    rows = rows.withColumns({f"_e{k}": F.exp(F.col(scores[k]) - F.col("_top")) for k in each})
    rows = rows.withColumn("_total", reduce(lambda a, b: a + b, [F.col(f"_e{k}") for k in each]))
    rows = rows.withColumns({names[k]: F.col(f"_e{k}") / F.col("_total") for k in each})
    return rows.drop("_top", "_total", *[f"_e{k}" for k in each])


def _smoothed(
    rows: DataFrame, counts: list[str], parents: list[Column], own: list[Column], names: list[str]
) -> DataFrame:
    """``rows`` with the columns ``names``: shares of the languages in a group without
    the document itself, drawn towards those of the parent."""
    each = range(len(counts))
    rows = rows.withColumns(
        {f"_r{k}": F.greatest(F.coalesce(F.col(counts[k]), F.lit(0.0)) - own[k], F.lit(0.0))
         for k in each}
    )
    rows = rows.withColumn("_total", reduce(lambda a, b: a + b, [F.col(f"_r{k}") for k in each]))
    rows = rows.withColumns(
        {names[k]: (F.col(f"_r{k}") + PARENT * parents[k]) / (F.col("_total") + PARENT)
         for k in each}
    )
    return rows.drop("_total", *[f"_r{k}" for k in each])


def identify(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    labelled: DataFrame | None = None,
    label: str = "lang",
    label_text: str = "text",
    sample: int = SAMPLE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """key, language, posterior, accepted for every document.

    The posterior of a language is in proportion to its prior on the host,
    times how likely the text, the ``declared`` language and the address
    ``suffix`` are under it.

    * Text: byte triples under a naive Bayes model, fitted on about ``sample``
      documents per language of ``labelled`` (by default ``df`` itself), its
      log scaled down to EVIDENCE triples.
    * Declared language and suffix: how often each goes with each language, the
      texts' own posteriors added up over all documents, one added to each.
    * Host: those posteriors added up by host without the document itself,
      drawn towards its suffix with PARENT documents' weight, and the suffix
      towards all documents.  Sums are made before the shuffle, and the tables
      are broadcast where their counted size is small.

    A missing (null) column or value is no evidence, and a document without a
    host takes its suffix's prior.  A text without a letter is none: its
    language follows from the rest, but it is never accepted; others are from a
    posterior of ACCEPTED.  Without labelled texts the language is null and
    nothing is accepted.  Repeated rows are judged alike, ``keep`` names columns
    to hand on, other columns are not in the way, an empty table gives no rows.
    """
    labelled = df if labelled is None else labelled
    languages, model = _text_model(labelled, label, label_text, sample)
    if not languages:
        return df.select(
            F.col(key), *keep, F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"),
        )
    none = F.lit(None).cast("string")
    named = df.select(
        F.col(key).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)],
        F.lower(none if declared is None else declared).alias("declared"),
        F.lower(none if suffix is None else suffix).alias("suffix"),
        F.lower(none if host is None else host).alias("host"),
        F.col(text).alias("t"),
    )
    kept = [f"k{i}" for i in range(len(keep) + 1)]
    seen = _evidence(named, "t", [*kept, "declared", "suffix", "host"], model)
    weight = F.lit(float(EVIDENCE)) / F.greatest(F.col("n_triples"), F.lit(EVIDENCE))
    each = range(len(languages))

    def names(prefix: str) -> list[str]:
        return [f"{prefix}{k}" for k in each]

    seen = seen.withColumns({f"s{k}": F.get("ll", F.lit(k)) * weight for k in each})
    seen = _softmax(seen, names("s"), names("t")).withColumns(
        {t: F.when(F.col("n_triples") > 0, F.col(t)).otherwise(0.0) for t in names("t")}
    )
    seen = stored(seen.drop("ll"), "evidence")

    own = [F.col(f"t{k}") for k in each]

    def sums(by: list[str], prefix: str) -> DataFrame:
        rows = seen.where(" AND ".join(f"{c} IS NOT NULL" for c in by)) if by else seen
        return rows.groupBy(*by).agg(*[F.sum(f"t{k}").alias(f"{prefix}{k}") for k in each])

    def attach(rows: DataFrame, by: str, prefix: str) -> DataFrame:
        table = stored(sums([by], prefix), by)
        n = table.count()
        table = table.withColumnRenamed(by, "_by")
        marked = maybe_broadcast(table, n, 64 + 8 * len(languages))
        return rows.join(marked, F.col(by) == F.col("_by"), "left").drop("_by")

    everything = sums([], "g").first()
    total = [float(everything[f"g{k}"] or 0) + 1 for k in each]
    flat = [F.lit(x / sum(total)) for x in total]
    rows = seen
    for by, prefix in (("declared", "d"), ("suffix", "x"), ("host", "h")):
        rows = attach(rows, by, prefix)
    rows = _smoothed(rows, names("x"), flat, own, names("by_suffix"))
    by_suffix = [F.col(c) for c in names("by_suffix")]
    rows = _smoothed(rows, names("h"), by_suffix, own, names("by_host"))

    def given(prefix: str, k: int) -> Column:
        """How likely this value is under language k, up to a common factor."""
        said = F.greatest(F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0)) - own[k], F.lit(0.0))
        return F.when(F.col(f"{prefix}{k}").isNull(), 0.0).otherwise(F.log((said + 1) / total[k]))

    rows = rows.withColumns(
        {
            f"j{k}": F.log(F.col(f"by_host{k}")) + given("d", k) + given("x", k)
            + F.when(F.col("n_triples") > 0, F.col(f"s{k}")).otherwise(0.0)
            for k in each
        }
    )
    judged = _softmax(rows, names("j"), names("p")).select(
        *kept, "n_triples", F.array(*names("p")).alias("p")
    ).withColumn("posterior", F.array_max("p"))
    known = F.array(*map(F.lit, languages))
    judged = judged.select(
        F.col("k0").alias(key), *[F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)],
        F.get(known, (F.array_position("p", F.col("posterior")) - 1).cast("int")).alias("language"),
        "posterior",
        ((F.col("n_triples") > 0) & (F.col("posterior") >= ACCEPTED)).alias("accepted"),
    )
    # A filter by ``accepted`` on top would be pushed below every step, each put into the next.
    return stored(judged, "judged")
