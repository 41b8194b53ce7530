"""Reversible line deduplication: sharded cuckoo filters before exact counts.

The index counts for every line in how many documents it stands and which of
them is the last.  Tables in a folder all executors share hold it: the lines of
each document (postings), the documents, the counts, and one cuckoo filter of
fixed size per shard of the lines.  A batch of documents is inserted or deleted:
its lines are added up, the filter of their shard tells which of them are surely
new, and only the others are looked up in the exact counts.  Lines that appear
enter the filter, lines that no document holds any more leave it, so a deleted
document leaves no trace.  Filters answer no question alone: counts are exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve.llm.common import maybe_broadcast, ship, stored
from speccurve.llm.near_dup import mix
from speccurve.operators.scale import attach

# Shortest line that counts, in code points.
LEAST_CHARS = 20
# A filter has BUCKETS buckets of SLOTS fingerprints of 16 bits; there are twice
# as many shards as soon as they hold more than LOAD lines on average.
BUCKETS, SLOTS = 1 << 16, 4
LOAD = 3 * BUCKETS * SLOTS // 4
# Rounds of moves before the rest goes to the stash of a filter.
MOVES = 200
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NAME = re.compile(r"[A-Za-z0-9._-]+")
_FILTER = "shard int, live long, slots binary, stash binary"


class CuckooFilter:
    """A set of pairs of 64-bit numbers that may answer a false yes, never a
    false no, and from which members can be deleted."""

    def __init__(self, slots: bytes | None = None, stash: bytes | None = None):
        empty = np.zeros(BUCKETS * SLOTS, np.uint16)
        self.slots = np.frombuffer(slots, np.uint16).copy() if slots else empty
        self.slots = self.slots.reshape(BUCKETS, SLOTS)
        # Bucket and fingerprint of what found no place.
        self.stash = np.frombuffer(stash or b"", np.uint32).reshape(-1, 2).copy()

    @staticmethod
    def places(k1: np.ndarray, k2: np.ndarray):
        """Fingerprint and first bucket; the bits that name the shard are not used again."""
        mark = (k2.view(np.uint64) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
        bucket = mix(k1.view(np.uint64)) % np.uint64(BUCKETS)
        return mark, bucket.astype(np.int64)

    @staticmethod
    def other(bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint; its own inverse."""
        return bucket ^ (mix(mark.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one = self.places(k1, k2)
        two = self.other(one, mark)
        found = (self.slots[one] == mark[:, None]).any(axis=1)
        found |= (self.slots[two] == mark[:, None]).any(axis=1)
        for bucket, kept in self.stash.tolist():
            found |= (mark == kept) & ((one == bucket) | (two == bucket))
        return found

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """All pairs at once: those that find a free slot take it, in a full
        bucket one takes the place of another, which moves to its other bucket."""
        mark, bucket = self.places(k1, k2)
        for round_no in range(MOVES):
            if not len(mark):
                return
            order = np.argsort(bucket, kind="stable")
            bucket, mark = bucket[order], mark[order]
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            rank = np.arange(len(bucket)) - np.maximum.accumulate(
                np.where(new, np.arange(len(bucket)), 0)
            )
            free = self.slots[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free, axis=1, kind="stable")
            slot = slot[np.arange(len(rank)), np.minimum(rank, SLOTS - 1)]
            self.slots[bucket[fits], slot[fits]] = mark[fits]
            bucket, mark = bucket[~fits], mark[~fits]
            lead = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
            # Moves of a filter are the same in every attempt of a task.
            seat = mix(mark[lead].astype(np.uint64) + np.uint64(round_no << 16)) % np.uint64(SLOTS)
            seat = seat.astype(np.int64)
            moved = self.slots[bucket[lead], seat]
            self.slots[bucket[lead], seat] = mark[lead]
            mark, bucket = (
                np.r_[moved, mark[~lead]],
                np.r_[self.other(bucket[lead], moved), self.other(bucket[~lead], mark[~lead])],
            )
        rest = np.column_stack([bucket, mark]).astype(np.uint32)
        self.stash = np.vstack([self.stash, rest])

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """One fingerprint for each pair; the pairs have to be members."""
        mark, one = self.places(k1, k2)
        while len(mark):
            two = self.other(one, mark)
            both = np.hstack([self.slots[one], self.slots[two]]) == mark[:, None]
            there = both.any(axis=1)
            at = both.argmax(axis=1)
            flat = np.where(at < SLOTS, one, two) * SLOTS + at % SLOTS
            flat[~there] = -1 - np.flatnonzero(~there)
            _, first = np.unique(flat, return_index=True)
            now = np.zeros(len(mark), bool)
            now[first] = True
            self.slots.reshape(-1)[flat[now & there]] = 0
            for i in np.flatnonzero(~there).tolist():
                hit = (self.stash[:, 1] == mark[i]) & np.isin(self.stash[:, 0], (one[i], two[i]))
                if hit.any():
                    self.stash = np.delete(self.stash, hit.argmax(), axis=0)
            mark, one = mark[~now], one[~now]


def line_keys(df: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """k1, k2, doc, tie, pos of every line that is long enough: two hashes of it
    without white space at its ends and with A-Z in lower case, the document, a
    hash of its text, and the place of the line."""
    lines = df.select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("tie"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"),
    )
    plain = F.translate(F.btrim("line", F.lit(_SPACES)), _UPPER, _UPPER.lower())
    # A cheap test first: bytes are no fewer than characters.
    named = lines.where(F.octet_length("line") >= least_chars).withColumn("plain", plain)
    return named.where(F.length("plain") >= least_chars).select(
        F.xxhash64("plain").alias("k1"), F.xxhash64(F.lit(1), "plain").alias("k2"), "doc", "tie",
        "pos",
    )


def _changes(lines: DataFrame) -> DataFrame:
    """k1, k2, n, last: the documents of each line, once each, and the last of them."""
    return lines.groupBy("k1", "k2").agg(
        F.countDistinct("doc").alias("n"), F.max("doc").alias("last")
    )


class LineIndex:
    """Lines and the documents that hold them, in ``folder``.

    A batch has a name and counts once, however often it is sent; one that broke
    off is written anew.  A document that is in the index is not added again
    (to revise it, remove it and add it); rows of one key in a batch are one
    document.  Rows with a null key are not counted.  Documents to remove that
    are not there, empty batches and empty texts do no harm.  A very long text
    is split where it is read.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text",
        least_chars: int = LEAST_CHARS,
    ) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.key, self.text, self.least_chars = key, text, least_chars
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )

    def committed(self) -> list[str]:
        """The finished batches in their order."""
        path = self._path(f"{self.folder}/commits")
        if not self._fs.exists(path):
            return []
        done = [s.getPath().getName() for s in self._fs.listStatus(path)]
        return [name.split("-", 1)[1] for name in sorted(done)]

    def _read(self, kind: str) -> DataFrame | None:
        names = self.committed()
        paths = [f"{self.folder}/{kind}/{name}" for name in names]
        paths = [p for p in paths if self._fs.exists(self._path(f"{p}/_SUCCESS"))]
        if not paths:
            return None
        return self.spark.read.parquet(*(paths[-1:] if kind == "filters" else paths))

    def _written(self, df: DataFrame, kind: str, batch: str) -> DataFrame:
        path = f"{self.folder}/{kind}/{batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(
        self, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None
    ) -> bool:
        """Insert the documents ``added`` (key, text) or delete those whose keys
        are in ``removed`` (key); False if the batch is there already."""
        if not _NAME.fullmatch(batch):
            raise ValueError("a batch is named with letters, digits, '.', '_' and '-'")
        if (added is None) == (removed is None):
            raise ValueError("a batch adds documents or removes some")
        done = self.committed()
        if batch in done:
            return False
        number = len(done)
        if added is not None:
            delta = self._added(batch, number, added)
        else:
            delta = self._removed(batch, number, removed)
        delta = self._written(delta.withColumn("batch", F.lit(number)), "counts", batch)
        self._update_filters(batch, delta)
        self._fs.mkdirs(self._path(f"{self.folder}/commits/{number:08d}-{batch}"))
        return True

    def _documents(self) -> DataFrame | None:
        """doc, batch of the documents in the index; batch is that of their lines."""
        rows = self._read("documents")
        if rows is None:
            return None
        last = rows.groupBy("doc").agg(F.max(F.struct("batch", "present")).alias("x"))
        return last.where("x.present").select("doc", F.col("x.batch").alias("batch"))

    def counts(self) -> DataFrame | None:
        """k1, k2, n_docs, last_doc of every line in the index."""
        rows = self._read("counts")
        if rows is None:
            return None
        last = rows.groupBy("k1", "k2").agg(
            F.max_by(F.struct("n_docs", "last_doc"), "batch").alias("x")
        )
        return last.where("x.n_docs > 0").select("k1", "k2", "x.*")

    def _postings(self) -> DataFrame:
        """k1, k2, doc, tie, pos of every line of the documents in the index."""
        return self._read("postings").join(self._documents(), ["doc", "batch"]).drop("batch")

    def _added(self, batch: str, number: int, added: DataFrame) -> DataFrame:
        fresh = added.where(F.col(self.key).isNotNull()).select(
            F.col(self.key).alias("doc"), F.col(self.text).alias("text")
        )
        known = self._documents()
        if known is not None:
            n = known.count()
            fresh = fresh.join(maybe_broadcast(known.select("doc"), n, 16), "doc", "left_anti")
        mark = fresh.select("doc").distinct().withColumns(
            {"batch": F.lit(number), "present": F.lit(True)}
        )
        self._written(mark, "documents", batch)
        lines = line_keys(fresh, "doc", "text", self.least_chars)
        lines = self._written(lines.withColumn("batch", F.lit(number)), "postings", batch)
        changes = _changes(lines)
        before = self.counts()
        if before is None:
            return changes.select(
                "k1", "k2", F.col("n").alias("n_docs"), F.col("last").alias("last_doc"),
                F.lit(0).cast("long").alias("was"),
            )
        probed = stored(self._probed(changes), "probed")
        fresh_lines = probed.where("NOT seen").select(
            "k1", "k2", F.col("n").alias("n_docs"), F.col("last").alias("last_doc"),
            F.lit(0).cast("long").alias("was"),
        )
        met = probed.where("seen").join(before, ["k1", "k2"], "left")
        return fresh_lines.unionByName(met.select(
            "k1", "k2", (F.col("n") + F.coalesce("n_docs", F.lit(0))).alias("n_docs"),
            F.greatest("last", "last_doc").alias("last_doc"),
            F.coalesce("n_docs", F.lit(0)).cast("long").alias("was"),
        ))

    def _removed(self, batch: str, number: int, removed: DataFrame) -> DataFrame:
        known = self._documents()
        kind = removed.schema[self.key].dataType.simpleString()
        if known is None:
            known = self.spark.createDataFrame([], f"doc {kind}, batch int")
        asked = removed.select(F.col(self.key).alias("doc")).distinct()
        gone = stored(known.join(asked, "doc", "left_semi"), "gone")
        mark = gone.select("doc", F.lit(number).alias("batch"), F.lit(False).alias("present"))
        self._written(mark, "documents", batch)
        all_lines = self._read("postings")
        before = self.counts()
        if before is None:
            return self.spark.createDataFrame(
                [], f"k1 long, k2 long, n_docs long, last_doc {kind}, was long"
            )
        n_gone = gone.count()
        lines = all_lines.join(maybe_broadcast(gone, n_gone, 20), ["doc", "batch"])
        changes = _changes(lines)
        left = stored(
            changes.join(before, ["k1", "k2"]).select(
                "k1", "k2", (F.col("n_docs") - F.col("n")).alias("n_docs"), "last_doc",
                (F.col("last") == F.col("last_doc")).alias("lost"),
                F.col("n_docs").alias("was"),
            ),
            "left",
        )
        # Lines whose last document goes get another one, from the exact postings.
        lost = left.where("lost AND n_docs > 0").select("k1", "k2", F.col("n_docs").alias("n_rows"))
        stay = self._postings().join(
            maybe_broadcast(gone.select("doc"), n_gone, 16), "doc", "left_anti"
        )
        last = attach(stay, lost, ["k1", "k2"], lost.count()).groupBy("k1", "k2").agg(
            F.max("doc").alias("found")
        )
        return left.join(last, ["k1", "k2"], "left").select(
            "k1", "k2", "n_docs", F.coalesce("found", "last_doc").alias("last_doc"), "was"
        )

    # -- filters ------------------------------------------------------------------------------

    def _shard(self, n: int) -> Column:
        return F.pmod("k1", F.lit(n)).cast("int").alias("shard")

    def _probed(self, changes: DataFrame) -> DataFrame:
        """``changes`` with ``seen``: false if the line is surely not in the index."""
        ship(self.spark)
        filters = self._read("filters")
        columns = changes.columns
        keyed = changes.select("*", self._shard(filters.count()))

        def run(lines: pa.Table, kept: pa.Table) -> pa.Table:
            own = kept.to_pylist()[0]
            seen = CuckooFilter(own["slots"], own["stash"]).contains(
                lines.column("k1").to_numpy(), lines.column("k2").to_numpy()
            )
            return lines.select(columns).append_column("seen", pa.array(seen))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema)
        return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(
            run, f"{kinds}, seen boolean"
        )

    def _update_filters(self, batch: str, delta: DataFrame) -> None:
        """Lines that appear enter their filter, lines that vanish leave it.  When
        the filters are full, twice as many are made from the exact counts."""
        ship(self.spark)
        old = self._read("filters")
        moved = F.when((F.col("was") == 0) & (F.col("n_docs") > 0), 1).when(
            (F.col("was") > 0) & (F.col("n_docs") == 0), -1
        )
        changed = delta.select("k1", "k2", moved.alias("sign")).where("sign IS NOT NULL")
        grown = changed.agg(F.coalesce(F.sum("sign"), F.lit(0))).first()[0]
        shards, live = 0, grown
        if old is not None:
            shards, before = old.agg(F.count("*"), F.sum("live")).first()
            live += before
        wanted = max(shards, 1)
        while wanted * LOAD < live:
            wanted *= 2
        if wanted != shards:
            kept = self.spark.range(wanted).select(F.col("id").cast("int").alias("shard"))
            for name, kind in (("live", "long"), ("slots", "binary"), ("stash", "binary")):
                kept = kept.withColumn(name, F.lit(None).cast(kind))
            if shards:
                known = self._read("counts").unionByName(delta).groupBy("k1", "k2").agg(
                    F.max_by("n_docs", "batch").alias("n_docs")
                )
                changed = known.where("n_docs > 0").select("k1", "k2", F.lit(1).alias("sign"))
        else:
            kept = old
        keyed = changed.select("*", self._shard(wanted))

        def run(filters: pa.Table, lines: pa.Table) -> pa.Table:
            own = filters.to_pylist()[0]
            made = CuckooFilter(own["slots"], own["stash"])
            live = own["live"] or 0
            for sign, change in ((-1, made.delete), (1, made.insert)):
                some = lines.filter(pa.compute.equal(lines.column("sign"), sign))
                change(some.column("k1").to_numpy(), some.column("k2").to_numpy())
                live += sign * some.num_rows
            return pa.table({
                "shard": pa.array([own["shard"]], pa.int32()), "live": pa.array([live], pa.int64()),
                "slots": [made.slots.tobytes()], "stash": [made.stash.tobytes()],
            })

        filters = kept.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(run, _FILTER)
        self._written(filters, "filters", batch)

    # -- reading ------------------------------------------------------------------------------

    def without_repeats(
        self, docs: DataFrame, least_docs: int = 3, keep: tuple[str, ...] = ()
    ) -> DataFrame:
        """key, text, n_lines, n_dropped of every row of ``docs``.

        Lines that ``least_docs`` documents of the index hold go from all of them
        but the last (the largest key); they are told apart by their characters
        without white space at the ends, in lower case, if there are enough of
        them.  Other lines stay as they are, joined by a line feed; a null or
        empty text is one empty line.  Documents that are not in the index with
        this text, and rows with a null key, lose nothing.  ``keep`` names
        columns to hand on.  The texts are shuffled only if the list of cuts is
        too large to be broadcast.
        """
        named = docs.select(
            F.col(self.key).alias("doc"),
            *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
            F.coalesce(F.col(self.text), F.lit("")).alias("text"),
            F.xxhash64(self.text).alias("tie"),
        )
        counts = self.counts()
        if counts is None:
            cut = named.withColumn("removed", F.lit(None).cast("array<int>"))
        else:
            common = stored(
                counts.where(F.col("n_docs") >= least_docs)
                .select("k1", "k2", "last_doc", F.col("n_docs").alias("n_rows")),
                "common",
            )
            held = attach(self._postings(), common, ["k1", "k2"], common.count())
            cuts = stored(
                held.where("doc <> last_doc").groupBy("doc", "tie").agg(
                    F.collect_set("pos").alias("removed")
                ),
                "cuts",
            )
            size = cuts.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
            small = maybe_broadcast(cuts, 1, 48 * size[0] + 4 * size[1])
            cut = named.join(small, ["doc", "tie"], "left")
        lines = F.split("text", "\n")
        rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
        kept = F.array_join(F.transform(rest, lambda i: F.get("_lines", i)), "\n")
        n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
        return cut.withColumn("_lines", F.when(F.col("removed").isNotNull(), lines)).select(
            F.col("doc").alias(self.key),
            *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
            F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
            n_lines.cast("long").alias("n_lines"),
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_dropped"),
        )
