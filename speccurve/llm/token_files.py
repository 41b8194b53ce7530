"""Token ids of all documents in Arrow files of equally long sequences."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speccurve.llm.common import ship
from speccurve.llm.common import per_worker, shared_folder, stored, text_slices

SEQUENCE = 2048
BATCH_SEQUENCES = 256
# Words whose ids a task remembers, twice at most.
REMEMBERED_WORDS = 1_000_000
# Texts longer than this are cut at white space before they are split into words.
LONG_TEXT = 4 << 20


class WordEncoder:
    """Ids of whole texts by a tokenizer that never looks across white space.

    Texts are split at ASCII white space only, each new word is encoded by the
    library once, and a text's ids are those of its words in turn.  A word of
    Latin letters with one closing comma or full stop is two words to the
    tokenizer, and letters are lower-cased by it, so such words share entries.
    """

    def __init__(self, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.fresh: dict[str, bytes] = {"": b""}
        self.stale: dict[str, bytes] = {}
        self.closing = {c: self._library([c])[0] for c in ",."}

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _library(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.fresh) > REMEMBERED_WORDS:
            self.fresh, self.stale = {"": b""}, self.fresh
        out = []
        split = [_words(x) for x in texts]
        missing = set().union(*split).difference(self.fresh)
        stale, fresh = self.stale, self.fresh
        new, parts = set(), {}
        for word in missing:
            if (ids := stale.get(word)) is not None:
                fresh[word] = ids
                continue
            stem, end = word, ""
            if max(word) < "ɐ" and "<|" not in word:  # special tokens keep their case
                stem = word.lower()
                if stem[-1] in ",." and stem[:-1].isalpha():
                    stem, end = stem[:-1], stem[-1]
            if stem not in fresh:
                new.add(stem)
            parts[word] = stem, end
        fetched = sorted(new)
        fresh.update(zip(fetched, self._library(fetched)))
        for word, (stem, end) in parts.items():
            fresh[word] = fresh[stem] + self.closing[end] if end else fresh[stem]
        for words in split:
            out.append(b"".join(map(fresh.__getitem__, words)))
        return out

    def whole(self, text: str) -> bytes:
        """Ids of one text of any length."""
        return b"".join(self.encode([part])[0] for part in _parts(text))


def _words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + LONG_TEXT)
        yield text[at : end if end >= 0 else len(text)]
        at = end if end >= 0 else len(text)


def _open(folder: str):
    """File system and path of a folder given as a Hadoop address."""
    from pyarrow.fs import FileSystem

    uri = re.sub(r"^(\w+):/(?=[^/])", r"\1:///", folder)
    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class SequenceWriter:
    """Packs documents into sequences of equal length, batch by batch.

    ``<name>.arrow``: ids fixed_size_list<uint16 or uint32>, mask
    fixed_size_list<bool> (false on the padding of the last sequence).
    ``<name>.docs.arrow``: doc_id, first (place in the file), n_tokens.
    """

    def __init__(self, fs, stem: str, id_type: pa.DataType, key: pa.DataType) -> None:
        self.id_type, self.key = id_type, key
        self.dtype = np.dtype(id_type.to_pandas_dtype())
        self.schema = pa.schema(
            [("ids", pa.list_(id_type, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))]
        )
        self.docs_schema = pa.schema(
            [("doc_id", key), ("first", pa.int64()), ("n_tokens", pa.int64())]
        )
        self.sinks = [fs.open_output_stream(f"{stem}{end}") for end in (".arrow", ".docs.arrow")]
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, keys: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        first = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(
            pa.RecordBatch.from_arrays(
                [keys.cast(self.key), pa.array(first), pa.array(sizes)], schema=self.docs_schema
            )
        )
        self.held += ids
        self.n_held += int(sizes.sum())
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(ids)
        if self.n_held >= SEQUENCE * BATCH_SEQUENCES:
            self._flush(SEQUENCE * BATCH_SEQUENCES)

    def _flush(self, unit: int) -> None:
        """Write whole batches of ``unit`` ids; keep the rest."""
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        whole = len(flat) // unit * unit
        for at in range(0, whole, unit):
            self._batch(flat[at : at + unit], unit)
        self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, n: int) -> None:
        full = np.zeros(-(-n // SEQUENCE) * SEQUENCE, self.dtype)
        full[:n] = ids
        mask = np.arange(len(full)) < n
        self.tokens.write_batch(
            pa.RecordBatch.from_arrays(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(full, self.id_type), SEQUENCE),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE),
                ],
                schema=self.schema,
            )
        )

    def close(self) -> None:
        self._flush(SEQUENCE * BATCH_SEQUENCES)
        if self.n_held:
            self._batch(self.held[0], self.n_held)
        for out in (self.tokens, self.docs, *self.sinks):
            out.close()


class SequenceReader:
    """Random access to a file of ``SequenceWriter``; ids are views of the file
    where a document lies within one batch."""

    def __init__(self, fs, stem: str) -> None:
        self.sinks = [_source(fs, f"{stem}{end}") for end in (".arrow", ".docs.arrow")]
        self.tokens = pa.ipc.open_file(self.sinks[0])
        self.docs = pa.ipc.open_file(self.sinks[1])
        self.at, self.flat = -1, np.empty(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at = k
            self.flat = self.tokens.get_batch(k).column(0).flatten().to_numpy()
        return self.flat

    def ids(self, first: int, n: int) -> np.ndarray:
        unit = SEQUENCE * BATCH_SEQUENCES
        parts = []
        for k in range(first // unit, -(-(first + n) // unit)):
            lo, hi = max(first, k * unit), min(first + n, (k + 1) * unit)
            parts.append(self._batch(k)[lo - k * unit : hi - k * unit])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [self.flat[:0]])

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.docs.num_record_batches):
            yield self.docs.get_batch(k)


def _source(fs, path: str):
    from pyarrow.fs import LocalFileSystem

    return pa.memory_map(path) if isinstance(fs, LocalFileSystem) else fs.open_input_file(path)


def write_token_files(
    df: DataFrame,
    model: str,
    end_id: int | None,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every document and write the files; returns the list of files.

    Rows are range-partitioned and sorted by key (nulls first; ties by a hash of
    the text), and each task writes one pair of files, so files follow each
    other in the order of keys.  A null text has no ids but ``end_id``.
    Repeated rows stay.  Columns of the result: part, file, n_docs, n_tokens,
    start (ids in all files before).  An empty table gives no rows.

    An attempt writes under a name of its own, and only files of attempts that
    Spark has accepted are in the stored list, so repeated tasks do no harm.
    """
    spark = df.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "tokens")
    blob = spark.sparkContext.broadcast(open(model, "rb").read())
    key_type = pa.string() if df.schema[key].dataType.typeName() == "string" else pa.int64()

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = per_worker(WordEncoder, blob.value)
                fs, base = _open(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
                small = encoder.size <= 1 << 16 and (end_id or 0) < 1 << 16
                writer = SequenceWriter(
                    fs, f"{base}/{name}", pa.uint16() if small else pa.uint32(), key_type
                )
                tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
            for lo, hi in text_slices(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
                    ids = [encoder.whole(texts[0])]
                else:
                    ids = encoder.encode(texts)
                writer.add(
                    batch.column(0).slice(lo, hi - lo),
                    [np.frombuffer(x + tail, "<u4").astype(writer.dtype) for x in ids],
                )
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [name], "n_docs": [writer.n_docs],
                 "n_tokens": [writer.n_tokens]}
            )

    by = [F.col("_key").asc_nulls_first(), F.col("_tie")]
    ranged = (
        df.select(
            F.col(key).alias("_key"), F.col(text).alias("_text"),
            F.xxhash64(F.col(text)).alias("_tie"),
        )
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("_key", "_text")
    )
    files = stored(
        ranged.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"), "files"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "part", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "n_docs", "n_tokens",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"),
    )


def read_documents(files: DataFrame, key_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before; the checksum is that of
    the ids as little-endian unsigned 32-bit integers.
    """
    ship(files.sparkSession)

    def read(batches):
        for batch in batches:
            for file, start in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                fs, stem = _open(file)
                reader = SequenceReader(fs, stem)
                for docs in reader.documents():
                    first = docs.column(1).to_numpy()
                    sizes = docs.column(2).to_numpy()
                    sums = [
                        zlib.crc32(reader.ids(f, n).astype("<u4"))
                        for f, n in zip(first.tolist(), sizes.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), pa.array(first + start), docs.column(2),
                         pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(n, "file").mapInArrow(
        read, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    )
