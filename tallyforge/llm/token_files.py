"""Token ids in Arrow stream files of equal-length sequences with masks.

A data set is a folder. Shard k, the k-th range of ascending doc_id, has two Arrow IPC files: ``seq-k.arrow`` with
record batches of ``ROWS`` rows of two fixed-size lists, ``ids`` (uint16, or uint32 for a vocabulary of over 65,536)
and ``mask`` (bool, true: a token, false: padding), both ``length`` long, and ``doc-k.arrow`` with one row per document: doc_id, start (its first id within the shard) and
n_tokens. All batches but a file's last are full, so id i of a shard is in batch i // (ROWS * length) at a known place,
and a mapped file gives any sequence, mask or document without copying.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

#: Sequences in a record batch.
ROWS = 64
#: Encoded pieces that a worker keeps, and those of them after a task; beyond, it drops what it met in one group of documents only.
PIECES, IDLE = 600_000, 400_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    The byte-level tokenizer never joins what is before a single space with what follows, so a text without other
    white space next to a space is the sequence of its pieces, and each different piece is encoded once. Other texts
    are encoded in one go. Ids are bytes: 16 bits each where the vocabulary allows, else 32.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)  # a character for each byte
        self.marks = {x: self._whole([x])[0].tobytes() for x in ".,"}
        self.known: list[dict] = [{}, {}]  # pieces at the start of a text, and those after a space
        self.reused: list[set] = [set(), set()]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, wanted: set[str], tail: int) -> dict[str, bytes | None]:
        """Ids of pieces; those after a space if tail. None: not a piece that can be encoded by itself."""
        known = self.known[tail]
        new = [x for x in wanted if x not in known]
        self.reused[tail].update(wanted.difference(new))
        if len(known) > PIECES:
            known = self.known[tail] = {x: known[x] for x in self.reused[tail]}
        if unsafe := [x for x in new if not x or x[0].isspace() or x[-1].isspace()]:
            known.update(dict.fromkeys(unsafe))
            new = [x for x in new if x not in known]
        # a mark after a letter is a token of its own, so a word with one needs no encoding besides the word's
        marked = [x for x in new if x[-1] in ".," and x[-2:-1].isalpha()] if tail else []
        if marked:
            new = list({x[:-1] for x in marked}.union(new).difference(marked, known))
        many = 256 if tail else 1
        for begin in range(0, len(new), many):
            part = new[begin : begin + many]
            ids = self._whole([" " * tail + " ".join(part)])[0]
            ends = np.cumsum(self.lengths[ids])
            wanted_ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + tail)
            cuts = np.searchsorted(ends, wanted_ends, "left") + 1
            if len(ids) and np.array_equal(ends[cuts - 1], wanted_ends):
                at, size = cuts * self.kind.itemsize, ids.tobytes()
                known.update(zip(part, map(size.__getitem__, map(slice, [0, *at[:-1].tolist()], at.tolist())), strict=True))
            else:
                known.update((x, i.tobytes()) for x, i in zip(part, self._whole([" " * tail + x for x in part]), strict=True))
        known.update((x, known[x[:-1]] + self.marks[x[-1]]) for x in marked)
        return known

    def forget(self) -> None:
        """After a task: if there are many pieces, keep those that it met in several groups of documents."""
        for tail in (0, 1):
            if len(self.known[tail]) > IDLE:
                self.known[tail] = {x: self.known[tail][x] for x in self.reused[tail]}
            self.reused[tail] = set()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [x.split(" ") for x in texts]
        head = self._learn({x[0] for x in split}, 0)
        wanted: set[str] = set()
        for x in split:
            wanted.update(x[1:])
        get, out = self._learn(wanted, 1).__getitem__, []
        for text, x in zip(texts, split, strict=True):
            try:
                out.append(head[x[0]] + b"".join(map(get, x[1:])))
            except TypeError:  # one of the pieces is None
                out.append(self._whole([text])[0].tobytes())
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Sequences:
    """Fills a shard's sequence file."""

    def __init__(self, sink: pa.NativeFile, length: int, kind: np.dtype):
        self.length, self.size, self.kind, self.parts, self.waiting, self.total = length, ROWS * length, kind, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        n = len(ids) // self.kind.itemsize
        self.waiting += n
        self.total += n
        if self.waiting >= self.size:
            self._flush(self.waiting // self.size * self.size)

    def _flush(self, n: int) -> None:
        data = b"".join(self.parts)
        for begin in range(0, n, self.size):
            self._batch(np.frombuffer(data, self.kind, min(self.size, n - begin), begin * self.kind.itemsize))
        self.parts, self.waiting = [data[n * self.kind.itemsize :]], self.waiting - n

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
        padded[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        self.file.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Encode and write documents (doc_id, text) in ascending doc_id order; give the manifest (shard, base, n_tokens).

    base: tokens of all shards before. The manifest has a row per file, which the driver gathers.

    Null text is empty, a null doc_id comes first, equal doc_ids are ordered by text, other columns are ignored.
    """
    work.make_dir(folder)
    order = ["doc_id", "text"]
    sorted_docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions(*order)
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        k, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = work.filesystem(folder)
        names = [(f"{base}/{x}-{k:06d}.{attempt}.tmp", f"{base}/{x}-{k:06d}.arrow") for x in ("seq", "doc")]
        encode, n_docs = encoder(tokenizer), 0
        kind = encode.kind
        end = np.asarray([end_id], kind).tobytes()
        gc.disable()  # nothing here is in cycles, and the pieces are many
        with fs.open_output_stream(names[0][0]) as one, fs.open_output_stream(names[1][0]) as two:
            sequences, index = _Sequences(one, length, kind), pa.ipc.new_file(two, index_schema)
            for batch in batches:
                for begin in range(0, len(batch), 512):
                    part = batch.slice(begin, 512)
                    start, counts = sequences.total, []
                    for ids in encode(part.column("text").to_pylist()):
                        sequences.add(ids + end)
                        counts.append(len(ids) // kind.itemsize + 1)
                    counts = np.asarray(counts, np.int64)
                    index.write_batch(pa.record_batch([part.column("doc_id"), pa.array(start + np.cumsum(counts) - counts), pa.array(counts)], schema=index_schema))
                    n_docs += len(part)
            sequences.close()
            index.close()
        encode.forget()
        gc.enable()
        for temporary, final in names:
            work.put_in_place(fs, temporary, final)
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([sequences.total], pa.int64())], ["shard", "n_docs", "n_tokens"])

    rows = sorted(sorted_docs.mapInArrow(shard, "shard int, n_docs long, n_tokens long").collect())
    bases = np.cumsum([0, *(r["n_tokens"] for r in rows)]).tolist()
    shards = [(r["shard"], base, r["n_tokens"]) for r, base in zip(rows, bases, strict=False) if r["n_docs"]]
    return docs.sparkSession.createDataFrame(shards, "shard int, base long, n_tokens long")


class Shard:
    """Random access to one shard's sequences and documents."""

    def __init__(self, folder: str, k: int):
        self.sequences = pa.ipc.open_file(work.open_for_reading(f"{folder}/seq-{k:06d}.arrow"))
        self.documents = pa.ipc.open_file(work.open_for_reading(f"{folder}/doc-{k:06d}.arrow"))
        self.length = self.sequences.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray | None] = -1, None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        batch, row = self.sequences.get_batch(i // ROWS), i % ROWS
        ids, mask = (batch.column(c).values.slice(row * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids [start, start + n) in pieces that lie together in the file."""
        size = ROWS * self.length
        while n > 0:
            batch, at = divmod(start, size)
            if batch != self.last[0]:
                self.last = batch, self.sequences.get_batch(batch).column(0).values.to_numpy()
            part = self.last[1][at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document as the files have it: doc_id, start over all shards, n_tokens, ids_crc32, shard."""
    n = max(1, manifest.count())
    shards = manifest.repartitionByRange(n, "shard")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(folder, k)
                for b in range(shard.documents.num_record_batches):
                    rows = shard.documents.get_batch(b)
                    crcs = []
                    for start, count in zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for part in shard.ids(start, count):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    start = pa.array(rows.column("start").to_numpy() + base)
                    yield pa.record_batch([rows.column("doc_id"), start, rows.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array([k] * len(rows), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return shards.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read every document back."""
    folder = work.shared_dir(docs.sparkSession, "tokens")
    return read(docs.sparkSession, folder, write(docs, folder, tokenizer, end_id, length))
