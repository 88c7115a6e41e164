"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds whole documents in ascending document order.  Its distinct ids are numbered, and the
numbers' bits are stored plane by plane from the highest: after each plane the sequence is stably
parted into its zeros and its ones.  Planes are cut into blocks that are compressed one by one and
carry the ones before them, so a single token, a count or an occurrence touches one block a plane.

File: magic, header length, JSON header, then the sections named there (documents, alphabet,
block directory, blocks).
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import VOCABULARY, partition_offsets
from .storage import shared_folder, written
from .tokens import default_vocabulary, word_bpe

MAGIC = b"WVMX0001"
BLOCK_BITS = 1 << 16
#: Tokens after which a shard is closed; a longer document still stays whole.
SHARD_TOKENS = 1 << 21
MANIFEST = "part int, number int, file string, n_docs long, n long, first_doc long, last_doc long"
DOCUMENTS = "part int, number int, doc_index long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def build_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file's bytes for documents laid end to end in ``ids``."""
    alphabet, numbers = np.unique(ids, return_inverse=True)
    current = numbers.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32).ravel()
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    zeros, ones_before, sizes, blocks = [], [], [], []
    for level in range(levels - 1, -1, -1):
        bits = (current & (1 << level)) != 0
        one, zero = np.flatnonzero(bits), np.flatnonzero(~bits)
        packed = np.packbits(bits, bitorder="little")
        marks = np.arange(0, len(bits), BLOCK_BITS)
        ones_before.append(np.searchsorted(one, marks))
        for mark in marks:
            block = zstandard.compress(packed[mark // 8:(mark + BLOCK_BITS) // 8].tobytes(), 1)
            sizes.append(len(block))
            blocks.append(block)
        parted = np.empty_like(current)
        np.take(current, zero, out=parted[:len(zero)])
        np.take(current, one, out=parted[len(zero):])
        zeros.append(len(zero))
        current = parted
    documents = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(lengths, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as stream:
        stream.write_table(documents)
    sections = {
        "documents": zstandard.compress(sink.getvalue().to_pybytes(), 3),
        "alphabet": zstandard.compress(alphabet.astype("<u4").tobytes(), 3),
        "ones_before": np.concatenate([*ones_before, []]).astype("<u8").tobytes(),
        "sizes": np.array(sizes, "<u4").tobytes(), "blocks": b"".join(blocks),
    }
    header = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros,
                         "sections": [[k, len(v)] for k, v in sections.items()]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections.values()])


class Shard:
    """One shard opened from its file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 8)
        header = json.loads(data[12:12 + size])
        at, found = 12 + size, {}
        for name, length in header["sections"]:
            found[name] = data[at:at + length]
            at += length
        self.n, self.levels, self.zeros = header["n"], header["levels"], header["zeros"]
        documents = pa.ipc.open_stream(zstandard.decompress(found["documents"])).read_all()
        self.doc_ids = documents.column("doc_id").to_pylist()
        self.lengths = documents.column("n").to_numpy()
        self.alphabet = np.frombuffer(zstandard.decompress(found["alphabet"]), "<u4")
        self.per_plane = -(-self.n // BLOCK_BITS)
        self.ones_before = np.frombuffer(found["ones_before"], "<u8").astype(np.int64).reshape(self.levels, -1)
        sizes = np.frombuffer(found["sizes"], "<u4").astype(np.int64)
        self.ends, self.blocks = np.cumsum(sizes), found["blocks"]
        self.starts = self.ends - sizes
        self._bits = functools.lru_cache(maxsize=64)(self._load)

    def _load(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per_plane + block
        raw = zstandard.decompress(self.blocks[self.starts[k]:self.ends[k]])
        size = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size, bitorder="little")

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, inside = divmod(i, BLOCK_BITS)
        if block == self.per_plane:
            return self.n - self.zeros[plane]
        return int(self.ones_before[plane, block]) + int(self._bits(plane, block)[:inside].sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value in a plane."""
        marks = self.ones_before[plane]
        if not bit:
            marks = np.arange(self.per_plane) * BLOCK_BITS - marks
        block = int(np.searchsorted(marks, k, side="right")) - 1
        bits = self._bits(plane, block)
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(marks[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        number = 0
        for plane in range(self.levels):
            bit = int(self._bits(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            number = number << 1 | bit
        return int(self.alphabet[number])

    def _number(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in [start, stop), the borders read as those of a Python slice."""
        number = self._number(token)
        start, stop, _ = slice(start, stop).indices(self.n)
        if number is None or start >= stop:
            return 0
        low, high = self._narrow(number, start, stop)
        return high - low

    def _narrow(self, number: int, low: int, high: int) -> tuple[int, int]:
        for plane in range(self.levels):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if number >> (self.levels - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def find(self, token: int, k: int) -> int | None:
        """Place of the ``k``-th (from 0) occurrence of an id; None beyond the last."""
        number = self._number(token)
        if number is None or not 0 <= k < self.count(token):
            return None
        i = self._narrow(number, 0, self.n)[0] + k
        for plane in range(self.levels - 1, -1, -1):
            bit = number >> (self.levels - 1 - plane) & 1
            i = self._select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the lowest."""
        current = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for plane in range(self.levels - 1, -1, -1):
            bits = np.concatenate([self._load(plane, b) for b in range(self.per_plane)]).view(bool)
            level, split, spread = self.levels - 1 - plane, self.zeros[plane], np.empty_like(current)
            spread[np.flatnonzero(~bits)] = current[:split]
            spread[np.flatnonzero(bits)] = current[split:] | current.dtype.type(1 << level)
            current = spread
        return self.alphabet[current]


def write_shards(docs: DataFrame, folder: str, end_id: int = 1, vocabulary: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` and write shard files in ascending ``doc_id`` order; gives the manifest.

    Null ids come first; equal ids are ordered by text.  A null text is an empty document, whose
    only id is ``end_id``.  A file is named by its partition and number and moved into place when
    complete, so a repeated task replaces its own files with equal ones.
    """
    path = vocabulary or default_vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = word_bpe(path), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2" if max(coder.size, end_id + 1) <= 1 << 16 else "<u4")
        last, doc_ids, held, size = np.array([end_id], kind), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([coder.encode(text or "").astype(kind, copy=False), last])
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield _store(folder, part, number, doc_ids, held)
                    doc_ids, held, size, number = [], [], 0, number + 1
        if doc_ids:
            yield _store(folder, part, number, doc_ids, held)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def _store(folder: str, part: int, number: int, doc_ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
    from pyarrow.fs import FileSystem

    lengths = np.array([len(x) for x in held], np.int64)
    data = build_shard(doc_ids, lengths, np.concatenate(held))
    store, base = FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"shard-{part:06d}-{number:05d}.wvm"
    attempt = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as out:
        out.write(data)
    store.move(attempt, f"{base}/{name}")
    row = [part, number, name, len(doc_ids), int(lengths.sum()), doc_ids[0], doc_ids[-1]]
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)],
                                      names=["part", "number", "file", "n_docs", "n", "first_doc", "last_doc"])


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shard files: its place among all ids, its length and its checksum.

    Files are read by Spark's binary reader, one file at a time in each task.
    """
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, number = map(int, file.rpartition("/")[2].removesuffix(".wvm").split("-")[1:])
                shard = Shard(data.as_py())
                ids, ends = shard.tokens().astype("<u4"), np.cumsum(shard.lengths)
                starts, count = ends - shard.lengths, len(ends)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(count, part, np.int32)), pa.array(np.full(count, number, np.int32)),
                    pa.array(np.arange(count)), pa.array(shard.doc_ids, pa.int64()), pa.array(starts),
                    pa.array(shard.lengths), pa.array(sums, pa.int64()),
                ], names=["part", "number", "doc_index", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
             .select("path", "content"))
    parts = partition_offsets(manifest.groupBy("part").agg(F.sum("n").alias("n")))
    shards = manifest.selectExpr(
        "part", "number", "sum(n) OVER (PARTITION BY part ORDER BY number) - n AS before").join(parts, "part")
    found = files.mapInArrow(run, DOCUMENTS)
    return found.join(shards, ["part", "number"]).selectExpr(
        "doc_id", "base + before + start_in_shard AS start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None,
               shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` as shard files in a new shared folder and read the documents back."""
    folder = shared_folder(docs.sparkSession, "wavelet")
    return read_documents(write_shards(docs, folder, end_id, vocabulary, shard_tokens), folder)
