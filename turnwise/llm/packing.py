"""Concatenate-and-cut packing of documents into fixed windows.

Pass one encodes every document and writes ids with the running offset inside its input
partition.  The partition totals, one row each, become global offsets by a two-level prefix sum.
Pass two cuts every document at the window borders; a document that crosses a border leaves one
piece on each side.  Only the last window of the corpus is shorter than the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import slices, written
from .tokens import default_vocabulary, word_bpe

WINDOW = 4096
VOCABULARY = "word_bpe_49k.json"
TOKENS = "doc_id long, part int, before long, n_tokens long, wide boolean, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")
#: Partitions whose offsets may be broadcast (16 bytes each); beyond, the table is joined.
BROADCAST_PARTS = 2_000_000
SPAN = 1024


def encoded(docs: DataFrame, end_id: int, vocabulary: str | None = None) -> DataFrame:
    """Ids of every text with ``end_id`` after them, and the tokens before it in its partition.

    A null text is empty; so is an empty one: its only id is ``end_id``.  A null id stays null and
    repeated rows stay separate documents.
    """
    path = vocabulary or default_vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = word_bpe(path), TaskContext.get().partitionId(), 0
        wide = max(coder.size, end_id + 1) > 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        last = np.array([end_id], kind).tobytes()
        for batch in slices(batches):
            ids = [coder.encode(t or "").astype(kind, copy=False).tobytes() + last
                   for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // kind.itemsize for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(n), part, np.int32)),
                pa.array(before + np.cumsum(n) - n), pa.array(n),
                pa.array(np.full(len(n), wide)), pa.array(ids, pa.binary()),
            ], names=["doc_id", "part", "before", "n_tokens", "wide", "ids"])
            before += int(n.sum())

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, TOKENS)


def partition_offsets(totals: DataFrame) -> DataFrame:
    """(part, n) to (part, base): the sum of ``n`` over smaller parts, in spans of parts."""
    spans = totals.selectExpr("*", f"part div {SPAN} AS span")
    by_span = spans.groupBy("span").agg(F.sum("n").alias("span_n"))
    carried = by_span.selectExpr(
        "span", "sum(span_n) OVER (ORDER BY span) - span_n AS carry")
    inside = spans.selectExpr("part", "span", "sum(n) OVER (PARTITION BY span ORDER BY part) - n AS inner_base")
    return inside.join(carried, "span").selectExpr("part", "inner_base + carry AS base")


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of every document of a written ``encoded`` table, with their ids."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = written(partition_offsets(totals), "offsets")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").selectExpr("doc_id", "base + before AS place", "wide", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, place, wide, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(window - offset, n - start)
                    piece = ids[start:start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset, piece))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.binary()], strict=True)]
                if rows else [pa.array([], t) for t in [pa.int64()] * 7 + [pa.binary()]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, end_id: int = 2, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Encode, place and cut ``docs`` (doc_id, text; other columns are not read).

    An empty table gives no pieces.
    """
    return pack(written(encoded(docs, end_id, vocabulary), "tokens"), window)
