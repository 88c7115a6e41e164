"""Repeated passages, found through anchors at the positions of a difference cover.

Every difference modulo 7 is a difference of two members of {0, 1, 3}.  So where 13 words at place i of
one document equal 13 words at place j of another, some shift below 7 brings both i and j to places
that the cover holds, and the 7 words there (an anchor) lie inside both.  Hence

1. only anchors are hashed, at three places of seven; texts are kept in one file for each block, and
   each block asks the parts of the hash space which of its anchors another document holds too;
2. an anchor that is shared is extended to the windows of 13 words that hold it; those are hashed in
   full, and each block asks in which of its windows a document of smaller id begins the same words;
3. the words of those windows go.

Questions travel as sorted arrays for each (block, part), answers as bits.  No pair of documents, and no
row for a window, is ever made, so a passage of any number of copies costs one hash for each block.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed, shared_folder, unpacked, written

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
#: Text of a block, and text whose hashes go to one part.
BLOCK_BYTES = 16 << 20
PART_BYTES, MOST_PARTS = 4 << 20, 4096
#: Bits of an anchor's hash.  Two anchors of one hash only cost work: windows are compared by 128 bits.
ANCHOR_BITS = 48
SIGN = np.uint64(1 << 63)
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WINDOW)]
ASKED = "block string, part int, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight side by side; of small numbers the upper ones compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).tobytes(), "<u8")


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` successive word hashes."""
    total = words[:len(words) - n + 1] * FACTORS[0]
    for k in range(1, n):
        total = total + words[k:len(words) - n + 1 + k] * FACTORS[k]
    return total ^ (total >> np.uint64(29))


def _row(block: str, part: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([part], pa.int32()), pa.array([payload], pa.binary())], names=["block", "part", "payload"])


class Block:
    """Documents side by side: their words as numbers, and the places where windows may begin."""

    def __init__(self, doc_ids: list[int | None], texts: list[bytes]):
        self.doc_ids, self.texts = doc_ids, texts
        numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        own = []
        for text in texts:
            words = text.split()
            own.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.words = np.concatenate([*own, np.zeros(0, np.int32)])
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), ">u8").reshape(-1, 2).astype(np.uint64)
        self.high, self.low = hashes[:, 0], hashes[:, 1]
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Ids in an order that unsigned numbers have; a missing id is the largest.
        self.ranks = np.array([2**63 - 1 if i is None else i for i in doc_ids], np.int64).view(np.uint64) ^ SIGN

    @functools.cached_property
    def windows(self) -> np.ndarray:
        """Places of all whole windows."""
        return self._places(WINDOW)

    def _places(self, length: int) -> np.ndarray:
        room = np.maximum(self.sizes - length + 1, 0)
        return np.repeat(self.starts - np.cumsum(room) + room, room) + np.arange(room.sum())

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.sizes, places, side="right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes."""
        length = WINDOW - PERIOD + 1
        places = self._places(length)
        owner = self.document(places)
        inside = (places - self.starts[owner]) % PERIOD
        places = places[np.isin(inside, COVER) & (self.sizes[owner] >= WINDOW)]
        if not len(places):
            return places, np.zeros(0, np.uint64)
        return places, _grams(self.high[self.words], length)[places] >> np.uint64(64 - ANCHOR_BITS)

    def around(self, places: np.ndarray) -> np.ndarray:
        """Places of the windows that hold an anchor at one of ``places``."""
        near = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(near, np.maximum(places - PERIOD + 1, 0), 1)
        np.add.at(near, places + 1, -1)
        return self.windows[np.cumsum(near)[self.windows] > 0]

    def hashed(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows at ``places``."""
        if not len(places):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _grams(self.high[self.words], WINDOW)[places], _grams(self.low[self.words], WINDOW)[places]

    def stored(self) -> bytes:
        ids = pa.array(self.doc_ids, pa.int64())
        return packed(ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                      np.array([len(t) for t in self.texts], "<u8").tobytes(), b"".join(self.texts))

    @classmethod
    def opened(cls, data: bytes) -> Block:
        ids, absent, sizes, raw = unpacked(data)
        ends = np.cumsum(np.frombuffer(sizes, "<u8")).tolist()
        doc_ids = [None if null else i for i, null in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(absent, bool).tolist(), strict=True)]
        return cls(doc_ids, [raw[a:b] for a, b in zip([0, *ends], ends)])


def _distinct(keys: list[np.ndarray], ranks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the number of each given key, and least and largest rank of each."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(fresh)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    ordered = ranks[order]
    return ([k[first] for k in keys], number, np.minimum.reduceat(ordered, first) if len(first) else ordered,
            np.maximum.reduceat(ordered, first) if len(first) else ordered)


def _cuts(keys: np.ndarray, bits: int, parts: int) -> list[int]:
    borders = np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)
    return [0, *np.searchsorted(keys, borders).tolist(), len(keys)]


def _shared_inside(block: Block, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block, the number of each anchor, and which of them two documents hold."""
    (own,), number, least, most = _distinct([keys], block.document(places))
    return own, number, least != most


def write_blocks(docs: DataFrame, folder: str, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store blocks of ``docs`` as files and give their anchors by part (part -1: the block itself).

    A file carries the attempt that wrote it in its name, so rows and file always belong together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield from ask(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
        if doc_ids:
            yield from ask(doc_ids, texts)

    def ask(doc_ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        block, name = Block(doc_ids, texts), f"block-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        _store(folder, name, block.stored())
        yield _row(name, -1, b"")
        own, _, twice = _shared_inside(block, *block.anchors())
        cuts = _cuts(own, ANCHOR_BITS, parts)
        for part, (a, b) in enumerate(itertools.pairwise(cuts)):
            if a < b:
                yield _row(name, part, packed(_planes(np.diff(own[a:b], prepend=np.uint64(0))), np.packbits(twice[a:b]).tobytes()))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, ASKED)


def _store(folder: str, name: str, data: bytes) -> None:
    from pyarrow.fs import FileSystem

    store, base = FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(data)


def _load(folder: str, name: str) -> Block:
    from pyarrow.fs import FileSystem

    store, base = FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{name}") as file:
        return Block.opened(file.read())


def _by_key(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of a stream sorted by a column, one group at a time."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for value, own in itertools.groupby(rows, key=lambda r: r[key]):
        yield value, list(own)


def shared_anchors(asked: DataFrame) -> DataFrame:
    """For each (block, part) a bit for each of its anchors: another document holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_key(batches, 1):
            held = [unpacked(payload) for _, _, payload in rows]
            keys = [np.cumsum(_numbers(k), dtype=np.uint64) for k, _ in held]
            twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for k, (_, t) in zip(keys, held, strict=True)]
            _, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            shared = (count > 1)[number] | np.concatenate(twice)
            at = 0
            for (block, _, _), own in zip(rows, keys, strict=True):
                bits, at = shared[at:at + len(own)], at + len(own)
                if bits.any():
                    yield _row(block, part, packed(len(own).to_bytes(8, "little"), np.packbits(bits).tobytes()))

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(run, ASKED)


def _answered(rows: list[tuple], cuts: list[int]) -> np.ndarray:
    bits = np.zeros(cuts[-1], bool)
    for _, part, payload, *_ in rows:
        n, own = unpacked(payload)
        bits[cuts[part]:cuts[part + 1]] = np.unpackbits(np.frombuffer(own, np.uint8), count=int.from_bytes(n, "little"))
    return bits


def _extended(block: Block, rows: list[tuple], parts: int) -> tuple:
    """Windows that hold a shared anchor: places, distinct hashes, numbers, least ids."""
    places, keys = block.anchors()
    own, number, _ = _shared_inside(block, places, keys)
    bits = _answered(rows, _cuts(own, ANCHOR_BITS, parts))
    windows = block.around(places[bits[number]])
    ranks = block.ranks[block.document(windows)]
    distinct, which, least, _ = _distinct(list(block.hashed(windows)), ranks)
    return windows, ranks, distinct, which, least


def ask_windows(answers: DataFrame, folder: str, parts: int, tasks: int) -> DataFrame:
    """The extended windows of each block by part: hashes, and the least id that begins them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _by_key(batches, 0):
            _, _, (high, low), _, least = _extended(_load(folder, name), rows, parts)
            for part, (a, b) in enumerate(itertools.pairwise(_cuts(high, 64, parts))):
                if a < b:
                    base = least[a:b].min()
                    yield _row(name, part, packed(
                        _planes(np.diff(high[a:b], prepend=np.uint64(0))), low[a:b].astype("<u8").tobytes(),
                        int(base).to_bytes(8, "little"), _planes(least[a:b] - base)))

    return answers.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(run, ASKED)


def earlier_windows(asked: DataFrame) -> DataFrame:
    """For each (block, part) a bit for each of its windows: a smaller id elsewhere begins it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_key(batches, 1):
            held = [unpacked(payload) for _, _, payload in rows]
            high = [np.cumsum(_numbers(h[0]), dtype=np.uint64) for h in held]
            low = [np.frombuffer(h[1], "<u8") for h in held]
            least = [_numbers(h[3]) + np.uint64(int.from_bytes(h[2], "little")) for h in held]
            own = np.concatenate(least)
            _, number, smallest, _ = _distinct([np.concatenate(high), np.concatenate(low)], own)
            earlier, at = smallest[number] < own, 0
            for (block, _, _), keys in zip(rows, high, strict=True):
                bits, at = earlier[at:at + len(keys)], at + len(keys)
                if bits.any():
                    yield _row(block, part, packed(len(keys).to_bytes(8, "little"), np.packbits(bits).tobytes()))

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(run, ASKED)


def _kept(block: Block, rows: list[tuple], parts: int) -> Iterator[tuple[int | None, int, int, list[bytes] | None]]:
    """Of each document: id, words, removed words, and the kept words (None: all)."""
    windows, ranks, (high, _), which, least = _extended(block, [r for r in rows if r[3] == 1], parts)
    earlier = _answered([r for r in rows if r[3] == 2], _cuts(high, 64, parts))
    gone = windows[earlier[which] | (least[which] < ranks)]
    depth = np.zeros(len(block.words) + 1, np.int32)
    np.add.at(depth, gone, 1)
    np.add.at(depth, gone + WINDOW, -1)
    removed = np.cumsum(depth)[:-1] > 0
    for doc_id, text, start, size in zip(block.doc_ids, block.texts, block.starts.tolist(), block.sizes.tolist(), strict=True):
        own = removed[start:start + size]
        words, n = text.split(), int(own.sum())
        yield doc_id, size, n, [words[i] for i in np.flatnonzero(~own)] if n else words


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
                    texts: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the words that repeat 13 words of a smaller doc_id.

    Gives doc_id, n_words, n_removed and a digest of the kept words; with ``texts`` also the kept words
    joined by a blank (``kept_text``).  Windows are judged on the texts as given.  A null or empty text
    has no words; a null id is larger than every other and never smaller than itself, so rows of equal or
    missing ids take nothing from each other; repeated rows stay; other columns are not read.  Rows of
    an empty table are none.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts, tasks = min(MOST_PARTS, 1 + size // part_bytes), 1 + size // block_bytes
    folder = shared_folder(spark, "blocks")
    asked = written(write_blocks(docs, folder, parts, block_bytes), "anchors")
    shared = written(shared_anchors(asked.where("part >= 0")), "shared")
    earlier = written(earlier_windows(ask_windows(shared, folder, parts, tasks)), "earlier")
    kinds = RESULT + (", kept_text string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _by_key(batches, 0):
            found = []
            for doc_id, n, n_removed, words in _kept(_load(folder, name), rows, parts):
                kept = b" ".join(words)
                found.append((doc_id, n, n_removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
            columns = list(zip(*found, strict=True))
            names = [k.split()[0] for k in kinds.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)], names=names)

    answers = (asked.where("part < 0").withColumn("kind", F.lit(0))
               .union(shared.withColumn("kind", F.lit(1))).union(earlier.withColumn("kind", F.lit(2))))
    # answers are small and the blocks they lead to are not: as many tasks as blocks
    return answers.repartition(tasks, "block").sortWithinPartitions("block", "kind", "part").mapInArrow(run, kinds)
