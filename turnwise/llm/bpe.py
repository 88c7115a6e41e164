"""Byte-level BPE over a distinct-word table.

1. Texts are split into words (leading white space, then the rest up to the next white space; the
   vocabulary's own pattern never joins characters across such a border).  Each block of texts
   keeps, in place of its text, the word numbers by position, and sends each of its distinct words
   once to the word's part.
2. A part holds every occurrence of its words, so it encodes each distinct word of the corpus once
   and answers every block that asked.
3. Answers meet the block again; ids come back by position.  Decoding joins ids to pieces.

Blocks and parts travel as packed columns, one row for each (block, part): no row per word.  Words of a
block are ordered by part, then text; positions hold ranks by frequency, which compress better.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .tokens import _byte_letters, default_vocabulary

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Words that tiktoken's pattern and the tokenizers library read alike; others go to the latter.
PLAIN = re.compile("[\n -~\xa1-\u024f]+")
BLOCK_BYTES = 32 << 20
PACKED = "block long, part int, payload binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _pack(*parts: bytes) -> bytes:
    """Compressed byte strings behind their lengths."""
    out = []
    for part in parts:
        small = zstandard.compress(part, 3)
        out += [len(small).to_bytes(8, "little"), small]
    return b"".join(out)


def _unpack(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        size = int.from_bytes(payload[at:at + 8], "little")
        out.append(zstandard.decompress(payload[at + 8:at + 8 + size]))
        at += 8 + size
    return out


def _coded(numbers: np.ndarray) -> list[bytes]:
    """The bit length of each number, then for each length the bytes of the numbers' lower bits.

    Small numbers are frequent and numbers of one length are about equally so, which leaves little
    to gain over compressing the lengths and the bytes as they are.
    """
    numbers = numbers.astype("<u4") + np.uint32(1)
    lengths = np.zeros(len(numbers), np.uint8)
    for at in range(0, len(numbers), 1 << 18):
        lengths[at:at + (1 << 18)] = np.frexp(numbers[at:at + (1 << 18)].astype(np.float64))[1]
    out = [lengths.tobytes()]
    for length in range(2, int(lengths.max(initial=0)) + 1):
        low = numbers[lengths == length] - np.uint32(1 << (length - 1))
        raw = low.view(np.uint8).reshape(-1, 4)
        out += [raw[:, k].tobytes() for k in range((length + 6) // 8)]
    return out


def _decoded(parts: list[bytes]) -> np.ndarray:
    lengths, at = np.frombuffer(parts[0], np.uint8), 1
    out = np.zeros(len(lengths), np.uint32)
    for length in range(2, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == length)
        low = np.full(len(own), (1 << (length - 1)) - 1, np.uint32)
        for k in range((length + 6) // 8):
            low += np.frombuffer(parts[at], np.uint8).astype(np.uint32) << np.uint32(8 * k)
            at += 1
        out[own] = low
    return out


class ByteBpe:
    """Ids of single words and the bytes of each id."""

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        tokens = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        self.pieces = [b""] * (1 + max(tokens.values()))
        for token, i in tokens.items():
            known = all(c in letters for c in token)
            self.pieces[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.texts = [str(i) for i in range(len(self.pieces))]
        self.fast = _same_ranks(ranks_path) if ranks_path else None

    def ids(self, word: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            return self.fast(word)
        return self.exact.encode(word, add_special_tokens=False).ids


def _same_ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, ranks_path: str | None) -> ByteBpe:
    return ByteBpe(path, ranks_path)


def split_blocks(docs: DataFrame, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of blocks (part -1: documents and word numbers) and of their words by part."""

    def flush(block: int, ids: list, texts: list[str]) -> Iterator[tuple[int, int, bytes]]:
        numbers: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        codes, lengths = [np.zeros(0, np.int32)], []
        for text in texts:
            words = WORD.findall(text)
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
        flat, by_part = np.concatenate(codes), defaultdict(list)
        codes.clear()
        texts.clear()
        for w in numbers:
            by_part[zlib.crc32(w.encode()) % parts].append(w)
        place, at = np.zeros(len(numbers), np.int32), 0
        for part in sorted(by_part):
            own = sorted(by_part[part])
            place[[numbers[w] for w in own]] = np.arange(at, at + len(own))
            raw = [w.encode() for w in own]
            yield block, part, _pack(at.to_bytes(8, "little"), np.array([len(w) for w in raw], "<u4").tobytes(), b"".join(raw))
            at += len(own)
        known = pa.array(ids, pa.int64())
        counts = np.bincount(flat, minlength=len(numbers))
        often = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts > 1)]
        order = _completed(place[often], len(numbers))
        rank = np.empty(len(numbers), np.int32)
        rank[order] = np.arange(len(numbers))
        yield block, -1, _pack(
            known.fill_null(0).to_numpy().astype("<i8").tobytes(), known.is_null().to_numpy(zero_copy_only=False).tobytes(),
            np.array(lengths, "<u4").tobytes(), place[often].astype("<u4").tobytes(), len(numbers).to_bytes(8, "little"),
            *_coded(rank[place[flat]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield from map(_row, flush(block, ids, texts))
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield from map(_row, flush(block, ids, texts))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PACKED)


def _completed(first: np.ndarray, n: int) -> np.ndarray:
    """All of 0 .. n-1: ``first``, then the others ascending."""
    rest = np.ones(n, bool)
    rest[first] = False
    return np.concatenate([first, np.flatnonzero(rest)])


def _row(row: tuple[int, int, bytes]) -> pa.RecordBatch:
    block, part, payload = row
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())],
        names=["block", "part", "payload"])


def encode_words(words: DataFrame, parts: int, path: str, ranks_path: str | None) -> DataFrame:
    """Each part's distinct words encoded once, answered to every block that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, current, known = byte_bpe(path, ranks_path), None, {}
        for batch in batches:
            for block, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current:
                    current, known = part, {}
                first, sizes, raw = _unpack(payload)
                answers, end = [], 0
                for size in np.frombuffer(sizes, "<u4").tolist():
                    word, end = raw[end:end + size], end + size
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(coder.ids(word.decode()), "<u4").tobytes()
                    answers.append(ids)
                counts = np.array([len(a) // 4 for a in answers], "<u4").tobytes()
                yield _row((block, part, _pack(first, counts, *_coded(np.frombuffer(b"".join(answers), "<u4")))))

    return words.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, PACKED)


def by_position(blocks: DataFrame, answers: DataFrame, path: str, ranks_path: str | None) -> DataFrame:
    """Ids of each document from its word numbers, and the text that the ids stand for."""

    def run(_key, block: pa.Table, answered: pa.Table) -> pa.Table:
        coder = byte_bpe(path, ranks_path)
        rows = []
        for held in block.column("payload"):
            ids, absent, lengths, first, n_words, *planes = _unpack(held.as_py())
            n_words = int.from_bytes(n_words, "little")
            texts, pieces, counts = [""] * n_words, [b""] * n_words, np.zeros(n_words, np.int64)
            for payload in answered.column("payload"):
                start, sizes, *own = _unpack(payload.as_py())
                at, sizes, own, end = int.from_bytes(start, "little"), np.frombuffer(sizes, "<u4"), _decoded(own).tolist(), 0
                counts[at:at + len(sizes)] = sizes
                for k, size in enumerate(sizes.tolist(), at):
                    word, end = own[end:end + size], end + size
                    texts[k] = ",".join([coder.texts[i] for i in word])
                    pieces[k] = b"".join([coder.pieces[i] for i in word])
            order = _completed(np.frombuffer(first, "<u4").astype(np.int64), n_words)
            places, at = order.astype(np.int32)[_decoded(planes)], 0
            for doc_id, null, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(absent, bool).tolist(),
                                       np.frombuffer(lengths, "<u4").tolist(), strict=True):
                where = places[at:at + n]
                own, at = where.tolist(), at + n
                decoded = b"".join(map(pieces.__getitem__, own)).decode("utf-8", "replace").encode()
                rows.append((None if null else doc_id, int(counts[where].sum()),
                             hashlib.sha256(",".join(map(texts.__getitem__, own)).encode()).hexdigest(),
                             hashlib.sha256(decoded).hexdigest()))
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = "",
                  parts: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Digests of ids and of decoded text for every row of ``docs`` (doc_id, text).

    A null or empty text has no ids and decodes to the empty string.  Null ids stay, repeated rows
    stay.  ``ranks`` may be None: then the tokenizers library encodes every word.
    """
    path = vocabulary or default_vocabulary(VOCABULARY)
    ranks_path = default_vocabulary(RANKS) if ranks == "" and vocabulary is None else ranks or None
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = written(split_blocks(docs, parts, block_bytes), "words")
    answers = encode_words(packed.where("part >= 0"), parts, path, ranks_path)
    return by_position(packed.where("part < 0"), answers, path, ranks_path)
