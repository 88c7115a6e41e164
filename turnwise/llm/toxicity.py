"""Convolutional toxicity scores over hashed word embeddings.

A text is read as units: each word between blanks, the parts of a word that other signs join, and for
long words and scripts without blanks every place of the word with the letters that follow.  A unit's
vector is the sum of hashed embeddings of the whole unit and of its leading letters.  Filters of several widths run over a text's unit vectors, each filter keeps its largest answer, and a linear
layer makes a logit of them.  The network is trained on all labelled rows: in each pass every block of
rows moves a copy of the weights in its task, and the moves are averaged in Spark.  Scoring runs over
whole texts where they lie.  Thresholds are found for each language (guessed from the text's own
function words) and shifted onto one common value.
"""

from __future__ import annotations

import io
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, shared_folder, slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 16, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
#: Words longer than this, and words with signs of a script without blanks, are also read place by place.
LONG = 20
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u3000\u3003-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
#: Signs other than letters that join words; marks that belong to letters are none of them.
JOINTS = re.compile(r"[\x00-@\[-`{-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u200b\u200e-\u206f\u3000-\u3003\u3008-\u3020\u30fb\uff00-\uff20\uff3b-\uff40\uff5b-\uff65]+")
#: Characters of a text that are worked on at once; a word longer than this is read in pieces that overlap.
BLOCK = 1 << 16
EPOCHS, BATCH, RATE = 5, 32, 0.1
#: A small table is passed over until it has had as many steps.
LEAST_STEPS = 400
#: Labelled rows of a block on average; rows and characters that a task holds at once.
ROWS, CHARACTERS = 4000, 1 << 23
#: Weights that every text moves.
DENSE = ("bias", "out", "base", *(f"filters{w}" for w in WIDTHS))
#: Filter and place of each tap of the filters.
TAPS = np.array([(k * FILTERS + f, j) for k, w in enumerate(WIDTHS) for j in range(w) for f in range(FILTERS)])
#: Sums of a pass are taken by ranges of so many places, in so many tasks.
PART, PARTS = 4096, 16
ADDED = {"kind": pa.string(), "part": pa.int32(), "block": pa.int32(), "at": pa.binary(), "values": pa.binary()}
#: Logits are counted in cells of this width for thresholds and losses.
STEP, CELLS = 1 / 128, 60 * 128
LOGITS = (np.arange(CELLS) - CELLS // 2 + 0.5) * STEP
#: Spread of the untrained embeddings; unseen words should say little.  Prior rows of each bucket.
SPREAD, PRIOR = 0.01, 2.0
REJECT, CLEAN_COST = 0.7, 2.0
#: Frequent function words of the languages that thresholds are kept for.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with on as are by",
    "fr": "le la les de des et un une qui que dans pour par",
    "de": "der die das und in ist den von zu mit sich auf ein",
    "es": "el los las de y en que un una por con para se",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
CACHED = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, lower-cased, in lists of at most about ``BLOCK`` characters."""
    text = text.lower()
    if len(text) <= BLOCK:
        yield text.split()
        return
    held, size = [], 0
    for found in re.finditer(r"\S+", text):
        for at in range(found.start(), found.end(), BLOCK):
            word = text[at:min(found.end(), at + BLOCK + PREFIXES[-1] - 1)]
            if held and size + len(word) > BLOCK:
                yield held
                held, size = [], 0
            held.append(word)
            size += len(word)
    yield held


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for; ``add`` gets each new one."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: str) -> int:
        self.add(word)
        self[word] = number = len(self)
        return number


class Words:
    """Numbers of words and of their units, and for new units their hashed keys (flat) and the
    languages they mark."""

    def __init__(self):
        self.of: dict[str, int] = {}
        for i, words in enumerate(FUNCTION_WORDS.values()):
            for w in words.split():
                self.of[w] = self.of.get(w, 0) | 1 << i
        self.reset()

    def reset(self) -> None:
        self.number, self.keys, self.marks = Numbers(self._add), array("i"), array("b")
        self.first, self.total = array("i", [0]), 0

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and marks of the units since the last call."""
        keys, marks = np.array(self.keys, np.int32).reshape(-1, 1 + len(PREFIXES)), np.array(self.marks, np.int64)
        self.keys, self.marks = array("i"), array("b")
        return keys, marks

    def codes(self, words: list[str]) -> np.ndarray:
        """Numbers of the units of words, in their order."""
        codes = np.array(list(map(self.number.__getitem__, words)), np.int64)
        first = np.frombuffer(self.first, np.intc)
        start, count = first[codes], first[codes + 1] - first[codes]
        if not len(codes) or count.max() == 1:
            return start
        ends = count.cumsum()
        return np.arange(ends[-1]) + np.repeat(start - ends + count, count)

    def _add(self, word: str) -> None:
        crc32 = zlib.crc32
        if len(word) <= LONG and word.isascii() and word.rstrip(".,;:!?").isalpha():  # one unit, one byte a letter
            raw, (a, b, c, d) = word.encode(), PREFIXES
            self.keys.extend((crc32(raw) % BUCKETS, crc32(raw[:a], a) % BUCKETS, crc32(raw[:b], b) % BUCKETS,
                              crc32(raw[:c], c) % BUCKETS, crc32(raw[:d], d) % BUCKETS))
            self.marks.append(self.of.get(word, 0))
            self.total += 1
            self.first.append(self.total)
            return
        parts = [p for p in JOINTS.split(word) if p]
        for unit in [word, *parts] if parts and not word.startswith(parts[0]) or len(parts) > 1 else [word]:
            self.keys.append(crc32(unit.encode()) % BUCKETS)
            self.keys.extend([crc32(unit[:n].encode(), n) % BUCKETS for n in PREFIXES])
            self.marks.append(self.of.get(unit, 0))
            self.total += 1
        if len(word) > LONG or not word.isascii() and UNSPACED.search(word):
            for i in range(len(word)):
                self.keys.extend([crc32(word[i:i + n].encode(), n) % BUCKETS for n in (2, *PREFIXES)])
            self.marks.extend(bytes(len(word)))
            self.total += len(word)
        self.first.append(self.total)


def _pooled(model: dict, parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter over one text and where it was; zero-padded at the end.

    The vectors come in parts of at least one array; windows reach over the border of two.
    """
    widest, parts = max(WIDTHS), iter(parts)
    best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
    place = np.zeros((len(WIDTHS), FILTERS), np.int64)
    held, start, part = np.zeros((0, DIM), np.float32), 0, next(parts)
    while part is not None:
        following = next(parts, None)
        shown = np.concatenate([held, part] if following is not None else [held, part, np.zeros((widest, DIM), np.float32)])
        n = len(shown) - widest + 1
        for k, width in enumerate(WIDTHS if n > 0 else ()):
            answers = shown[:n] @ model["filters"][width][0]
            for j in range(1, width):
                answers += shown[j:n + j] @ model["filters"][width][j]
            at = answers.argmax(axis=0)
            found = answers[at, np.arange(FILTERS)]
            better = found > best[k]
            best[k], place[k] = np.where(better, found, best[k]), np.where(better, start + at, place[k])
        held, start, part = shown[max(n, 0):], start + max(n, 0), following
    return best.ravel() + model["bias"], place.ravel()


def _vectors(embedding: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """Vectors of a text's units in parts."""
    for at in range(0, max(1, len(codes)), BLOCK):
        yield _summed(embedding, keys[codes[at:at + BLOCK]])


def _summed(embedding: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Vectors of units: the rows of their keys, added in order."""
    total = embedding[keys[:, 0]]
    for k in range(1, keys.shape[1]):
        total += embedding[keys[:, k]]
    return total


def _marked(marks: np.ndarray) -> np.ndarray:
    return np.array([(marks >> i & 1).sum() for i in range(len(FUNCTION_WORDS))])


def _language(counts: np.ndarray) -> int:
    most = int(np.argmax(counts))
    return most if counts[most] else len(FUNCTION_WORDS)


def started(clean: np.ndarray, toxic: np.ndarray, share: float, seed: int = 7) -> dict:
    """Weights before the first pass, with the state of the steps; ``clean`` and ``toxic`` are rows of each bucket."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    model = {
        "embedding": (rng.standard_normal((BUCKETS, DIM)) * SPREAD).astype(np.float32),
        **{f"filters{w}": (rng.standard_normal((w, DIM, FILTERS)) * np.sqrt(2 / (w * DIM))).astype(np.float32) for w in WIDTHS},
        "bias": np.zeros(total, np.float32), "out": (rng.standard_normal(total) * 0.3).astype(np.float32), "base": np.zeros(1, np.float32),
    }
    model["embedding"][:, 0] = _odds(clean, toxic, share)
    for w in WIDTHS:
        model[f"filters{w}"][:, 0] = np.abs(model[f"filters{w}"][:, 0])
    return model | {f"square_{k}": np.full_like(model[k], 1e-2) for k in DENSE} | {"square_embedding": np.full(BUCKETS, 1e-2, np.float32)}


def _pass(model: dict, texts: list[np.ndarray], keys: np.ndarray, labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, moved: np.ndarray) -> None:
    """One pass of small steps over texts, in place; buckets that it moves are marked."""
    net = _with_filters(model)
    for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
        grads = {k: np.zeros_like(model[k]) for k in DENSE}
        slopes, touched, deltas = np.zeros((len(TAPS), DIM), np.float32), [], []
        taps = np.concatenate([model[f"filters{w}"].transpose(0, 2, 1).reshape(-1, DIM) for w in WIDTHS])
        for i in batch:
            codes = texts[i]
            raw, place = _pooled(net, _vectors(model["embedding"], keys, codes))
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["base"][0], -30, 30)))
            err = np.float32((p - labels[i]) * weight[i] / len(batch))
            grads["out"] += err * hidden
            grads["base"] += err
            back = np.where(raw > 0, err * model["out"], 0)
            grads["bias"] += back
            at, pull = place[TAPS[:, 0]] + TAPS[:, 1], back[TAPS[:, 0]]
            used = np.flatnonzero((at < len(codes)) & (pull != 0))
            if len(used):
                units, pull = keys[codes[at[used]]], pull[used, None]
                slopes[used] += _summed(model["embedding"], units) * pull
                touched.append(units)
                deltas.append(taps[used] * pull)
        start = 0
        for w in WIDTHS:
            grads[f"filters{w}"] = slopes[start:start + w * FILTERS].reshape(w, FILTERS, DIM).transpose(0, 2, 1)
            start += w * FILTERS
        for k, g in grads.items():
            model[f"square_{k}"] += g * g
            model[k] -= RATE * g / np.sqrt(model[f"square_{k}"])
        if touched:
            rows = np.concatenate(touched)
            unique, where = np.unique(rows.ravel(), return_inverse=True)
            order = np.argsort(where, kind="stable")
            step = np.concatenate(deltas)[order // rows.shape[1]]
            summed = np.add.reduceat(step, np.searchsorted(where[order], np.arange(len(unique))), axis=0)
            model["square_embedding"][unique] += (summed * summed).mean(axis=1)
            model["embedding"][unique] -= RATE * summed / np.sqrt(model["square_embedding"][unique])[:, None]
            moved[unique] = True


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches, BATCH):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (.., text) in lists of bounded rows and characters."""
    held, size = [], 0
    for row in rows:
        if held and (len(held) == ROWS or size + len(row[-1]) > CHARACTERS):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held


class Block:
    """What one block of coded rows adds to the totals of a pass, as (kind, places, values).

    Without a model: rows of each class by bucket.  With one: ``check`` rows by language, class and
    cell of their logit; with ``passes`` the other rows also move a copy of the model, and what moved is added.
    """

    def __init__(self, model: dict | None, weight: tuple[float, float], passes: int, seed: int):
        self.model, self.weight, self.passes, self.rng = model, np.array(weight, np.float32), passes, np.random.default_rng(seed)
        self.own = model and passes and {k: v.copy() for k, v in model.items()}
        self.net = model and _with_filters(model)
        self.seen, self.cells, self.moved, self.rows = np.zeros((2, BUCKETS) if model is None else 0), {}, np.zeros(BUCKETS, bool), 0

    def add(self, facts: bytes, codes: bytes, keys: bytes) -> None:
        check, labels, language, length = np.frombuffer(facts, "<i4").reshape(-1, 4).T
        keys = np.frombuffer(keys, "<i4").reshape(-1, 1 + len(PREFIXES))
        coded = np.split(np.frombuffer(codes, "<i4"), np.cumsum(length)[:-1])
        if self.model is None:
            for i in np.flatnonzero(check == 0):
                self.seen[labels[i], np.unique(keys[np.unique(coded[i])])] += 1
            return
        for i in np.flatnonzero(check):
            logit = _logit(self.net, _vectors(self.model["embedding"], keys, coded[i]))
            cell = int(np.clip(np.floor(logit / STEP), -(CELLS // 2), CELLS // 2 - 1)) + CELLS // 2
            cell += int(language[i] * 2 + labels[i]) * CELLS
            self.cells[cell] = self.cells.get(cell, 0) + 1
        kept = np.flatnonzero(check == 0) if self.passes else ()
        for _ in range(self.passes if len(kept) else 0):
            _pass(self.own, [coded[i] for i in kept], keys, labels[kept], self.weight[labels[kept]], self.rng, self.moved)
            self.rows += len(kept)

    def totals(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        if self.model is None:
            at = np.flatnonzero(self.seen.any(axis=0))
            yield "seen", at, self.seen[:, at].T
        cells = np.array(sorted(self.cells), np.int64)
        yield "cells", cells, np.array([[self.cells[c]] for c in cells.tolist()], float).reshape(-1, 1)
        if self.rows:
            dense = [np.concatenate([(self.own[k + n] - self.model[k + n]).ravel() for n in DENSE]) for k in ("", "square_")]
            yield "dense", np.arange(len(dense[0])), np.stack([*dense, np.ones(len(dense[0]))], axis=1)
            at = np.flatnonzero(self.moved)
            change = [(self.own[k][at] - self.model[k][at]).reshape(len(at), -1) for k in ("embedding", "square_embedding")]
            yield "rows", at, np.concatenate([*change, np.ones((len(at), 1))], axis=1)


def _totals(rows: DataFrame, model: dict | None, weight: tuple[float, float] = (1.0, 1.0), passes: int = 0, seed: int = 0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums over all blocks of ``rows`` (``labelled_blocks``) of what ``Block`` adds, by kind: places and values.

    Sums are taken by range of places in Spark, in order of block; what comes back is bounded by the model.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in groupby(_tuples(batches), key=lambda r: r[0]):
            block = Block(shared.value, weight, passes, seed * 1_000_003 + number)
            for _, *chunk in own:
                block.add(*chunk)
            out = []
            for kind, at, values in block.totals():
                for part in np.unique(at // PART).tolist():
                    inside = at // PART == part
                    out.append((kind, part, number, at[inside].astype("<i8").tobytes(), values[inside].astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ADDED.values(), strict=True)], names=list(ADDED))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), own in groupby(_tuples(batches), key=lambda r: r[:2]):
            total = None
            for _, _, _, at, values in own:
                at = np.frombuffer(at, "<i8") - part * PART
                values = np.frombuffer(values, "<f4").reshape(len(at), -1)
                total = np.zeros((PART, 1 + values.shape[1])) if total is None else total
                total[at] += np.concatenate([np.ones((len(at), 1)), values], axis=1)
            at = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind]), pa.array([(at + part * PART).astype("<i8").tobytes()]), pa.array([total[at, 1:].astype("<f8").tobytes()])],
                names=["kind", "at", "values"])

    added = rows.select("block", "facts", "codes", "keys").mapInArrow(run, "kind string, part int, block int, at binary, values binary")
    got = (added.repartition(PARTS, "kind", "part").sortWithinPartitions("kind", "part", "block")
           .mapInArrow(summed, "kind string, at binary, values binary").collect())
    shared.unpersist()
    out = {}
    for kind in {r.kind for r in got}:
        at = [np.frombuffer(r["at"], "<i8") for r in got if r.kind == kind]
        values = [np.frombuffer(r["values"], "<f8").reshape(len(a), -1) for a, r in zip(at, (r for r in got if r.kind == kind), strict=True)]
        out[kind] = np.concatenate(at), np.concatenate(values)
    return out


def _moved(model: dict, totals: dict) -> dict:
    """The model after a pass: each weight moves by the mean over the blocks that moved it."""
    model = {k: v.copy() for k, v in model.items()}
    if "dense" in totals:
        at, values = totals["dense"]
        mean = values[np.argsort(at)]
        mean = (mean[:, :2] / mean[:, 2:]).astype(np.float32)
        start = 0
        for name in DENSE:
            n = model[name].size
            model[name] += mean[start:start + n, 0].reshape(model[name].shape)
            model[f"square_{name}"] += mean[start:start + n, 1].reshape(model[name].shape)
            start += n
    if "rows" in totals:
        at, values = totals["rows"]
        mean = (values[:, :-1] / values[:, -1:]).astype(np.float32)
        model["embedding"][at] += mean[:, :DIM]
        model["square_embedding"][at] += mean[:, DIM]
    return model


def _counted(totals: dict) -> np.ndarray:
    """Rows by language, class and cell of logit."""
    cells = np.zeros(len(LANGUAGES) * 2 * CELLS)
    if "cells" in totals:
        cells[totals["cells"][0]] = totals["cells"][1][:, 0]
    return cells.reshape(len(LANGUAGES), 2, CELLS)


def _loss(cells: np.ndarray, weight: tuple[float, float]) -> float:
    clean, toxic = cells.sum(axis=0)
    return float((np.logaddexp(0, LOGITS) * clean * weight[0] + np.logaddexp(0, -LOGITS) * toxic * weight[1]).sum() / max(cells.sum(), 1))


def _odds(clean: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Starting value of each bucket: how much oftener toxic texts hold it, zero where none does."""
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))


def _logit(model: dict, parts: Iterable[np.ndarray]) -> float:
    raw, _ = _pooled(model, parts)
    return float(np.maximum(raw, 0) @ model["out"] + model["base"][0])


def _cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The logit of least cost (a clean text rejected costs ``CLEAN_COST`` toxic ones kept), from rows by
    cell; among equals the middle of the widest gap."""
    if not clean.sum() or not toxic.sum():
        return 0.0
    at = np.flatnonzero(clean + toxic)
    values = LOGITS[at]
    errors = np.concatenate([[0], np.cumsum(toxic[at])]) + CLEAN_COST * (clean.sum() - np.concatenate([[0], np.cumsum(clean[at])]))
    edges = np.concatenate([[values[0] - 1], values, [values[-1] + 1]])
    gaps = np.where(errors == errors.min(), np.diff(edges), -1)
    k = int(np.argmax(gaps))
    return float((edges[k] + edges[k + 1]) / 2)


def _with_filters(model: dict) -> dict:
    return model | {"filters": {w: model[f"filters{w}"] for w in WIDTHS}}


def _saved(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: v for k, v in model.items() if not k.startswith("square_")})
    return out.getvalue()


def _loaded(raw: bytes) -> dict:
    return _with_filters(dict(np.load(io.BytesIO(raw))))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled rows that are not held out (block, check, toxic, text), by block in order of a hash.

    Of repeated labels of an id the largest counts, of repeated texts the smallest; null labels and ids
    do not.  ``check`` is 1 for a fifth of the rows.
    """
    doc_id = F.col("doc_id").cast("long")
    usable = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(doc_id))
              .select(doc_id.alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")))
    blocks = max(1, -(-usable.count() // ROWS))
    texts = docs.where("doc_id IS NOT NULL").where(~held_out(doc_id)).select(
        doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("int").alias("toxic"))
    placed = usable.union(texts).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    joined = placed.groupBy("block", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).where("toxic IN (0, 1) AND text IS NOT NULL")
    check = (F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)) == 0).cast("int")
    ordered = joined.withColumns({"check": check, "draw": F.xxhash64("doc_id", F.lit("order"))}).sortWithinPartitions("block", "draw", "doc_id")
    return ordered.select("block", "check", "toxic", "text")


def labelled_blocks(rows: DataFrame) -> DataFrame:
    """A table of ``rows`` in chunks, each block in one file: check, class, language and length of every text
    (``facts``), its unit numbers (``codes``) and the keys of the units, so that words are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in groupby(_tuples(batches), key=lambda r: r[0]):
            for chunk in _chunks(own):
                words = Words()
                coded = [np.concatenate([words.codes(b) for b in _blocks(r[3])]).astype("<i4") for r in chunk]
                keys, marks = words.taken()
                facts = np.array([(r[1], r[2], _language(_marked(marks[c])), len(c)) for r, c in zip(chunk, coded, strict=True)], "<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([len(chunk)], pa.int32()), pa.array([int(facts[:, 1].sum())], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (facts, np.concatenate(coded), keys.astype("<i4")))],
                    names=["block", "n", "n_toxic", "facts", "codes", "keys"])

    path = shared_folder(rows.sparkSession, "labelled")
    chunks = rows.mapInArrow(run, "block int, n int, n_toxic int, facts binary, codes binary, keys binary")
    chunks.write.option("compression", "zstd").partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema("n int, n_toxic int, facts binary, codes binary, keys binary, block int").parquet(path)


def fit(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """A model from all labelled rows that are not held out; None where one class is missing.

    Four fifths of the rows move the weights: in each pass every block moves a copy, and the moves are
    averaged.  The other fifth chooses among the passes and gives the thresholds.
    """
    rows = labelled_blocks(labelled_rows(docs, labels))
    size = rows.agg(F.sum("n"), F.sum("n_toxic")).first()
    n = ((size[0] or 0) - (size[1] or 0), size[1] or 0)
    if not all(n):
        return None
    weight = tuple(0.5 * sum(n) / k for k in n)
    passes = -(-max(EPOCHS, LEAST_STEPS * BATCH // max(1, sum(n) * 4 // 5)) // EPOCHS)
    at, values = _totals(rows, None).get("seen", (np.zeros(0, np.int64), np.zeros((0, 2))))
    seen = np.zeros((BUCKETS, 2))
    seen[at] = values
    model, best = started(seen[:, 0], seen[:, 1], n[1] / sum(n)), (np.inf, None, None)
    for epoch in range(EPOCHS + 1):
        totals = _totals(rows, model, weight, passes if epoch < EPOCHS else 0, epoch)
        if epoch:
            cells = _counted(totals)
            best = min(best, (_loss(cells, weight), model, cells), key=lambda x: x[0])
        model = _moved(model, totals)
    _, model, cells = best
    common = _cut(*cells.sum(axis=0))
    model["cuts"] = np.array([_cut(*own) if own.sum(axis=1).min() >= 20 else common for own in cells], np.float32)
    return _saved(model)


def score(docs: DataFrame, model: bytes | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new column of this name.

    Only the text is read.  A null or empty text has the score of no words.  Without a model every
    score is zero.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shift = np.log(REJECT / (1 - REJECT))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, words, known = _loaded(shared.value), Words(), 0
        vectors, marks = np.zeros((CACHED * 2, DIM), np.float32), np.zeros(CACHED * 2, np.int64)

        def parts(text: str, counts: np.ndarray) -> Iterator[np.ndarray]:
            """Unit vectors of a text block by block; function words are added to ``counts``."""
            nonlocal known
            for block in _blocks(text):
                if known > CACHED:
                    words.reset()
                    known = 0
                at = words.codes(block)
                seen = words.total
                if seen > len(vectors):
                    vectors.resize((2 * seen, DIM), refcheck=False)
                    marks.resize(2 * seen, refcheck=False)
                if seen > known:
                    keys, marks[known:seen] = words.taken()
                    vectors[known:seen] = _summed(net["embedding"], keys)
                    known = seen
                counts += _marked(marks[at])
                yield vectors[at]

        for texts in batches:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                counts = np.zeros(len(FUNCTION_WORDS), np.int64)
                z = _logit(net, parts(text or "", counts))
                z += shift - net["cuts"][_language(counts)]
                out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.Series(out)

    return docs.withColumn(name, scored(F.col("text").cast("string")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and the decision at ``REJECT``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= REJECT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is scored as toxic; columns as they were, whatever their names.

    Every row is judged by its own text, so repeated rows and rows without an id go or stay alike.
    """
    name = free_name(docs, "toxicity")
    return score(docs, fit(docs, labels), name).where(F.col(name) < REJECT).select(*docs.columns)
