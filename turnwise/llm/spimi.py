"""Divergence of each source from the other sources of its language, by single-pass indexing.

1. A task reads texts once and keeps postings in memory: for each language, the documents of a term
   and its occurrences in each source.  When they fill their memory they are spilled as a run: sorted
   by term, dealt by a hash of the term into shards, cut into slices.
2. A shard's slices arrive in order of their first term.  A heap merges them, so one task holds one
   slice of each run at most; runs beyond ``FAN_IN`` are merged in groups first.  What comes out is one
   row for each kept term with its occurrences by source.
3. Divergences of two sources start from the value they would have if no term occurred in either.
   Terms that occur in one add a correction by how often they occur (a histogram); terms that occur in
   both add another, summed in the task that streams the terms past.  No row for each pair and term.

Terms are UTF-8 bytes throughout: letters A-Z are lowered, bytes of other ASCII characters are borders.
"""

from __future__ import annotations

import heapq
import itertools
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed, slices, unpacked, written

#: Postings (a term in a source, or in a language's documents) that fill a task's memory.
POSTINGS = 400_000
#: Terms in one slice of a run.
SLICE = 2048
#: Runs that one heap merges.
FAN_IN = 256
#: Text in one shard, and the most shards; a shard is merged as a stream, so it may hold more.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 4096
#: Bytes of a text that are split at once.
STRETCH = 4 << 20
#: Sources in one tile of the pair sums, and tiles a task holds before it gives them out.
TILE, TILES = 256, 64
RUNS = "lang string, shard int, run long, first binary, payload binary"
KEPT = "lang string, term string, sources array<string>, counts array<long>"
#: A-Z become a-z; every other ASCII character but a-z becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def stretches(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a stretch at a time."""
    raw = text.encode().translate(LETTERS)
    at = 0
    while at < len(raw):
        end = at + STRETCH
        end = len(raw) if end >= len(raw) else raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def spill_runs(rows: DataFrame, shards: int, postings: int = POSTINGS) -> DataFrame:
    """Slices of the runs that the tasks spill from ``rows`` (text, lang, source; no nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        documents, sources, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in slices(batches):
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, there, own = set(), documents[lang], sources[lang, source]
                before = len(there) + len(own)
                for words in stretches(text):
                    own.update(words)
                    seen.update(words)
                there.update(seen)
                held += len(there) + len(own) - before
                if held >= postings:
                    yield from _spilled(number, documents, sources, shards)
                    documents, sources, held, number = defaultdict(Counter), defaultdict(Counter), 0, number + 1
        yield from _spilled(number, documents, sources, shards)

    return rows.select("text", "lang", "source").mapInArrow(run, RUNS)


def _spilled(number: int, documents: dict[str, Counter], sources: dict[tuple[str, str], Counter],
             shards: int) -> Iterator[pa.RecordBatch]:
    for lang, there in documents.items():
        dealt = sorted([(zlib.crc32(t) % shards, t) for t in there])
        terms = [t for _, t in dealt]
        place = {t: i for i, t in enumerate(terms)}
        shard = np.array([k for k, _ in dealt])
        names = sorted(s for own_lang, s in sources if own_lang == lang)
        owns = [sources[lang, s] for s in names]
        at = np.concatenate([np.fromiter(map(place.__getitem__, own), np.int64, len(own)) for own in owns])
        code = np.repeat(np.arange(len(owns)), [len(own) for own in owns])
        count = np.concatenate([np.fromiter(own.values(), np.int64, len(own)) for own in owns])
        order = np.argsort(at, kind="stable")
        at, code, count = at[order], code[order], count[order]
        frequency = np.fromiter(map(there.__getitem__, terms), np.int64, len(terms))
        cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(terms)]
        for a, b in itertools.pairwise(cuts):
            for low in range(a, b, SLICE):
                high = min(b, low + SLICE)
                p, q = np.searchsorted(at, (low, high))
                yield _slice(lang, int(shard[a]), number, names, terms[low:high], frequency[low:high],
                             np.bincount(at[p:q] - low, minlength=high - low), code[p:q], count[p:q])


def _slice(lang: str, shard: int, run: int, names: list[str], terms: list[bytes], documents: np.ndarray,
           sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    payload = packed(json.dumps(names).encode(), b" ".join(terms), *(
        np.asarray(x).astype(kind).tobytes() for x, kind in ((documents, "<u8"), (sizes, "<u4"), (codes, "<u4"), (counts, "<u8"))))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((lang, shard, run, terms[0], payload), kinds, strict=True)],
                                      names=["lang", "shard", "run", "first", "payload"])


def _postings(payload: bytes) -> Iterator[tuple[bytes, int, list[str], list[int]]]:
    names, terms, *arrays = unpacked(payload)
    documents, sizes, codes, counts = (np.frombuffer(a, k).tolist() for a, k in zip(arrays, ("<u8", "<u4", "<u4", "<u8"), strict=True))
    names, at = json.loads(names), 0
    for term, n, size in zip(terms.split(b" "), documents, sizes, strict=True):
        yield term, n, [names[c] for c in codes[at:at + size]], counts[at:at + size]
        at += size


def _merged(sorted_slices: Iterable[tuple[tuple, bytes, bytes]]) -> Iterator[tuple[tuple, bytes, int, dict[str, int]]]:
    """(key, term, documents, occurrences by source), in order, of slices sorted by key and first term."""
    heap, current, fresh = [], None, itertools.count()

    def drain(below: bytes | None) -> Iterator[tuple[tuple, bytes, int, dict[str, int]]]:
        while heap and (below is None or heap[0][0] < below):
            term, documents, occurrences = heap[0][0], 0, defaultdict(int)
            while heap and heap[0][0] == term:
                _, k, rest, (n, names, counts) = heap[0]
                documents += n
                for name, count in zip(names, counts, strict=True):
                    occurrences[name] += count
                following = next(rest, None)
                if following:
                    heapq.heapreplace(heap, (following[0], k, rest, following[1:]))
                else:
                    heapq.heappop(heap)
            yield current, term, documents, occurrences

    for key, first, payload in sorted_slices:
        yield from drain(first if key == current else None)
        current, rest = key, _postings(payload)
        term, *posting = next(rest)
        heapq.heappush(heap, (term, next(fresh), rest, posting))
    yield from drain(None)


def merge_runs(runs: DataFrame, groups: int) -> DataFrame:
    """``runs`` merged within ``groups`` groups of runs, so that as many runs remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((r["shard"], r["run"], r["lang"]), r["first"], r["payload"]) for b in batches for r in b.to_pylist())
        for (shard, number, lang), own in itertools.groupby(_merged(rows), key=lambda m: m[0]):
            while part := list(itertools.islice(own, SLICE)):
                names = sorted({s for _, _, _, occurrences in part for s in occurrences})
                code = {s: i for i, s in enumerate(names)}
                found = [sorted((code[s], n) for s, n in occurrences.items()) for _, _, _, occurrences in part]
                flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
                yield _slice(lang, shard, number, names, [m[1] for m in part], np.array([m[2] for m in part]),
                             np.array([len(f) for f in found]), flat[:, 0], flat[:, 1])

    dealt = runs.withColumn("run", F.expr(f"pmod(xxhash64(run), {groups}L)"))
    keys = ["shard", "run"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "lang", "first").mapInArrow(run, RUNS)


def kept_terms(rows: DataFrame, least_docs: int, postings: int = POSTINGS, fan_in: int = FAN_IN,
               shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Terms in at least ``least_docs`` documents of a language, with their occurrences by source."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, 1 + size // shard_bytes)
    runs = written(spill_runs(rows, shards, postings), "runs")
    while (n := runs.agg(F.count_distinct("run")).first()[0]) > fan_in:
        runs = written(merge_runs(runs, -(-n // fan_in)), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((r["shard"], r["lang"]), r["first"], r["payload"]) for b in batches for r in b.to_pylist())
        found = ((lang, term.decode(), list(own), list(own.values()))
                 for (_, lang), term, documents, own in _merged(rows) if documents >= least_docs)
        kinds = (("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())))
        while part := list(itertools.islice(found, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), kinds, strict=True)],
                                             names=[k for k, _ in kinds])

    dealt = runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return written(dealt.mapInArrow(run, KEPT), "terms")


def _share(count: str, total: str, terms: str) -> str:
    """Exact smoothed share in billionths, from 1."""
    return f"1L + CAST((1000000000BD * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {terms} AS DECIMAL(20, 0)) AS BIGINT)"


def _distance(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def _parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_corrections(terms: DataFrame) -> DataFrame:
    """(lang, a, b, value): what terms in both of two sources add; ``terms`` hold (lang, own), where own
    lists source number, share and share of absent terms by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, x, y), held in sums.items():
                a, b = np.nonzero(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a), pa.string()), pa.array(a + x * TILE), pa.array(b + y * TILE), pa.array(held[a, b])],
                    names=["lang", "a", "b", "value"])
            sums.clear()

        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            number, p, absent = (flat.field(k).to_numpy() for k in ("idx", "p", "absent"))
            first = ends[0]
            for lang, low, high in zip(batch.column(0).to_pylist(), (ends[:-1] - first).tolist(), (ends[1:] - first).tolist(), strict=True):
                tile = number[low:high] // TILE
                borders = [low, *(np.flatnonzero(np.diff(tile)) + 1 + low).tolist(), high]
                spans = list(itertools.pairwise(borders))
                for r, s in itertools.product(spans, spans):
                    i, j = slice(*r), slice(*s)
                    pi, ai, pj, aj = p[i, None], absent[i, None], p[None, j], absent[None, j]
                    add = _parts(pi, pj) - _parts(pi, aj) - _parts(ai, pj) + _parts(ai, aj)
                    key = (lang, int(number[r[0]]) // TILE, int(number[s[0]]) // TILE)
                    if key not in sums:
                        if len(sums) >= TILES:
                            yield from out()
                        sums[key] = np.zeros((TILE, TILE), np.int64)
                    sums[key][np.ix_(number[i] % TILE, number[j] % TILE)] += add
        yield from out()

    return terms.mapInArrow(run, "lang string, a long, b long, value long")


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """Per source of a language its divergence from every other source and the terms that mark it out.

    ``docs`` has text, lang and source.  A null in them is the empty string; an empty text has no terms
    but its source counts as a group; repeated rows count each; other columns, whatever their names, are
    not read.  Equal values are ranked by item in byte order.  An empty table gives no rows.
    """
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = kept_terms(rows, least_docs)
    per_lang = kept.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum(F.expr("aggregate(counts, 0L, (s, n) -> s + n)")).alias("lang_n"))
    postings = kept.selectExpr(
        "lang", "term", "aggregate(counts, 0L, (s, n) -> s + n) AS total", "inline(arrays_zip(sources, counts))"
    ).withColumnsRenamed({"sources": "source", "counts": "n"})
    groups = (rows.select("lang", "source").distinct()
              .join(postings.groupBy("lang", "source").agg(F.sum("n").alias("source_n")), ["lang", "source"], "left")
              .join(per_lang, "lang", "left"))
    groups = groups.selectExpr(
        "lang", "source", "row_number() OVER (PARTITION BY lang ORDER BY source) - 1L AS idx",
        "coalesce(terms, 0) AS terms", "coalesce(lang_n, 0) AS lang_n", "coalesce(source_n, 0) AS source_n",
    ).selectExpr("*", f"CASE WHEN terms > 0 THEN {_share('0', 'source_n', 'terms')} END AS absent")
    groups = written(groups, "groups")
    known = postings.join(groups, ["lang", "source"]).selectExpr(
        "lang", "term", "source", "idx", "absent", f"{_share('n', 'source_n', 'terms')} AS p", f"{_share('total', 'lang_n', 'terms')} AS q")
    known = written(known, "shares")
    marks = known.where("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", f"{_distance('p', 'q')} AS value")
    ranking = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank"
    marks = marks.selectExpr("*", ranking).where(f"rank <= {top}")

    left = groups.selectExpr("lang", "idx AS a", "absent AS p_a", "terms")
    pairs = left.join(groups.selectExpr("lang", "idx AS b", "absent AS p_b"), "lang").where("a <> b")
    bars = (known.groupBy("lang", "idx", "absent", "p").count()
            .groupBy("lang", "idx", "absent", F.expr("pmod(p, 16)").alias("chunk"))
            .agg(F.collect_list(F.struct("p", "count")).alias("bars"))
            .selectExpr("lang", "idx AS a", "absent AS p_a", "bars"))
    alone = bars.join(groups.selectExpr("lang", "idx AS b", "absent AS p_b"), "lang").where("a <> b").selectExpr(
        "lang", "a", "b",
        f"aggregate(bars, 0L, (s, x) -> s + x.count * ({_distance('x.p', 'p_b')} - {_distance('p_a', 'p_b')})) AS value")
    both = known.groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.struct("idx", "p", "absent"))).alias("own")).where("size(own) > 1").select("lang", "own")
    columns = ["lang", "a", "b", "value"]
    values = (pairs.selectExpr("lang", "a", "b", f"CASE WHEN terms = 0 THEN 0L ELSE terms * ({_distance('p_a', 'p_b')}) END AS value")
              .union(alone.select(columns)).union(alone.selectExpr("lang", "b AS a", "a AS b", "value"))
              .union(pair_corrections(both).where("a <> b"))
              .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    named = (values.join(groups.selectExpr("lang", "idx AS a", "source"), ["lang", "a"])
             .join(groups.selectExpr("lang", "idx AS b", "source AS item"), ["lang", "b"]))
    found = named.selectExpr("lang", "source", "'pair' AS part", "item", "value").selectExpr("*", ranking)
    return found.unionByName(marks)
