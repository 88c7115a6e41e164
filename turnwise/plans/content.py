"""Dense content: relevance-weighted pooling and attention statistics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.scalars import num
from ..operators.ordered import aggregate
from ..operators.retrieval import PAIR, unit
from ..operators.windows import window_members

CACHED = 200_000  # words whose buckets a task remembers


def content_pool(sims: DataFrame, k: int, dims: int) -> DataFrame:
    """Weighted mean of each pair's top-k passage vectors as ``cont_raw_NNN`` columns.

    ``sims`` carries ``vector``.  Weights are the scores clipped at zero, uniform when all
    are zero.  At most ``k`` vectors meet in a group.
    """
    by = f"PARTITION BY {', '.join(PAIR)}"
    top = sims.selectExpr(
        "*", f"row_number() OVER ({by} ORDER BY sim DESC, window_idx) AS rank"
    ).where(f"rank <= {k}")
    total = f"sum(greatest(sim, 0D)) OVER ({by})"
    weighted = top.selectExpr(
        *PAIR, "vector",
        f"CASE WHEN {total} <= 0 THEN 1D / count(1) OVER ({by}) ELSE greatest(sim, 0D) / {total} END AS w",
    )
    return aggregate(
        weighted, PAIR,
        *[f"sum(w * CAST(vector[{i}] AS DOUBLE)) AS cont_raw_{i:03d}" for i in range(dims)],
    )


def attention_statistics(scored: DataFrame, temperature: float = 1.0, k: int = 3) -> DataFrame:
    """Cosine mean, max and top-k mean, softmax entropy and attended position per pair.

    ``scored`` has ``sim`` in [-1, 1] and ``position``.  The entropy uses
    ``ln Z - sum(e * z) / Z``, so one map-side combined aggregate is enough.
    """
    z = f"(sim / {num(temperature)})"
    mass = f"sum(exp({z}))"
    stats = aggregate(
        scored, PAIR,
        "avg(sim) AS cosine_mean", "max(sim) AS cosine_max",
        f"ln({mass}) - sum(exp({z}) * {z}) / {mass} AS attention_entropy",
        f"sum(exp({z}) * position) / {mass} AS attended_position",
    )
    best = scored.selectExpr(
        *PAIR, "sim",
        f"row_number() OVER (PARTITION BY {', '.join(PAIR)} ORDER BY sim DESC, window_idx) AS rank",
    ).where(f"rank <= {k}")
    return stats.join(aggregate(best, PAIR, "avg(sim) AS cosine_topk_mean"), PAIR)


def encode_texts(
    texts: DataFrame, keys: list[str], encode: Callable[[pd.Series], list], dims_check: int | None = None
) -> DataFrame:
    """Unit vectors of ``content`` from a caller-supplied batch encoder.

    ``encode`` maps a batch of texts to equal-length float lists; it runs per Arrow batch
    inside the tasks, so a model is loaded once per Python worker.
    """
    slim = texts.select(*keys, "content")
    fields = ", ".join(f"{n} {t}" for n, t in slim.dtypes if n != "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encode(batch["content"])
            yield batch[keys].assign(vector=[[float(x) for x in v] for v in vectors])

    raw = slim.mapInPandas(run, f"{fields}, vector array<double>")
    return raw.selectExpr(*keys, f"{unit('vector')} AS vector")


def hashed_counts(texts: DataFrame, keys: list[str], dims: int = 64) -> DataFrame:
    """``keys, counts``: how many words of ``content`` fall in each bucket of ``hashed_vectors``.

    Counted in the scan's tasks, a bucket looked up once per known word, so that no text is shuffled.
    """
    slim = texts.select(*keys, "content")
    fields = ", ".join(f"{n} {t}" for n, t in slim.dtypes if n != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, known = re.compile("[a-z0-9]+"), {}
        for batch in batches:
            counts = []
            for text in batch.column(len(keys)).to_pylist():
                found = word.findall((text or "").lower())
                for w in set(found).difference(known):
                    if len(known) >= CACHED:
                        known.clear()
                        known.update((v, _bucket(v, dims)) for v in set(found))
                        break
                    known[w] = _bucket(w, dims)
                counts.append(np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=dims))
            flat = np.concatenate(counts).astype(np.int32) if counts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dims), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], lists], names=[*keys, "counts"])

    return slim.mapInArrow(run, f"{fields}, counts array<int>")


def _bucket(word: str, dims: int) -> int:
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big") % dims


def hashed_window_vectors(utterances: DataFrame, dims: int = 64) -> DataFrame:
    """``session_id, window_idx, vector``: ``hashed_vectors`` of passages whose rows bring their ``counts``.

    Rows of a passage are joined by a blank, so no word spans two rows and a passage's counts are their sum.
    """
    members = window_members(utterances.select("session_id", "pos", "n_rows", "counts"))
    keys = ["session_id", "window_idx"]
    summed = aggregate(members, keys, *[f"sum(counts[{i}]) AS _c{i}" for i in range(dims)])
    dense = summed.selectExpr(*keys, f"array({', '.join(f'CAST(_c{i} AS DOUBLE)' for i in range(dims))}) AS vector")
    return dense.selectExpr(*keys, f"{unit('vector')} AS vector")


def hashed_vectors(texts: DataFrame, keys: list[str], dims: int = 64) -> DataFrame:
    """A deterministic built-in encoder: counts of words by bucket as a unit dense vector.

    Words are runs of ASCII letters and digits, lower-cased; a bucket is the first 32 bits of a
    word's md5 modulo ``dims``, so any engine can repeat it.  A text without words is all zeros.
    """
    words = "filter(split(lower(content), '[^a-z0-9]+'), w -> w <> '')"
    placed = texts.selectExpr(*keys, f"explode_outer({words}) AS word").selectExpr(
        *keys, f"CAST(conv(substr(md5(word), 1, 8), 16, 10) AS BIGINT) % {dims} AS bucket")
    counted = aggregate(placed, [*keys, "bucket"], "count(bucket) AS n")
    held = aggregate(
        counted, keys, "map_from_entries(collect_list(CASE WHEN bucket IS NOT NULL THEN struct(bucket, n) END)) AS counts")
    dense = held.selectExpr(
        *keys, f"transform(sequence(0L, {dims - 1}L), i -> CAST(coalesce(counts[i], 0L) AS DOUBLE)) AS vector")
    return dense.selectExpr(*keys, f"{unit('vector')} AS vector")
