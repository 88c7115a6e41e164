"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, oracle, pii, toxicity, warc
from .bpe import encode_decode
from .cpsjoin import near_duplicates
from .hnsw import near_duplicate_vectors
from .packing import pack_documents
from .spelling import variants
from .spimi import divergences
from .substrings import without_repeats
from .vptree import audited_nearest, usable
from .wavelet import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    messages = chat.fold_events(chat.turn_events(given.unionByName(probe)))
    return chat.digests(chat.parse(chat.render(messages)))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings within their labels."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op3_cpsjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    return encode_decode(_table(spark, sf_dir, "documents"))


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every embedding whose id is divisible by 20."""
    vectors = usable(_table(spark, sf_dir, "embeddings"))
    return audited_nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records of all pages, the unchanged ones given back their bodies."""
    records = warc.parse_records(warc.page_records(_table(spark, sf_dir, "pages")))
    return warc.digests(warc.resolve(records))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids."""
    return pack_documents(_table(spark, sf_dir, "documents"), end_id=2, window=4096).drop("ids")


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as wavelet shard files and read back."""
    return round_trip(_table(spark, sf_dir, "documents"), end_id=1)


def op11_spimi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources within their languages, and the terms that mark each out."""
    return divergences(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent words one edit away."""
    return variants(_table(spark, sf_dir, "documents"))


def op13_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 13 words that an earlier document holds."""
    return without_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_hnsw": op2_hnsw,
    "op3_cpsjoin": op3_cpsjoin,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_vptree": op7_vptree,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_packing": op9_packing,
    "op10_wavelet_shards": op10_wavelet_shards,
    "op11_spimi": op11_spimi,
    "op12_spelling": op12_spelling,
    "op13_difference_cover": op13_difference_cover,
}
SQL: dict[str, str] = {
    "op1_chat": oracle.CHAT,
    "op2_hnsw": oracle.VECTOR_LINKS,
    "op3_cpsjoin": oracle.TEXT_LINKS,
    "op7_vptree": oracle.NEAREST,
    "op8_warc_revisits": oracle.REVISITS,
    "op11_spimi": oracle.DIVERGENCE,
    "op12_spelling": oracle.VARIANTS,
    "op13_difference_cover": oracle.REPEATS,
}
