"""Encoding, packing, wavelet shards and the distinct-word table against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from turnwise.llm import bpe, packing, tokens, wavelet

WORD = Tokenizer.from_file(tokens.default_vocabulary("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(tokens.default_vocabulary("byte_bpe_50k.json"))
ALPHABET = "ab1I \n\t \x85\xa0'stLl,.!éİΣſ中𝒳\x1c​́ ЯÀ　\x00"
TEXTS = [None, "", " ", "It's 12,5 a\tb", "é<|endoftext|>x  <|startoftext|>", "ΣΑΣ İstanbul", "a" * 3000, "x y " * 900, "x y " * 900]


def wild(n, seed=4):
    rng = random.Random(seed)
    for _ in range(n):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        yield text[:3] + "<|endoftext|>" + text[3:] if rng.random() < 0.1 else text


def table(spark, rows):
    """Columns that clash with the operators' own, and more than one partition."""
    return spark.createDataFrame([(i, t, "x", 1, b"") for i, t in rows],
                                 "doc_id long, text string, part string, n_tokens int, ids binary").repartition(3)


def test_word_coder_equals_the_library():
    coder = tokens.word_bpe(tokens.default_vocabulary("word_bpe_49k.json"))
    for text in [*wild(4000), *filter(None, TEXTS)]:
        assert coder.encode(text).tolist() == WORD.encode(text, add_special_tokens=False).ids, text


def test_byte_words_concatenate_to_the_library_ids():
    coder = bpe.byte_bpe(tokens.default_vocabulary(bpe.VOCABULARY), tokens.default_vocabulary(bpe.RANKS))
    for text in [*wild(4000), *filter(None, TEXTS)]:
        words = bpe.WORD.findall(text)
        assert "".join(words) == text
        assert [i for w in words for i in coder.ids(w)] == BYTE.encode(text, add_special_tokens=False).ids, text


def word_ids(text, end):
    return WORD.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("window", [5, 4096])
def test_packing_places_every_id_once(spark, window):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "again")]
    pieces = packing.pack_documents(table(spark, rows), window=window).toPandas()
    pieces = pieces.sort_values(["sequence_id", "offset"])
    place = pieces.sequence_id * window + pieces.offset
    assert (place.to_numpy() == np.cumsum(pieces.length) - pieces.length).all()
    assert (pieces.offset + pieces.length <= window).all()
    got = {}
    for p in pieces.itertuples():
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        got.setdefault((None if np.isnan(p.doc_id) else int(p.doc_id), p.doc_tokens), {})[p.start] = ids
    for i, text in rows:
        whole = word_ids(text, 2)
        parts = got[i, len(whole)]
        assert np.concatenate([parts[k] for k in sorted(parts)]).tolist() == whole


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_partition_offsets_cross_spans(spark):
    totals = spark.range(3000).selectExpr("CAST(id AS INT) AS part", "id % 7 AS n").where("part % 5 <> 0")
    got = {r.part: r.base for r in packing.partition_offsets(totals).collect()}
    total = 0
    for part in range(3000):
        if part % 5:
            assert got[part] == total
            total += part % 7


def test_wavelet_files_hold_all_documents_in_order(spark):
    rows = [(9, "b c"), (-4, None), *[(100 + i, t) for i, t in enumerate(TEXTS)], (9, "a"), (None, "z")]
    got = wavelet.round_trip(table(spark, rows), shard_tokens=50).collect()
    at = 0
    for row, (i, text) in zip(sorted(got, key=lambda r: r.start),
                              sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = word_ids(text, 1)
        assert (row.doc_id, row.start, row.n_tokens) == (i, at, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert wavelet.round_trip(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[7], [3, 3, 3], list(np.random.default_rng(0).integers(0, 40, 150_000) ** 2)])
def test_wavelet_shard_access_count_and_find(ids):
    ids = np.array(ids, np.uint16)
    shard = wavelet.Shard(wavelet.build_shard([1], np.array([len(ids)]), ids))
    assert (shard.tokens() == ids).all()
    for i in {0, len(ids) // 2, len(ids) - 1, min(65_536, len(ids) - 1)}:
        assert shard.access(i) == ids[i]
    for token in (3, 7, 1521):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 1, len(ids) - 1) == ((places >= 1) & (places < len(ids) - 1)).sum()
        for start, stop in ((-3, None), (2, 1), (0, 10**9), (-10**9, -1)):
            assert shard.count(token, start, stop) == (ids[start:stop] == token).sum()
        for k in {0, len(places) // 2, len(places) - 1, len(places)}:
            assert shard.find(token, k) == (places[k] if 0 <= k < len(places) else None)
    with pytest.raises(IndexError):
        shard.access(len(ids))


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_distinct_words_give_back_ids_and_texts(spark, block_bytes):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "again"), *((50 + i, t) for i, t in enumerate(wild(40)))]
    got = bpe.encode_decode(table(spark, rows), parts=3, block_bytes=block_bytes).collect()
    expected = []
    for i, text in rows:
        ids = BYTE.encode(text or "", add_special_tokens=False).ids
        decoded = BYTE.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.encode_decode(table(spark, rows).limit(0)).count() == 0
