"""Toxicity, archive records and the pipeline on small tables."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import cpsjoin, pii, toxicity, warc

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words = [a + b for a in ("re", "th", "ou", "er", "an") for b in ("in", "al", "ed", "st", "on", "ly")]
    rows, labels = [], []
    for i in range(900):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(4, 60))], int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "foul" + rng.choice(words)]))
        rows.append((i, " ".join(text), "en" if i % 2 else "fr", 5))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (2000, None, "en", 1), (2001, "", None, 1), (None, "vile", "en", 1), (2002, "an " * 50_000, "en", 1)],
                                 "doc_id long, text string, lang string, score int").repartition(3)
    return docs, spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_held_out_rows_are_judged_well(labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(got) == 904
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    unseen = [(got[i].predicted, y) for i, _, y in truth if got[i].held_out]
    assert sum(p == y for p, y in unseen) / len(unseen) > 0.95
    assert not got[2000].predicted and not got[2001].predicted and not got[2002].predicted


def test_every_labelled_row_teaches(labelled, monkeypatch):
    """Many small blocks: no labelled row is left out, and blocks whose moves are averaged learn as one does."""
    docs, labels, truth = labelled
    monkeypatch.setattr(toxicity, "ROWS", 80)
    rows = toxicity.labelled_rows(docs, labels)
    own = [(i, y) for i, _, y in truth if zlib.crc32(str(i).encode()) % 3 != 1]
    assert rows.count() == len(own) and rows.select("block").distinct().count() > 5
    assert all(r.blocks == 1 for r in rows.groupBy(F.spark_partition_id()).agg(F.countDistinct("block").alias("blocks")).collect())
    assert sorted(r.toxic for r in rows.collect()) == sorted(y for _, y in own)
    plain = np.zeros((toxicity.BUCKETS, 2))
    for r in rows.where("check = 0").collect():
        words = toxicity.Words()
        codes = words.codes(r.text.lower().split())
        plain[np.unique(words.taken()[0][np.unique(codes)]), r.toxic] += 1
    at, seen = toxicity._totals(toxicity.labelled_blocks(rows), None)["seen"]
    assert (seen == plain[at]).all() and seen.sum() == plain.sum()
    got = {r.doc_id: r.predicted for r in toxicity.report(docs, labels).collect()}
    unseen = [(got[i], y) for i, _, y in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in unseen) / len(unseen) > 0.95


def test_without_labels_nothing_is_rejected(labelled):
    docs, labels, _ = labelled
    kept = toxicity.reject(docs, labels.limit(0))
    assert kept.count() == 904 and kept.dtypes == docs.dtypes
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_all_of_an_unspaced_text_is_read(spark, monkeypatch):
    rng = random.Random(9)
    signs = {"zh": [chr(0x4E00 + i) for i in range(300)], "th": [chr(0xE01 + i) for i in range(46)], "en": list("abcdefghijklmnop")}
    bad = {"zh": "\u7a00\u7a01\u7a02", "th": "\u0e4f\u0e50\u0e51\u0e52", "en": "vqzxw"}
    rows, labels = [], []
    for i in range(1200):
        lang, toxic = ("zh", "th", "en")[i % 3], int(rng.random() < 0.4)
        words = ["".join(rng.choices(signs[lang], k=rng.randint(2, 5))) for _ in range(40)]
        for _ in range(2 * toxic):
            words.insert(rng.randrange(20, len(words)), bad[lang])
        rows.append((i, rng.choice(["_", ",", "-"] if lang == "en" else [""]).join(words)))
        labels.append((i, toxic))
    long = ["\u4e00\u4e01" * 500, "\u4e00\u4e01" * 500 + bad["zh"] * 2]
    docs = spark.createDataFrame([*rows, *((5000 + k, t) for k, t in enumerate(long))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for k, lang in enumerate(("zh", "th", "en")):
        unseen = [(got[i].predicted, y) for i, y in labels if got[i].held_out and i % 3 == k]
        assert sum(p == y for p, y in unseen) / len(unseen) > 0.9, lang
    assert not got[5000].predicted and got[5001].predicted
    words, texts = toxicity.Words(), [" ".join(t for _, t in rows[:9]), "a" * 100 + "b", "a" * 100 + "c"]
    whole = [{tuple(r) for r in keys} for keys in ((words.codes(t.lower().split()), words.taken()[0])[1] for t in texts)]
    assert whole[1] and whole[2] and whole[1] != whole[2]
    net = {"filters": {w: np.random.default_rng(w).standard_normal((w, 16, 16)).astype(np.float32) for w in toxicity.WIDTHS}, "bias": np.zeros(48, np.float32)}
    shown = np.random.default_rng(1).standard_normal((50, 16)).astype(np.float32)
    one, cut = toxicity._pooled(net, [shown]), toxicity._pooled(net, [shown[:1], shown[1:2], shown[2:30], shown[30:30], shown[30:]])
    assert np.allclose(one[0], cut[0], atol=1e-5) and (one[1] == cut[1]).all()
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    for text in texts:
        blocks = list(toxicity._blocks(text))
        assert max(sum(map(len, b)) for b in blocks) <= 64 + 5
        grams = {text[i:i + 6] for i in range(len(text) - 5) if not re.search(r"\s", text[i:i + 6])}
        assert all(any(g in w for b in blocks for w in b) for g in grams)


@pytest.mark.parametrize("url,want", [
    ("HTTP://user@WWW.A.com:80/x/?b=2&utm_source=f&a=1#top", "a.com/x?a=1&b=2"), ("https://a.com/x", "a.com/x"), ("https://a.com", "a.com"),
    ("a.com/?ref=1", "a.com"), ("", ""), (None, None)])
def test_canonical_urls(spark, url, want):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(warc.canonical_url(frame.u)).first()[0] == want


def test_revisits_take_the_latest_earlier_body(spark):
    gap = "\r\n\r\n"

    def record(name, kind, url, minute, status, tag, body=""):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00Z"
        tags = f"\r\nETag: {tag}" if tag else ""
        return (f"{head}{gap}HTTP/1.1 {status} X\r\nServer: {name}\r\nVary: a\r\nvary: b{tags}{gap}{body}", 1)

    rows = [record("f1", "response", "http://a.com/", 10, 200, '"1"', f"one{gap}two"), record("f2", "response", "https://www.a.com", 20, 200, '"2"', "later"),
            record("r1", "revisit", "a.com#x", 15, 304, 'W/"1"'), record("r2", "revisit", "a.com", 30_000, 304, '"2"'),
            record("r3", "revisit", "a.com", 25, 304, '"1"'), record("r4", "revisit", "a.com", 5, 304, '"1"'), record("r5", "revisit", "a.com", 40, 304, None),
            (None, 1), ("junk", 1)]
    raw = spark.createDataFrame(rows, "record string, payload int").repartition(3)
    got = {r.record_id: r for r in warc.resolve(warc.parse_records(raw)).collect()}
    assert {k: (r.outcome, r.source_id, r.status, r.payload) for k, r in got.items()} == {
        "f1": ("full", None, 200, f"one{gap}two"), "f2": ("full", None, 200, "later"), "r1": ("resolved", "f1", 200, f"one{gap}two"),
        "r2": ("resolved", "f2", 200, "later"), "r3": ("changed", None, 304, None), "r4": ("orphan", None, 304, None),
        "r5": ("unverified", "f2", 200, "later"), None: ("orphan", None, None, None)}
    assert got["r1"].headers == {"server": "f1", "vary": "a, b", "etag": 'W/"1"'}
    assert warc.resolve(warc.parse_records(raw.limit(0))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([
        (1, "one two three four five six seven eight", "en", "a", 39), (2, "One two three four five six seven eight", "en", "a", 39),
        (3, "write to a@b.co now", "en", "b", 19), (4, None, None, None, None), (4, "", "en", "b", 0)],
        "doc_id long, text string, lang string, source string, n_chars long")
    near, private, pack = (f for _, f in corpus_pipeline.STAGES[1:])
    kept = near(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 4] and kept.columns == docs.columns
    masked = private(spark, kept, "")
    assert {r.doc_id: r.text for r in masked.collect()}[3] == "write to <EMAIL> now" and masked.columns == docs.columns
    assert pack(spark, masked, "").count() == 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


def test_stages_keep_columns_that_share_names_with_helpers(spark, labelled):
    _, labels, _ = labelled
    names = ["_found", "_merged", "_toxicity", "_gone", "found_spans", "merged_spans", "toxicity", "gone_id", "score", "component_id", "kept"]
    docs = spark.createDataFrame([(1, "write to a@b.co or c@d.org", *names), (2, "re in", *names), (None, None, *names)],
                                 f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    for out in (pii.redact(docs), toxicity.reject(docs, labels), cpsjoin.keep_first(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == 3
        assert all(tuple(r[n] for n in names) == tuple(names) for r in rows)
    assert [r.text for r in pii.redact(docs).where("doc_id = 1").collect()] == ["write to <EMAIL> or <EMAIL>"]


def test_pipeline_from_end_to_end(spark):
    """Against each step done plainly: scores of the toxicity report, groups by brute force, tokens by the library."""
    import corpus_pipeline
    import public_tokenizers
    from test_llm_links import brute_groups
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.report(docs, labels).where("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic]
    kept = {i for i, (_, _, first) in brute_groups(left, 5).items() if first}
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder.no_truncation()
    encoder.no_padding()
    masked = {r.doc_id: r.text for r in pii.redact(docs).select("doc_id", "text").collect()}
    want = {i: len(encoder.encode(masked[i] or "", add_special_tokens=False).ids) + 1 for i in kept}
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = {}
    for r in pieces:
        assert got.setdefault(r.doc_id, r.doc_tokens) == r.doc_tokens
    assert got == want
    assert sum(r.length for r in pieces) == sum(want.values())


def test_page_records_become_digests(spark):
    pages = spark.createDataFrame([(4, "http://a.com/x", "<p>é"), (3, "http://a.com/x", "b"), (None, None, None)], "page_id long, url string, html string")
    got = {r.record_id: r for r in warc.digests(warc.resolve(warc.parse_records(warc.page_records(pages)))).collect()}
    assert got["f4"].payload_sha256 == hashlib.sha256("<p>é".encode()).hexdigest() and got["f4"].payload_chars == 4
    assert got["r3"].outcome == "changed"


def test_plain_words_are_coded_without_pattern(monkeypatch):
    import zlib
    from types import SimpleNamespace

    words = ["plain", "comma,", "End.", "a", "of", "xn", "what?!", "plain", "dot.ted", "e-mail", "(x)", "42", "...", "café", "漢字", "w" * 30, "w" * 20 + "."]
    asked, real = [], toxicity.JOINTS
    monkeypatch.setattr(toxicity, "JOINTS", SimpleNamespace(split=lambda w: asked.append(w) or real.split(w)))
    coder = toxicity.Words()
    codes = coder.codes(words)
    keys, marks = coder.taken()
    expected = []
    for word in words:
        parts = [p for p in real.split(word) if p]
        units = [word, *parts] if parts and not word.startswith(parts[0]) or len(parts) > 1 else [word]
        for u in units:
            expected.append([zlib.crc32(u.encode()) % toxicity.BUCKETS, *(zlib.crc32(u[:n].encode(), n) % toxicity.BUCKETS for n in toxicity.PREFIXES)])
        if len(word) > toxicity.LONG or not word.isascii() and toxicity.UNSPACED.search(word):
            expected += [[zlib.crc32(word[i:i + n].encode(), n) % toxicity.BUCKETS for n in (2, *toxicity.PREFIXES)] for i in range(len(word))]
    assert keys[codes].tolist() == expected
    assert len(marks) == len(keys) and coder.codes(["plain"]).tolist() == codes[:1].tolist()
    assert not set(asked) & {"plain", "comma,", "End.", "a", "of", "xn", "what?!"}
