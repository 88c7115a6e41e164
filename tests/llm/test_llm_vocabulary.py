"""Source divergence, spelling variants and repeated passages against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from turnwise.llm import spelling, spimi, substrings
from turnwise.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- divergence ------------------------------------------------------------------------
def plain_divergences(docs, least, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = []
    texts = [((t or "").translate(lower), lang or "", source or "") for _, t, lang, source in docs]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in texts]
    for lang in {x[1] for x in texts}:
        here = [(t, s) for t, (_, own, s) in zip(terms, texts) if own == lang]
        df, tf = Counter(), defaultdict(Counter)
        for t, s in here:
            df.update(set(t))
            tf[s].update(t)
        kept = sorted(t for t in df if df[t] >= least)
        total = Counter()
        for c in tf.values():
            total.update({t: c[t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in tf.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in tf:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in tf if o != s)
            marks = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if tf[s][t] and p[s][t] > q[t])[:top]
            for part, own in (("pair", pairs), ("term", marks)):
                found += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(own, 1)]
    return sorted(found, key=repr)


def made_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["Apple", "apple", "pear", "ÉTÉ", "été", "名前", "x", "y'z", "a1b", "the", "The"] + [f"w{c}" for c in "abcdefghij"]
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30]))) if rng.random() > 0.05 else None
        docs.append((i // 2, text, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None])))
    return docs + [(-1, "one two", "xx", "alone"), (-2, "", "yy", "s"), (-3, None, "yy", "t"), (-4, "apple " * 5000, "en", "long")]


@pytest.mark.parametrize("postings, fan_in, shard_bytes", [(10, 3, 200), (10**6, 256, 1 << 20)])
def test_divergences(spark, monkeypatch, postings, fan_in, shard_bytes):
    """Many small runs merged in several rounds, and one run; both equal plain counting."""
    docs = made_docs(1)
    whole = spimi.kept_terms
    monkeypatch.setattr(spimi, "kept_terms", lambda rows, least: whole(rows, least, postings, fan_in, shard_bytes))
    monkeypatch.setattr(spimi, "SLICE", 3)
    monkeypatch.setattr(spimi, "STRETCH", 64)
    monkeypatch.setattr(spimi, "TILE", 2)
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS term", "2 AS idx", "3 AS n").repartition(5)
    for least in (3, 10):
        assert rows_of(spimi.divergences(frame, least)) == plain_divergences(docs, least)


def test_divergences_of_nothing(spark):
    found = spimi.divergences(spark.createDataFrame([], DOCS))
    assert found.collect() == []
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]


# --- spelling --------------------------------------------------------------------------
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out, key=repr)


def misspelt(seed, stems, size):
    rng = random.Random(seed)
    letters, words = "abcdeÉÿ", []
    for stem in stems:
        for _ in range(size):
            w, i = stem, rng.randrange(len(stem) + 1)
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]])
            words += [w] * rng.choice([1, 3, 4, 9])
    rng.shuffle(words)
    return [(i // 30, " ".join(words[i:i + 30])) for i in range(0, len(words), 30)]


@pytest.mark.parametrize("most", [4, 20_000])
def test_variants(spark, most):
    """Lists parted down to a few words, and whole ones; both equal a comparison of all pairs."""
    docs = misspelt(3, ["banana", "cabbage", "aaaaaaa", "prefixedbyalongstemabc", "dadada"], 60)
    docs += [(None, "Banana BANANA banana"), (7, None), (7, ""), (8, "名前 x1y\x00z×÷×÷× " * 4), (9, "banana " * 30_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS near")
    want = plain_variants(docs)
    assert sum(r[3] is not None for r in want) > 30 and any(r[5] != r[3] for r in want if r[3])
    assert rows_of(spelling.variants(frame, most)) == want


def test_damage_reads_the_checksum_of_id_and_run():
    for doc_id, run in itertools.product(range(300), ("letters", "élèves")):
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        want = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
        assert list(spelling.damaged(doc_id, Counter([run.encode("latin-1")]))) == [(want.encode("latin-1"), 1)]


def test_scan_equals_all_pairs():
    rng = random.Random(5)
    for m, h in itertools.product((4, 5, 7), (1, 2)):
        words = sorted({"a" * h + "".join(rng.choices("abc", k=rng.choice([m, m + 1]) - h)) for _ in range(60)})
        want = {(a, b) for a in words if len(a) == m for b in words if one_edit(a, b)}
        assert set(spelling.scan(words, m, h)) == want


def test_letters_are_split_in_stretches(monkeypatch):
    text = "Abc défΔghi  " * 50 + "z" * 100
    monkeypatch.setattr(spelling, "STRETCH", 16)
    assert [w.decode("latin-1") for part in spelling.runs_of_letters(text) for w in part] == ["abc", "déf", "ghi"] * 50 + ["z" * 100]


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- repeated passages -----------------------------------------------------------------
def plain_repeats(docs):
    rank = lambda i: float("inf") if i is None else i
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in docs]
    least = {}
    for i, words in split:
        for k in range(len(words) - 12):
            w = tuple(words[k:k + 13])
            least[w] = min(least.get(w, float("inf")), rank(i))
    out = []
    for i, words in split:
        gone = {j for k in range(len(words) - 12) if least[tuple(words[k:k + 13])] < rank(i) for j in range(k, k + 13)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 15, 19, 20, 40)]
    docs = []
    for i in range(160):
        words = [word() for _ in range(rng.choice([0, 3, 12, 13, 30]))]
        for _ in range(rng.choice([0, 1, 2])):
            words += rng.choice(shared) + [word() for _ in range(rng.randrange(5))]
        docs.append((rng.choice([i, i, i // 3, None, -i]), rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    docs += [(5, None), (6, ""), (7, " \n "), (1000, "a b " * 2000), (999, "a b " * 20), (1001, "x y " * 30), (1002, "x y " * 13), (1002, "x y " * 13)]
    return docs


@pytest.mark.parametrize("block_bytes, part_bytes", [(300, 500), (1 << 24, 1 << 22)])
def test_repeats(spark, block_bytes, part_bytes):
    """Many blocks and parts, and one of each; both equal a table of all windows."""
    docs = passages(11)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS part", "3 AS kind").repartition(4)
    want = plain_repeats(docs)
    assert sum(r[2] > 0 for r in want) > 50
    assert rows_of(substrings.without_repeats(frame, block_bytes, part_bytes, texts=True)) == want


def test_cover_meets_every_shift():
    for shift in range(substrings.PERIOD):
        assert any((a - b) % substrings.PERIOD == shift for a in substrings.COVER for b in substrings.COVER)


def test_repeats_of_nothing(spark):
    found = substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == [] and found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_queries_are_registered():
    assert {"op11_spimi", "op12_spelling", "op13_difference_cover"} <= set(QUERIES)
