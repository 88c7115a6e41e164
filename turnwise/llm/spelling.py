"""Spelling variants: words one edit apart, found by a scan of the sorted vocabulary.

The vocabulary is scanned in order.  For all words sought the rows of the edit matrix, three cells wide
(the band of one edit), stand on a stack, one entry for each character of the scanned word; the next
word keeps the entries of the prefix it shares with the last one and computes the others.  An entry holds
only the words still within one edit; where none is left, all words that share this prefix are skipped.

The scan is dealt to tasks by what two words one edit apart must share: of a shorter length m, the
first m // 2 characters or the last m - m // 2.  A list is the words of length m and m + 1 that share
them, forwards or reversed, and the words of length m are sought in it.  A list longer than ``LIST`` is
parted again: words that share one character more, and words that differ exactly at the next character
and share all that follows.  So no list grows with a common prefix, and no pair is lost.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: A-Z become a-z; letters a-z and U+00C0 to U+00FF stay; any other character is a border.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: One occurrence of a word in a text of so many loses a letter.
DAMAGED = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Words a task counts before it gives the counts out; words of one list; characters split at once.
HELD, LIST, STRETCH = 400_000, 20_000, 4 << 20
#: Words of the vocabulary for each task of the scan (a word is in four lists and more).
TASK_WORDS = 10_000
MEMBERS = "side string, m int, h int, key string, word string"


def runs_of_letters(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters in Latin-1 bytes, a stretch of the text at a time."""
    raw, at = text.encode("latin-1", "replace").translate(LETTERS), 0
    while at < len(raw):
        end = at + STRETCH
        end = len(raw) if end >= len(raw) else raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def damaged(doc_id: int | None, counts: Counter[bytes]) -> Iterator[tuple[bytes, int]]:
    """Words of one text: where ``DAMAGED`` divides the checksum of id and run, a letter goes.

    A text without id keeps its letters.
    """
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in counts.items():
        if len(run) < LEAST_LETTERS:
            continue
        if start is not None:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % DAMAGED == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
                if len(run) < LEAST_LETTERS:
                    continue
        yield run, n


def vocabulary(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(word, n) of all words long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts: Counter[bytes] = Counter()
                for runs in runs_of_letters(text or ""):
                    counts.update(runs)
                for word, n in damaged(doc_id, counts):
                    total[word] += n
                if len(total) >= held:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(f"n >= {LEAST_COUNT}")


def _counted(total: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def first_lists(words: DataFrame) -> DataFrame:
    """Members of the lists that every word belongs to, as shorter and as longer word, from both sides.

    ``side`` f: the key is the first ``h`` characters; b: the same of the reversed word; words are
    stored as they are scanned.
    """
    each = words.selectExpr("word", "explode(array(length(word), length(word) - 1)) AS m")
    sides = each.selectExpr("m", "inline(array(named_struct('side', 'f', 'h', m div 2, 'word', word), "
                            "named_struct('side', 'b', 'h', m - m div 2, 'word', reverse(word))))")
    return sides.selectExpr("side", "m", "CAST(h AS INT) AS h", "substr(word, 1, CAST(h AS INT)) AS key", "word")


def parted_lists(members: DataFrame) -> DataFrame:
    """Each list in two ways: one character more shared (``h`` + 1), or the next one edited.

    The second kind (side upper case, which is not parted again) shares the first ``h`` characters and
    what follows the edited one in the shorter word: the last m - h - 1 characters where one is
    replaced, the last m - h where one is inserted.
    """
    more = members.where("h < m").selectExpr("side", "m", "h + 1 AS h", "substr(word, 1, h + 1) AS key", "word")
    edited = members.selectExpr(
        "upper(side) AS side", "m", "h", "word",
        "explode(CASE WHEN length(word) > m THEN array(concat('+', substr(word, 1, h), '|', substr(word, h + 2))) "
        "WHEN h < m THEN array(concat('=', substr(word, 1, h), '|', substr(word, h + 2)), concat('+', substr(word, 1, h), '|', substr(word, h + 1))) "
        "ELSE array(concat('+', substr(word, 1, h), '|', substr(word, h + 1))) END) AS key")
    return more.unionByName(edited)


def scan(words: list[str], m: int, h: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of the sorted ``words`` (of length m or m + 1, their first ``h`` characters equal),
    the first of each pair of length ``m``."""
    sought = [w for w in words if len(w) == m]
    if not sought or len(words) < 2:
        return
    codes = np.full((len(sought), m + 3), -1, np.int32)
    codes[:, :m] = np.frombuffer("".join(sought).encode("utf-32-le"), "<i4").reshape(-1, m)
    start = np.repeat(np.array([[1, 0, 1]], np.int8), len(sought), axis=0)
    stack, last, dead = [(np.arange(len(sought)), start)], words[0][:h], None
    for word in words:
        shared = h
        most = min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        last = word
        if dead is not None and shared >= dead:
            continue
        dead = None
        del stack[shared - h + 1:]
        for d in range(shared + 1, len(word) + 1):
            alive, row = stack[-1]
            here = codes[alive]
            c = ord(word[d - 1])
            # cells of row d at columns d - 1, d and d + 1 from those of row d - 1 at d - 2, d - 1 and d
            left = np.minimum(row[:, 0] + (here[:, d - 2] != c), row[:, 1] + 1)
            middle = np.minimum(np.minimum(row[:, 1] + (here[:, d - 1] != c), row[:, 2] + 1), left + 1)
            right = np.minimum(row[:, 2] + (here[:, d] != c), middle + 1)
            cells = np.stack([left, middle, right], axis=1).astype(np.int8)
            near = cells.min(axis=1) <= 1
            if not near.any():
                dead = d
                break
            stack.append((alive[near], cells[near]))
        else:
            alive, row = stack[-1]
            for k in alive[row[:, 1 - (len(word) - m)] == 1].tolist():
                yield sought[k], word


def near_pairs(members: DataFrame, tasks: int) -> DataFrame:
    """(word, near): both directions of every pair of words one edit apart, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        pairs: list[tuple[str, str]] = []
        for (side, m, h, _), own in itertools.groupby(rows, key=lambda r: r[:4]):
            turn = -1 if side in "bB" else 1
            for a, b in scan([r[4] for r in own], m, h):
                pairs += [(a[::turn], b[::turn])] if len(b) == m else [(a[::turn], b[::turn]), (b[::turn], a[::turn])]
                if len(pairs) >= 50_000:
                    yield _paired(pairs)
                    pairs = []
        yield _paired(pairs)

    dealt = members.repartition(tasks, "side", "m", "h", "key").sortWithinPartitions("side", "m", "h", "key", "word")
    return dealt.mapInArrow(run, "word string, near string").distinct()


def _paired(pairs: Iterable[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["word", "near"])


def lists(words: DataFrame, most: int = LIST) -> DataFrame:
    """Lists of at most ``most`` words, as far as parting can make them so; lists of one word are left out."""
    keys, done = ["side", "m", "h", "key"], []
    open_lists = first_lists(words)
    while True:
        open_lists = written(open_lists, "lists")
        sizes = open_lists.groupBy(*keys).agg(F.count("*").alias("size"), F.count_if(F.expr("length(word) = m")).alias("short"))
        sized = open_lists.join(sizes.where("size > 1 AND short > 0"), keys)
        large = f"size > {most} AND side IN ('f', 'b')"
        done.append(sized.where(f"NOT ({large})").select(*keys, "word"))
        rest = sized.where(large).select(*keys, "word")
        if rest.isEmpty():
            break
        open_lists = parted_lists(rest)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of the chain of forms.

    Pointers are doubled until none moves; a form is at least twice as frequent as its word, so a chain
    has at most as many words as a count has bits, and few rounds are made.
    """
    current = written(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        onward = current.selectExpr("word AS root", "root AS further")
        if current.join(onward, "root", "left_semi").isEmpty():
            return current
        current = written(current.join(onward, "root", "left").selectExpr("word", "coalesce(further, root) AS root"), "roots")


def variants(docs: DataFrame, most: int = LIST) -> DataFrame:
    """Every word of ``docs`` (doc_id, text) with its count, near words, form and root.

    A null or empty text has no words; a null doc_id damages none; repeated rows count each; other
    columns are not read.  Near words of equal count: the smallest in code-point order is the form.
    An empty table gives no rows.
    """
    words = written(vocabulary(docs), "vocabulary")
    near = near_pairs(lists(words.select("word"), most), 1 + words.count() // TASK_WORDS)
    counted = near.join(words.selectExpr("word AS near", "n AS near_n"), "near")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = written(words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near",
        "CASE WHEN -best.less >= 2 * n THEN best.near END AS form", "CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n"), "forms")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").selectExpr("word", "n", "n_near", "form", "form_n", "coalesce(root, word) AS root")
