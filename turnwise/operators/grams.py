"""Character grams of words, hashed as Spark's ``hash`` does, and the counts of a batch of texts.

A text's character grams follow from its words.  ``gram_cells`` counts them for each text; blocks of texts
(``GramBlock``) keep the words instead, each with its grams once a block, and the length of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .sparse import sums_of

LENGTHS = (3, 4, 5)
#: Grams of texts that are counted at once, and texts at most; a text is never parted.
ENTRIES, TEXTS = 1 << 22, 1 << 14
#: Numbers and words of a block, as often as they occur; a longer text is a block of its own.
BLOCK_ENTRIES = 1 << 22
#: Cells of texts by gram that are counted at once for the lengths.
DENSE = 1 << 20
#: Whole numbers in as few bytes as hold them, then lengths and labels; columns of the texts as an Arrow stream.
PARTS = ("fold", "number_sizes", "numbers", "number_counts", "word_sizes", "words", "word_counts", "group_sizes", "group_words", "grams",
         "label", "number_lengths", "word_lengths", "rows")


def murmur(items: list[bytes], seed: int = 42) -> np.ndarray:
    """Spark's 32-bit ``hash`` of strings, by groups of equal length."""
    out, sizes = np.zeros(len(items), np.int32), np.array([len(x) for x in items], np.int64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([items[i] for i in own]), np.uint8).reshape(len(own), size)
        whole = size - size % 4
        words = [*np.ascontiguousarray(raw[:, :whole]).view("<u4").T, *raw[:, whole:].view(np.int8).astype(np.int32).view(np.uint32).T]
        out[own] = _mixed(words, np.full(len(own), seed, np.uint32), size)
    return out


def _mixed(words: list[np.ndarray], h: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` bytes that ``words`` hold by fours, the last ones one by one."""
    turned = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for k in words:
        h = turned(h ^ turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(size)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _windows(letters: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Hashes of all stretches of ``n`` letters of words of one length (words x letters, plain ASCII)."""
    many = letters.shape[1] - n + 1
    by_letter = [letters[:, i:i + many].astype(np.uint32) for i in range(n)]
    words = [by_letter[i] | by_letter[i + 1] << np.uint32(8) | by_letter[i + 2] << np.uint32(16) | by_letter[i + 3] << np.uint32(24)
             for i in range(0, n - 3, 4)]
    return _mixed([*words, *by_letter[n - n % 4:]], np.full((len(letters), many), seed, np.uint32), n)


def word_table(words: pa.LargeStringArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character grams of words with a blank on either side, the words put in order of their number of grams.

    Each word's place in that order, where each place's grams begin (one more than words), and the buckets of all grams.
    """
    size, letters = pc.utf8_length(words).to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy(zero_copy_only=False)
    number = sum(np.where(size > 0, np.maximum(size + 3 - n, 0), 0) for n in LENGTHS)
    order = np.argsort(number, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.concatenate([[0], number[order].cumsum()]).astype(np.int64)
    out, plain = np.zeros(first[-1], np.int64), size == letters
    offsets, raw = (np.frombuffer(b, kind) for b, kind in zip(words.buffers()[1:], ("<i8", "u1"))) if len(words) else (None, None)
    for n in np.unique(size[plain & (size > 0)]).tolist():
        own = np.flatnonzero(plain & (size == n))
        letter = np.full((len(own), n + 2), ord(" "), np.uint8)
        letter[:, 1:-1] = raw[offsets[own + words.offset][:, None] + np.arange(n)]
        hashed = np.concatenate([_windows(letter, k) for k in LENGTHS if k <= n + 2], axis=1)
        out[first[place[own]][:, None] + np.arange(hashed.shape[1])] = hashed.astype(np.int64) % buckets
    own = np.flatnonzero(~plain)
    if len(own):
        starts, grams = word_grams([f" {w} " for w in words.take(pa.array(own)).to_pylist()], buckets)
        out[_spans(first[place[own]], np.diff(starts))] = grams
    return place, first, out


def word_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's character grams begin (one more than words), and the buckets of all of them."""
    known: dict[str, int] = {}
    codes, ends = [], [0]
    for w in words:
        codes += [known.setdefault(w[i:i + n], len(known)) for n in LENGTHS for i in range(len(w) - n + 1)]
        ends.append(len(codes))
    hashed = murmur([g.encode() for g in known]).astype(np.int64) % buckets
    return np.array(ends), hashed[np.array(codes, np.int64)] if codes else np.zeros(0, np.int64)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places ``first .. first + count - 1``, one span after another."""
    ends = count.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def gram_cells(numbers: pa.ListArray, words: pa.ListArray, buckets: int) -> Iterator[tuple[int, int, pa.ListArray, pa.ListArray]]:
    """(first row, rows, buckets, values) of stretches of a batch.

    ``numbers`` holds a row's buckets below ``buckets`` as often as they occur, ``words`` the words whose
    character grams take the buckets above.  Values are counts over the length of either part.
    """
    flat = words.flatten().dictionary_encode()
    first, grams = word_grams(flat.dictionary.to_pylist(), buckets)
    size = max(1, len(first) - 1)
    place = lambda lists: np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    held, times = np.unique(place(words) * size + flat.indices.to_numpy(), return_counts=True)
    row, word = held // size, held % size
    count = first[word + 1] - first[word]
    plain_row, plain = place(numbers), numbers.flatten().to_numpy().astype(np.int64)
    entries = np.bincount(row, count, len(words)).cumsum() + np.bincount(plain_row, minlength=len(words)).cumsum()
    start = 0
    while start < len(words):
        before = entries[start - 1] if start else 0
        end = max(start + 1, min(start + TEXTS, int(np.searchsorted(entries, before + ENTRIES))))
        (a, b), (c, d) = np.searchsorted(row, [start, end]), np.searchsorted(plain_row, [start, end])
        cell = np.repeat((row[a:b] - start) * 2 * buckets + buckets, count[a:b]) + grams[_spans(first[word[a:b]], count[a:b])]
        cell = np.concatenate([cell, (plain_row[c:d] - start) * 2 * buckets + plain[c:d]])
        weight = np.concatenate([np.repeat(times[a:b], count[a:b]), np.ones(d - c, np.int64)])
        yield start, end - start, *_counted(cell, weight, end - start, buckets)
        start = end


def _counted(cell: np.ndarray, weight: np.ndarray, rows: int, buckets: int) -> tuple[pa.ListArray, pa.ListArray]:
    order = np.argsort(cell)
    cell, weight = cell[order], weight[order]
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    n, cell = np.add.reduceat(weight, new).astype(float) if len(new) else np.zeros(0), cell[new]
    part = cell // buckets
    value = n / np.sqrt(np.bincount(part, n * n, 2 * rows))[part]
    offsets = pa.array(np.searchsorted(cell, np.arange(rows + 1) * 2 * buckets).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array((cell % (2 * buckets)).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(value)))


@dataclass
class GramBlock:
    """Texts with their distinct numbers and words, how often each occurs, and the grams of each word of the block.

    ``margins`` and ``add`` are those of a ``sparse.Block`` of ``gram_cells``: a number's value is its count over the
    length of the text's number counts, a gram's likewise, and the grams of all words are summed through the words.
    Words are in groups of equally many grams, whose grams are tables of grams by word.
    """

    buckets: int
    fold: np.ndarray
    number_sizes: np.ndarray
    numbers: np.ndarray
    number_counts: np.ndarray
    word_sizes: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    group_sizes: np.ndarray
    group_words: np.ndarray
    grams: np.ndarray
    label: np.ndarray
    number_lengths: np.ndarray
    word_lengths: np.ndarray
    rows: pa.RecordBatch | None

    @property
    def weight(self) -> np.ndarray:
        return np.ones(len(self.label))

    def groups(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Words of each group, and their grams, a row for the first gram of each word, one for the second and so on."""
        word = gram = 0
        for size, many in zip(self.group_sizes.tolist(), self.group_words.tolist(), strict=True):
            yield slice(word, word + many), self.grams[gram:gram + size * many].reshape(size, many)
            word, gram = word + many, gram + size * many

    def margins(self, weights: np.ndarray, scale: None = None) -> tuple[np.ndarray, None]:
        """Linear predictors, rows x models; ``weights`` has a row for each model, the intercept last."""
        out, word = [], np.zeros((len(weights), int(self.group_words.sum())))
        for own, grams in self.groups():
            for gram in grams:
                for k, at in enumerate(weights):
                    word[k, own] += at[self.buckets:].take(gram)
        plain, spoken = np.empty(len(self.numbers)), np.empty(len(self.words))
        for at, score in zip(weights, word, strict=True):
            at.take(self.numbers, out=plain, mode="clip")
            score.take(self.words, out=spoken, mode="clip")
            plain *= self.number_counts
            spoken *= self.word_counts
            out.append(sums_of(plain, self.number_sizes) / self.number_lengths + sums_of(spoken, self.word_sizes) / self.word_lengths + at[-1])
        return np.stack(out, axis=1), None

    def add(self, sums: np.ndarray, own: np.ndarray, held: None = None) -> None:
        """Add each model's residuals (rows x models) times the texts to ``sums``, models x 2 buckets."""
        words = int(self.group_words.sum())
        score = np.zeros((len(sums), words))
        for k, r in enumerate(own.T):
            plain, spoken = np.repeat(r / self.number_lengths, self.number_sizes), np.repeat(r / self.word_lengths, self.word_sizes)
            plain *= self.number_counts
            spoken *= self.word_counts
            sums[k, :self.buckets] += np.bincount(self.numbers, plain, self.buckets)
            score[k] = np.bincount(self.words, spoken, words)
        for mine, grams in self.groups():
            flat = grams.ravel()
            for k in range(len(sums) if len(flat) else 0):
                sums[k, self.buckets:] += np.bincount(flat, np.tile(score[k, mine], len(grams)), self.buckets)


def _tallied(place: np.ndarray, item: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items of each row: how many, which, and how often each occurs."""
    size = int(item.max()) + 1 if len(item) else 1
    cell, count = np.unique(place * size + item, return_counts=True)
    return np.bincount(cell // size, minlength=rows), cell % size, count


def _lengths(squares: np.ndarray) -> np.ndarray:
    return np.where(squares > 0, np.sqrt(squares), 1.0)


def gram_blocks(rows: pa.RecordBatch, numbers: pa.ListArray, texts: pa.Array, buckets: int,
                entries: int = BLOCK_ENTRIES, dense: int = DENSE) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts of a batch, ``PARTS`` as bytes; ``rows`` are their other columns, fold and label among them.

    ``numbers`` holds a text's buckets as often as they occur, ``texts`` are parted into words at blanks as Java's ``\\s`` does.
    """
    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    held = pc.list_value_length(numbers).to_numpy(zero_copy_only=False) + pc.list_value_length(words).to_numpy(zero_copy_only=False)
    ends, start = held.astype(np.int64).cumsum(), 0
    while start < len(held):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - held[start] + entries, "right")))
        yield _gram_block(rows.slice(start, end - start), numbers.slice(start, end - start), words.slice(start, end - start), buckets, dense)
        start = end


def _gram_block(rows: pa.RecordBatch, numbers: pa.ListArray, words: pa.ListArray, buckets: int, dense: int) -> pa.RecordBatch:
    place = lambda lists: np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    number_sizes, number, number_counts = _tallied(place(numbers), numbers.flatten().to_numpy().astype(np.int64), len(rows))
    flat = words.flatten().dictionary_encode()
    order, first, grams = word_table(flat.dictionary, buckets)
    word_sizes, word, word_counts = _tallied(place(words), order[flat.indices.to_numpy()], len(rows))
    squares = _gram_squares(word_sizes, word, word_counts, first, grams, buckets, dense)
    group_sizes, group_words = np.unique(np.diff(first), return_counts=True)
    starts, tables = 0, []
    for size, many in zip(group_sizes.tolist(), group_words.tolist(), strict=True):
        tables.append(grams[starts:starts + size * many].reshape(many, size).T.ravel())
        starts += size * many
    parts = [rows.column("fold").fill_null(-1).to_numpy(zero_copy_only=False), number_sizes, number, number_counts, word_sizes, word, word_counts,
             group_sizes, group_words, np.concatenate([*tables, np.zeros(0, np.int64)])]
    wide = [rows.column("label").to_numpy(zero_copy_only=False), _lengths(sums_of(number_counts.astype(float) ** 2, number_sizes)), _lengths(squares)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    kinds = [np.promote_types(np.min_scalar_type(x.min(initial=0)), np.min_scalar_type(x.max(initial=0))) for x in parts]
    blobs = [x.astype(kind).tobytes() for x, kind in zip(parts, kinds, strict=True)] + [x.astype("<f8").tobytes() for x in wide]
    return pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, kinds))]), *(pa.array([b], pa.binary()) for b in (*blobs, sink.getvalue().to_pybytes()))],
                                      names=["kinds", *PARTS])


def _gram_squares(sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, first: np.ndarray, grams: np.ndarray, buckets: int, dense: int) -> np.ndarray:
    """Sum of squared gram counts of each text, some texts at a time as a table of texts by gram."""
    seen = np.bincount(grams, minlength=buckets) > 0
    own, width = (seen.cumsum() - 1)[grams], max(1, int(seen.sum()))
    ends, out, step = sizes.cumsum(), np.zeros(len(sizes)), max(1, dense // width)
    for a in range(0, len(sizes), step):
        b = min(a + step, len(sizes))
        part = slice(ends[a] - sizes[a], ends[b - 1])
        many = first[words[part] + 1] - first[words[part]]
        cell = np.repeat(np.repeat(np.arange(b - a) * width, sizes[a:b]), many) + own[_spans(first[words[part]], many)]
        table = np.bincount(cell, np.repeat(counts[part], many), (b - a) * width).reshape(b - a, width)
        out[a:b] = np.einsum("ij,ij->i", table, table)
    return out


def opened_grams(buckets: int, columns: bool = False):
    """How to read the blocks of a batch, with the columns of their texts where asked."""

    def opened(batch: pa.RecordBatch) -> Iterator[GramBlock]:
        for i in range(batch.num_rows):
            raw = [batch.column(c)[i].as_buffer() for c in PARTS]
            kinds = [*batch.column("kinds")[i].as_py().split(), "f8", "f8", "f8"]
            parts = [np.frombuffer(b, kind) for b, kind in zip(raw, kinds)]
            wide = [x.astype(float if c.endswith("counts") else np.int64) if x.dtype != float else x for c, x in zip(PARTS, parts)]
            yield GramBlock(buckets, *wide, next(iter(pa.ipc.open_stream(raw[-1]))) if columns else None)

    return opened
