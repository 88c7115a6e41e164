"""Whole-text encoding by a word-level BPE vocabulary, one encode per distinct word.

The vocabulary drops white space, so a text's ids are the ids of its blank-separated chunks in
order.  Each Python worker keeps recent chunks in a bounded cache.  Chunks of plain Latin text are
merged by tiktoken's loop over the same ranks (a word end is one more byte); every other chunk
goes to the tokenizers library itself.  Both give the same ids (tests compare them).
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

END = b"\xff"
#: Characters that composition leaves alone and that lower-case without context (not U+0130).
PLAIN = re.compile("[\x21-\x7e\xc0-\u012f\u0131-\u017f]+")
#: Chunks kept by one worker, twice at most (recent and older ones); about 200 bytes each.
CACHED = 120_000
LONGEST = 64


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """``encode(text)``: ids of one text as little-endian unsigned 16- or 32-bit numbers."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        ranks, ids = _ranks(vocabulary, spec["model"]["merges"])
        self.coded = [np.array([i], self.dtype).tobytes() for i in ids]
        core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.merge = core.encode_single_piece
        self.new, self.old = {"": b""}, {}

    def encode(self, text: str) -> np.ndarray:
        chunks = text.replace("\n", " ").split(" ")
        try:
            joined = b"".join([self.new[c] for c in chunks])
        except KeyError:
            joined = self._with_missing(chunks)
        return np.frombuffer(joined, self.dtype)

    def _with_missing(self, chunks: list[str]) -> bytes:
        found = {}
        for c in set(chunks):
            known = self.new.get(c)
            if known is None:
                known = self.old.get(c)
                if known is None:
                    known = self._chunk(c)
                if len(c) <= LONGEST:
                    self.new[c] = known
            found[c] = known
        joined = b"".join([found[c] for c in chunks])
        if len(self.new) > CACHED:
            self.new, self.old = {"": b""}, self.new
        return joined

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not PLAIN.fullmatch(chunk):
            ids = self.exact.encode(chunk, add_special_tokens=False).ids
            return np.array(ids, self.dtype).tobytes()
        lowered, coded = chunk.lower(), self.coded
        words = [lowered] if lowered.isalpha() else self.words.findall(lowered)
        return b"".join([coded[r] for w in words for r in self.merge(w.encode() + END)])


def _ranks(vocabulary: dict[str, int], merges: list) -> tuple[dict[bytes, int], list[int]]:
    """Byte strings by merge order, a closing byte for the word end, and the id of each rank."""
    letters = _byte_letters()

    def raw(token: str) -> bytes:
        body, closed = (token[:-4], END) if token.endswith("</w>") else (token, b"")
        return bytes(letters[c] for c in body) + closed

    ranks, ids = {}, []
    for closed in ("", "</w>"):
        for letter, byte in letters.items():
            ranks[bytes([byte]) + (END if closed else b"")] = len(ids)
            ids.append(vocabulary.get(letter + closed, 0))
    for pair in merges:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks.setdefault(raw(left + right), len(ids))
        ids.append(vocabulary[left + right])
    return ranks, ids


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One coder per Python worker."""
    return WordBpe(path)
