"""Token ids of a byte-level BPE tokenizer for whole columns of text.

The tokenizer's own pattern cuts a text into pre-tokens; here the cuts are found with NumPy over all characters
of a chunk, and every distinct pre-token is encoded by the library once and kept. Which class a character has
for the pattern (letter, number, white space, other) is asked of the library itself.
"""

from __future__ import annotations

import os

import numpy as np

from plumbline.llm.text import coded

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 0, 255
#: Bytes of distinct pre-tokens and their ids in each half of a worker's cache, with ENTRY_BYTES more for each.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 160
#: The characters by which a byte-level vocabulary writes bytes: printable ones for themselves, the others in
#: order from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
#: What the pattern splits off after an apostrophe.
SUFFIXES = (("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l"))


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Classes:
    """table[chars]: the class of each code point, asked of the library when it is first met: a character makes one
    pre-token with a letter, a digit or a hyphen before it, or none of these."""

    def __init__(self, tokenizer):
        self.cut, self.known = tokenizer.pre_tokenizer, np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._learn(np.arange(0x250, dtype=np.uint32))

    def _learn(self, points: np.ndarray) -> None:
        self.known[points] = SPACE
        for before, kind in (("a", LETTER), ("1", NUMBER), ("-", OTHER)):
            triples = np.empty((len(points), 3), dtype="<u4")
            triples[:, 0], triples[:, 1], triples[:, 2] = ord("\n"), ord(before), points
            at = np.array([place for _, place in self.cut.pre_tokenize_str(triples.tobytes().decode("utf-32-le"))])
            together = np.flatnonzero((at[:, 0] % 3 == 1) & (at[:, 1] - at[:, 0] >= 2))
            self.known[points[at[together, 0] // 3]] = kind

    def __getitem__(self, chars: np.ndarray) -> np.ndarray:
        kind = self.known[chars]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(chars[kind == UNKNOWN]))
            kind = self.known[chars]
        return kind


def pre_tokens(chars: np.ndarray, at: np.ndarray, table: Classes) -> np.ndarray:
    """Places where pre-tokens start; at: where rows start, and the end. As the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ cuts each row."""
    n = len(chars)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = table[chars]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[at[at <= n]] = True
    row_start[n] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | row_start[:-1]
    space = kind == SPACE
    blank = np.concatenate(([False], chars[:-1] == 0x20)) & ~row_start[:-1]
    # the last of several spaces before other characters stands apart: it goes with them if it is a blank
    last = space & np.concatenate((change[1:], [True])) & ~row_start[1:]
    start = np.where(space, change | last, change & ~blank)
    for mark in np.flatnonzero((chars == 0x27) & start).tolist():
        for suffix in SUFFIXES:
            end = mark + 1 + len(suffix)
            if end <= n and not row_start[mark + 1 : end].any() and all(chars[mark + 1 + i] == ord(c) for i, c in enumerate(suffix)):
                start[mark + 1] = False
                if end < n:
                    start[end] = True
                break
    return np.flatnonzero(start)


class Encoder:
    """ids(raw, at): the token ids of each row, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.table = Classes(self.tokenizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newer: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.first, self.size = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _entries(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in `first` and `size`; words not met lately are encoded. When the newer half of
        the cache is full it becomes the older half, so that words which recur stay."""
        if self.held > CACHE_BYTES:
            self.older, self.newer, self.held = self.newer, {}, 0
            kept = np.fromiter(self.older.values(), dtype=np.int64, count=len(self.older))
            first, size = self.first[kept], self.size[kept]
            ends = np.cumsum(size)
            self.pool = self.pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]
            self.first, self.size = ends - size, size
            self.older = {w: i for i, w in enumerate(self.older)}
        fresh, lengths, ids = len(self.first), [], []
        newer, older, tokenize = self.newer, self.older, self.tokenizer.model.tokenize
        out = list(map(newer.get, words))
        for place in [i for i, at in enumerate(out) if at is None]:
            word = words[place]
            at = older.get(word)
            if at is None:
                found = [t.id for t in tokenize(word.decode("latin-1").translate(_BYTE_CHARS))]
                at = fresh + len(lengths)
                lengths.append(len(found))
                ids += found
            newer[word] = out[place] = at
            self.held += ENTRY_BYTES + 5 * len(word)
        size = np.array(lengths, dtype=np.int64)
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, np.array(ids, dtype=np.uint32)))
        return np.array(out, dtype=np.int64)

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and where each row's begin (and the end)."""
        text = raw.tobytes()
        if any(s in text for s in self.special):
            return self._plain(text, at)
        chars = np.frombuffer(text.decode().encode("utf-32-le"), dtype="<u4")
        places = np.int32 if len(raw) < 1 << 31 else np.int64
        begins = np.concatenate((np.flatnonzero((raw & 0xC0) != 0x80).astype(places), np.array([len(raw)], places)))
        row_at = np.searchsorted(begins, at)
        start = pre_tokens(chars, row_at, self.table)
        byte = begins[start]
        codes, words = coded(raw, np.diff(np.concatenate((byte, [len(raw)]))))
        entry = self._entries(words)
        first, size = self.first[entry][codes], self.size[entry][codes]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate(([0], ends))
        return ids, upto[np.searchsorted(byte, at)]

    def _plain(self, text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that spell a special token, which the library takes out before it cuts."""
        found = [self.tokenizer.encode(text[a:b].decode(), add_special_tokens=False).ids for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.array([i for f in found for i in f], dtype=np.uint32), np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
