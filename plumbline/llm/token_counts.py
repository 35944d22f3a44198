"""Token counts through a map-side two-tier lookup of pre-token lengths.

No piece of the vocabulary spans the place before a space that follows another character, or a place next to
a line break (`Pieces` checks that on the loaded vocabulary), so a text's tokens are those of its pre-tokens
"spaces + word" and the count is a sum. Tier one is a compact table of frequent pre-tokens and their
lengths, broadcast once. What it misses is encoded by the library and kept in the worker's bounded cache.
Pre-tokens themselves never move: the table's statistics are summaries of a fixed size, one a task, merged in
tasks that read a bounded number of them.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import buffers, chunks, coded, columns

#: Entries of the broadcast table, and of each task's summary; longer pre-tokens are left to the second tier.
TABLE, SUMMARY, LONGEST = 8192, 4096, 64
#: Bytes of pre-tokens that a worker's cache holds, with ENTRY_BYTES more for each, before it starts afresh.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 130

_MARK = b"\xe2\x96\x81"


class Pieces:
    """A sentencepiece model whose tokens can be counted by pre-token."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if "\n" in piece or "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} spans pre-tokens; this vocabulary can't be counted by parts")

    def lengths(self, words: list[bytes]) -> list[int]:
        """Tokens of each pre-token: after the one space that the library itself puts before a text, or, for a
        pre-token without a space, after a line break (a mark and a byte, which are taken off again)."""
        texts = [(w[1:] if w[:1] == b" " else b"\n" + w).decode() for w in words]
        ids = self.model.encode(texts, num_threads=1)
        # b" " alone would be the empty text, for which the library returns nothing: it is the mark itself
        return [(len(x) or 1) if w[:1] == b" " else len(x) - 2 for w, x in zip(words, ids, strict=True)]


def pre_tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Codes of the pre-tokens, the distinct ones, the row of each, and each row's line breaks (a token each).
    A space is put before every text, as the library does."""
    size = np.diff(at)
    # a literal mark character is the same to the library as a space
    if _MARK in (text := raw.tobytes()):
        parts = [text[a:b].replace(_MARK, b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
        raw, size = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts], dtype=np.int64)
    n = len(size)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    data = np.full(begin[-1], 0x20, dtype=np.uint8)
    body = np.ones(len(data), dtype=bool)
    body[begin[:-1]] = False
    data[body] = raw
    space, line = data == 0x20, data == 0x0A
    starts = np.zeros(len(data), dtype=bool)
    starts[1:] = (space[1:] & ~space[:-1]) | line[:-1]
    starts |= line
    starts[begin[:-1]] = True
    first = np.flatnonzero(starts)
    end = np.concatenate((first[1:], [len(data)]))
    row = np.searchsorted(begin, first, "right") - 1
    breaks = line[first]
    lines = np.bincount(row[breaks], minlength=n)
    keep = ~breaks & (size > 0)[row]
    inside = np.repeat(keep, end - first)
    codes, words = coded(data[inside], (end - first)[keep])
    return codes, words, row[keep], lines


def _summary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for batch in batches:
        raw, at = buffers(batch.column("text"))
        for a, b in chunks(at):
            codes, words, _, _ = pre_tokens(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                if len(w) <= LONGEST:
                    count[w] += n
            if len(count) > 8 * SUMMARY:
                count = _cut(count, 4 * SUMMARY)
    yield _packed(count)


def _cut(count: Counter, most: int) -> Counter:
    return Counter(dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most]))


def _packed(count: Counter) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([json.dumps([[w.hex(), n] for w, n in _cut(count, SUMMARY).items()])])], names=["task", "summary"])


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for batch in batches:
        for text in batch.column("summary").to_pylist():
            count.update({bytes.fromhex(w): n for w, n in json.loads(text)})
            if len(count) > 8 * SUMMARY:
                count = _cut(count, 4 * SUMMARY)
    yield _packed(count)


def frequent(docs: DataFrame) -> list[bytes]:
    """Pre-tokens that are frequent over all of docs (text), at most TABLE of them. Summaries are merged a
    square root at a time, so that neither a task nor the driver reads more than that many of them. Which ones
    it finds has no bearing on any count."""
    summaries = docs.mapInArrow(_summary_batches, "task long, summary string")
    groups = max(1, isqrt(docs.rdd.getNumPartitions()))
    merged = summaries.repartition(groups, "task").mapInArrow(_merge_batches, "task long, summary string")
    count: Counter = Counter()
    for row in merged.select("summary").toLocalIterator():
        count.update({bytes.fromhex(w): n for w, n in json.loads(row.summary)})
        count = _cut(count, 2 * TABLE)
    return list(_cut(count, TABLE))


def _counter(path: str, table: dict[bytes, int], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache, held = Pieces(path), {}, 0
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            total = np.zeros(len(at) - 1, dtype=np.int64)
            for a, b in chunks(at):
                codes, words, row, lines = pre_tokens(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                # the extra space of a text that begins with a line break is a token of its own, as in the library
                missed = [w for w in words if w not in table and w not in cache]
                for i in range(0, len(missed), 4096):
                    cache.update(zip(missed[i : i + 4096], pieces.lengths(missed[i : i + 4096]), strict=True))
                sizes = np.fromiter((table[w] if w in table else cache[w] for w in words), dtype=np.int64, count=len(words))
                total[a:b] = lines + np.bincount(row, weights=sizes[codes], minlength=b - a).astype(np.int64)
                held += sum(ENTRY_BYTES + len(w) for w in missed)
                if held > CACHE_BYTES:
                    cache, held = {}, 0
            size = pa.array(np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; over_limit: more than `limit` tokens.

    model_path: a sentencepiece model, which every worker can read at that path. Null and empty texts have no
    bytes and no tokens; texts of any length are counted whole; an empty table gives no rows. Repeated rows and null ids are counted row by row; other columns are not looked at."""
    texts = columns(docs, (id_col, "doc_id"), (text_col, "text"))
    words = frequent(texts.select("text"))
    table = dict(zip(words, Pieces(model_path).lengths(words), strict=True))
    return texts.mapInArrow(_counter(model_path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
