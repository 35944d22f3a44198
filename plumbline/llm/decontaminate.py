"""Benchmark decontamination with an FM-index for each shard of the training texts.

The phrases to look for are the windows of `window` consecutive words of the benchmark's items. A task reads its
share of the documents in shards of a bounded size. A word's symbol is its number in the benchmark's
vocabulary; a stretch of words can only hold a window if all its words are in there and it is as long as the
shortest window, so a shard's index is built over just those stretches, each closed by a separator symbol. All
windows are searched backward at once, occurrences are located by the sampled positions, and the
occurrences of a document are merged into spans of words to remove.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.fm_index import FMIndex
from plumbline.llm.text import ALNUM, Words, buffers, chunks, columns, written

#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Characters of benchmark text whose windows are searched at a time; a larger benchmark is taken in blocks.
BLOCK_CHARS = 8_000_000


class Phrases:
    """Distinct windows of a block of benchmark items, by length, as rows of vocabulary numbers (from 1)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            raw, at = buffers(pa.array([text], pa.string()))
            words = Words(raw, at, ALNUM)
            codes, distinct = words.coded()
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in distinct]
            coded = [numbers[c] for c in codes.tolist()]
            for i in range(max(len(coded) - window + 1, min(1, len(coded)))):
                found[tuple(coded[i : i + window])].add(item)
        self.items, self.by_length = [], []
        for length in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == length]
            self.by_length.append((length, len(self.items), np.array(rows, dtype=np.int64)))
            self.items += [sorted(found[w], key=lambda i: (i is None, i)) for w in rows]
        self.shortest = min((n for n, _, _ in self.by_length), default=0)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first word, length) of every occurrence in a shard; words are counted over the shard."""
        none = (np.zeros(0, dtype=np.int64),) * 3
        if not len(words) or not self.shortest:
            return none
        codes, distinct = words.coded()
        symbol = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), dtype=np.int64, count=len(distinct))[codes]
        # stretches of known words within a row
        known = symbol > 0
        begins = known & ~np.concatenate(([False], known[:-1]))
        begins |= known & np.concatenate(([True], words.row[1:] != words.row[:-1]))
        start = np.flatnonzero(begins)
        stops = known & ~np.concatenate((known[1:], [False]))
        stops |= known & np.concatenate((words.row[1:] != words.row[:-1], [True]))
        size = np.flatnonzero(stops) + 1 - start
        long = size >= self.shortest
        start, size = start[long], size[long]
        if not len(start):
            return none
        # symbol 1 separates; vocabulary numbers move up by one
        put = np.concatenate(([0], np.cumsum(size + 1)))
        origin = np.full(put[-1], -1, dtype=np.int64)
        inside = np.ones(put[-1], dtype=bool)
        inside[put[1:] - 1] = False
        origin[inside] = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = np.ones(put[-1], dtype=np.int64)
        text[inside] = symbol[origin[inside]] + 1
        index = FMIndex(text)
        out = []
        for length, first, rows in self.by_length:
            low, high = index.search(rows + 1)
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            place = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at = origin[index.locate(place)]
            out.append((np.repeat(hit + first, many), at, np.full(len(at), length)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins intervals that overlap or touch: (starts, ends), ascending."""
    if not len(start):
        return start, start
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((new[1:], [True]))]


_SCHEMA = "doc_id long, n_words long, hits array<struct<first:long,last:long>>, items array<string>, spans array<struct<first:long,last:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan(phrases: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            for a, b in chunks(at, SHARD_BYTES):
                words = Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], ALNUM)
                phrase, place, length = phrases.occurrences(words)
                hits, spans, items = [[] for _ in range(b - a)], [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                row = words.row[place]
                # occurrences row by row
                order = np.argsort(row, kind="stable")
                row, phrase, place, length = row[order], phrase[order], place[order], length[order]
                edges = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)])) if len(row) else np.zeros(1, dtype=np.int64)
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    r = int(row[lo])
                    first, last = merged(place[lo:hi], length[lo:hi])
                    base, offset = words.word_at[r], words.at[r]
                    hits[r] = [{"first": int(i - base), "last": int(j - base)} for i, j in zip(first, last, strict=True)]
                    spans[r] = [{"first": int(words.start[i] - offset), "last": int(words.end[j - 1] - offset)} for i, j in zip(first, last, strict=True)]
                    items[r] = sorted({x for p in np.unique(phrase[lo:hi]).tolist() for x in phrases.items[p] if x is not None})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words.per_row), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    names=["doc_id", "n_words", "hits", "items", "spans"],
                )

    return run


def _blocks(benchmark: DataFrame) -> list[int]:
    """Numbers of blocks of items, each of about BLOCK_CHARS characters by the hash of the id."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return list(range(chars // BLOCK_CHARS + 1))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, items, spans) for every row of docs: `hits` are merged ranges of words inside any
    occurrence of a window, first to last exclusive; `spans` the same as ranges of UTF-8 bytes of the text (lower-casing
    A-Z leaves places as they are); `items` the ids, as strings, of the items with an occurring window.

    An item of fewer words than `window`, but not none, is one window. Texts of any length are searched whole, and a longer text than a shard is one of
    its own; repeated rows are searched one by one; an empty table gives no rows, and an empty benchmark no hits. Null texts have no words; an item with a
    null id marks words, but is not listed. A benchmark of over BLOCK_CHARS characters is searched block by block, each
    against all rows, and rows are put together by a row number, so repeated rows and ids stay apart."""
    texts = columns(docs, (id_col, "doc_id"), (text_col, "text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    blocks = _blocks(items)

    def phrases(block: int) -> Phrases:
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(len(blocks))) == block)
        return Phrases([(r.item, r.text) for r in mine.toLocalIterator()], window)

    if len(blocks) == 1:
        return texts.mapInArrow(_scan(phrases(0)), _SCHEMA)
    return _in_blocks(texts, blocks, phrases)


def _in_blocks(texts: DataFrame, blocks: list[int], phrases) -> DataFrame:
    """Rows get a number once, in a written table, so that every block sees the same one."""
    numbered = written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    parts = None
    for block in blocks:
        part = numbered.select(F.col("row").alias("doc_id"), "text").mapInArrow(_scan(phrases(block)), _SCHEMA)
        parts = part if parts is None else parts.union(part)
    ranges = "array<struct<first:long,last:long>>"

    def union_of(column: str) -> F.Column:
        """Ranges of all blocks, sorted and joined where they overlap or touch."""
        step = f"""aggregate(array_sort(flatten(collect_list({column}))), CAST(array() AS {ranges}), (a, x) ->
            CASE WHEN size(a) > 0 AND x.first <= element_at(a, -1).last
                 THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last))))
                 ELSE concat(a, array(x)) END)"""
        return F.expr(step).alias(column)

    whole = parts.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), union_of("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), union_of("spans"))
    return numbered.select("row", "doc_id").join(whole, "row").select("doc_id", "n_words", "hits", "items", "spans")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 8, most_items: int = 2, **names: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs, from `scan`."""
    found = scan(docs, benchmark, window, **names)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= most_items).alias("contaminated"),
    )


def _without(text: str, spans: list[dict]) -> str:
    raw, left, at = text.encode(), [], 0
    for span in spans:
        left, at = [*left, raw[at : span["first"]]], span["last"]
    return b"\n".join([*left, raw[at:]]).decode()


def _cleaned(batch: pa.RecordBatch, items: list[list], spans: list[list], most_items: int, text_col: str, count_col: str | None) -> pa.RecordBatch:
    keep = [len(found) < most_items for found in items]
    cut = [r for r, s in enumerate(spans) if s and keep[r]]
    if cut:
        names = batch.schema.names
        texts = batch.column(text_col).to_pylist()
        for r in cut:
            texts[r] = _without(texts[r], spans[r])
        batch = batch.set_column(names.index(text_col), text_col, pa.array(texts, batch.column(text_col).type))
        if count_col:
            counts = batch.column(count_col).to_pylist()
            for r in cut:
                counts[r] = len(texts[r])
            batch = batch.set_column(names.index(count_col), count_col, pa.array(counts, batch.column(count_col).type))
    return batch.filter(pa.array(keep, pa.bool_()))


def _clean_batches(phrases: Phrases, most_items: int, text_col: str, count_col: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], names=["doc_id", "text"])
            found = list(_scan(phrases)([part]))
            items, spans = ([x for f in found for x in f.column(name).to_pylist()] for name in ("items", "spans"))
            yield _cleaned(batch, items, spans, most_items, text_col, count_col)

    return run


def _found_batches(names: list[str], most_items: int, text_col: str, count_col: str | None):
    """As _clean_batches, for rows that come with what was found in them as two more columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, spans = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            yield _cleaned(batch.select(list(range(len(names)))), items, spans, most_items, text_col, count_col)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, most_items: int = 2, text_col: str = "text", count_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without contaminated rows (windows of `most_items` items or more), the merged spans of all
    occurrences cut from the texts that stay, a line break in their place; `count_col`, if given, is set to the new
    number of characters of a text that was cut. All other rows and columns stay as they are, null texts, repeated rows and null ids among
    them; an empty table gives no rows."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    if len(_blocks(items)) == 1:
        phrases = Phrases([(r.item, r.text) for r in items.toLocalIterator()], window)
        return docs.mapInArrow(_clean_batches(phrases, most_items, text_col, count_col), docs.schema)
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.select("*", F.monotonically_increasing_id().alias(row)))
    found = scan(numbered, benchmark, window, row, text_col, item_col, item_text_col).select(F.col("doc_id").alias(row), F.col("items").alias(f"{row}_items"), F.col("spans").alias(f"{row}_spans"))
    joined = numbered.join(found, row).select(*[F.col(f"`{c}`") for c in docs.columns], f"{row}_items", f"{row}_spans")
    return joined.mapInArrow(_found_batches(docs.columns, most_items, text_col, count_col), docs.schema)
