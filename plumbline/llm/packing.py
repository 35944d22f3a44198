"""Packing of token sequences as a cutting-stock problem, solved by column generation.

1. One pass over whole texts encodes them, cuts every document into full sequences and one rest, and writes
   the pieces (not the ids): length, checksum, and their unit's number within its task and size class. A unit is a piece, or
   short ones together.
2. The histogram of size classes (at most capacity / CLASS rows, however large the input) goes to the driver. The linear
   program over patterns, ways to fill one sequence, is solved by the revised simplex method; a knapsack dynamic
   program prices columns. Rounded down, its patterns cover nearly all pieces; the rest is filled greedily.
3. Units are ranked within their class from the per-task numbers, without sorting or gathering a class, and a
   rank's pattern gives the sequence. Offsets are sums within a sequence, which holds at most `capacity` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.byte_bpe import Encoder
from plumbline.llm.text import buffers, chunks, columns, written

#: Tokens by which size classes differ; a sequence's pieces are counted by class, so that it may stay short by
#: fewer than CLASS tokens a piece.
CLASS = 8
#: Pieces of fewer tokens are put together, into units of SHORT to 2 SHORT tokens, so that rounding up to a class costs little.
SHORT = 128
END_ID = 1
#: The linear program ends when it is this close to its lower bound.
GAP = 0.002
#: Rounds of the simplex method for each class, at most; where it stops, its patterns are still a full solution.
ROUNDS = 12

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, nth long, inner int"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId() if TaskContext.get() else 0, np.zeros(capacity // CLASS + 2, dtype=np.int64)
        encoder = Encoder(path)
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            for a, b in chunks(at):
                ids, row_at = encoder.ids(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                size = np.diff(row_at) + 1
                # each document's ids with the end id after them
                out = np.full(len(ids) + b - a, END_ID, dtype="<u4")
                own = np.ones(len(out), dtype=bool)
                own[np.cumsum(size) - 1] = False
                out[own] = ids
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(size[row] - start, capacity)
                begin = (np.cumsum(size) - size)[row] + start
                view = memoryview(out.tobytes())
                crc = [crc32(view[4 * i : 4 * (i + n)]) for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
                # a unit is a piece, or several short ones together: those that begin within one SHORT tokens of all short ones
                is_short = length < min(SHORT, capacity // 2)
                upto = np.cumsum(np.where(is_short, length, 0)) - np.where(is_short, length, 0)
                alone = np.cumsum(~is_short)
                order = np.lexsort((np.arange(len(length)), np.where(is_short, upto // min(SHORT, capacity // 2), alone), is_short))
                same = is_short[order][1:] & is_short[order][:-1] & (np.diff(upto[order] // min(SHORT, capacity // 2)) == 0)
                heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), dtype=bool), ~same)))
                unit, inner = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
                counted = np.diff(np.concatenate((heads, [len(order)])))
                unit[order] = np.repeat(np.arange(len(heads)), counted)
                inner[order] = np.arange(len(order)) - np.repeat(heads, counted)
                total = np.bincount(unit, weights=length, minlength=len(heads)).astype(np.int64)
                kind = -(-total // CLASS)
                order = np.argsort(kind, kind="stable")
                ordered = kind[order]
                firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
                nth = np.empty(len(kind), dtype=np.int64)
                nth[order] = np.arange(len(kind)) - np.repeat(firsts, np.diff(np.concatenate((firsts, [len(kind)])))) + seen[ordered]
                seen += np.bincount(kind, minlength=len(seen))
                doc = batch.column("doc_id").slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row]), pa.array(kind[unit], pa.int32()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth[unit]), pa.array(inner, pa.int32())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "nth", "inner"],
                )

    return run


def _price(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: how many of each class the most valuable pattern holds."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    size, value = size[order], value[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            total = value[:k] + best[c - size[:k]]
            if total[i := int(total.argmax())] > best[c] + 1e-12:
                best[c], took[c] = total[i], i
    pattern, c = np.zeros(len(size), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[order[took[c]]] += 1
            c -= size[took[c]]
    return pattern


def patterns(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) such that each class is met exactly, in few patterns' times in all. size in units up to capacity."""
    m = len(size)
    columns_ = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / (capacity // size))
    x = demand / (capacity // size)
    for _ in range(ROUNDS * m):
        dual = inverse.sum(axis=0)
        column = _price(np.maximum(dual, 0), size, capacity).astype(float)
        # the objective divided by this value is a lower bound of the program
        if dual @ column <= 1 + gap:
            break
        enters = inverse @ column
        up = np.flatnonzero(enters > 1e-9)
        if not len(up):
            break
        out = up[np.argmin(x[up] / enters[up])]
        step = x[out] / enters[out]
        x = np.maximum(x - step * enters, 0)
        x[out] = step
        inverse[out] /= enters[out]
        enters[out] = 0
        inverse -= np.outer(enters, inverse[out])
        columns_[:, out] = column
    chosen, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        pattern = columns_[:, j].astype(np.int64)
        used = pattern > 0
        times = min(int(x[j] + 1e-9), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times:
            chosen.append((pattern, times))
            left -= times * pattern
    # a pattern used for a fraction of a sequence may still fit what is left, the largest fractions first
    for j in np.argsort(-(x % 1), kind="stable"):
        pattern = columns_[:, j].astype(np.int64)
        if pattern.any() and (pattern <= left).all():
            chosen.append((pattern, 1))
            left -= pattern
    while left.any():
        pattern, room = np.zeros(m, dtype=np.int64), capacity
        for i in np.argsort(-size, kind="stable"):
            pattern[i] = min(left[i], room // size[i])
            room -= pattern[i] * size[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        chosen.append((pattern, times))
        left -= times * pattern
    return chosen


def _plan(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(class, from rank, to rank, first sequence, pieces a sequence)."""
    histogram = sorted(histogram)
    size, demand = np.array([c for c, _ in histogram], dtype=np.int64), np.array([n for _, n in histogram], dtype=np.int64)
    rank, sequence, out = np.zeros(len(size), dtype=np.int64), 0, []
    for pattern, times in patterns(size, demand, capacity // CLASS):
        for i in np.flatnonzero(pattern):
            out.append((int(size[i]), int(rank[i]), int(rank[i] + times * pattern[i]), sequence, int(pattern[i])))
            rank[i] += times * pattern[i]
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every row.

    A null or empty text is the end id alone; a text of any length is encoded whole and cut into full sequences and a rest. Repeated rows and null ids are packed row by row; other columns
    are not looked at. An empty table gives no rows. capacity: a multiple of CLASS."""
    if capacity % CLASS:
        raise ValueError(f"capacity must be a multiple of {CLASS}")
    spark = docs.sparkSession
    texts = columns(docs, (id_col, "doc_id"), (text_col, "text"))
    pieces = written(texts.mapInArrow(_cut(tokenizer_path, capacity), _PIECES))
    units = pieces.where("inner = 0")
    counts = units.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("class", "task", (F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).alias("before"))
    histogram = [(r["class"], r["n"]) for r in units.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = spark.createDataFrame(_plan(histogram, capacity), "plan_class int, low long, high long, first long, each long")
    ranked = pieces.join(before, ["class", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    # the plan has at most a few rows for each pair of class and pattern, and patterns are as many as classes
    placed = ranked.join(F.broadcast(plan), (F.col("class") == F.col("plan_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank", "inner").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.sum("length").over(order) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
