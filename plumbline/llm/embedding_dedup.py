"""Embedding near-duplicates by tiles of int8 products with error bounds.

Vectors are scaled to length one. Each is written as scale * (int8 vector) + rest, and the length of the rest is kept.
For two vectors the product of the int8 parts differs from the cosine by at most
|x'| |rest y| + |rest x| |y|, a bound that holds for every pair. A tile is a product of two blocks of one
label: one matrix product of int8 values (exact in float32, as sums of up to 1040 products stay below 2^24) gives all its
pairs. The bound decides most of them either way. Only the rest are computed in double precision, in a second task of the
tile that gets just the vectors that they are of; all others travel as int8.

Equal vectors of a label fall together first, by a digest, so copies meet nobody pairwise. A label's vectors are dealt to blocks of
a bounded size by hash, so a large label is many tiles, not one task. Each tile returns counts and a spanning
forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components, forest
from plumbline.llm.text import columns, joined, one_thread, written

#: Vectors in a block, about.
BLOCK = 1024
#: Dimensions that one float32 product of int8 values can sum without rounding.
EXACT_DIMENSIONS = 1024


class Quantised:
    """The int8 form of unit vectors: scale * q + rest, and the lengths of rest and of the int8 part, rounded up."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, rest: np.ndarray, whole: np.ndarray):
        self.q, self.scale, self.rest, self.whole = q, scale, rest, whole


class Block(Quantised):
    """Unit vectors with their quantised form."""

    def __init__(self, vectors: np.ndarray):
        # by the largest component first, so that no square overflows or vanishes
        vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
        self.x = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        scale = np.abs(self.x).max(axis=1) / 127
        q = np.rint(self.x / scale[:, None]).clip(-127, 127)
        whole = q * scale[:, None]
        # by more than double precision can be off
        rest = np.sqrt(((self.x - whole) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        super().__init__(q.astype(np.int8), scale, rest, np.sqrt((whole**2).sum(axis=1)) * (1 + 1e-9))


def decided(a: Quantised, b: Quantised, least: float, same: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of a, j of b; i < j if both are the same block) that surely have cosine >= least, and those that may or may not."""
    product = np.zeros((len(a.q), len(b.q)), dtype=np.float64)
    for d in range(0, a.q.shape[1], EXACT_DIMENSIONS):
        product += a.q[:, d : d + EXACT_DIMENSIONS].astype(np.float32) @ b.q[:, d : d + EXACT_DIMENSIONS].astype(np.float32).T
    product *= a.scale[:, None]
    product *= b.scale[None, :]
    # |x.y - x'.y'| <= |x'| |rest y| + |rest x| |y|, and |y| is 1
    bound = np.outer(a.whole, b.rest)
    bound += a.rest[:, None] * (1 + 1e-9) + 1e-12
    maybe = product + bound >= least
    if same:
        maybe &= np.arange(len(a.q))[:, None] < np.arange(len(b.q))[None, :]
    # the sum of products in double precision is off by less than this margin
    sure = maybe & (product - bound >= least + 1e-9)
    return np.nonzero(sure), np.nonzero(maybe & ~sure)


def exact(a: Block, b: Block, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs i, j have cosine >= least in double precision."""
    found = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        found[part] = np.einsum("ij,ij->i", a.x[i[part]], b.x[j[part]]) >= least
    return found


def tile_links(a: Block, b: Block, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """All pairs with cosine >= least, and how many pairs were computed in double precision."""
    (i, j), (k, m) = decided(a, b, least, same)
    found = exact(a, b, k, m, least)
    return np.concatenate((i, k[found])), np.concatenate((j, m[found])), len(k)


def _by_size(rows: pa.Table, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(left rows, right rows, whether they are one block) of a tile, for each length of vectors; only those of one length are compared."""
    side = rows.column("side").to_numpy()
    same = not side.any()
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        left = mine[side[mine] == 0]
        right = left if same else mine[side[mine] == 1]
        if len(left) and len(right):
            yield left, right, same


def _found(rep: np.ndarray, copies: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], doubtful: np.ndarray) -> pa.Table:
    """A row for each vector that has links here, or doubtful pairs: rep, its links, the least rep it hangs together with."""
    u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
    count = np.zeros(len(rep), dtype=np.int64)
    np.add.at(count, u, copies[v])
    np.add.at(count, v, copies[u])
    label = forest(len(rep), u, v)
    some = np.flatnonzero((count > 0) | doubtful)
    return pa.table({"rep": rep[some], "n": count[some], "low": rep[label[some]], "doubtful": doubtful[some]})


def _quantised_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one_thread()
    for batch in batches:
        vectors, reps = batch.column("embedding"), batch.column("rep")
        size = np.asarray(pc.list_value_length(vectors))
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            for lo in range(0, len(mine), BLOCK):
                some = pa.array(mine[lo : lo + BLOCK])
                block = Block(np.asarray(vectors.take(some).flatten(), dtype=np.float64).reshape(len(some), n))
                q = pa.Array.from_buffers(pa.binary(n), len(some), [None, pa.py_buffer(np.ascontiguousarray(block.q))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([reps.take(some), q, *(pa.array(x) for x in (block.scale, block.rest, block.whole))], names=["rep", "q", "scale", "rest", "whole"])


def _tile(least: float):
    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        one_thread()
        rows = rows.sort_by([("side", "ascending"), ("rep", "ascending")])
        rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        q = rows.column("q").combine_chunks()
        numbers = [rows.column(c).to_numpy() for c in ("scale", "rest", "whole")]
        size = np.asarray(pc.binary_length(q))
        of = lambda some: Quantised(np.frombuffer(b"".join(q.take(pa.array(some)).to_pylist()), np.int8).reshape(len(some), -1), *(x[some] for x in numbers))
        pairs, doubtful = [], np.zeros(len(rep), dtype=bool)
        for left, right, same in _by_size(rows, size):
            a = of(left)
            (i, j), (k, m) = decided(a, a if same else of(right), least, same)
            pairs.append((left[i], right[j]))
            doubtful[left[k]] = doubtful[right[m]] = True
        found = _found(rep, copies, pairs, doubtful)
        at = [pa.array([part.as_py()] * len(found), pa.int64()) for part in key[1:]]
        sides = dict(zip(rep.tolist(), rows.column("side").to_pylist(), strict=True))
        return found.append_column("i", at[0]).append_column("j", at[1]).append_column("side", pa.array([sides[r] for r in found.column("rep").to_pylist()], pa.int32()))

    return tile


def _doubts(least: float):
    """The doubtful pairs of a tile, among the vectors that have some, in double precision."""

    def tile(rows: pa.Table) -> pa.Table:
        one_thread()
        rows = rows.sort_by([("side", "ascending"), ("rep", "ascending")])
        rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        vectors = rows.column("embedding").combine_chunks()
        size = np.asarray(pc.list_value_length(vectors))
        of = lambda some: Block(np.asarray(vectors.take(pa.array(some)).flatten(), dtype=np.float64).reshape(len(some), -1))
        pairs = []
        for left, right, same in _by_size(rows, size):
            a = of(left)
            b = a if same else of(right)
            _, (k, m) = decided(a, b, least, same)
            links = exact(a, b, k, m, least)
            pairs.append((left[k[links]], right[m[links]]))
        return _found(rep, copies, pairs, np.zeros(len(rep), dtype=bool)).drop_columns(["doubtful"])

    return tile


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are compared if their labels are equal and not null. Null and zero vectors and those with null or
    non-finite components link with nothing, and stand for themselves; so do vectors with a null label, and
    vectors of different lengths among each other. Vectors with equal components are links, whatever rounding makes of their cosine. A repeated
    id is a vector of its own each time, and counts as such. A null id is never a component of others. Vectors of any length are compared whole; an empty table gives
    no rows; other columns are not looked at."""
    given = columns(vectors, (id_col, "vec_id"), (vector_col, "embedding"), (label_col, "label"))
    values = F.transform("embedding", lambda x: x.cast("double"))
    # 0.0 and -0.0 are the same component
    values = F.transform(values, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0), F.lit(False))
    # equal vectors of a label have equal digests; no two others do
    same = F.when(usable, F.unhex(F.sha2(F.concat_ws(",", F.size("embedding").cast("string"), F.transform(values, lambda x: x.cast("string")), F.col("label").cast("string")), 256)))
    known = written(given.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding", same.alias("same")))
    # rep stands for all rows with the same components and label; it is the number of one of them in this job, not an id
    classes = known.where("same IS NOT NULL").groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("rep"), F.min("vec_id").alias("least_id"))
    classes = written(classes)
    chosen = known.select("row", "label", "embedding").join(classes.select(F.col("rep").alias("row"), "rows"), "row").select(F.col("row").alias("rep"), F.col("rows").alias("copies"), "label", values.alias("embedding"))
    chosen = written(chosen)
    sizes = chosen.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    small = chosen.select("rep", "embedding").mapInArrow(_quantised_batches, "rep long, q binary, scale double, rest double, whole double")
    small = written(small).join(chosen.select("rep", "copies", "label"), "rep")
    dealt = small.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # block b is the left side of tiles (b, c) for c >= b, and the right side of tiles (c, b) for c < b
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("rep", "copies", "q", "scale", "rest", "whole", "label", "block", other)
    tiles = tiles.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")}).drop("block", "other")
    found = written(tiles.groupBy("label", "i", "j").applyInArrow(_tile(least), "rep long, n long, low long, doubtful boolean, i long, j long, side int"))
    again = found.where("doubtful").select("rep", "i", "j", "side").join(chosen, "rep")
    settled = again.groupBy("label", "i", "j").applyInArrow(_doubts(least), "rep long, n long, low long")
    found = written(found.where("n > 0").select("rep", "n", "low").union(settled))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    of = classes.join(counts, "rep", "left").join(linked, classes.rep == linked.node, "left")
    of = of.select("same", "rows", "least_id", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    lowest = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ready = written(of.join(lowest, "component").select("same", "rows", "n_links", "component_id"))
    met = joined(known.where("same IS NOT NULL").select("vec_id", "same"), ready, "same").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = known.where("same IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
