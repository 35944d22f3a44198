"""SimHash near-duplicate detection with a Gray-order hierarchical index.

1. Fingerprints: one pass over whole texts, 64 bits from the XXH64 of every 3-word shingle.
2. Equal fingerprints fall together (grouped minimum of the ids), so copies never meet pairwise.
3. Distinct fingerprints are dealt out by pigeonhole: of three blocks of bits, two fingerprints with at most
   two differences have one block in common. A group that is too large is dealt out again, by three blocks of
   the bits that are still free, so no group that a task gets together grows with the input.
4. A task builds one index over its groups: each group's fingerprints sorted by Gray rank, so that neighbours
   differ in few bits; runs of FANOUT nodes share an upper node that holds the bits on which all below agree,
   and each node keeps just the bits that its parent has not fixed yet. A search walks down from its group's root, adds up
   the differences in the fixed bits, and drops a node with everything below as soon as they pass the limit.
5. A task returns a spanning forest of the links it found; `components` joins the forests.

Near copies by similarity (`near_copies`) take fingerprints of 5-word shingles, too far apart for blocks of bits: texts of similarity 0.8
differ in 10 of 64 bits on the average. They are dealt out by keys made of least hashes of shingles instead, searched for with the same index,
and every candidate is decided by whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components, forest
from plumbline.llm.text import SPACED, Words, buffers, chunks, columns, joined, partitions_for, written

FANOUT = 8
#: Fingerprints that share a block: above this they are dealt out again by further bits.
GROUP_ROWS = 256
#: Rows of a task of the search, about.
TASK_ROWS = 50_000
#: Times that a group can be dealt out; then fewer than 20 bits are free, so that it holds under 2^20 fingerprints.
ROUNDS = 4
#: Near copies: keys that a text is dealt out by, least hashes in each key, and bits in which candidates may differ.
BANDS, BAND, BITS = 14, 5, 16
SEED = 7
#: Rows of two numbers that are broadcast.
SENT_ROWS = 2_000_000


def shingles_of(raw: np.ndarray, at: np.ndarray, shingle: int, seed: int = 42) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """(a, b, h, count, words) for runs of rows [a, b) of a buffer: the XXH64 of each shingle, row by row, how many
    each row has, and each row's words, one space between them. A text without words has no shingle."""
    digest = xxhash.xxh64_intdigest
    for a, b in chunks(at, 1 << 20):
        words = Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], SPACED)
        # words of the chunk, each followed by one space
        length = words.end - words.start
        put = np.concatenate(([0], np.cumsum(length + 1)))
        joined = np.full(put[-1], 0x20, dtype=np.uint8)
        where = np.ones(put[-1], dtype=bool)
        where[put[1:] - 1] = False
        joined[where] = words.data[words.inside]
        text = joined.tobytes()
        n = words.per_row
        # a row's shingles start at each word but the last shingle-1; a short row has one, from its first word
        count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
        rows = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        first = words.word_at[:-1][rows] + nth
        last = np.minimum(first + shingle, words.word_at[1:][rows])
        begin, end = put[first].tolist(), (put[last] - 1).tolist()
        h = np.fromiter((digest(text[i:j], seed) for i, j in zip(begin, end, strict=True)), dtype=np.uint64, count=len(begin))
        edges = put[words.word_at].tolist()
        yield a, b, h, count, [text[i : max(i, j - 1)] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def fingerprints_of(raw: np.ndarray, at: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprint of each text of a buffer."""
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    for a, _, h, count, _ in shingles_of(raw, at, shingle, seed):
        out[a : a + len(count)] = _majority(h, count)
    return out


def _majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: bits that are set in over half of its hashes."""
    out, ends, some = np.zeros(len(count), dtype=np.uint64), np.cumsum(count), np.flatnonzero(count)
    big = h.astype(">u8")
    for r in range(0, len(some), 64):
        part = some[r : r + 64]
        lo, hi = ends[part[0]] - count[part[0]], ends[part[-1]]
        bits = 2 * _ones(big[lo:hi], count[part]) > count[part][:, None]
        out[part] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


#: the eight bits of each byte value, most significant first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def _ones(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each bit, most significant first; h holds count[0] hashes of the
    first row, then count[1] of the next. A histogram of each byte gives its eight bits' counts at once."""
    key = np.repeat(np.arange(len(count)) * 256, count)
    octets = h.view(np.uint8).reshape(-1, 8)
    tables = (np.bincount(key + octets[:, i], minlength=256 * len(count)).reshape(-1, 256) @ _BITS for i in range(8))
    return np.concatenate(list(tables), axis=1)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = buffers(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(raw, at).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row; null and wordless texts have fingerprint 0."""
    return columns(docs, (id_col, "doc_id"), (text_col, "text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence, in which neighbours differ in one bit."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over groups of fingerprints, each group in Gray order. `levels[0]` are the leaves, the last level the groups' roots."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes = codes[self.order]
        group = group[self.order]
        full = np.full(len(codes), ~np.uint64(0))
        masks, patterns, starts, groups = [full], [self.codes], [np.arange(len(codes) + 1)], [group]
        while len(groups[-1]) > 1 and (groups[-1][1:] == groups[-1][:-1]).any():
            g = groups[-1]
            begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            size = np.diff(np.concatenate((begin, [len(g)])))
            nth = np.arange(len(g)) - np.repeat(begin, size)
            first = np.flatnonzero(nth % FANOUT == 0)
            every = np.bitwise_and.reduceat(patterns[-1] & masks[-1], first)
            none = np.bitwise_and.reduceat(~patterns[-1] & masks[-1], first)
            masks.append(every | none)
            patterns.append(every)
            starts.append(np.concatenate((first, [len(g)])))
            groups.append(g[first])
        self.groups, self.starts, self.patterns = groups, starts, patterns
        # a node keeps the bits that its parent leaves open
        self.own = []
        for k, mask in enumerate(masks):
            if k + 1 < len(masks):
                mask = mask & ~np.repeat(masks[k + 1], np.diff(starts[k + 1]))
            self.own.append(mask)

    def within(self, most: int, work: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs i < j (places in Gray order) in one group that differ in at most `most` bits, and in how many. One step takes as many
        queries as there are about `work` pairs of, were none pruned."""
        top = len(self.groups) - 1
        root = np.searchsorted(self.groups[top], self.groups[0])
        pairs = np.cumsum(np.bincount(root)[root])
        lo = 0
        while lo < len(self.codes):
            hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + work, "right")))
            query = np.arange(lo, hi)
            lo = hi
            node, spent = root[query], np.zeros(len(query), dtype=np.uint8)
            for level in range(top, -1, -1):
                spent = spent + np.bitwise_count((self.codes[query] ^ self.patterns[level][node]) & self.own[level][node])
                last = self.starts[level][node + 1] if level else node + 1
                keep = np.flatnonzero((spent <= most) & ((last - 1 > query) if level == 0 else True))
                query, node, spent = query[keep], node[keep], spent[keep]
                if level:
                    begin, size = self.starts[level][node], np.diff(self.starts[level])[node]
                    query, spent = np.repeat(query, size), np.repeat(spent, size)
                    node = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield query, node, spent


def _search_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept)
        rep = rows.column("rep").to_numpy()
        _, group = np.unique(rows.column("key").to_numpy(), return_inverse=True)
        index = GrayIndex(rows.column("fp").to_numpy().view(np.uint64), group)
        rep = rep[index.order]
        nodes, at = np.unique(rep, return_inverse=True)
        label = np.arange(len(nodes))
        for i, j, _ in index.within(most):
            low = forest(len(nodes), *np.concatenate((np.stack((np.arange(len(nodes)), label)), np.stack((at[i], at[j]))), axis=1)) if len(i) else label
            label = low
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])

    return run


def _blocks(width: int, blocks: int) -> list[int]:
    """`blocks` masks that cover the low `width` bits."""
    edges = [width * i // blocks for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(distinct: DataFrame, most: int = 2, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """distinct: (fp long, rep long), one row per fingerprint. Returns a spanning forest (u, v) of the
    pairs with at most `most` differing bits, over the reps."""
    parts, found = most + 1, None
    # blocks of a round lie side by side in the bits left free by the rounds before, which are the low bits
    # after each round the row's code is turned so that the block used is on top and the free bits are low
    now = distinct.select("fp", "rep", F.lit(0).cast("long").alias("key"), F.col("fp").alias("turned"))
    width = 64
    for turn in range(ROUNDS):
        masks = _blocks(width, parts)
        dealt = now.select("fp", "rep", "key", "turned", F.posexplode(F.array(*[F.lit(i) for i in range(parts)])).alias("pos", "block"))
        used, turned = None, None
        for i, m in enumerate(masks):
            lo, hi = width * i // parts, width * (i + 1) // parts
            value = F.col("turned").bitwiseAND(F.lit(_signed(m)))
            low = F.col("turned").bitwiseAND(F.lit(_signed((1 << lo) - 1)))
            high = F.shiftrightunsigned("turned", hi).bitwiseAND(F.lit(_signed((1 << (width - hi)) - 1))) if width > hi else F.lit(0).cast("long")
            rest = low.bitwiseOR(F.shiftleft(high, lo))
            used = F.when(F.col("block") == i, value) if used is None else used.when(F.col("block") == i, value)
            turned = F.when(F.col("block") == i, rest) if turned is None else turned.when(F.col("block") == i, rest)
        dealt = dealt.select("fp", "rep", F.xxhash64("key", F.lit(turn), "block", used).alias("key"), turned.alias("turned"))
        width -= width // parts  # the narrowest block leaves most bits free
        if turn + 1 < ROUNDS and width >= parts:
            dealt = written(dealt)
            large = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("key")
            large = written(large)
            more = not large.isEmpty()
            ready = dealt.join(large, "key", "left_anti") if more else dealt
        else:
            more, ready = False, dealt
        ready = ready.select("key", "fp", "rep")
        found = ready if found is None else found.union(ready)
        if not more:
            break
        now = dealt.join(large, "key", "left_semi").select("fp", "rep", "key", "turned")
    found = written(found)
    tasks = partitions_for(found.count(), task_rows)
    return found.repartition(tasks, "key").mapInArrow(_search_batches(most), "u long, v long")


def near_duplicates(docs: DataFrame, most: int = 2, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null texts and texts without words have fingerprint zero and link like any other. Rows repeated with one
    id are repeated in the result. A null id is kept; it never becomes a component id unless its whole
    component has none, but its fingerprint links others. Texts of any length are taken whole, an empty table gives no rows, and other
    columns of docs are not looked at."""
    prints = written(fingerprints(docs, id_col, text_col))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    by_fp = components(links(distinct.select("fp", F.col("fp").alias("rep")), most, group_rows))
    of = distinct.join(by_fp, distinct.fp == by_fp.node, "left").select("fp", "rep", "rows", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = written(of.join(least, "component").select("fp", "rows", "component_id"))
    return joined(prints, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signature_batches(shingle: int):
    odd = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            for a, b, h, count, words in shingles_of(raw, at, shingle):
                some = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[some]
                bands = np.zeros((BANDS, b - a), dtype=np.uint64)
                for k in range(BANDS * BAND):
                    if len(some):
                        least = np.minimum.reduceat((h ^ odd[-k]) * odd[k], begin)
                        band = bands[k // BAND]
                        band[some] = (band[some] ^ least) * odd[0] ^ (band[some] >> np.uint64(29))
                same = pa.array([blake2b(w, digest_size=16).digest() for w in words], pa.binary())
                own = [batch.column(c).slice(a, b - a) for c in ("file", "index", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, same, pa.array(_majority(h, count).view(np.int64)), *(pa.array(x.view(np.int64)) for x in bands)], names=_SIGNED)

    return run


_SIGNED = ["file", "index", "doc_id", "same", "fp", *(f"band{k}" for k in range(BANDS))]


def lightest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the links i - j among nodes 0..n-1 make up a spanning forest of least total d."""
    order = np.argsort(d, kind="stable")
    a, b, label, picked = i[order], j[order], np.arange(n), []
    while len(order):
        u, v = label[a], label[b]
        open_ = np.flatnonzero(u != v)
        order, a, b, u, v = order[open_], a[open_], b[open_], u[open_], v[open_]
        if not len(order):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, u, np.arange(len(order)))
        np.minimum.at(best, v, np.arange(len(order)))
        chosen = np.unique(best[best < len(order)])
        picked.append(order[chosen])
        label = forest(n, u[chosen], v[chosen])[label]
    return np.concatenate(picked) if picked else order


def _candidate_batches(most: int):
    """A spanning forest of the links with fewest differences, of the pairs of a group that differ in at most `most` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept)
        key = rows.column("key").to_numpy()
        kind, group, size = np.unique(key, return_inverse=True, return_counts=True)
        some = np.flatnonzero(size[group] > 1)
        index = GrayIndex(rows.column("fp").to_numpy().view(np.uint64)[some], group[some])
        nodes, at = np.unique(rows.column("row").to_numpy()[some][index.order], return_inverse=True)
        part = rows.column("part").to_numpy()[some][index.order]
        has: list[np.ndarray] = [np.zeros((3, 0), dtype=np.int64)]
        found = 0
        for i, j, d in index.within(most):
            # rows of a block of a divided group meet each other in the block's first task
            fresh = np.flatnonzero((at[i] != at[j]) & ((part[i] != part[j]) | (part[i] == 0)))
            has.append(np.stack((at[i[fresh]], at[j[fresh]], d[fresh].astype(np.int64))))
            found += len(fresh)
            if found > 1 << 20:
                whole = np.concatenate(has, axis=1)
                has = [whole[:, lightest(len(nodes), *whole)]]
                found = 0
        whole = np.concatenate(has, axis=1)
        u, v, d = whole[:, lightest(len(nodes), *whole)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    return run


def _set_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            for a, b, h, count, _ in shingles_of(raw, at, shingle):
                ends = np.cumsum(count)
                sets = [np.unique(h[i:j]).view(np.int64) for i, j in zip((ends - count).tolist(), ends.tolist(), strict=True)]
                at_ = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at_), pa.array(np.concatenate(sets)))], names=["row", "shingles"])

    return run


def alike(sets: list[np.ndarray], label: np.ndarray, part: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links i - j of sets with a Jaccard similarity of `least` or more, enough to span what they join; sets of one label are known to be
    joined, and of divided groups those of one part meet elsewhere unless the part is 0."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    posted = owner[np.argsort(code, kind="stable")]
    first, ends = np.cumsum(often) - often, np.cumsum(size)
    _, now = np.unique(label, return_inverse=True)
    out = []
    for x in range(len(sets)):
        own = code[ends[x] - size[x] : ends[x]]
        many = often[own]
        met = posted[np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        shared = np.bincount(met, minlength=x + 1)[: x + 1]
        close = np.flatnonzero((shared >= least * (size[: x + 1] + size[x] - shared)) & (now[: x + 1] != now[x]) & ((part[: x + 1] != part[x]) | (part[x] == 0)))
        for y in close.tolist():
            if now[y] != now[x]:
                out.append((x, y))
                now[now == now[y]] = now[x]
    return out


def _alike_batches(least: float):
    def run(group: pa.Table) -> pa.Table:
        shingles = group.column("shingles").combine_chunks()
        at = shingles.offsets.to_numpy()
        values = shingles.values.to_numpy()
        row = group.column("row").to_numpy()
        found = alike([values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], group.column("label").to_numpy(), group.column("part").to_numpy(), least)
        u, v = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(row[u], pa.int64()), "v": pa.array(row[v], pa.int64())})

    return run


def _divided(rows: DataFrame, key: str, of: str, most: int, weight: str | None = None) -> DataFrame:
    """rows with columns `key` (now of a task's group) and `part`. Groups of at most `most` rows (or sums of `weight`) stay whole, in part
    0. A larger one is divided into blocks by its rows' number `of`, and a task gets two blocks: rows of different parts meet there, and rows of
    one block meet as part 0 of the group of this block alone. So all rows of a group meet, however large it is."""
    large = written(rows.groupBy(key).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).where(F.col("n") > most).select(key, F.ceil(2 * F.col("n") / most).cast("int").alias("blocks")))
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0))
    # at most one row for each `most` rows or weights
    large = F.broadcast(large)
    block = F.pmod(F.xxhash64(of), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(large, key).withColumn("block", block).withColumn("other", other)
    pair = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.withColumn(key, pair).withColumn("part", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)).drop("blocks", "block", "other")
    return rows.join(large, key, "left_anti").withColumn("part", F.lit(0)).unionByName(dealt)


def _placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs as a table of files, and the columns that say where a row lies: a number for its file, and its place there."""
    for table in (docs, None):
        table = written(docs) if table is None else table
        try:
            meta = table.metadataColumn("_metadata")
            file, index = F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("index")
            table.select(file, index).schema  # noqa: B018
            return table, file, index
        except AnalysisException:
            continue
    raise ValueError("rows of this table have no place")


def _thin(rows: DataFrame, some: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined to some; a small table goes to the rows, which then are not shuffled."""
    return rows.join(F.broadcast(some) if some.count() <= SENT_ROWS else some, on, how)


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 8192, set_sizes: int = 500_000) -> DataFrame:
    """(file, index, doc_id, component, kept) of the rows that have a copy or near copy; docs must come from `_placed`.

    Two rows are linked if their sets of `shingle`-word shingles have a Jaccard similarity of `least` or more; a text of fewer words is one
    shingle, and texts without words (null, empty, blank) are copies of each other. `component` numbers what links join, and one row of each is
    kept: the smallest id, of several such rows the first; null ids come last.

    Candidates are pairs with fingerprints of at most BITS different bits among those that share one of BANDS keys, each made of the least
    hash of the shingles under BAND orders. Two texts of similarity 0.8 share a key with probability 0.996 and are within BITS with 0.985; of
    0.85, 0.9997 and 0.998. All candidates are decided by their whole sets of shingles.
    Copies and repeated rows meet by a digest of their words before anything else; an empty table gives no rows; texts of any length are
    taken whole; no other column is looked at."""
    docs, file, index = _placed(docs)
    texts = docs.select(file, index, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = "file long, index long, doc_id long, same binary, fp long, " + ", ".join(f"band{k} long" for k in range(BANDS))
    signed = written(texts.mapInArrow(_signature_batches(shingle), kinds).withColumn("row", F.monotonically_increasing_id()))
    bands = [F.any_value(f"band{k}").alias(f"band{k}") for k in range(BANDS)]
    classes = written(signed.groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("row"), F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), *bands))
    dealt = classes.select("row", "fp", F.explode(F.array(*[F.xxhash64(F.lit(k), f"band{k}") for k in range(BANDS)])).alias("key"))
    dealt = _divided(dealt, "key", "row", group_rows)
    tasks = partitions_for(classes.count() * BANDS, 4 * TASK_ROWS)
    edges = written(dealt.select("key", "row", "fp", "part").repartition(tasks, "key").mapInArrow(_candidate_batches(BITS), "u long, v long").distinct())
    # sets of shingles of the rows that have a candidate, once each
    ends = edges.select(F.col("u").alias("row")).union(edges.select(F.col("v").alias("row"))).distinct()
    wanted = written(signed.join(ends, "row", "left_semi").select("file", "index", "row"))
    sets = written(_thin(texts, wanted, ["file", "index"], "inner").select("row", "text").mapInArrow(_set_batches(shingle), "row long, shingles array<long>"))
    met = edges.join(sets.select(F.col("row").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("row").alias("v"), F.col("shingles").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    sure = written(met.select("u", "v", (both >= least * (F.size("a") + F.size("b") - both)).alias("sure")))
    links_ = sure.where("sure").select("u", "v")
    if not sure.where("NOT sure").isEmpty():
        # where a candidate failed, all pairs of what hangs together by candidates are compared but those already joined
        hangs = components(edges).select(F.col("node").alias("row"), F.col("component").alias("key"))
        joins = components(links_).select(F.col("node").alias("row"), F.col("component").alias("label"))
        known = hangs.join(joins, "row", "left").select("row", "key", F.coalesce("label", "row").alias("label"))
        unsettled = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        known = known.join(unsettled, "key", "left_semi")
        sized = written(known.join(sets.select("row", F.size("shingles").alias("size")), "row"))
        tiles = _divided(sized, "key", "row", set_sizes, "size").drop("size").join(sets, "row")
        more = tiles.groupBy("key").applyInArrow(_alike_batches(least), "u long, v long")
        links_ = written(links_.union(more))
    joined_ = components(links_).select(F.col("node").alias("row"), "component")
    groups = classes.join(joined_, "row", "left").where("component IS NOT NULL OR rows > 1").select("same", "rows", "row", F.coalesce("component", "row").alias("component"), "least")
    smallest = groups.groupBy("component").agg(F.min("least").alias("smallest"))
    members = joined(signed.select("file", "index", "doc_id", "row", "same"), written(groups.join(smallest, "component").select("same", "rows", "component", "smallest")), "same")
    members = written(members.drop("rows", "same"))
    stays = members.where("doc_id <=> smallest").groupBy("component").agg(F.min("row").alias("stays"))
    return members.join(stays, "component").select("file", "index", "doc_id", "component", (F.col("row") == F.col("stays")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that `near_copies` does not keep; texts are not shuffled unless those rows are more than SENT_ROWS."""
    docs, file, index = _placed(docs)
    gone = written(near_copies(docs, shingle, least, id_col, text_col).where("NOT kept").select(F.col("file").alias("\0file"), F.col("index").alias("\0index")))
    if gone.count() <= SENT_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, (file == gone["\0file"]) & (index == gone["\0index"]), "left_anti")
