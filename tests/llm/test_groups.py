"""Near-duplicates of texts and vectors against brute force."""

import numpy as np
import pytest
import xxhash

from plumbline.llm import embedding_dedup, simhash
from plumbline.llm.components import components, forest
from plumbline.llm.oracles import OP8
from tests.llm.conftest import low


def reach(n, links):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return [top(i) for i in range(n)]


def brute_print(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", low(text).encode())
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = rng.integers(1, 40), rng.integers(0, 40)
        a, b = rng.integers(0, n, (2, m))
        assert forest(n, a, b).tolist() == reach(n, zip(a.tolist(), b.tolist(), strict=True))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = reach(400, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_gray_index(most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for _ in range(3)]
    codes = np.unique(np.concatenate([base, *near, near[0] ^ (base & np.uint64(3))]))
    group = rng.integers(0, 2, len(codes))
    index = simhash.GrayIndex(codes, group)
    got = {tuple(sorted((int(index.codes[a]), int(index.codes[b])))) for i, j, _ in index.within(most) for a, b in zip(i, j, strict=True)}
    want = {tuple(sorted((int(codes[a]), int(codes[b])))) for a in range(len(codes)) for b in range(a) if group[a] == group[b] and int(codes[a] ^ codes[b]).bit_count() <= most}
    assert got == want


def test_gray_rank():
    code = np.arange(64, dtype=np.uint64)
    assert (simhash.gray_rank(code ^ (code >> np.uint64(1))) == code).all()


@pytest.mark.parametrize("group_rows", [256, 2])
def test_links_at_two_bits(spark, group_rows):
    """Clusters around shared bits, so that groups are large enough to be dealt out again and again."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-(2**62), 2**62, 8)
    codes = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for bit in rng.integers(0, 62, rng.integers(1, 7)).tolist():
                x ^= 1 << bit
            codes.add(x)
    codes = sorted(codes)
    table = spark.createDataFrame([(c, c) for c in codes], "fp long, rep long")
    found = [(codes.index(r.u), codes.index(r.v)) for r in simhash.links(table, 2, group_rows, task_rows=200).collect()]
    want = [(i, j) for i in range(len(codes)) for j in range(i) if ((codes[i] ^ codes[j]) & (2**64 - 1)).bit_count() <= 2]
    assert reach(len(codes), found) == reach(len(codes), want) and want


def test_near_duplicates(spark, docs, rows, nothing):
    real = [(i, t) for i, t in rows]
    near = [(20_000 + k, t + " x") for k, (_, t) in enumerate(r for r in real if r[1] and len(r[1]) > 3000)]
    table = docs.select("doc_id", "text", "fp", "key").union(spark.createDataFrame([(i, t, 0, 0) for i, t in near], "doc_id long, text string, fp int, key int"))
    everything = real + near
    prints = [brute_print(t) for _, t in everything]
    ids = [i for i, _ in everything]
    label = reach(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {}
    for i, g in zip(ids, label, strict=True):
        least[g] = min(i if i is not None else 1 << 60, least.get(g, 1 << 60))
    want = sorted(((i, f"{p:016x}", least[g] if least[g] < 1 << 60 else None) for i, p, g in zip(ids, prints, label, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(table).collect()), key=str) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_null_ids_carry_links(spark):
    """A fingerprint that only rows without an id hold bridges two others."""
    code = lambda *bits: sum(1 << b for b in bits)
    words = {}
    for k in range(200_000):
        p = brute_print(f"w{k}")
        words.setdefault(p >> 52, []).append((p, f"w{k}"))
    bridge = next((a, b, c) for group in words.values() for a in group for b in group for c in group if 0 < (a[0] ^ b[0]).bit_count() <= 14 and 0 < (b[0] ^ c[0]).bit_count() <= 14 and (a[0] ^ c[0]).bit_count() > 14)
    rows = [(9, bridge[0][1]), (None, bridge[1][1]), (5, bridge[2][1]), (None, "alone without an id")]
    assert code(0, 1) == 3
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 14, group_rows=4).collect()}
    assert [got[f"{brute_print(t):016x}"] for _, t in rows] == [5, 5, 5, None]


def sets_of(text, n=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b, least=0.8):
    shared = len(a & b)
    return shared >= least * (len(a) + len(b) - shared)


def one_of_each(rows, least=0.8):
    """Indices of the rows that stay: of each group the smallest id, then the first; null ids last."""
    sets = [sets_of(t) for _, t in rows]
    label = reach(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b], least)])
    best = {}
    for k, ((i, _), g) in enumerate(zip(rows, label, strict=True)):
        best[g] = min(best.get(g, (1 << 60, 0)), (1 << 59 if i is None else i, k))
    return sorted(k for _, k in best.values())


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 8, "set_sizes": 2000}])
def test_near_copies(spark, docs, rows, nothing, sizes):
    """Against every pair's sets: edits of many strengths, chains of them, passages that many texts share, repeated ids, null ids."""
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k}" for k in range(400)]
    some = [(k, t) for k, (_, t) in enumerate(rows)]
    fresh = lambda n: rng.choice(vocabulary, n).tolist()
    passage = fresh(60)
    for k in range(12):
        w = fresh(120)
        for edits in range(6):
            some.append((30_000 + 10 * k + edits, " ".join(w)))
            w = list(w)
            for at in rng.integers(0, len(w), rng.integers(1, 5)):
                w[at] = str(rng.choice(vocabulary))
    some += [(40_000 + k, " ".join(passage + fresh(int(rng.integers(5, 60))))) for k in range(60)]
    some += [(7, "alpha beta gamma delta epsilon zeta"), (7, "one two three four five six"), (None, "one two three four five six"), (None, "only here and without any id"), (None, "only here and without any id")]
    table = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(some)], "doc_id long, text string, n long, _metadata long").repartition(3)
    stay = one_of_each(some)
    if sizes:
        placed, file, index = simhash._placed(table)
        near = simhash.near_copies(placed, **sizes).where("NOT kept")
        kept = placed.withColumns({"file": file, "index": index}).join(near.select("file", "index"), ["file", "index"], "left_anti").collect()
    else:
        kept = simhash.one_of_each(table).collect()
        assert simhash.one_of_each(table).columns == table.columns
    # of rows with one id and one text, either may be the first
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(some[k][0]), str(some[k][1])) for k in stay)
    assert len(stay) < len(some) - 40
    assert simhash.one_of_each(nothing).collect() == []


def test_shared_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(80)] + [np.arange(40), np.arange(41), np.arange(1, 41)]
    label, part = rng.integers(0, 70, len(sets)), np.zeros(len(sets), dtype=int)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if similar(set(sets[a].tolist()), set(sets[b].tolist()), 0.5)]
    same = [(a, b) for a in range(len(sets)) for b in range(a) if label[a] == label[b]]
    assert reach(len(sets), same + simhash.alike(sets, label, part, 0.5)) == reach(len(sets), same + links)
    halves = (np.arange(len(sets)) % 2) + 1
    across = [(a, b) for a, b in links if halves[a] != halves[b]]
    found = simhash.alike(sets, np.arange(len(sets)), halves, 0.5)
    assert reach(len(sets), found) == reach(len(sets), across) and set(found) <= set(across)


def test_lightest_forest():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n, m = int(rng.integers(2, 30)), int(rng.integers(1, 80))
        i, j, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 6, m)
        keep = i != j
        i, j, d = i[keep], j[keep], d[keep]
        got = simhash.lightest(n, i, j, d)
        label, total, taken = list(range(n)), 0, 0
        for k in np.argsort(d, kind="stable").tolist():
            a, b = label[i[k]], label[j[k]]
            if a != b:
                label = [a if x == b else x for x in label]
                total, taken = total + d[k], taken + 1
        assert len(got) == taken and d[got].sum() == total and reach(n, zip(i[got].tolist(), j[got].tolist(), strict=True)) == reach(n, zip(i.tolist(), j.tolist(), strict=True))


def vectors_of(spark):
    rng = np.random.default_rng(3)
    rows = []
    base = rng.normal(size=(40, 24))
    for i in range(300):
        v = base[i % 40] + rng.normal(size=24) * rng.choice([0.0, 0.03, 0.06, 0.12, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32) * (10.0 ** rng.integers(-3, 4))], int(i % 3)))
    rows += [(400 + k, rows[0][1], 0) for k in range(5)] + [(300, None, 0), (301, [], 1), (302, [0.0] * 24, 1), (303, [float("nan")] + [1.0] * 23, 1), (304, [None] + [1.0] * 23, 1), (305, [float("inf")] * 24, 1), (306, rows[0][1], None), (307, rows[0][1][:3], 0), (308, rows[0][1][:3], 0), (0, rows[0][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS block")


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_near_duplicates(spark, block):
    rows, table = vectors_of(spark)
    x = [np.array(v, dtype=np.float32).astype(float) if v and all(c is not None and np.isfinite(c) for c in v) and any(v) else None for _, v, _ in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                cos = x[a] @ x[b] / np.sqrt(x[a] @ x[a]) / np.sqrt(x[b] @ x[b])
                if cos >= 0.98:
                    links.append((a, b))
    label = reach(len(rows), links)
    least = {}
    for (i, _, _), g in zip(rows, label, strict=True):
        least[g] = min(i, least.get(g, 1 << 60))
    degree = [sum(k in p for p in links) for k in range(len(rows))]
    want = sorted((i, d, least[g], i == least[g]) for (i, _, _), d, g in zip(rows, degree, label, strict=True))
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(table, block=block).collect()) == want and len(links) > 100
    empty = table.limit(0)
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_quantisation_bound_is_never_passed():
    """The bound holds for every pair, and spares most of them the exact product."""
    rng = np.random.default_rng(4)
    a, b = embedding_dedup.Block(rng.normal(size=(300, 64))), embedding_dedup.Block(rng.normal(size=(200, 64)) * np.geomspace(1, 300, 64))
    exact = a.x @ b.x.T
    product = (a.q.astype(float) @ b.q.astype(float).T) * a.scale[:, None] * b.scale[None, :]
    bound = np.outer(a.whole, b.rest) + a.rest[:, None]
    assert (np.abs(exact - product) <= bound + 1e-12).all() and bound.max() < 0.2
    i, j, computed = embedding_dedup.tile_links(a, b, 0.3, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(exact >= 0.3)), strict=True)) and computed < 0.2 * exact.size


def test_oracle_agrees(spark):
    import duckdb

    from plumbline.llm.queries import op8_embedding_dedup

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.sql(OP8).select("vec_id", "n_links", "component_id", "kept").fetchall())
    assert sorted(tuple(r) for r in op8_embedding_dedup(spark, "/root/testdata/sf0.001").collect()) == want
