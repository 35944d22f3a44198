"""Operators on single texts against brute force: decontamination, tokens, licenses, language model."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import decontaminate, licenses, lm_score, token_counts
from plumbline.llm.fm_index import FMIndex
from tests.llm.conftest import low

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(frame, *more):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# FM-index


@pytest.mark.parametrize("kinds", [1, 2, 5, 60])
def test_fm_index(kinds):
    rng = np.random.default_rng(kinds)
    text = rng.integers(1, kinds + 1, 700)
    text[300:500] = text[100:300]
    index = FMIndex(text)
    for m in (1, 2, 4, 9):
        patterns = np.array([text[i : i + m] for i in rng.integers(0, 690, 30)] + [rng.integers(1, kinds + 3, m) for _ in range(20)])
        for p, a, b in zip(patterns, *index.search(patterns), strict=True):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


# decontamination


def benchmark_of(spark):
    real = [(str(r.item_id), r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    return [*real, ("short", "Two, WORDS!"), ("none", "..."), ("null", None), ("z", "z " * 9), (None, "a b c"), ("10", "tab and cr"), ("9", "tab and cr")]


def brute_scan(text, items):
    words = ALNUM.findall(low(text))
    hit, found = set(), set()
    for item, phrase in items:
        w = ALNUM.findall(low(phrase))
        for i in range(max(len(w) - 7, min(1, len(w)))):
            window = w[i : i + 8]
            for k in range(len(words) - len(window) + 1):
                if words[k] == window[0] and words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
    items = sorted(x for x in found if x is not None)
    return len(words), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= 2


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 3000])
def test_decontamination(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    items = benchmark_of(spark)
    table = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.report(docs, table)
    want = sorted(((i, *brute_scan(t, items)) for i, t in rows), key=str)
    assert by_row(got) == want and sum(r[2] for r in want) > 100 and any(r[5] for r in want)
    kept = decontaminate.clean(docs, table, count_col="n_chars")
    assert kept.columns == docs.columns
    left = {r.doc_id: r for r in kept.collect()}
    for (i, t), r in zip(sorted(rows, key=str), sorted(((i, *brute_scan(t, items)) for i, t in rows), key=str), strict=False):
        if i is None:
            continue
        mine = brute_scan(t, items)
        if mine[4]:
            assert i not in left
        elif mine[1]:
            assert brute_scan(left[i].text, items)[1] == 0 and left[i].n_chars == len(left[i].text)
        else:
            assert left[i].text == t


def test_decontamination_of_nothing(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.report(nothing, empty).count() == 0
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, empty).collect()} == {(0, 0, False)}


# tokens


def test_token_counts(docs, rows, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    n = [len(library.encode(t or "")) for _, t in rows]
    want = sorted(((i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(rows, n, strict=True)), key=str)
    assert by_row(token_counts.token_counts(docs, path)) == want and any(w[3] for w in want)
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_counts_of_any_text():
    import random

    import pyarrow as pa
    import sentencepiece

    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\t▁ab'é日.1\r") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    (out,) = token_counts._counter(path, {}, 10)([batch])
    assert out.column("n_tokens").to_pylist() == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]


# licenses


def test_license_base(spark, docs, rows, nothing):
    more = [(1, "Under the MIT License. (c) under the mit-license, Apache License, Version 2.0; CC BY-NC"), (2, "under the mit"), (3, None), (4, "apache license version 2 apache license version 2")]
    all_rows = rows + more
    got = licenses.scan(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")))
    want = []
    for i, t in all_rows:
        w = ALNUM.findall(low(t))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert by_row(got.select(columns)) == sorted(want, key=str)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert licenses.scan(nothing).count() == 0


def expand(template):
    """All the wordings of a template, {low-high} filled with 'any'."""
    part = re.search(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", template)
    if part:
        return expand(template[: part.start()] + template[part.end() :]) | expand(template[: part.start()] + part[1] + template[part.end() :])
    part = re.search(r"\{(\d+)-(\d+)\}", template)
    if part:
        low_, high = int(part[1]), int(part[2])
        return {x for n in {low_, high} for x in expand(template[: part.start()] + " any" * n + " " + template[part.end() :])}
    return {" ".join(template.split())}


@pytest.mark.parametrize(("label", "template"), licenses.TEMPLATES)
def test_license_templates(label, template):
    scanner = licenses.Scanner(templates=((label, template),))
    ((_, automaton, _, _),) = [x for x in scanner.all if not x[3]]
    number = lambda text: [scanner.vocabulary.get(w.encode(), 0) for w in text.split()]
    for wording in sorted(expand(template)):
        words = number(wording)
        assert automaton.accepts(words) == len(words), wording
        assert automaton.accepts([*words, 0, 0]) >= len(words)
    mandatory = re.sub(r"\[\[.*?\]\]+|\{.*?\}", " | ", template)
    first = max(mandatory.split("|"), key=lambda p: len(p.split())).split()[-1]
    wrong = [w if w != first else "wrong" for w in min(expand(template), key=len).split()]
    assert not automaton.accepts(number(" ".join(wrong)))


def test_license_templates_in_texts(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "All Rights\nreserved!", "all rights were reserved", "Copyright (c) 2020 Some One. All rights reserved", "licensed under the GNU Public License version 3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"]
    got = [r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:5] == ["gpl-3", "all-rights-reserved", "", "all-rights-reserved", ""]


def test_templates_that_begin_with_any_words(spark):
    docs = spark.createDataFrame([(1, "unknown foo bar"), (2, "foo bar"), (3, "x y z w foo bar"), (4, "foo x foo bar")], "doc_id long, text string")
    got = {r.doc_id: [(m["first"], m["words"]) for m in r.matches] for r in licenses.scan(docs, (), (("l", "{1-3} foo bar"),)).collect()}
    assert got == {1: [(0, 3)], 2: [], 3: [(1, 5), (2, 4), (3, 3)], 4: [(0, 4), (1, 3)]}


def test_licence_texts_are_matched_whole(spark):
    plain = lambda t: re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\d+-\d+\}", "Jane Doe", t))
    texts = {"mit": licenses.MIT_TEXT, "bsd-3-clause": f"{licenses.BSD_HEAD} {licenses.BSD_THIRD} {licenses.BSD_TAIL}", "bsd-2-clause": f"{licenses.BSD_HEAD} {licenses.BSD_TAIL}", "mpl-2": licenses.MPL_NOTICE, "gpl-3": f"{licenses.GPL_NOTICE} 3 of the license", "lgpl-2.1": f"{licenses.LGPL_NOTICE} 2.1 of the license"}
    rows = [(k, f"Copyright (c) 2020. {plain(t)}. The end") for k, t in enumerate(texts.values())]
    # a condition more or less is another licence
    clause = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement. "
    rows += [(10, plain(licenses.BSD_HEAD) + clause + plain(licenses.BSD_THIRD) + plain(licenses.BSD_TAIL)), (11, plain(licenses.MIT_TEXT)[:200]), (12, plain(licenses.MIT_TEXT).replace("sublicense", "lease"))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [{label} for label in texts]
    assert got[10] == got[11] == got[12] == {""}


def test_refused_templates():
    for bad in ("[[a]]", "[[a b", "{0-3}"):
        with pytest.raises((ValueError, IndexError)):
            licenses.Scanner(templates=(("x", bad),))


# language model


def test_lm_base_scores(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 200)  # so that most words take the join
    got = {}
    for r in lm_score.scores(docs, vocabulary=24).collect():
        got.setdefault(r.doc_id, []).append(r)
    count, n = Counter(), 0
    for i, t in rows:
        if crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            w = SPACED.findall(low(t))
            count.update([*w, None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*SPACED.findall(low(t)), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens)
        for r in got[i]:
            if r.n_tokens == len(tokens):
                assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_known == sum(count[x] > 0 for x in tokens)
            assert r.held_out == (crc32(b"" if i is None else str(i).encode()) % 7 == 2) and r.train_tokens == n and r.score < 0
        assert len(tokens) in [r.n_tokens for r in got[i]]
    assert sum(map(len, got.values())) == len(rows)
    assert lm_score.scores(nothing, vocabulary=8).count() == 0


def test_lm_is_a_distribution_and_learns():
    """Probabilities after every context sum to one; held-out text is likelier than by unigram counts."""
    rng = np.random.default_rng(0)
    n = 12
    move = rng.dirichlet(np.full(n - 3, 0.3), n)
    draw = lambda k: np.array(_chain(rng, move, k))
    train, test = draw(20_000), draw(4000)
    count = np.zeros((n, n, n), dtype=np.int64)
    np.add.at(count, (train[:-2], train[1:-1], train[2:]), 1)
    count[:, :, 1] += 0
    first, second, log_z = lm_score.LogBilinear(count, steps=150).tables()
    total = np.exp(first[:, None, :] + second[None, :, :] - log_z[:, :, None]).sum(axis=2)
    assert np.allclose(total, 1)
    model = (first[test[:-2], test[2:]] + second[test[1:-1], test[2:]] - log_z[test[:-2], test[1:-1]]).mean()
    share = np.bincount(train, minlength=n) / len(train)
    assert model > np.log(share[test[2:]]).mean() + 0.2


def _chain(rng, move, k):
    out = [3]
    for _ in range(k - 1):
        out.append(3 + rng.choice(len(move) - 3, p=move[out[-1]]))
    return out


def test_lm_beats_unigrams_on_held_out(spark):
    scored = lm_score.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)).where("held_out")
    base, model = scored.selectExpr("sum(base_score)", "sum(score)").first()
    assert model > base


def test_lm_learns_words_beyond_the_most_frequent(spark):
    """Pairs of words, none of them among the classes of the small model: the second follows from the first, or not."""
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 40, (6000, 10))
    texts = [" ".join(f"a{k} b{k}" for k in row) for row in pairs.tolist()]
    odd = [" ".join(f"a{k} b{(k + 7) % 40}" for k in row) for row in pairs[:300].tolist()]
    docs = spark.createDataFrame([*enumerate(texts), *((-1 - i, t) for i, t in enumerate(odd) if crc32(str(-1 - i).encode()) % 7 == 2)], "doc_id long, text string")
    scored = lm_score.scores(docs, vocabulary=8).where("held_out").cache()
    right, base = scored.where("doc_id >= 0").selectExpr("avg(score)", "avg(base_score)").first()
    wrong = scored.where("doc_id < 0").selectExpr("avg(score)").first()[0]
    # a right pair's second word is nearly certain: up to half of the text's information
    assert right > 0.75 * base and right > wrong + 5


def test_lm_score_of_each_text(docs, rows):
    """Against loops over the model's matrix, for every text: rare, trained and grouped words, ends, empty and long texts."""
    texts = docs.select("doc_id", "text")
    fitted = lm_score.Fitted(texts, 7, 2, 16)
    m, count = fitted.model, Counter()
    assert fitted.modelled > 30 and m.groups > 2
    for i, t in rows:
        if crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            count.update([*SPACED.findall(low(t)), None])
    p, d = m.p.astype(np.float64), m.width
    first, c = p[m.first : m.second], p[m.c :, :d]
    logs = {}

    def log_p(x, y, z):
        if (x, y, z) not in logs:
            h = np.append(p[x, :d] @ c[:d] + p[y, :d] @ c[d:], 1.0)
            share = lambda q, k: (q @ h)[k] - np.log(np.exp(q @ h).sum())
            out = z if z < m.n else m.n + (z - m.n) // m.size
            found = share(first[m.allowed], int(m.allowed[:out].sum()))
            if z >= m.n:
                group = (z - m.n) // m.size * m.size
                found += share(p[m.second + group : min(m.second + group + m.size, m.c)], z - m.n - group)
            logs[x, y, z] = found / math.log(10)
        return logs[x, y, z]

    got = Counter((r.doc_id, r.n_tokens, round(r.score, 2)) for r in lm_score.scores(docs, vocabulary=16).collect())
    for i, t in rows:
        words = SPACED.findall(low(t))
        if len(words) > 3000:
            continue
        want, x, y = 0.0, lm_score.BEGIN, lm_score.BEGIN
        for w in words:
            z = fitted.table.get(lm_score._key(w.encode()), fitted.modelled)
            z = z if z < fitted.modelled else lm_score.OTHER
            want += log_p(x, y, z) + (math.log10(count[w] + 1) - fitted.divided if z == lm_score.OTHER else 0)
            x, y = y, z
        want += log_p(x, y, lm_score.END)
        close = [k for k in got if k[0] == i and k[1] == len(words) + 1 and abs(k[2] - want) < 0.02 + 1e-5 * abs(want)]
        assert close, (i, want)


def test_lm_factored_is_a_distribution():
    rng = np.random.default_rng(1)
    n, ids = 6, 60
    start = lm_score.LogBilinear(rng.integers(0, 9, (n, n, n)), steps=3)
    model = lm_score.Factored(start, np.sort(rng.integers(1, 99, ids))[::-1].copy())
    x, y, z = (rng.integers(0, ids, 3000) for _ in range(3))
    model.train(x, y, np.where(z == lm_score.BEGIN, 1, z), 1, 0)
    every = np.array([i for i in range(ids) if i != lm_score.BEGIN])
    for a, b in ((0, 0), (2, 2), (2, 40), (59, 3)):
        logs = model.log_probability(np.full(len(every), a), np.full(len(every), b), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
