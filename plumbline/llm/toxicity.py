"""Toxicity scores: boosted trees over dense features of whole texts, with isotonic calibration.

The features are densities of a lexicon's words and word beginnings, how many of its words stand near the second
person, capitals, punctuation, and rates of obfuscation (digits and signs in place of letters, hidden letters,
words spelled letter by letter). The lexicon is learned too: terms that are far more frequent in toxic texts. One
part of the labelled sample gives the lexicon, another the trees, a third the calibration, so that no
stage is fitted on what the one before has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.boosting import Boosted, Isotonic
from plumbline.llm.text import ALNUM, Words, buffers, chunks, columns, written

#: Labelled documents that everything is fitted on: those whose ids have the lowest hash.
SAMPLE = 12_000
#: Terms of each kind in the lexicon, and toxic documents that a term must occur in.
TERMS, LEAST = 400, 3
#: Bytes of a word's beginning that can be a term.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
#: Words between a lexicon word and a second person that stands near.
NEAR = 5

#: The second person in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro vuestra"
).split()
#: Signs and digits that stand for letters.
STANDS_FOR = bytes.maketrans(b"013457@$", b"oieastas")
#: Characters of a word here: letters, digits, and signs that hide or replace letters.
WORD = ALNUM.copy()
WORD[[0x24, 0x2A, 0x40]] = True

_ODD = re.compile(rb"[0-9$*@]")
_SECOND = {w.encode() for w in SECOND_PERSON}
FEATURES = 18


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked by a trailing space."""
    return [word, *(word[:n] + b" " for n in BEGINNINGS if n < len(word))]


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents of a batch that hold the term."""
    for batch in batches:
        raw, at = buffers(batch.column("text"))
        label = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        count: dict[bytes, list[int]] = {}
        for a, b in chunks(at):
            words = Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], WORD)
            codes, distinct = words.coded()
            pairs = np.unique(words.row * len(distinct) + codes) if len(codes) else codes
            row, word = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
            edges = np.searchsorted(row, np.arange(b - a + 1))
            for r, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                for t in {t for w in word[lo:hi].tolist() for t in terms_of(distinct[w])}:
                    count.setdefault(t, [0, 0])[label[a + r]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.binary()), pa.array([n[1] for n in count.values()], pa.int64()), pa.array([n[0] for n in count.values()], pa.int64())], names=["term", "toxic", "clean"]
        )


class Lexicon:
    """Terms with their strength, the log odds of a toxic text."""

    def __init__(self, terms: dict[bytes, float]):
        self.words = {t: s for t, s in terms.items() if t[-1:] != b" "}
        self.beginnings = {t[:-1]: s for t, s in terms.items() if t[-1:] == b" "}
        self.lengths = [n for n in BEGINNINGS if any(len(t) == n for t in self.beginnings)]

    def _beginning(self, word: bytes) -> float:
        return max([0.0, *(self.beginnings.get(word[:n], 0.0) for n in self.lengths if n < len(word))])

    def entry(self, word: bytes) -> tuple[float, float, float, float, float]:
        """Strengths as a word, as a beginning, and as a disguised word; whether it is second person; whether
        letters in it are replaced or hidden."""
        plain = self.words.get(word, 0.0)
        if not _ODD.search(word):
            return plain, self._beginning(word), 0.0, float(word in _SECOND), 0.0
        core = word.strip(b"*@$")
        if not _ODD.search(core):
            return self.words.get(core, 0.0), self._beginning(core), 0.0, float(core in _SECOND), 0.0
        letters = bool(re.search(rb"[a-z\x80-\xff]", core))
        hidden = 0.0
        if letters:
            for ones in (b"i", b"l"):
                hidden = max(hidden, self.words.get(core.replace(b"1", ones).translate(STANDS_FOR), 0.0))
            if b"*" in core and not hidden:
                shape = re.compile(re.escape(core.translate(STANDS_FOR)).replace(rb"\*", b"."), re.S)
                hidden = max([0.0, *(s for w, s in self.words.items() if len(w) == len(core) and shape.fullmatch(w))])
        return plain, 0.0, hidden, float(core in _SECOND), float(letters)

    def features(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of FEATURES numbers for each text; an empty text has zeros."""
        n = len(at) - 1
        words = Words(raw, at, WORD)
        codes, distinct = words.coded()
        table = np.array([self.entry(w) for w in distinct], dtype=np.float64).reshape(-1, 5)
        per = table[codes]
        size = words.end - words.start
        row = words.row
        count = np.maximum(words.per_row, 1).astype(float)

        def sums(values: np.ndarray) -> np.ndarray:
            return np.bincount(row, weights=values, minlength=n)

        strong = np.maximum(np.maximum(per[:, 0], per[:, 1] * 0.5), per[:, 2])
        top = np.zeros(n)
        np.maximum.at(top, row, strong)
        # lexicon words with a second person at most NEAR words off, in the same text
        you = np.concatenate(([0], np.cumsum(per[:, 3])))
        i = np.arange(len(row))
        low, high = np.maximum(i - NEAR, words.word_at[:-1][row]), np.minimum(i + NEAR + 1, words.word_at[1:][row])
        near = (you[high] - you[low] > 0) & (strong > 0)
        # letters that stand alone one after another
        single = size == 1
        spelled = single & np.concatenate(([False], single[:-1])) & np.concatenate(([False], row[1:] == row[:-1]))
        upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        of = lambda mask: np.diff(upto(mask)[at]).astype(float)
        capital = (raw >= 0x41) & (raw <= 0x5A)
        letter = capital | ((raw >= 0x61) & (raw <= 0x7A))
        capitals, letters = of(capital), np.maximum(of(letter), 1)
        loud = sums((np.diff(upto(capital)[np.stack((words.start, words.end))], axis=0)[0] >= 2) & (size >= 3)) if len(row) else np.zeros(n)
        bytes_ = np.maximum(np.diff(at), 1).astype(float)
        hits, starts, hidden = sums(per[:, 0] > 0), sums(per[:, 1] > 0), sums(per[:, 2] > 0)
        return np.stack(
            [
                hits / count, sums(per[:, 0]) / count, starts / count, sums(per[:, 1]) / count, hidden / count, np.minimum(hits, 20), np.minimum(starts, 20), np.minimum(hidden, 20), top,
                sums(near) / count, sums(per[:, 3]) / count, capitals / letters, loud / count,
                of(raw == 0x21) / bytes_, of(raw == 0x3F) / bytes_, sums(per[:, 4]) / count, sums(spelled) / count, np.log1p(words.per_row),
            ],
            axis=1,
        )


class Model:
    """Lexicon, trees and calibration. Without labelled texts of both classes every score is the smoothed share of toxic ones."""

    def __init__(self, lexicon: Lexicon, trees: Boosted | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(at) - 1, self.share)
        return np.clip(self.calibration(self.trees.raw(self.lexicon.features(raw, at))), 0.0, 1.0)


def _feature_batches(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            rows = [x for a, b in chunks(at) for x in lexicon.features(raw[at[a] : at[b]], at[a : b + 1] - at[a]).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("part"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic). Learns from labelled rows whose crc32 of the id as text is
    not divisible by `fold`; of several labels of an id the majority counts, a tie as toxic; null labels and ids
    are left out. At most `sample` ids are fitted on, one text of each."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    ids = ids.where(number % fold != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
    # `sample` rows of two numbers: a bounded side
    texts = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    # an id may be repeated: of its texts the one with the lowest hash serves, so that rows are as bounded as ids
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    texts = written(texts.select("*", part.cast("int").alias("part")))
    share = texts.agg((F.sum("toxic") + 0.5) / (F.count(F.lit(1)) + 1)).first()[0]
    share = 0.0 if share is None else float(share)
    total = texts.where("part < 5").agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = total[0] or 0, total[1] - (total[0] or 0)
    if not toxic or not clean:
        return Model(Lexicon({}), None, None, share)
    seen = texts.where("part < 5").mapInArrow(_term_batches, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    seen = seen.where(F.col("toxic") >= LEAST).select("term", odds.alias("odds"), (odds * F.sqrt("toxic")).alias("weight")).where("odds > 1.5")
    terms: dict[bytes, float] = {}
    for kind in (seen.where(~F.endswith("term", F.lit(b" "))), seen.where(F.endswith("term", F.lit(b" ")))):
        terms |= {bytes(r.term): r.odds for r in kind.orderBy(F.desc("weight"), "term").limit(TERMS).collect()}
    lexicon = Lexicon(terms)
    rows = texts.where("part >= 5").mapInArrow(_feature_batches(lexicon), "toxic int, part int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    y, part_of = rows.column("toxic").to_numpy().astype(float), rows.column("part").to_numpy()
    order = np.lexsort((*x.T, y, part_of))
    x, y, part_of = x[order], y[order], part_of[order]
    fitted, held = part_of < 8, part_of >= 8
    if not 0 < y[fitted].sum() < fitted.sum():
        return Model(lexicon, None, None, share)
    trees = Boosted(x[fitted], y[fitted])
    return Model(lexicon, trees, Isotonic(trees.raw(x[held]), y[held]), share)


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            parts = [model.score(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in chunks(at)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; held_out: the id's crc32 is divisible by `fold`.

    Scores depend on the text alone: null and empty texts get that of a text without words. A null id is held
    out (its crc32 counts as 0). Texts of any length are scored whole.
    Repeated rows are scored one by one, other columns are not looked at, and an empty table gives no rows."""
    texts = columns(docs, (id_col, "doc_id"), (text_col, "text"))
    model = fit(texts, labels.select("doc_id", "toxic"), sample, fold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % fold == 0
    return texts.select("doc_id", "text", held.alias("held_out")).mapInArrow(_score_batches(model), "doc_id long, held_out boolean, score double, predicted int")


def _keep_batches(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(text_col))
            parts = [model.score(raw[at[a] : at[b]], at[a : b + 1] - at[a]) < 0.5 for a, b in chunks(at)]
            yield batch.filter(pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=bool)))

    return run


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose score is below a half. Null and empty texts have the score of a text without words; repeated
    rows and null ids are judged row by row; an empty table gives no rows."""
    texts = columns(docs, (id_col, "doc_id"), (text_col, "text"))
    return docs.mapInArrow(_keep_batches(fit(texts, labels.select("doc_id", "toxic"), sample, fold), text_col), docs.schema)
