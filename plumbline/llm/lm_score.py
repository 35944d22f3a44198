"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

1. Words of all training texts are counted (grouped sum, pre-aggregated in the tasks).
2. The model knows the words that occur TRAINED times or more, up to a number that grows with the corpus. A word has a
   vector as context. As target it is one of the most frequent words, which the first level of the output holds by
   themselves, or it belongs to a group of words of like frequency: the first level predicts the group, the second the
   word in it. There are about as many groups as words in each. Rarer words are one class, divided among them in
   proportion to (count + 1).
3. Log-bilinear model: the vector predicted from two words is R[a] C1 + R[b] C2, and an output's score its product
   with Q[w], plus a bias. It starts from a small model of the most frequent words (LogBilinear, on counted sequences of
   three classes). Then shards of the training texts, whose number grows with the root of the corpus, go on
   training it by noise-contrastive estimation with drawn noise words, and the mean of their changes is the model.
4. Batched matrix products give the scores of all outputs of the first level and of a group after each context, and
   their exact normalisation.
5. Texts are written as ids once; cells, shards and scores read these. Words in the broadcast table are counted in the
   task that reads the text; the rest meet their counts in a join, a row for each word and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import SPACED, Words, buffers, chunks, columns, crc_of_id, written

#: Outputs that are not groups: rare words, the end, the beginning (context only), and the most frequent words.
VOCABULARY = 128
OTHER, END, BEGIN, WORDS = 0, 1, 2, 3
#: Words that occur TRAINED times or more in the training texts have vectors of their own, the most frequent first: ROOT times the
#: cube root of the tokens, so that the model grows with the corpus and fits a worker at any size.
TRAINED, ROOT = 20, 40
#: A word that makes up at least 1/HEAD of all tokens is in the broadcast table, too, which bounds the table by HEAD. Words of
#: more than LONGEST bytes are there by their digest.
HEAD, LONGEST = 2_000_000, 64
#: A corpus of n times as many tokens has the root of n more shards to train in.
SHARD_TOKENS = 400_000
#: Tokens that small corpora are trained on, over and over.
PASSES, PASSED_TOKENS = 8, 4_000_000
#: Steps that a shard's training takes, about, the tokens of each that are worked on at once, and the first step's rate.
STEPS, PART, RATE = 400, 4096, 0.15
#: Tokens that a shard holds in memory, and shuffles, at a time.
HELD = 2_000_000
#: Bytes of text that are split into words at a time: the more, the fewer words are looked up again.
CHUNK = 3 << 20
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n); the end has word null."""
    count: dict[bytes | None, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        raw, at = buffers(batch.column("text"))
        if batch.num_rows:
            count[None] = count.get(None, 0) + batch.num_rows
        for a, b in chunks(at, CHUNK):
            codes, distinct = Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], SPACED).coded()
            for word, n in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist(), strict=True):
                count[word] = count.get(word, 0) + n
            if len(count) > COUNTED:
                yield out()
                count.clear()
    yield out()


def _sequences(classes: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a few texts, ends included: its two classes before, its own, and its row."""
    rows = len(per_row)
    size = per_row + 3
    ends = np.cumsum(size)
    padded = np.full(ends[-1] if rows else 0, BEGIN, dtype=np.int64)
    body = np.ones(len(padded), dtype=bool)
    for k in (0, 1):
        body[ends - size + k] = False
    body[ends - 1] = False
    padded[body] = classes
    padded[ends - 1] = END
    body[ends - 1] = True
    at = np.flatnonzero(body)
    return padded[at - 2], padded[at - 1], padded[at], np.repeat(np.arange(rows), per_row + 1)


def _texts_of(column: pa.Array, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, ids, words of each) for runs of rows [a, b) of a column of coded texts, of at most `most` words; a longer text stands alone."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4 if len(column) else np.zeros(1, np.int64)
    ids = np.frombuffer(column.buffers()[2], np.int32) if len(column) and at[-1] > at[0] else np.zeros(0, np.int32)
    for a, b in chunks(at, most):
        yield a, b, ids[at[a] : at[b]], np.diff(at[a : b + 1])


def _cell_batches(n: int):
    """How often each sequence of three classes occurs, of `n`: ids from there on are OTHER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met, size = np.zeros(n**3, dtype=np.int64), [], 0
        for batch in batches:
            for _, _, ids, per_row in _texts_of(batch.column("ids")):
                x, y, z, _ = _sequences(np.where(ids < n, ids, OTHER), per_row)
                met.append(((x * n + y) * n + z).astype(np.int32))
                size += len(z)
                if size > n**3:
                    total += np.bincount(np.concatenate(met), minlength=n**3)
                    met, size = [], 0
        if met:
            total += np.bincount(np.concatenate(met), minlength=n**3)
        cell = np.flatnonzero(total)
        for lo in range(0, len(cell), 100_000):
            part = cell[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    return run


class LogBilinear:
    """count[a, b, w]: how often class w follows a, b."""

    def __init__(self, count: np.ndarray, width: int = 16, noise: int = 8, steps: int = 100, seed: int = 0):
        n, rng = len(count), np.random.default_rng(seed)
        self.r, self.q = rng.normal(0, 0.1, (2, n, width)).astype(np.float32)
        self.c = np.stack((np.eye(width, dtype=np.float32) * 0.5, np.eye(width, dtype=np.float32)))
        unigram = count.sum(axis=(0, 1), dtype=np.float64) + 0.1
        unigram[BEGIN] = 0
        unigram /= unigram.sum()
        self.allowed = unigram > 0
        log_noise = np.log(np.where(self.allowed, unigram, 1)).astype(np.float32)
        self.bias = log_noise.copy()
        total = max(float(count.sum()), 1.0)
        data = (count / total).astype(np.float32)
        contexts = data.sum(axis=2)
        noise_rate = (noise * unigram).astype(np.float32)
        shift = log_noise + np.float32(np.log(noise))
        slow, fast = ({k: np.zeros_like(v) for k, v in self._all().items()} for _ in range(2))
        for step in range(1, steps + 1):
            gradient = {k: np.zeros_like(v) for k, v in self._all().items()}
            for a in range(n):
                some = np.flatnonzero(contexts[a])
                if not len(some):
                    continue
                predicted = self.r[a] @ self.c[0] + self.r[some] @ self.c[1]
                p = 1 / (1 + np.exp(np.clip(shift - (predicted @ self.q.T + self.bias), -30, 30)))
                # of log p for the data and log(1 - p) for the noise
                g = data[a, some] * (1 - p) - contexts[a, some][:, None] * noise_rate * p
                gradient["q"] += g.T @ predicted
                gradient["bias"] += g.sum(axis=0)
                back = g @ self.q
                gradient["c"][0] += np.outer(self.r[a], back.sum(axis=0))
                gradient["c"][1] += self.r[some].T @ back
                gradient["r"][a] += self.c[0] @ back.sum(axis=0)
                gradient["r"][some] += back @ self.c[1].T
            rate = 0.05 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in self._all().items():
                slow[k] += 0.1 * (gradient[k] - slow[k])
                fast[k] += 0.01 * (gradient[k] ** 2 - fast[k])
                v += rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.99**step)) + 1e-9)

    def _all(self) -> dict[str, np.ndarray]:
        return {"r": self.r, "q": self.q, "c": self.c, "bias": self.bias}

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the first and second word of the context (bias within the second), and the log of the
        normalisation of every context: log P(w | a, b) = first[a, w] + second[b, w] - log_z[a, b]."""
        first = (self.r @ self.c[0] @ self.q.T).astype(np.float64)
        second = (self.r @ self.c[1] @ self.q.T + self.bias).astype(np.float64)
        second[:, ~self.allowed] = -np.inf
        log_z = np.empty((len(first), len(first)))
        for a in range(len(first)):
            scores = first[a] + second
            top = scores.max(axis=1)
            log_z[a] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return first, second, log_z


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else sha256(word).digest()


def _code_batches(table: dict[bytes, int], listed: np.ndarray, known: int, end_count: int, modulus: int, remainder: int):
    """A row for each text: its words' ids, OTHER from `known` on, and what the table of listed words says about them. table: place of each
    listed word; listed: the count at each place. A row more for each word of a text that the table doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            held = crc_of_id(batch.column("doc_id")) % modulus == remainder
            for a, b in chunks(at, CHUNK):
                words = Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], SPACED)
                codes, distinct = words.coded()
                n, m = b - a, len(distinct)
                place, classes = _ids(table, known, codes, distinct)
                count = np.where(place >= 0, listed[place], -1)[codes]
                in_head, other = count >= 0, classes == OTHER
                logs = np.log10(np.maximum(count, 0) + 1.0)
                of = lambda weights: np.bincount(words.row, weights=weights, minlength=n)  # noqa: B023, E731
                base = of(logs) + np.log10(end_count + 1.0)
                known_words = of(in_head).astype(np.int64) + (end_count > 0)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * words.word_at).astype(np.int32)), pa.py_buffer(classes.astype(np.int32))])
                keys = key + np.arange(n)
                key += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column("doc_id").slice(a, n), pa.array(held[a:b]), pa.array(words.per_row + 1), pa.array(known_words), pa.array(base), pa.array(of(np.where(other, logs, 0.0))), pa.array(of(other).astype(np.int64)), ids, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())],
                    names=_CODED,
                )
                tail = np.flatnonzero(~in_head)
                pairs, times = np.unique(words.row[tail] * np.int64(max(m, 1)) + codes[tail], return_counts=True)
                k = len(pairs)
                if k:
                    rare = pa.array(distinct, pa.binary()).take(pa.array(pairs % m))
                    empty = [pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[pairs // m]), *empty, rare, pa.array(times)], names=_CODED)

    return run


_CODED = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "others", "n_other", "ids", "word", "n"]
_CODED_TYPES = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, others double, n_other long, ids binary, word binary, n long"


def _ids(table: dict[bytes, int], known: int, codes: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each distinct word in the table (-1: none), and the model's id of each word."""
    get = table.get
    place = np.fromiter((get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
    for i in np.flatnonzero(place < 0).tolist():
        if len(distinct[i]) > LONGEST:
            place[i] = get(_key(distinct[i]), -1)
    return place, np.where((place >= 0) & (place < known), place, OTHER)[codes]


class Factored:
    """The model of all trained words. One matrix holds, a row each: the context vectors of all ids, the outputs of the first
    level (frequent words, then groups), those of the second (words of groups), and C1 and C2. The last column is the bias."""

    def __init__(self, start: LogBilinear, counts: np.ndarray):
        """counts: of each id, in the order of ids; those of OTHER, END and BEGIN first."""
        self.n, self.ids, self.width = len(start.bias), len(counts), start.r.shape[1]
        self.grouped = max(self.ids - self.n, 0)
        self.size = max(math.isqrt(max(self.grouped - 1, 0)) + 1, 1)
        self.groups = -(-self.grouped // self.size)
        self.first = self.ids
        self.second = self.first + self.n + self.groups
        self.c = self.second + self.grouped
        self.p = p = np.zeros((self.c + 2 * self.width, self.width + 1), dtype=np.float32)
        d = self.width
        some = min(self.n, self.ids)
        p[:some, :d], p[some : self.ids, :d] = start.r[:some], start.r[OTHER]
        p[self.first : self.first + self.n] = np.concatenate((start.q, start.bias[:, None]), axis=1)
        p[self.first + self.n : self.second] = p[self.first + OTHER]
        p[self.c :, :d] = start.c.reshape(2 * d, d)
        words = counts[self.n :].astype(np.float64)
        mass = np.add.reduceat(words, np.arange(0, self.grouped, self.size)) if self.grouped else np.zeros(0)
        shares = np.concatenate(([counts[OTHER] + 0.1], mass))
        shares = np.log(shares / shares.sum())
        p[self.first + OTHER, d] += shares[0]
        p[self.first + self.n : self.second, d] += shares[1:]
        group = np.arange(self.grouped) // self.size
        p[self.second : self.c, d] = np.log(words / mass[group]) if self.grouped else 0
        self.allowed = np.concatenate((start.allowed, np.ones(self.groups, dtype=bool)))
        # noise: unigrams of the first level, and of each group
        top = np.zeros(self.n)
        top[:some] = counts[:some] + 0.1
        noise = np.where(self.allowed, np.concatenate((top, mass)), 0)
        self.noise = noise / noise.sum()
        self.log_noise = np.log(np.where(self.noise > 0, self.noise, 1)).astype(np.float32)
        self.within = p[self.second : self.c, d].copy()
        self.up_to = np.concatenate(([0], np.cumsum(words)))
        self.squares, self.seen = None, 0

    def outputs(self, z: np.ndarray) -> np.ndarray:
        """Output of the first level for each id."""
        return np.where(z < self.n, z, self.n + (z - self.n) // self.size)

    def predicted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = self.width
        h = np.ones((len(x), d + 1), dtype=np.float32)
        h[:, :d] = self.p[x, :d] @ self.p[self.c : self.c + d, :d] + self.p[y, :d] @ self.p[self.c + d :, :d]
        return h

    def train(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, passes: int, seed: int, expected: int = 0, batch: int | None = None, drawn: int = 64, noise: int = 8, few: int = 1, rate: float = RATE) -> np.ndarray:
        """Goes on training on tokens z after x, y, of `expected` that are to come in all; returns how often each row of the matrix was
        changed so far."""
        rng, p, d = np.random.default_rng(seed), self.p, self.width
        expected = max(expected, len(z))
        batch = batch or min(max(passes * expected // STEPS, 256), 1 << 18)
        if self.squares is None:
            self.squares, self.changed = np.zeros(len(p), dtype=np.float32), np.zeros(len(p), dtype=np.int32)
        edges, out_of = np.cumsum(self.noise), self.outputs(np.arange(self.ids))
        shift, own_shift = np.float32(math.log(noise)), np.float32(math.log(few))
        for _ in range(passes):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), batch):
                self.rate = rate * max(1 - self.seen / (passes * expected), 0.01)
                self.seen += min(batch, len(z) - lo)
                sums = np.zeros((len(p), d + 1), dtype=np.float32)
                met = np.zeros(len(p), dtype=bool)
                false = np.minimum(np.searchsorted(edges, rng.random(drawn) * edges[-1], "right"), len(edges) - 1)
                v, u = p[self.first + false], np.zeros((drawn, d + 1), dtype=np.float32)
                # parts that stay in a core's cache; all of them see the weights as they were before the batch
                for i in range(lo, min(lo + batch, len(z)), PART):
                    some = order[i : min(i + PART, lo + batch)]
                    a, b, w = x[some], y[some], z[some]
                    h, out = self.predicted(a, b), out_of[w]
                    # first level: one draw of noise for the whole batch
                    q = p[self.first + out]
                    g = 1 - _sigmoid(np.einsum("nd,nd->n", h, q) - self.log_noise[out] - shift)
                    f = np.float32(-noise / drawn) * _sigmoid(h @ v.T - (self.log_noise[false] + shift))
                    back = g[:, None] * q + f @ v
                    u += f.T @ h
                    _add(sums, met, self.first + out, g[:, None] * h)
                    # second level: a few words of the same group for each token
                    deep = np.flatnonzero(w >= self.n)
                    if len(deep):
                        word, hd = w[deep] - self.n, h[deep]
                        begin = word // self.size * self.size
                        end = np.minimum(begin + self.size, self.grouped)
                        low = self.up_to[begin]
                        wide, back_deep = self.up_to[end] - low, np.zeros_like(hd)
                        for k in range(few + 1):
                            pick = word if k == 0 else np.clip(np.searchsorted(self.up_to, low + rng.random(len(deep)) * wide, "right") - 1, begin, end - 1)
                            q = p[self.second + pick]
                            g = np.float32(k == 0) - _sigmoid(np.einsum("nd,nd->n", hd, q) - self.within[pick] - own_shift)
                            back_deep += g[:, None] * q
                            _add(sums, met, self.second + pick, g[:, None] * hd)
                        back[deep] += back_deep
                    back = back[:, :d]
                    ra, rb, c = p[a, :d], p[b, :d], p[self.c :, :d]
                    _add(sums, met, a, back @ c[:d].T)
                    _add(sums, met, b, back @ c[d:].T)
                    sums[self.c : self.c + d, :d] += ra.T @ back
                    sums[self.c + d :, :d] += rb.T @ back
                _add(sums, met, self.first + false, u)
                met[self.c :] = True
                self._step(sums, met)
        return self.changed

    def _step(self, sums: np.ndarray, met: np.ndarray) -> None:
        rows = np.flatnonzero(met)
        g = sums[rows]
        self.squares[rows] += np.einsum("nd,nd->n", g, g) / g.shape[1]
        self.changed[rows] += 1
        self.p[rows] += self.rate * g / np.sqrt(self.squares[rows] + np.float32(1e-8))[:, None]

    def log_probability(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, step: int = 1024) -> np.ndarray:
        """Natural log of P(z | x, y), normalised over all outputs of the first level and all words of z's group."""
        q = self.p[self.first : self.second].T.copy()
        q[-1, ~self.allowed] = -np.inf
        out, found = self.outputs(z), np.empty(len(z))
        for lo in range(0, len(z), step):
            part = slice(lo, lo + step)
            found[part] = _log_share(self.predicted(x[part], y[part]), q, out[part])
        deep = np.flatnonzero(z >= self.n)
        deep = deep[np.argsort(out[deep], kind="stable")]
        edges = [*np.flatnonzero(np.diff(out[deep], prepend=-1)).tolist(), len(deep)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            begin = (int(out[deep[lo]]) - self.n) * self.size
            v = self.p[self.second + begin : self.second + min(begin + self.size, self.grouped)].T
            for i in range(lo, hi, step):
                some = deep[i : min(i + step, hi)]
                found[some] += _log_share(self.predicted(x[some], y[some]), v, z[some] - self.n - begin)
        return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _add(sums: np.ndarray, met: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
    """Adds a gradient to each of the rows of sums; as flat places, for which NumPy has a fast loop."""
    wide, d = sums.shape[1], grads.shape[1]
    np.add.at(sums.reshape(-1), (rows[:, None] * wide + np.arange(d)).ravel(), grads.ravel())
    met[rows] = True


def _log_share(h: np.ndarray, q: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of each row's scores h q, the log of the softmax at `which`."""
    scores = h @ q
    own = scores[np.arange(len(which)), which].astype(np.float64)
    top = scores.max() if scores.size else 0
    scores -= top
    np.exp(scores, out=scores)
    total = (scores @ np.ones(scores.shape[1], dtype=np.float32)).astype(np.float64)
    found = own - top - np.log(np.maximum(total, 1e-300))
    # rows that lie far below the highest of all are done by themselves
    far = np.flatnonzero(total < 1e-20)
    if len(far):
        scores = (h[far] @ q).astype(np.float64)
        tops = scores.max(axis=1)
        found[far] = own[far] - tops - np.log(np.exp(scores - tops[:, None]).sum(axis=1))
    return found


def _shard_batches(start: LogBilinear, counts: np.ndarray, passes: int, expected: int):
    """(row, times, change) of the rows of the matrix that a shard's texts change; a shard is a partition, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, times, tokens, held, turn = None, None, [], 0, 0

        def learn() -> None:
            nonlocal times, tokens, held, turn
            ids = np.concatenate(tokens)
            at = np.flatnonzero(ids != BEGIN)
            times = model.train(ids[at - 2], ids[at - 1], ids[at], passes, seed=TaskContext.get().partitionId() + (turn << 32), expected=expected)
            tokens, held, turn = [], 0, turn + 1

        for batch in batches:
            if model is None:
                model = Factored(start, counts)
                before = model.p.copy()
            for ids in batch.column("ids"):
                own = np.frombuffer(ids.as_py(), np.int32)
                tokens += [np.array([BEGIN, BEGIN], np.int32), own, np.array([END], np.int32)]
                held += len(own) + 1
                if held >= HELD:
                    learn()
        if tokens:
            learn()
        if model is None or times is None:
            return
        rows = np.flatnonzero(times)
        for lo in range(0, len(rows), 100_000):
            part = rows[lo : lo + 100_000]
            change = (model.p[part] - before[part]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(times[part].astype(np.int64)), _binary(change)], names=["row", "times", "change"])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    kind = pa.binary(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(kind, len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, width)


def _mean_batches(width: int):
    """The mean change of each row, weighted by how often a shard changed it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = np.concatenate([b.column("row").to_numpy() for b in kept])
        times = np.concatenate([b.column("times").to_numpy() for b in kept]).astype(np.float64)
        order = np.argsort(rows, kind="stable")
        change = np.concatenate([_floats(b.column("change"), width) for b in kept])[order]
        rows, times = rows[order], times[order]
        begin = np.flatnonzero(np.diff(rows, prepend=-1))
        mean = np.add.reduceat(change * times[:, None], begin, axis=0) / np.add.reduceat(times, begin)[:, None]
        for lo in range(0, len(begin), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(rows[begin[part]]), _binary(mean[part].astype(np.float16))], names=["row", "change"])

    return run


def _score_batches(model: Factored):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for a, b, ids, per_row in _texts_of(batch.column("ids")):
                x, y, z, row = _sequences(ids, per_row)
                found.append(np.bincount(row, weights=model.log_probability(x, y, z), minlength=b - a) / np.log(10))
            rest = [batch.column(c) for c in _SCORED[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(found))], names=_SCORED)

    return run


_SCORED = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "others", "n_other", "model"]
_SCORED_TYPES = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, others double, n_other long, model double"


class Fitted:
    """What `scores` knows of the training texts. coded: the texts as ids; counts: of all words, the end null; divided: log10 of what the
    class of other words is divided by."""

    def __init__(self, texts: DataFrame, modulus: int, remainder: int, vocabulary: int):
        crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
        training = texts.where(crc % modulus != remainder).select("text")
        self.counts = counts = written(training.mapInArrow(_count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
        total, self.distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.total = total = total or 0
        self.ends = ends = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
        # by falling count: the places of listed words, of which the first are the model's
        key = F.when(F.octet_length("word") <= LONGEST, F.col("word")).otherwise(F.unhex(F.sha2("word", 256)))
        words = counts.where("word IS NOT NULL").select(key.alias("key"), "n")
        most = max(int(ROOT * total ** (1 / 3)), vocabulary)
        order = [("n", "descending"), ("key", "ascending")]
        often = pa.concat_tables([words.where(F.col("n") * HEAD >= total).toArrow(), words.where(F.col("n") >= TRAINED).orderBy(F.desc("n"), "key").limit(most).toArrow()])
        often = often.group_by(["key", "n"]).aggregate([]).sort_by(order)
        times = often.column("n").to_numpy()
        self.table = table = dict(zip(often.column("key").to_pylist(), range(WORDS, WORDS + len(times)), strict=True))
        listed = np.concatenate((np.zeros(WORDS, dtype=np.int64), times))
        n_model = max(min(len(times), vocabulary - WORDS), min(int((times >= TRAINED).sum()), most))
        self.modelled = modelled = WORDS + n_model
        in_model = int(times[:n_model].sum())
        of_ids = listed[:modelled].copy()
        of_ids[[OTHER, END]] = total - ends - in_model, ends
        # their tokens, one more for each, and one for words not seen
        self.divided = float(np.log10(total - ends - in_model + self.distinct - (ends > 0) - n_model + 1))
        self.coded = written(texts.mapInArrow(_code_batches(table, listed, modelled, ends, modulus, remainder), _CODED_TYPES))
        learned = self.coded.where("word IS NULL AND NOT held_out")
        cells = learned.select("ids").mapInArrow(_cell_batches(vocabulary), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(vocabulary**3, dtype=np.int64)
        count[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        start = LogBilinear(count.reshape(vocabulary, vocabulary, vocabulary))
        self.model = model = Factored(start, of_ids)
        shards = 1 + math.isqrt(total // SHARD_TOKENS)
        passes = max(1, min(PASSES, PASSED_TOKENS // max(total, 1)))
        dealt = learned.select(F.xxhash64("doc_id", "ids").alias("place"), "ids").repartition(shards, "place").sortWithinPartitions("place", "ids")
        changes = dealt.mapInArrow(_shard_batches(start, of_ids, passes, total // shards), "row long, times long, change binary")
        # a change for each row of the model
        changes = changes.repartition(shards, "row").mapInArrow(_mean_batches(model.width + 1), "row long, change binary").toArrow()
        for batch in changes.to_batches():
            model.p[batch.column("row").to_numpy()] += _floats(batch.column("change"), model.width + 1)


def scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    held_out: the id's crc32 has the remainder; all other rows are learned from. base_score: add-one unigram score;
    score: the model's log10 probability of the text. Null and empty texts are the end alone; texts of any length are taken whole. Repeated rows are
    counted and scored one by one; a null id counts by the crc32 of the empty text. Without training texts all counts are zero, and an empty
    table gives no rows. Other columns are not looked at."""
    fitted = Fitted(columns(docs, (id_col, "doc_id"), (text_col, "text")), modulus, remainder, vocabulary)
    rare = fitted.coded.where("word IS NOT NULL").select("key", "word", F.col("n").alias("times"))
    # a word that the table doesn't have makes up less than 1/HEAD of all tokens: no key of this join is large
    met = rare.join(fitted.counts.where("word IS NOT NULL"), "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("c"))
    more = met.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    per_token = float(np.log10(fitted.total + fitted.distinct + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    scored = fitted.coded.where("word IS NULL").select(*_SCORED[:-1], "ids").mapInArrow(_score_batches(fitted.model), _SCORED_TYPES)
    return scored.join(more, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(fitted.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * per_token).alias("base_score"), (F.col("model") + F.col("others") + logs - F.col("n_other") * fitted.divided).alias("score"),
    )
