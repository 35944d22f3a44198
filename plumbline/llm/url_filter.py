"""URL filter: two character language models, one of accepted and one of rejected URLs.

Each model is a variable-order Markov model with Witten-Bell smoothing: the probability of a character after
the last ORDER characters is a mixture over all shorter contexts, each weighted by how often it was seen. A URL's
score is the difference of its log-likelihoods divided by its length; the threshold, and a slope that turns
scores into probabilities, are calibrated on labelled URLs that the models have not seen.

Labels come from the rule list: URLs that an allow rule decides are accepted examples, those of a block rule
rejected ones. Rules always win; the models judge what no rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import columns, written

ORDER = 5
#: Labelled URLs of each class that are fitted and calibrated on, those with the lowest hash, each whole.
SAMPLE = 4000
#: Parts that the examples are dealt to for calibration.
FOLDS = 3

#: (verdict, rule): a rule is a host, then the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: F.Column) -> F.Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict, both null if none does; of two alike the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


class Markov:
    """Counts of what follows each context of up to ORDER characters."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order, self.next = order, {}
        for url in urls:
            text = url + "\n"
            for i, c in enumerate(text):
                for k in range(min(order, i) + 1):
                    seen = self.next.setdefault(text[i - k : i], {})
                    seen[c] = seen.get(c, 0) + 1
        self.total = {context: sum(seen.values()) for context, seen in self.next.items()}

    def log_likelihood(self, url: str) -> float:
        """Of the URL and its end. Below all contexts lies the uniform distribution over 256 characters."""
        text, sum_ = url + "\n", 0.0
        for i, c in enumerate(text):
            p = 1 / 256
            for k in range(min(self.order, i) + 1):
                if (seen := self.next.get(text[i - k : i])) is None:
                    break
                kinds, n = len(seen), self.total[text[i - k : i]]
                p = (seen.get(c, 0) + kinds * p) / (n + kinds)
            sum_ += math.log(p)
        return sum_


class Judge:
    """Accepted and rejected models with the calibrated threshold. With no examples of one class, every URL
    that no rule decides gets the verdict of the other; with none at all it is allowed."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.only = "allow" if not rejected else "block" if not accepted else None
        self.threshold = self.slope = 0.0
        if self.only:
            return
        # every example is scored by models that were fitted on the other folds; those that judge see all examples
        held = []
        for fold in range(FOLDS):
            good, bad = (Markov([u for i, u in enumerate(x) if i % FOLDS != fold], order) for x in (accepted, rejected))
            held += [(difference(good, bad, u), y) for x, y in ((accepted, 1), (rejected, 0)) for u in x[fold::FOLDS]]
        self.good, self.bad = Markov(accepted, order), Markov(rejected, order)
        self._calibrate(sorted(held))

    def score(self, url: str | None) -> float:
        """Log-likelihood of accepted less that of rejected, for each character; null is the empty URL."""
        return 0.0 if self.only else difference(self.good, self.bad, url or "")

    def _calibrate(self, held: list[tuple[float, int]]) -> None:
        """The threshold with the least balanced error, in the middle of its gap; then a logistic slope about it."""
        goods, bads = sum(y for _, y in held), sum(1 - y for _, y in held)
        missed, passed = 0.0, 1.0
        best, at = missed + passed, held[0][0] - 1e-6
        for i, (s, y) in enumerate(held):
            missed, passed = missed + y / goods, passed - (1 - y) / bads
            if missed + passed < best - 1e-12 and (i + 1 == len(held) or held[i + 1][0] > s):
                best, at = missed + passed, (s + held[i + 1][0]) / 2 if i + 1 < len(held) else s + 1e-6
        self.threshold, self.slope = at, 1.0
        for _ in range(50):
            gradient = curve = 0.0
            for s, y in held:
                x = s - at
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x))))
                gradient, curve = gradient + (y - p) * x, curve + p * (1 - p) * x * x
            self.slope = min(1000.0, max(0.0, self.slope + gradient / (curve + 1e-9 + 1e-3)))

    def verdict(self, url: str | None) -> str:
        return self.said(self.score(url))[0]

    def said(self, score: float) -> tuple[str, float]:
        """Verdict and probability of being accepted for a score."""
        if self.only:
            return self.only, float(self.only == "allow")
        return "allow" if score >= self.threshold else "block", 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * (score - self.threshold)))))


def difference(good: Markov, bad: Markov, url: str) -> float:
    return (good.log_likelihood(url) - bad.log_likelihood(url)) / (len(url) + 1)


def _judged(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [judge.score(u) for u in batch.column("url").to_pylist()]
            said = [judge.said(s) for s in scores]
            verdicts = [r or v for (v, _), r in zip(said, batch.column("ruled").to_pylist(), strict=True)]
            names = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64()), pa.array([p for _, p in said], pa.float64())], names=[*names, "verdict", "score", "probability"])

    return run


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, probability) for every row.

    rule: the longest rule that fits, else null; verdict: its verdict, else that of the models. Null URLs and
    those without :// have an empty host and path and are judged by the models (null as the empty URL). The models are fitted on at most
    `sample` distinct labelled URLs of each class, those of the lowest hash. Without any, see Judge. URLs of any length are fitted and scored
    whole. Repeated rows are judged row by row; an empty table gives no rows; columns other than the two named are not looked at."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = columns(pages, (id_col, "page_id"), (url_col, "url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select("*", rule.alias("rule"), ruled.alias("ruled"))
    known = written(seen.where("ruled IS NOT NULL").select("url", "ruled").distinct())

    def examples(said: str) -> list[str]:
        return [r.url for r in known.where(F.col("ruled") == said).orderBy(F.xxhash64("url"), "url").limit(sample).collect()]

    judge = Judge(examples("allow"), examples("block"))
    return seen.mapInArrow(_judged(judge), "page_id long, host string, path string, rule string, verdict string, score double, probability double")
