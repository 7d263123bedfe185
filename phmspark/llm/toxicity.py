"""Toxicity by maximum-scoring segments.

Fit on a bounded sample of labelled texts: a word's score is its log-odds of toxic against clean under a Dirichlet prior
that the pooled counts inform; words (or word beginnings, for words never met) whose log-odds are not significant share
the score of everything else, a little below zero. A text's maximal-scoring segments are found in one linear scan. On
held-back clean texts the largest segment follows an extreme-value law, which turns a segment's score into an E-value
for the text's length; segments with small E-values are passages, and their evidence is calibrated to a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm.batches import with_text_columns
from phmspark.llm.common import bounded_collect, fold, spread, table, written
from phmspark.llm.fit_sample import class_counts, distinct_texts, one_label, share

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    """The word in lower case and its beginnings, longest first."""
    w = word.lower()
    return [w, *(w[:k] + "*" for k in PREFIXES[::-1] if len(w) > k)]


@dataclass
class Model:
    score: dict[str, float]  # of significant words and beginnings
    other: float  # of every other word
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 0.1  # K of it
    intercept: float = -2.0
    slope: float = 1.0
    alpha: float = 0.1
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        for f in features(word):
            if f in self.score:
                return self.score[f]
        return self.other

    def scores(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        if len(seen) > 200_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.word_score(w)
        return np.fromiter(map(seen.__getitem__, words), dtype=np.float64, count=len(words))

    def evalue(self, segment: float, n: int) -> float:
        """Expected number of segments as high in a clean text of ``n`` words."""
        return self.scale * max(n, 1) * float(np.exp(-self.decay * segment))

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(first word, last word + 1, score, E-value) of every significant maximal segment."""
        n = len(scores)
        return [(a, b, s, e) for a, b, s in maximal_segments(scores) if (e := self.evalue(s, n)) <= self.alpha]

    def evidence(self, found: Iterable[tuple[int, int, float, float]]) -> float:
        """Nats of evidence, of all passages together; grows by the logarithm so that long texts do not outrun it."""
        return float(np.log1p(sum(-np.log(max(e, 1e-300)) for *_, e in found)))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * evidence))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring subsequences as (start, end, score), left to right, in linear time."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier with less before
    for k in hits.tolist():
        start, end, before, after = k, k + 1, float(total[k]), float(total[k + 1])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                kept.append((start, end, before, after, j))
                break
            start, _, before, _, link = kept[j]
            del kept[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def log_odds(counts: DataFrame, n_toxic: float, n_clean: float, prior: float, z: float, max_features: int) -> dict[str, float]:
    """Significant log-odds of (feature, toxic, clean) document counts under a Dirichlet prior of ``prior`` documents,
    which shrinks what few documents have. Significance is the signed root of the likelihood ratio of the counts against
    one share for both classes: unlike the odds over their deviation it holds for features that no clean text has."""
    whole = F.col("toxic") + F.col("clean")
    a = F.lit(prior) * whole / F.lit(n_toxic + n_clean)
    up, uc = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(up / (F.lit(n_toxic + prior) - up)) - F.log(uc / (F.lit(n_clean + prior) - uc))
    share_ = whole / F.lit(n_toxic + n_clean)
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (F.lit(n) * p))).otherwise(0.0)
    ratio = sum(part(F.col(c), n, share_) + part(F.lit(n) - F.col(c), n, 1 - share_) for c, n in (("toxic", n_toxic), ("clean", n_clean)))
    told = counts.withColumn("odds", odds).withColumn("z", F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))).filter((F.col("z") >= z) & (F.col("odds") >= 1))
    return {r["feature"]: r["odds"] for r in bounded_collect(told.select("feature", "odds"), max_features)}


FOLDS = 3


def fit(sample: DataFrame, toxic_share: float, prior_share: float = 0.03, z: float = 3.7, alpha: float = 0.1, max_features: int = 200_000) -> Model:
    """From texts and labels (y). The prior weighs ``prior_share`` of the sample. All of the sample gives the scores; what
    they are worth is found by cross-fitting: each third, by hash, is scored with the odds of the two others, and the law
    of clean segments and the curve of probabilities are fitted to all thirds together."""
    sample = sample.withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int"))
    names = [f"{c}{k}" for c in ("clean", "toxic") for k in range(FOLDS)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = [Counter() for _ in names]
        for batch in batches:
            for text, y, k in zip(batch["text"], batch["y"], batch["fold"], strict=True):
                met[FOLDS * int(y == 1) + k].update({f for w in set(_WORD.findall(text)) for f in features(w)})
        found = sorted(set().union(*met))
        yield pd.DataFrame({"feature": found} | {name: [m[x] for x in found] for name, m in zip(names, met, strict=True)})

    size = {(int(r["y"] == 1), r["fold"]): float(r["count"]) for r in sample.groupBy("y", "fold").count().collect()}
    n_of = lambda y, but=None: sum(n for (c, k), n in size.items() if c == y and k != but)
    base = float(np.log((toxic_share + 1e-6) / (1 - toxic_share + 1e-6)))
    if not n_of(1) or not n_of(0):
        return Model({}, -0.05, intercept=float(np.clip(base, -8, 8)), alpha=alpha)
    counts = sample.select("text", "y", "fold").mapInPandas(count, "feature string, " + ", ".join(f"{c} long" for c in names)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))
    counts = written(counts, "feature-counts")

    def scores(but: int | None = None) -> dict[str, float]:
        nt, nc = n_of(1, but), n_of(0, but)
        some = counts.select("feature", *(sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != but), F.lit(0)).alias(c) for c in ("toxic", "clean")))
        return log_odds(some.filter("toxic > 0"), nt, nc, prior_share * (nt + nc), z, max_features) if nt and nc else {}

    model = Model(scores(), -0.05, alpha=alpha)
    if not model.score:
        return Model({}, -0.05, intercept=float(np.clip(base, -8, 8)), alpha=alpha)
    others = [Model(scores(k), -0.05, alpha=alpha) for k in range(FOLDS)]
    rest = sample

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, y, k in zip(batch["text"], batch["y"], batch["fold"], strict=True):
                s = others[k].scores(_WORD.findall(text))
                rows.append((int(y), len(s), int((s > 0).sum()), float(s[s > 0].sum()), max((x[2] for x in maximal_segments(s)), default=0.0)))
            yield pd.DataFrame(rows, columns=["y", "n", "hits", "gain", "top"])

    got = pd.DataFrame([r.asDict() for r in rest.select("text", "y", "fold").mapInPandas(profile, "y int, n long, hits long, gain double, top double").collect()], columns=["y", "n", "hits", "gain", "top"])  # numbers only, of the bounded sample
    clean = got[got["y"] == 0]
    n, hits = float(clean["n"].sum()), float(clean["hits"].sum())
    # A hit's mean score in clean texts; other words bear the log of their share among toxic against clean words, or less:
    # the law holds only where the scores of clean texts fall on average
    toxic = got[got["y"] == 1]
    there = [(x["n"].sum() - x["hits"].sum() + 1.0) / (x["n"].sum() + 2.0) for x in (toxic, clean)]
    p = (hits + 0.5) / (n + 1)
    hit = float(clean["gain"].sum()) / hits if hits else float(np.mean(list(model.score.values())))
    model.other = float(min(-0.01, np.log(there[0] / there[1]), -2 * p * hit / (1 - p)))
    model.decay = _decay(p, hit, model.other)
    tops = clean["top"].to_numpy()
    model.scale = float((len(clean) + 1) / (np.sum(np.maximum(clean["n"], 1) * np.exp(-model.decay * tops)) + 1)) if len(clean) else 0.1
    for m in (model, *others):
        m.other, m.decay, m.scale = model.other, model.decay, model.scale
        m._seen.clear()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by = [others[k] for k in batch["fold"]]
            yield pd.DataFrame({"y": batch["y"].astype("int32"), "x": [m.evidence(m.passages(m.scores(_WORD.findall(t)))) for m, t in zip(by, batch["text"], strict=True)]})

    told = [(r["y"], r["x"]) for r in rest.select("text", "y", "fold").mapInPandas(weigh, "y int, x double").collect()]
    y, x = np.array([t[0] for t in told], dtype=float), np.array([t[1] for t in told])
    sampled = max(1e-6, y.mean()) if len(y) else 0.5
    a, model.slope = _logistic(x, y)
    model.intercept = float(a + base - np.log(sampled / max(1e-6, 1 - sampled)))
    return model


def _decay(p: float, hit: float, other: float) -> float:
    """The positive root of p exp(l hit) + (1 - p) exp(l other) = 1; at most 1 where hits are rarer than that."""
    low, high = 1e-6, 1.0
    f = lambda v: p * np.exp(v * hit) + (1 - p) * np.exp(v * other) - 1
    if f(low) >= 0:
        return 0.05
    if f(high) <= 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Intercept and non-negative slope of a ridge-damped logistic curve, by Newton steps."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.sum(y - p) - ridge * a, np.sum((y - p) * x) - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with tox_score and tox_passages: character range, score and E-value of every significant passage. Null
    and empty texts have no words, so no passage, and the score of a text without evidence. A text column of any length
    is read whole; repeated rows each keep a row; columns named as the new ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts: list[str | None]) -> dict[str, list]:
            probability, spans = [], []
            for text in texts:
                text = text or ""
                found = m.passages(m.scores(_WORD.findall(text)))
                probability.append(m.probability(m.evidence(found)))
                at = [(x.start(), x.end()) for x in _WORD.finditer(text)] if found else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "evalue": e} for a, b, s, e in found])
            return {"tox_score": probability, "tox_passages": spans}

        return run

    return with_text_columns(docs, text_col, make, "tox_score double, tox_passages array<struct<start:int,end:int,score:double,evalue:double>>")


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """Fit on about ``per_class`` labelled rows of either class, of those whose fold is not held out.

    Labels are chosen by hash before they meet their texts, so the join's small side is bounded by ``2 * per_class``.
    Rows with a null id or label, and documents labelled both ways, teach nothing; without labels, or labels of one class, every score is the base rate.
    """
    usable = one_label(labels.filter(fold(F.col("doc_id"), 3) != 1), "toxic")
    counts = class_counts(usable, "y")
    if not counts:
        return Model({}, -0.05)
    chosen = usable.filter(share(F.col("doc_id"), counts, per_class, F.col("y")))
    sample = distinct_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), "toxicity-sample")
    return fit(sample, counts.get(1, 0) / sum(counts.values()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document; odd texts as said at ``score_texts``, odd labels at ``fit_tables``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit_tables(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.7).cast("int").alias("predicted"), F.size("tox_passages").alias("n_passages"))
