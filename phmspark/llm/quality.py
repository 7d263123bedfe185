"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, the shapes of its words and a few binned properties of its layout, each hashed. From a
bounded labelled sample come document frequencies and a truncated singular value decomposition; the sample's latent
vectors and labels are broadcast, and each document's exact cosine products with all of them, block by block, give its
nearest neighbours, whose labels vote by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm.batches import with_text_columns
from phmspark.llm.common import bounded_collect, fold, spread, table
from phmspark.llm.fit_sample import class_counts, distinct_texts, one_label, share

DIMS = 4096  # hashed terms
_RUN = re.compile(r"(.)\1+")


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % DIMS


class _Signs(dict):
    """Kind of each character: capital, small letter, digit, other letter; punctuation is itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "l" if c.isalpha() else c
        return kind


_SIGNS = _Signs()


def shape_hash(word: str) -> int:
    """Of the word's runs of capitals, small letters, digits, other letters and punctuation."""
    return _hash("shape " + _RUN.sub(r"\1", word.translate(_SIGNS)))


def _bin(name: str, x: float, steps: int = 10) -> str:
    return f"{name}{min(steps, int(x * steps))}"


def layout(text: str, words: list[str], kinds: int) -> list[str]:
    """Terms for what single words do not show: repeated words and lines, length, signs."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    letters = sum(map(len, words))
    return [
        _bin("kinds", kinds / n),
        _bin("lines", len(set(lines)) / max(1, len(lines))),
        f"size{min(14, len(words).bit_length())}",
        f"line{min(10, (n // max(1, len(lines))).bit_length())}",
        f"word{min(14, letters // n)}",
    ]


@dataclass
class Terms:
    """(hashed terms, counts) of texts; remembers the words last met, but for very long ones."""

    seen: dict[str, int] = field(default_factory=dict)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        count = Counter(words)
        seen = self.seen
        if len(seen) > 150_000:
            seen.clear()
        long = [w for w in count if w not in seen and len(w) > 200]
        for w in [w for w in count if w not in seen]:
            seen[w] = _hash(w.strip(".,;:!?").lower()) * DIMS + shape_hash(w)
        both = np.fromiter(map(seen.__getitem__, count), dtype=np.int64, count=len(count))
        for w in long:
            del seen[w]
        pairs = np.stack((both // DIMS, both % DIMS), axis=1)
        n = np.fromiter(count.values(), dtype=np.float64, count=len(count))
        # words by the logarithm of their count, shapes by their share of the text, layout by presence
        row = np.bincount(pairs[:, 0], np.log1p(n), DIMS) if len(n) else np.zeros(DIMS)
        row /= max(1e-9, np.sqrt(row @ row))
        shapes = np.sqrt(np.bincount(pairs[:, 1], n, DIMS) / max(1, n.sum())) if len(n) else np.zeros(DIMS)
        row = 0.5 * row + shapes
        for t in layout(text, words, len(count)):
            row[_hash("layout " + t)] += 0.5
        at = np.flatnonzero(row)
        return at, row[at]


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled texts x latent dimensions, of unit length
    labels: np.ndarray
    odds: float  # of label 1 against the sample's, as a factor
    k: int
    power: float

    def latent(self, texts: list[str], terms: Terms) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        for i, t in enumerate(texts):
            at, x = terms(t)
            out[i] = (x * self.idf[at]).astype(np.float32) @ self.axes[at]
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def vote(self, latent: np.ndarray, block: int = 256) -> np.ndarray:
        """Probability of label 1: similarity-weighted share of the k nearest labelled texts, one vote shared as prior."""
        out = np.empty(len(latent))
        k = min(self.k, len(self.labels))
        for a in range(0, len(latent), block):
            cos = latent[a : a + block] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0.0).astype(np.float64) ** self.power
            out[a : a + block] = ((w * self.labels[near]).sum(axis=1) + 0.01) / (w.sum(axis=1) + 0.02)
        odds = self.odds * out / np.maximum(1e-9, 1 - out)
        return odds / (1 + odds)


def fit(texts: list[str], labels: list[int], share_one: float, rank: int = 64, k: int = 15, power: float = 8.0, seed: int = 7) -> Model | None:
    """From a bounded sample. None where a label is missing: then every score is the base rate."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    terms, rows = Terms(), np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, t in enumerate(texts):
        at, x = terms(t)
        rows[i, at] = x
    idf = np.log((1 + len(texts)) / (1 + (rows > 0).sum(axis=0))) + 0.25
    rows *= idf.astype(np.float32)
    rows /= np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))
    rank = min(rank, *rows.shape)
    q = np.random.default_rng(seed).standard_normal((DIMS, min(rank + 16, len(texts)))).astype(np.float32)
    for _ in range(4):  # randomised range finding with power steps
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, vt = np.linalg.svd(rows @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :rank].astype(np.float32)
    latent = rows @ axes
    latent /= np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
    base, here = share_one / max(1e-9, 1 - share_one), y.mean() / (1 - y.mean())
    return Model(idf, axes, latent, y, base / here, k, power)


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> tuple[Model | None, float]:
    """Model and base rate from about ``per_class`` labelled rows of either class whose fold is not held out. Copies and
    near copies count once. Rows with a null id, label or text, and documents labelled both ways, teach nothing."""
    usable = one_label(labels.filter(fold(F.col("doc_id"), 4) != 2), "quality")
    counts = class_counts(usable, "y")
    if not counts:
        return None, 0.5
    chosen = usable.filter(share(F.col("doc_id"), counts, per_class, F.col("y")))
    sample = distinct_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), "quality-sample")
    rows = sorted(((r["key"], r["text"], r["y"]) for r in bounded_collect(sample, 8 * per_class)), key=lambda r: (r[0], r[1]))
    base = counts.get(1, 0) / sum(counts.values())
    return fit([r[1] for r in rows], [r[2] for r in rows], base), base


def score_texts(docs: DataFrame, model: Model | None, base: float, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score. Null and empty texts have only layout terms and are scored by their neighbours like
    any text; texts are read whole; repeated rows each keep a row; a column named quality_score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, terms = shared.value, Terms()
        return lambda texts: {"quality_score": [base] * len(texts) if m is None else m.vote(m.latent([t or "" for t in texts], terms)).tolist()}

    return with_text_columns(docs, text_col, make, "quality_score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model, base = fit_tables(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model, base)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
