"""Language of code-switched text by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and its entry in a lexicon learned from the sample; transitions
between the languages of neighbouring words are learned with them. Forward-backward over windows of consecutive words
gives each word's language probabilities, and a text's language is the one most of its letters belong to.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm.batches import with_text_columns
from phmspark.llm.common import bounded_collect, fold, spread, table
from phmspark.llm.fit_sample import distinct_texts

_WORD = re.compile(r"[^\W\d_]+")
HASHED = 1 << 16  # places of n-grams and affixes
WINDOW = 48  # words of a chain
CELLS = 500_000  # potentials (words x languages) held at once
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _gram(codes: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    h = np.full(len(at), salt * 0x1000193 + size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ codes[at + k]) * _M[k]
        h ^= h >> np.uint64(29)
    return (h % np.uint64(HASHED)).astype(np.int64)


@dataclass
class Features:
    lexicon: np.ndarray  # sorted hashes of its words

    @property
    def size(self) -> int:
        return HASHED + len(self.lexicon) + 1

    @staticmethod
    def _lay(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = "<" + "><".join(words) + ">"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        return codes, lengths, np.concatenate(([0], np.cumsum(lengths)[:-1]))

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        codes, lengths, starts = Features._lay(words)
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        mixed = (codes + _M[0]) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _M[1])
        mixed ^= mixed >> np.uint64(31)
        return np.add.reduceat(mixed * _M[2], starts)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the words in a row, and where each word's begin. Every word has at least its bias."""
        codes, lengths, starts = self._lay(words)
        owner = np.repeat(np.arange(len(words)), lengths)
        owners, ids = [np.arange(len(words))], [np.full(len(words), self.size - 1)]
        for n in (2, 3):
            at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            owners.append(owner[at])
            ids.append(_gram(codes, at, n, 0))
        long = np.flatnonzero(lengths >= 5)  # affixes of three letters and the word's edge
        for salt, at in ((1, starts[long]), (2, starts[long] + lengths[long] - 4)):
            owners.append(long)
            ids.append(_gram(codes, at, 4, salt))
        if len(self.lexicon):
            h = self.hashes(words)
            k = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            known = np.flatnonzero(self.lexicon[k] == h)
            owners.append(known)
            ids.append(HASHED + k[known])
        owner, feature = np.concatenate(owners), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        return feature[order], np.searchsorted(owner[order], np.arange(len(words)))


def chains(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences (rows of ``potentials``, sequence x place x label, in logarithms) of these lengths:
    marginals, scaled forward messages and backward messages times local potentials (for the transitions' gradient)."""
    s, t, n = potentials.shape
    local = np.exp(potentials - potentials.max(axis=2, keepdims=True))
    a = np.exp(transitions).astype(local.dtype)
    forward, back = np.empty_like(local), np.ones_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, t):
        x = (forward[:, k - 1] @ a) * local[:, k]
        forward[:, k] = x / x.sum(axis=1, keepdims=True)
    for k in range(t - 2, -1, -1):
        x = (local[:, k + 1] * back[:, k + 1]) @ a.T
        x /= x.sum(axis=1, keepdims=True)
        back[:, k] = np.where((k < lengths - 1)[:, None], x, 1.0)
    marginal = forward * back
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal, forward, local * back


@dataclass
class Model:
    languages: list[str]
    features: Features
    weights: np.ndarray
    transitions: np.ndarray
    _row: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def emissions(self, words: list[str], remembered: int = 200_000) -> np.ndarray:
        """Log-potential of each language for each word; those of the words last met are remembered."""
        row = self._row
        new = list(set(words).difference(row))
        if self._rows is None or len(row) + len(new) > len(self._rows):
            row.clear()
            new = list(set(words))
            self._rows = np.empty((max(min(remembered, 4 * CELLS // len(self.languages)), len(new)), len(self.languages)), dtype=np.float32)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            ids, starts = self.features(some)
            self._rows[len(row) : len(row) + len(some)] = np.add.reduceat(self.weights[ids], starts)
            row.update(zip(some, range(len(row), len(row) + len(some))))
        return self._rows[np.fromiter(map(row.__getitem__, words), dtype=np.int64, count=len(words))]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its share of the text's letters, and how sure the letters' languages are, whichever they be;
        ``und``, 0 and 0 where there is no letter."""
        found = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        words = [w for x in found for w in x]
        if not words or not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        of_text = np.repeat(np.arange(len(texts)), counts)
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        place = np.arange(len(words)) - begin[of_text]
        windows = (counts + WINDOW - 1) // WINDOW
        window = np.concatenate(([0], np.cumsum(windows)[:-1]))[of_text] + place // WINDOW
        letters = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        total, sure = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        step = max(1, CELLS // (WINDOW * len(self.languages)))  # chains are labelled so many at once, also those of one text
        for first in range(0, int(windows.sum()), step):
            a, b = np.searchsorted(window, [first, first + step])
            row, column = window[a:b] - first, place[a:b] % WINDOW
            potentials = np.zeros((int(row[-1]) + 1, WINDOW, len(self.languages)), dtype=np.float32)
            potentials[row, column] = self.emissions(words[a:b])
            of_word = chains(potentials, np.bincount(row), self.transitions)[0][row, column]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(of_text[a:b], of_word[:, k] * letters[a:b], len(texts))
            sure += np.bincount(of_text[a:b], of_word.max(axis=1) * letters[a:b], len(texts))
        best = total.argmax(axis=1)
        sure /= np.maximum(total.sum(axis=1), 1e-300)
        share_ = total[np.arange(len(texts)), best] / np.maximum(total.sum(axis=1), 1e-300)
        return [self.languages[b] if c else "und" for b, c in zip(best, counts)], [min(1.0, float(x)) if c else 0.0 for x, c in zip(share_, counts)], [min(1.0, float(x)) for x in sure]


def fit(texts: list[str], langs: list[str], windows_per_text: int = 8, steps: int = 60, rate: float = 0.15, decay: float = 1e-4, lexicon_words: int = 5000) -> Model:
    """Adam on the conditional likelihood. A text gives up to ``windows_per_text`` windows, evenly over its length, whose
    words all bear its language; every fourth window continues in the next text's, so that switches are met."""
    names = sorted(set(langs))
    seqs: list[tuple[list[str], int]] = []
    for t, lang in zip(texts, langs, strict=True):
        ws = words_of(t)
        places = range(0, len(ws), WINDOW)
        for p in list(places)[:: max(1, len(places) // windows_per_text)][:windows_per_text]:
            seqs.append((ws[p : p + WINDOW], names.index(lang)))
    if not seqs:
        return Model(names if texts else [], Features(np.empty(0, np.uint64)), np.zeros((HASHED + 1, len(names)), np.float32), np.zeros((len(names), len(names))))
    mixed: list[tuple[list[str], list[int]]] = []
    for k, (ws, y) in enumerate(seqs):
        other, z = seqs[(k * 7 + 3) % len(seqs)]
        cut = len(ws) // 2
        mixed.append((ws[:cut] + other[: len(ws) - cut], [y] * cut + [z] * min(len(other), len(ws) - cut)) if k % 4 == 0 else (ws, [y] * len(ws)))
    mixed = [m for m in mixed if m[0]]
    count = Counter(w for ws, _ in mixed for w in ws)
    vocabulary = sorted(count)
    lexicon = sorted(w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words] if count[w] >= 3)
    features = Features(np.sort(Features.hashes(lexicon)) if lexicon else np.empty(0, np.uint64))
    ids, starts = features(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(starts, len(ids))))
    number = {w: k for k, w in enumerate(vocabulary)}
    n, s = len(names), len(mixed)
    lengths = np.array([len(ws) for ws, _ in mixed])
    seq, place = np.repeat(np.arange(s), lengths), np.concatenate([np.arange(x) for x in lengths])
    word = np.array([number[w] for ws, _ in mixed for w in ws])
    y = np.array([z for _, ys in mixed for z in ys])
    pairs = np.flatnonzero(place[1:] > 0)
    seen = np.zeros((n, n))
    np.add.at(seen, (y[pairs], y[pairs + 1]), 1)
    w, trans = np.zeros((features.size, n), dtype=np.float32), np.zeros((n, n))
    m = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(trans), np.zeros_like(trans)]]
    # Windows, and words, so many at once that no array grows with their number times that of the languages
    some = max(1, CELLS // (WINDOW * n))
    blocks = [(k, min(s, k + some), *np.searchsorted(seq, [k, k + some]).tolist()) for k in range(0, s, some)]
    ends = np.append(starts, len(ids))
    spans = [(k, min(len(vocabulary), k + 20_000)) for k in range(0, len(vocabulary), 20_000)]
    for step in range(1, steps + 1):
        emitted = np.concatenate([np.add.reduceat(w[ids[ends[c] : ends[d]]], starts[c:d] - ends[c]) for c, d in spans])
        by_word, gt, move = np.zeros((n, len(vocabulary))), seen.copy(), np.exp(trans)
        for first, last, c, d in blocks:
            row, column = seq[c:d] - first, place[c:d]
            padded = np.zeros((last - first, WINDOW, n), dtype=np.float32)
            padded[row, column] = emitted[word[c:d]]
            marginal, forward, ahead = chains(padded, lengths[first:last], trans)
            off = -marginal[row, column]
            off[np.arange(d - c), y[c:d]] += 1
            for k in range(n):
                by_word[k] += np.bincount(word[c:d], off[:, k], len(vocabulary))
            here = np.flatnonzero(column[1:] > 0)
            before, after = forward[row[here], column[here]], ahead[row[here + 1], column[here + 1]]
            z = ((before @ move) * after).sum(axis=1)  # of all pairs of languages in closed form
            gt -= move * ((before / z[:, None]).T @ after)
        gw = np.stack([np.bincount(ids, by_word[k][owner], features.size) for k in range(n)], axis=1) / len(y) - decay * w
        gt = gt / len(y) - decay * trans
        for x, g, (g1, g2) in ((w, gw, m[0]), (trans, gt, m[1])):
            g1 += 0.1 * (g - g1)
            g2 += 0.01 * (g * g - g2)
            x += rate * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-7)
    return Model(names, features, w.astype(np.float32), trans)


def fit_tables(docs: DataFrame, per_language: int = 300, most_texts: int = 60_000) -> Model:
    """From about ``per_language`` texts of each language, chosen by hash, of the documents with a language whose fold is
    not held out; copies and near copies count once. Beyond ``most_texts / per_language`` languages each gives fewer
    texts. Without any, nothing is learned and every text is ``und``."""
    usable = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", "text", F.col("lang").alias("y"))
    counts = {r["y"]: r["n"] for r in bounded_collect(usable.groupBy("y").agg(F.count("*").alias("n")), most_texts)}
    if not counts:
        return Model([], Features(np.empty(0, np.uint64)), np.zeros((HASHED + 1, 0), np.float32), np.zeros((0, 0)))
    per_language = max(1, min(per_language, most_texts // len(counts)))
    share_of = F.broadcast(docs.sparkSession.createDataFrame([(y, float(min(1.0, per_language / n))) for y, n in counts.items()], "y string, _share double"))
    by_hash = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.floor(F.col("_share") * (1 << 30))
    chosen = usable.join(share_of, "y").filter(by_hash).select("doc_id", "text", "y")
    rows = sorted(((r["key"], r["text"], r["y"]) for r in bounded_collect(distinct_texts(chosen, "language-sample"), 8 * per_language * len(counts))), key=lambda r: (r[0], r[1]))
    return fit([r[1] for r in rows], [r[2] for r in rows])


def label_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (its share of the letters) and lang_sure (the mean probability of each
    letter's own language), of whole texts. Null texts and texts without a letter are ``und`` with 0 and 0;
    repeated rows each keep a row; columns named as the new ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: list[str | None]) -> dict[str, list]:
            return dict(zip(("lang_pred", "lang_score", "lang_sure"), shared.value.label(texts), strict=True))

        return run

    return with_text_columns(docs, text_col, make, "lang_pred string, lang_score double, lang_sure double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document; odd texts as said at ``label_texts``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    labelled = label_texts(docs.select("doc_id", "text"), fit_tables(docs))
    return labelled.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
