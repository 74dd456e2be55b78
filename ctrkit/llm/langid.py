"""Operator 5: language by hierarchical discrimination with linear support vector machines.

A text is the mean of its words' hashed n-grams of bytes. One linear machine per family decides
the language family, one against the rest; within the family one machine per pair of languages
votes. Machines are trained on the driver from a bounded sample (dual coordinate descent) and
sent to the tasks as one weight per hashed n-gram and machine.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, texts_of
from ctrkit.llm.words import sums, word_index

#: Rows that the machines learn from at most, and of one language.
TRAIN_ROWS = 6000
TRAIN_ROWS_OF_ONE = 1000
#: Hashed features and the lengths of the byte n-grams.
DIMENSIONS = 4096
GRAMS = (1, 2, 3, 4)
COST = 1.0
EPOCHS = 15
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

# Language codes by family; others form the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(), "turkic": "tr az kk uz ky".split(), "indic": "hi bn ur mr gu pa ne si".split(),
    "semitic": "ar he mt am".split(), "sinitic": "zh yue wuu".split(),
}


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), "other")


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of all byte n-grams of the words, a boundary sign on either side."""
    raw = [w.encode() for w in words]
    joined = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    word = np.append(np.repeat(np.arange(len(raw)), sizes), len(raw))
    end = np.cumsum(sizes)  # place of the sign after each word
    features, owners = [], []
    for n in GRAMS:
        at = np.arange(len(joined) - n + 1)
        owner = word[at]
        ok = (owner < len(raw)) & (at + n - 1 <= end[np.minimum(owner, len(raw) - 1)])
        at, owner = at[ok], owner[ok]
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = (code * np.uint64(257) + joined[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        features.append((code >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
        owners.append(owner)
    return np.concatenate(features), np.concatenate(owners)


def per_word(words: list[str], weights: np.ndarray) -> np.ndarray:
    """For each word the mean over its n-grams of the rows of ``weights``."""
    feature, owner = word_grams(words)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return sums(weights[feature[order]], ends) / counts[:, None]


def matrix(texts: list[str]) -> np.ndarray:
    """Features of texts: for training, where the rows are bounded."""
    words, index, offsets = word_index(pa.array(texts, pa.string()))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not words:
        return out
    feature, owner = word_grams(words)
    grams = np.bincount(owner, minlength=len(words))
    order = np.argsort(owner, kind="stable")
    feature, ends = feature[order], np.concatenate([[0], np.cumsum(grams)])
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        own, times = np.unique(index[a:b], return_counts=True)
        take = np.repeat(ends[own] - (np.cumsum(grams[own]) - grams[own]), grams[own]) + np.arange(grams[own].sum())
        weight = np.repeat(times / grams[own] / max(1, b - a), grams[own])
        out[i] = np.bincount(feature[take], weight, DIMENSIONS)
    return out


def machine(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights, the bias last, of an L2-regularised squared-hinge machine; ``y`` is -1 or 1.

    Classes weigh the same whatever their counts.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    n = len(x)
    share = np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    slack = 1 / (2 * COST * n / 2 / share)
    square = (x * x).sum(1) + slack
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            gradient = y[i] * (w @ x[i]) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Discriminator:
    """Weights of all machines side by side: families first, then the pairs within each family."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        x = matrix(texts)
        scale = 1 / np.maximum(x.std(0), 1e-4) if len(x) else np.ones(DIMENSIONS)
        centre = x.mean(0) if len(x) else np.zeros(DIMENSIONS)
        x = ((x - centre) * scale / np.sqrt(DIMENSIONS)).astype(np.float32)
        lang = np.array(langs)
        family = np.array([family_of(v) for v in langs])
        learned = []
        if len(self.families) > 1:
            learned += [machine(x, np.where(family == f, 1, -1)) for f in self.families]
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family_of(a) == family_of(b)]
        for a, b in self.pairs:
            use = (lang == a) | (lang == b)
            learned.append(machine(x[use], np.where(lang[use] == a, 1, -1)))
        w = np.array(learned).reshape(len(learned), DIMENSIONS + 1).T
        self.weights = w[:-1] * (scale / np.sqrt(DIMENSIONS))[:, None]
        self.bias = w[-1] - centre @ self.weights

    def margins(self, texts: pa.Array) -> np.ndarray:
        words, index, offsets = word_index(texts)
        n = np.maximum(np.diff(offsets), 1)[:, None]
        if not words:
            return np.zeros((len(texts), self.weights.shape[1])) + self.bias
        return sums(per_word(words, self.weights)[index], offsets) / n + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score joins the margins of both levels."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin = self.margins(texts)
        sure = np.ones(len(texts))
        family = np.zeros(len(texts), int)
        k = 0
        if len(self.families) > 1:
            k = len(self.families)
            order = np.sort(margin[:, :k], axis=1)
            family = margin[:, :k].argmax(1)
            sure = 1 / (1 + np.exp(-2 * (order[:, -1] - order[:, -2])))
        votes = np.zeros((len(texts), len(self.langs)))
        at = {v: i for i, v in enumerate(self.langs)}
        for j, (a, b) in enumerate(self.pairs):
            m = margin[:, k + j]
            # Votes decide, margins break ties.
            votes[:, at[a]] += (m > 0) + 0.4 * np.tanh(m) / len(self.langs)
            votes[:, at[b]] += (m <= 0) - 0.4 * np.tanh(m) / len(self.langs)
        own = np.array([self.families.index(family_of(v)) for v in self.langs])
        votes[own[None, :] != family[:, None]] = -np.inf
        best = votes.argmax(1)
        for j, (a, b) in enumerate(self.pairs):
            m = np.where(best == at[a], margin[:, k + j], np.where(best == at[b], -margin[:, k + j], np.inf))
            sure = np.minimum(sure, 1 / (1 + np.exp(-2 * m)))
        return [self.langs[i] for i in best], sure


def sample(rows: DataFrame, label: str, text_col: str, id_col: str, per_label: int, total: int) -> list:
    """A bounded sample, (text, label) pairs: about ``per_label`` rows of each label value and
    ``total`` in all at most, chosen by a hash of the id over the whole table."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = min(per_label, total // len(counts))
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = wanted | ((F.col(label) == F.lit(value)) & (place < F.lit(min(1.0, share / n))))
    found = rows.where(wanted).select(place.alias("place"), F.col(text_col).alias("text"), label).collect()
    return [(r["text"], r[label]) for r in sorted(found, key=lambda r: (r["place"], r["text"]))]


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_label: int = TRAIN_ROWS_OF_ONE, total: int = TRAIN_ROWS) -> Discriminator:
    """Learn from a bounded sample of the rows with a language and a letter in the text."""
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(id_col, text_col, lang_col)
    pairs = sample(known, lang_col, text_col, id_col, per_label, total)
    return Discriminator([t for t, _ in pairs], [v for _, v in pairs])


def identify(docs: DataFrame, model: Discriminator, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per document, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if the model
    learned from no rows; repeated rows and null ids stay; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights a machine

    def predict(batches):
        own = shipped.value
        for batch in in_slices(batches, "text"):
            texts = texts_of(batch, "text")
            langs, scores = own.predict(texts)
            for i, text in enumerate(texts.to_pylist()):
                if not LETTER.search(text):
                    langs[i], scores[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
