"""Operator 1: toxicity by a convolutional classifier over hashed word embeddings, in numpy.

A word's vector is the sum of the embeddings of a few hashes: of the whole word and of its first
letters (compounds of a stem share those). Filters one, two and three words wide run over the
text, each filter's greatest response in the whole text is pooled, and a logistic unit weighs
the pooled responses. Embeddings start from the classes' log-odds and are then trained with
everything else by back-propagation (Adam). All labelled rows are learned from: they are dealt into
shards of bounded size, the counts behind the log-odds are summed over the shards, every shard trains
the network from that common start, each of its rows in turn, and the shards' parameters are averaged.

Thresholds are calibrated by language, on a quarter of the labelled rows that a network learned from the others
has not seen; then the network that scores learns from all of them. The language is told from the
text alone (word log-odds of all labelled rows), so it is no input beside the text; a language's threshold is
drawn towards the common one the fewer toxic rows it was found on. Scores are shifted so that
every language's threshold is at 0.5.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, texts_of, written
from ctrkit.llm.words import sums, word_index
from ctrkit.operators.ranking import ordered_scan
from ctrkit.session import scratch_path

#: Labelled rows and bytes of text of a shard, about; they deal the work and leave no row out.
SHARD_ROWS, SHARD_BYTES = 4000, 32 << 20
#: Every so many-th labelled row calibrates the thresholds.
FOLDS = 4
BUCKETS = 1 << 15
DIMENSIONS = 8
PREFIXES = (3, 4, 5, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8
STEPS, BATCH, RATE, DECAY = 500, 48, 0.01, 3e-3
WORD_DROPOUT = 0.3
LANGUAGE_BUCKETS = 1 << 13
#: Texts that are scored at a time while learning.
ROWS_AT_ONCE = 256
#: A language's own threshold counts as much as the common one at so many toxic rows.
SHRINK = 10


def word_features(words: list[str]) -> np.ndarray:
    """Buckets of each word: the whole word and its first letters; 0 stands for none."""
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int32)
    for i, word in enumerate(words):
        out[i, 0] = 1 + zlib.crc32(word.encode()) % (BUCKETS - 1)
        for j, n in enumerate(PREFIXES):
            if len(word) > n:
                out[i, 1 + j] = 1 + zlib.crc32(b"^" + word[:n].encode()) % (BUCKETS - 1)
    return out


class Tokens:
    """Words of texts with two empty places after each text, so that filters may run over its end."""

    def __init__(self, texts: pa.Array):
        self.words, index, self.offsets = word_index(texts)
        self.features = np.vstack([word_features(self.words), np.zeros((1, 1 + len(PREFIXES)), np.int32)])
        empty, gap = len(self.words), max(WIDTHS) - 1
        sizes = np.diff(self.offsets)
        self.place = np.arange(len(index)) + gap * np.repeat(np.arange(len(sizes)), sizes)
        self.index = np.full(len(index) + gap * (len(sizes) + 1), empty, np.int64)
        self.index[self.place] = index

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of some texts, and offsets of the texts in them."""
        sizes = np.diff(self.offsets)[rows]
        ends = np.cumsum(sizes)
        take = np.repeat(self.offsets[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.place[take], np.concatenate([[0], ends])


def occurrences(tokens: Tokens, toxic: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of each class that hold a bucket, rows of each class)."""
    seen = np.zeros((2, BUCKETS))
    for r in rows:
        own = np.unique(tokens.features[tokens.index[tokens.place[tokens.offsets[r]:tokens.offsets[r + 1]]]])
        seen[int(toxic[r]), own] += 1
    return seen, np.bincount(toxic[rows].astype(int), minlength=2)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {"embed": np.zeros((BUCKETS, DIMENSIONS), np.float32), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            filters = rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS))
            filters[:, 0] = np.abs(filters[:, 0]) * np.where(np.arange(FILTERS) % 4 == 3, -1, 1)
            self.p[f"filter{w}"] = filters.astype(np.float32)
            self.p[f"shift{w}"] = np.zeros(FILTERS, np.float32)
            self.p[f"out{w}"] = (rng.normal(0, 0.1, FILTERS) + np.where(np.arange(FILTERS) % 4 == 3, -0.3, 0.3)).astype(np.float32)

    def start_from(self, tokens: Tokens, toxic: np.ndarray, rows: np.ndarray, seed: int = 0) -> None:
        """Embeddings of what occurs in the rows: its log-odds, and small random values."""
        self.start(*occurrences(tokens, toxic, rows), seed)

    def start(self, seen: np.ndarray, rows: np.ndarray, seed: int = 0) -> None:
        """As ``start_from``, from the sums of ``occurrences``."""
        totals = np.maximum(rows, 1)[:, None]
        odds = np.log((seen + 0.5) / (totals + 1))
        n = seen.sum(0)
        self.p["embed"][:, 0] = (odds[1] - odds[0]) * n / (n + 3) / 2
        noise = np.random.default_rng(seed).normal(0, 0.05, (BUCKETS, DIMENSIONS - 1))
        self.p["embed"][:, 1:] = noise * (n > 0)[:, None]
        self.p["embed"][0] = 0

    def forward(self, tokens: Tokens, rows: np.ndarray, dropout: np.random.Generator | None = None):
        """(logits, what back-propagation needs)."""
        place, offsets = tokens.of(rows)
        # The words of these texts only; the last one is the empty place.
        reach = place[:, None] + np.arange(max(WIDTHS))
        used, index = np.unique(np.append(tokens.index[reach], len(tokens.words)), return_inverse=True)
        index = index[:-1].reshape(reach.shape)
        if dropout is not None:
            index = np.where(dropout.random(index.shape) < WORD_DROPOUT, len(used) - 1, index)
        features = tokens.features[used]
        vectors = self.p["embed"][features].sum(1)
        full = np.flatnonzero(np.diff(offsets))
        z = np.full(len(rows), self.p["bias"][0], np.float64)
        kept = {}
        for w in WIDTHS:
            response = self.p[f"shift{w}"] + sum((vectors @ self.p[f"filter{w}"][j])[index[:, j]] for j in range(w))
            pooled = np.zeros((len(rows), FILTERS), response.dtype)
            if len(full):
                pooled[full] = np.maximum.reduceat(response, offsets[full], axis=0)
            active = np.maximum(pooled, 0)
            z += active @ self.p[f"out{w}"]
            kept[w] = response, pooled, active
        return z, (offsets, index, features, vectors, kept)

    def gradients(self, dz: np.ndarray, state) -> dict[str, np.ndarray]:
        offsets, index, features, vectors, kept = state
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"][0] = dz.sum()
        row = np.repeat(np.arange(len(dz)), np.diff(offsets))
        for w in WIDTHS:
            response, pooled, active = kept[w]
            g[f"out{w}"] = active.T @ dz
            down = dz[:, None] * self.p[f"out{w}"] * (pooled > 0)
            at, f = np.nonzero(response == pooled[row])
            # The first place of the greatest response takes the gradient.
            _, first = np.unique(row[at] * FILTERS + f, return_index=True)
            at, f = at[first], f[first]
            d = down[row[at], f].astype(vectors.dtype)
            use = d != 0
            at, f, d = at[use], f[use], d[use]
            g[f"shift{w}"] += np.bincount(f, d, FILTERS).astype(vectors.dtype)
            for j in range(w):
                word = index[at, j]
                np.add.at(g[f"filter{w}"][j].T, f, d[:, None] * vectors[word])
                back = d[:, None] * self.p[f"filter{w}"][j][:, f].T
                for feature in features[word].T:
                    np.add.at(g["embed"], feature, back)
        g["embed"][0] = 0
        return g

    def train(self, tokens: Tokens, toxic: np.ndarray, use: np.ndarray, seed: int = 0, least: int = STEPS) -> None:
        """Adam on balanced batches of the logistic loss, with weight decay and word dropout: at least
        ``least`` steps, and as many as show every row once."""
        rng = np.random.default_rng(seed)
        groups = [use[toxic[use] == v] for v in (0, 1)]
        if not all(map(len, groups)):
            return
        half = BATCH // 2
        steps = max(least, -(-max(map(len, groups)) // half))
        turns = [np.concatenate([rng.permutation(g) for _ in range(-(-steps * half // len(g)))]) for g in groups]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            rows = np.concatenate([t[(step - 1) * half:step * half] for t in turns])
            z, state = self.forward(tokens, rows, rng if step % 2 else None)
            dz = (sigmoid(z) - toxic[rows]) / len(rows)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(dz, state).items():
                g += DECAY * self.p[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            self.p["embed"][0] = 0

    def logits(self, tokens: Tokens) -> np.ndarray:
        rows = np.arange(len(tokens.offsets) - 1)
        parts = [self.forward(tokens, rows[a:a + ROWS_AT_ONCE])[0] for a in range(0, len(rows), ROWS_AT_ONCE)]
        return np.concatenate([np.zeros(0), *parts])


class Languages:
    """Tells languages apart by the log-odds of hashed words; for the choice of a threshold only."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        total = np.array([counts[lang] for lang in self.langs]).reshape(-1, LANGUAGE_BUCKETS) + 0.5
        self.weights = np.log(total / total.sum(1, keepdims=True)).T

    @staticmethod
    def counts(tokens: Tokens, langs: list[str]) -> dict[str, np.ndarray]:
        """How often a bucket occurs in the texts of each language."""
        out: dict[str, np.ndarray] = {}
        buckets = tokens.features[:, 0] % LANGUAGE_BUCKETS
        for lang, a, b in zip(langs, tokens.offsets, tokens.offsets[1:]):
            own = np.bincount(buckets[tokens.index[tokens.place[a:b]]], minlength=LANGUAGE_BUCKETS)
            out[lang] = out[lang] + own if lang in out else own
        return out

    def guess(self, tokens: Tokens) -> np.ndarray:
        if len(self.langs) < 2:
            return np.zeros(len(tokens.offsets) - 1, int)
        per_word = self.weights[tokens.features[:, 0] % LANGUAGE_BUCKETS]
        return sums(per_word[tokens.index[tokens.place]], tokens.offsets).argmax(1)


def threshold(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the best stretch of cuts: least weighted errors."""
    order = np.argsort(z, kind="stable")
    z, toxic, weight = z[order], toxic[order], weight[order]
    # Errors if the first i rows are called clean.
    errors = np.concatenate([[0], np.cumsum(weight * toxic)]) + (weight * (1 - toxic)).sum() - np.concatenate(
        [[0], np.cumsum(weight * (1 - toxic))])
    best = int(errors.argmin())
    low = z[best - 1] if best else z[0] - 1
    high = z[best] if best < len(z) else z[-1] + 1
    return float((low + high) / 2)


def drawn(common: float, own: float, toxic: float, rows: float) -> float:
    """A language's threshold, drawn to the common one; without rows of both classes it is that one."""
    share = toxic / (toxic + SHRINK) if 0 < toxic < rows else 0
    return (share * own if share else 0) + (1 - share) * common


class Classifier:
    """The network, the languages and a threshold for each."""

    def __init__(self, texts: pa.Array, toxic: list[int], langs: list[str], weights: list[float], seed: int = 0):
        tokens = Tokens(texts)
        y, weight = np.array(toxic, np.float64), np.array(weights, np.float64)
        self.network = Network(seed)
        self.languages = Languages(Languages.counts(tokens, langs))
        self.thresholds = np.zeros(max(1, len(self.languages.langs)))
        if not len(y):
            return
        # Thresholds come from rows that the network has not seen; then it learns from all rows.
        fold = np.arange(len(y)) % FOLDS == FOLDS - 1
        self._learn(tokens, y, np.flatnonzero(~fold), seed)
        z = self.network.logits(tokens)
        guess = self.languages.guess(tokens)
        if fold.any():
            common = threshold(z[fold], y[fold], weight[fold])
            for i in range(len(self.thresholds)):
                own = fold & (guess == i)
                self.thresholds[i] = drawn(common, threshold(z[own], y[own], weight[own]) if own.any() else common, y[own].sum(), own.sum())
        self.network = Network(seed)
        self._learn(tokens, y, np.arange(len(y)), seed)

    @classmethod
    def of(cls, network: Network, languages: Languages, thresholds: np.ndarray) -> Classifier:
        out = cls.__new__(cls)
        out.network, out.languages, out.thresholds = network, languages, thresholds
        return out

    def _learn(self, tokens: Tokens, y: np.ndarray, rows: np.ndarray, seed: int) -> None:
        self.network.start_from(tokens, y, rows, seed)
        self.network.train(tokens, y, rows, seed)

    def scores(self, texts: pa.Array) -> np.ndarray:
        tokens = Tokens(texts)
        return sigmoid(self.network.logits(tokens) - self.thresholds[self.languages.guess(tokens)])


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str,
                  label_col: str) -> tuple[DataFrame, int]:
    """(rows (place, text, lang, toxic, fold) of all labelled documents, written once, and the number of shards)."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"),
                       F.coalesce(lang_col, F.lit("")).alias("lang"))
    found = rows.join(marked.hint("merge"), F.col("id") == F.col("labelled")).select(
        F.xxhash64(F.lit("sample"), F.col("labelled")).alias("place"), "text", "lang", "toxic",
        (F.pmod(F.xxhash64(F.lit("fold"), F.col("labelled")), F.lit(FOLDS)) == 0).alias("fold"))
    path = scratch_path(docs.sparkSession, "toxicity-labelled")
    found.write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    return found, max(1, -(-found.count() // SHARD_ROWS))


def by_shard(rows: DataFrame, shards: int, work) -> DataFrame:
    """Rows (value): what ``work(texts, toxic, langs, fold)`` makes of each shard, pickled. A shard is a stretch of
    the written rows, which stay in their files; its rows are sorted before."""
    at_most, most_bytes = SHARD_ROWS, SHARD_BYTES

    def value(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("place", "ascending"), ("text", "ascending"), ("lang", "ascending")])
        out = work(table["text"].combine_chunks(), table["toxic"].to_numpy().astype(np.float64), table["lang"].to_pylist(),
                   table["fold"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["value"])

    def values(batches):
        held, rows, size = [], 0, 0
        for batch in in_slices(batches, "text", most_bytes // 8):
            while batch.num_rows:
                part = batch.slice(0, at_most - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows == at_most or size >= most_bytes:
                    yield value(held)
                    held, rows, size = [], 0, 0
        if held:
            yield value(held)

    return rows.coalesce(shards).mapInArrow(values, "value binary")


def added(values: DataFrame) -> dict:
    """The sum of the shards' values (dictionaries of arrays), added up in a tree."""
    def add(x: dict, y: dict) -> dict:
        return {k: x[k] + y[k] if k in x and k in y else x.get(k, y.get(k)) for k in {**x, **y}}

    return values.rdd.map(lambda r: pickle.loads(r["value"])).treeAggregate({}, add, add, 3)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic", seed: int = 0) -> Classifier:
    """Learn from all labelled rows given, in shards of about ``SHARD_ROWS``.

    Null labels are left out, null texts are empty, a null language is one of its own; an id with both
    labels is toxic.
    """
    spark = docs.sparkSession
    rows, shards = labelled_rows(docs, labels, id_col, text_col, lang_col, label_col)
    parts = ("rest", "all")  # learned from: the rows that do not calibrate, and all

    def count(texts, toxic, langs, fold):
        tokens = Tokens(texts)
        out = {("lang", lang): n for lang, n in Languages.counts(tokens, langs).items()}
        for part, fits in ((0, ~fold), (1, fold)):
            out["seen", part], out["rows", part] = occurrences(tokens, toxic, np.flatnonzero(fits))
        return out

    totals = added(by_shard(rows, shards, count))
    if not totals:
        return Classifier.of(Network(seed), Languages({}), np.zeros(1))
    languages = Languages({k[1]: n for k, n in totals.items() if k[0] == "lang"})
    starts = {part: Network(seed) for part in parts}
    starts["rest"].start(totals["seen", 0], totals["rows", 0], seed)
    starts["all"].start(totals["seen", 0] + totals["seen", 1], totals["rows", 0] + totals["rows", 1], seed)
    begin = spark.sparkContext.broadcast(starts)  # fixed in size by BUCKETS

    def learn(texts, toxic, langs, fold):
        tokens, out = Tokens(texts), {}
        for part, use in (("rest", np.flatnonzero(~fold)), ("all", np.arange(len(toxic)))):
            network = Network(seed)
            network.p = {k: v.copy() for k, v in begin.value[part].p.items()}
            network.train(tokens, toxic, use, seed, -(-STEPS // shards))
            # A shard weighs as its rows; one without rows of both classes has learned nothing.
            weight = len(use) * (0 < toxic[use].sum() < len(use))
            out |= {(part, k): v.astype(np.float64) * weight for k, v in network.p.items()} | {(part, "weight"): weight}
        return out

    learned = added(by_shard(rows, shards, learn))
    for part in parts:
        if learned[part, "weight"]:
            starts[part].p = {k: (learned[part, k] / learned[part, "weight"]).astype(np.float32) for k in starts[part].p}
    return Classifier.of(starts["all"], languages, calibrated(rows, starts["rest"], languages))


def calibrated(rows: DataFrame, network: Network, languages: Languages) -> np.ndarray:
    """A threshold for each language, from the responses to all rows that the network has not seen."""
    shipped = rows.sparkSession.sparkContext.broadcast((network, languages))  # fixed in size by BUCKETS

    def respond(batches):
        network, languages = shipped.value
        for batch in in_slices(batches, "text", 4 << 20):
            tokens = Tokens(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(network.logits(tokens), pa.float64()), pa.array(languages.guess(tokens), pa.int32()),
                 batch.column("toxic")], ["z", "guess", "toxic"])

    seen = written(rows.where("fold").select("text", "toxic").mapInArrow(respond, "z double, guess int, toxic int"), "toxicity-responses")
    # Group -1 is all languages together.
    cells = (seen.select(F.explode(F.array(F.lit(-1), "guess")).alias("group"), "z", "toxic").groupBy("group", "z")
             .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    cuts = thresholds_of(cells)
    out = np.zeros(max(1, len(languages.langs)))
    if -1 in cuts:
        common = cuts[-1][0]
        out[:] = [drawn(common, *cuts.get(i, (common, 0, 0))) for i in range(len(out))]
    return out


def thresholds_of(cells: DataFrame) -> dict[int, tuple[float, int, int]]:
    """{group: (the middle of the best cut, toxic rows, rows)} of the cells (group, z, bad, good), as ``threshold``
    finds it; one row per group comes to the driver."""
    scanned = written(ordered_scan(cells, [F.col("z").asc()], ["group"], sums=["bad", "good"]), "toxicity-cuts")
    sums = scanned.groupBy("group").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.max("z").alias("last"))
    # A cut lies before a row, or after the last one.
    cut = F.struct((F.col("bad_before") + F.col("all_good") - F.col("good_before")).alias("errors"), "z")
    best = scanned.join(sums, "group").groupBy("group").agg(
        F.least(F.min(cut), F.struct(F.max("all_bad").alias("errors"), F.lit(float("inf")).alias("z"))).alias("cut"),
        F.max("all_bad").alias("all_bad"), F.max("all_good").alias("all_good"), F.max("last").alias("last"))
    below = best.select("group", "cut.z", "all_bad", "all_good", "last").withColumnRenamed("z", "at")
    low = scanned.join(below, "group").groupBy("group", "at", "all_bad", "all_good", "last").agg(
        F.max(F.when(F.col("z") < F.col("at"), F.col("z"))).alias("low"))
    out = {}
    for r in low.collect():
        high = r["last"] + 1 if r["at"] == float("inf") else r["at"]
        out[r["group"]] = (((r["low"] if r["low"] is not None else high - 1) + high) / 2, r["all_bad"], r["all_bad"] + r["all_good"])
    return out


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one per document, from the whole text alone.

    Empty and null texts get the score of no response at all; without labelled rows of both
    classes the network is untrained; repeated rows and null ids stay; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed in size by BUCKETS

    def predict(batches):
        own = shipped.value
        for batch in in_slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own.scores(texts_of(batch, "text")), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed in size by BUCKETS

    def keep(batches):
        own = shipped.value
        for batch in in_slices(batches, text_col, 4 << 20):
            yield batch.filter(pa.array(own.scores(texts_of(batch, text_col)) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
