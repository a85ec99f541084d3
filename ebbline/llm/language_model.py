"""Document scores by masked pseudo-likelihood.

A network sees the `WINDOW` words on both sides of a word, never the word itself, and gives the
probability of the word's class; times the share of the word in its class that is the conditional
probability of the word. The sum of its logarithms over all words scores a document.

The corpus is gathered in a table of the counts of every word of all documents, which grows with it; one
unit of each class is left for words it does not hold. The network has a fixed size: it sees words hashed
into `VOCABULARY` numbers, cut into `CLASSES` classes of about the same weight, most frequent first.
Training goes `ROUNDS` times over all documents: every task takes the model of the round, runs
stochastic gradients over its own documents in numpy, and the results are averaged row by row, weighted by
how often a task has seen a row.

Counts of frequent words, 1 / `FREQUENT` of all words or more each, travel with the network: these are
`FREQUENT` words at most. All other words are joined with the table, so no key of the join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import stored, text_batches
from ebbline.llm.text_arrays import SPACED, hashed_words

VOCABULARY_BITS = 15
VOCABULARY = 1 << VOCABULARY_BITS
#: Most words whose counts travel with the network.
FREQUENT = 1 << 17
#: Stands for what lies outside a document.
OUTSIDE = VOCABULARY
CLASSES, WINDOW, DIM, HIDDEN = 32, 2, 8, 16
ROUNDS, BATCH, RATE = 2, 8192, 0.1
_CONTEXT = [-2, -1, 1, 2]
_VALUES = [f"v{i}" for i in range(DIM)]


@dataclass
class Model:
    """Class of each hashed word, logarithm of the words in a class, frequent words with their counts, and the network."""

    classes: np.ndarray
    log_class: np.ndarray
    frequent: np.ndarray
    times: np.ndarray
    words: np.ndarray
    context: np.ndarray
    context_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, counts: np.ndarray, frequent: np.ndarray, times: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        smooth = counts + 1.0
        order = np.lexsort((np.arange(VOCABULARY), -counts))
        below = np.cumsum(smooth[order]) - smooth[order] / 2
        classes = np.empty(VOCABULARY, np.int64)
        classes[order] = np.minimum(below / smooth.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        weight = np.bincount(classes, smooth, CLASSES)
        wide = len(_CONTEXT) * DIM
        return cls(
            classes,
            np.log(np.bincount(classes, counts, CLASSES) + 1),
            frequent,
            times,
            rng.normal(0, 0.1, (VOCABULARY + 1, DIM)).astype(np.float32),
            rng.normal(0, wide**-0.5, (wide, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, HIDDEN**-0.5, (HIDDEN, CLASSES)).astype(np.float32),
            np.log(np.maximum(weight / smooth.sum(), 1e-9)).astype(np.float32),
        )

    def network(self) -> list[np.ndarray]:
        return [self.words, self.context, self.context_bias, self.out, self.out_bias]

    def rows(self) -> np.ndarray:
        """The network as rows of DIM numbers: word vectors first."""
        return np.concatenate([x.reshape(-1, DIM) for x in self.network()])

    def with_rows(self, rows: np.ndarray) -> Model:
        parts, at = [], 0
        for x in self.network():
            n = x.size // DIM
            parts.append(rows[at : at + n].reshape(x.shape).astype(np.float32))
            at += n
        return Model(self.classes, self.log_class, self.frequent, self.times, *parts)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values and log probabilities of the classes for rows of context words."""
        x = self.words[around].reshape(len(around), -1)
        hidden = np.tanh(x @ self.context + self.context_bias)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return x, hidden, logits

    def log_probabilities(self, words: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of the words' classes, less the logarithm of the words in the class."""
        logits, own = self.forward(around)[2], self.classes[words]
        return logits[np.arange(len(words)), own].astype(np.float64) - self.log_class[own]

    def log_counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of the count of each frequent word, 0 for others, and which words these are."""
        if not len(self.frequent):
            return np.zeros(len(hashes)), np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        known = self.frequent[at] == hashes
        return np.where(known, np.log(self.times[at]), 0.0), ~known

    def train(self, words: np.ndarray, around: np.ndarray, squares: list[np.ndarray]) -> None:
        """One step of stochastic gradients with a rate that falls for each number by its own gradients."""
        x, hidden, logits = self.forward(around)
        error = np.exp(logits)
        error[np.arange(len(words)), self.classes[words]] -= 1
        error /= len(words)
        d_hidden = error @ self.out.T * (1 - hidden * hidden)
        d_x = (d_hidden @ self.context.T).reshape(-1, DIM)
        flat = around.ravel()
        d_words = np.stack([np.bincount(flat, d_x[:, i], VOCABULARY + 1) for i in range(DIM)], 1)
        grads = [d_words, x.T @ d_hidden, d_hidden.sum(0), hidden.T @ error, error.sum(0)]
        for value, square, grad in zip(self.network(), squares, grads, strict=True):
            square += grad * grad
            value -= (RATE * grad / np.sqrt(square + 1e-8)).astype(np.float32)


@dataclass
class LanguageModel:
    """The network, and the table `word`, `n` of all words of the corpus."""

    network: Model
    counts: DataFrame


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of whole texts, hashes of their words, the numbers of the words around each, and the bounds of each text."""
    for batch in batches:
        for first, last, hashes, bounds in hashed_words(batch["text"], SPACED):
            spread = np.full(len(hashes) + WINDOW * (last - first + 1), OUTSIDE, np.int64)
            at = np.arange(len(hashes)) + WINDOW * (1 + np.repeat(np.arange(last - first), np.diff(bounds)))
            spread[at] = _bucket(hashes)
            around = np.stack([spread[at + j] for j in _CONTEXT], 1) if len(hashes) else np.zeros((0, 4), np.int64)
            yield batch.slice(first, last - first), hashes, around, bounds


def word_counts(rows: DataFrame) -> DataFrame:
    """`word` (its hash), `n`: how often each word occurs in all texts; counted per block ahead of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _ in hashed_words(batch["text"], SPACED):
                words, n = np.unique(hashes.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

    found = text_batches(rows.select("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(found, "word_counts")


def _fresh(counts: DataFrame) -> Model:
    """An untrained network; the driver gets `VOCABULARY` sums and `FREQUENT` words at most."""
    bucket = F.shiftrightunsigned("word", 64 - VOCABULARY_BITS)
    found = counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(VOCABULARY, np.int64)
    sums[found["bucket"].to_numpy()] = found["n"].to_numpy()
    often = counts.where(F.col("n") * FREQUENT >= int(sums.sum())).toArrow().sort_by("word")
    return Model.fresh(sums, often["word"].to_numpy(), often["n"].to_numpy())


def _train_round(rows: DataFrame, model: Model) -> Model:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.with_rows(sent.value.rows())
        squares = [np.full(x.shape, 1e-4) for x in own.network()]
        seen, n = np.zeros(VOCABULARY + 1, np.int64), 0
        for _, hashes, around, _ in _contexts(batches):
            words = _bucket(hashes)
            for i in range(0, len(words), BATCH):
                own.train(words[i : i + BATCH], around[i : i + BATCH], squares)
            seen += np.bincount(around.ravel(), minlength=VOCABULARY + 1)
            n += len(words)
        values = own.rows().astype(np.float64)
        weight = np.concatenate([seen, np.full(len(values) - len(seen), n)]).astype(np.float64)
        used = np.flatnonzero(weight)
        columns = [pa.array(used), pa.array(weight[used]), *(pa.array(values[used, i] * weight[used]) for i in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "weight", *_VALUES])

    schema = "row long, weight double, " + ", ".join(f"{v} double" for v in _VALUES)
    trained = text_batches(rows.select("text")).mapInArrow(run, schema).groupBy("row")
    trained = trained.agg(F.sum("weight").alias("weight"), *(F.sum(v).alias(v) for v in _VALUES)).toArrow()
    values = model.rows()
    for i, v in enumerate(_VALUES):
        values[trained["row"].to_numpy(), i] = trained[v].to_numpy() / trained["weight"].to_numpy()
    return model.with_rows(values)


def fit_language_model(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> LanguageModel:
    """Counts and network from all rows and whole texts of docs; a null text is empty."""
    rows = docs.select(F.col(text_col).alias("text"))
    counts = word_counts(rows)
    model = _fresh(counts)
    for _ in range(rounds):
        model = _train_round(rows, model)
    return LanguageModel(model, counts)


def score_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: `id`, `n_words`, `log_likelihood`, `mean_log_probability`.

    The whole text is scored. Texts without words, null or empty, have 0 words, a likelihood of 0 and
    no mean. A word that the corpus of the model does not hold counts as the one unit its class leaves.
    Repeated rows score alike; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, around, bounds in _contexts(batches):
            network, words, coded = sent.value, _bucket(hashes), hashes.view(np.int64)
            known, rare = network.log_counts(coded)
            logs = [network.log_probabilities(words[i : i + BATCH], around[i : i + BATCH]) for i in range(0, len(words), BATCH)]
            sums = np.r_[0.0, np.cumsum(np.concatenate(logs) + known)] if logs else np.zeros(1)
            total, n = np.diff(sums[bounds]), np.diff(bounds)
            rare_bounds = np.r_[0, np.cumsum(rare)][bounds].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(rare_bounds), pa.array(coded[rare]))
            yield pa.RecordBatch.from_arrays([part["id"], part["text_hash"], pa.array(n), pa.array(total), lists], ["id", "text_hash", "n_words", "partial", "rare"])

    schema = f"id {dict(rows.dtypes)['id']}, text_hash long, n_words long, partial double, rare array<long>"
    scored = stored(text_batches(rows).mapInArrow(run, schema), "scored")
    # A word that occurs once adds log 1. Copies of a text add up to one sum, divided among them.
    texts = scored.where("size(rare) > 0")
    words = texts.select("text_hash", F.explode("rare").alias("word")).join(model.counts.where("n > 1"), "word")
    added = words.groupBy("text_hash").agg(F.sum(F.ln("n")).alias("sum"))
    added = added.join(texts.groupBy("text_hash").agg(F.count("*").alias("copies")), "text_hash")
    added = added.select("text_hash", (F.col("sum") / F.col("copies")).alias("added"))
    alone = scored.where("size(rare) = 0").withColumn("added", F.lit(0.0))
    joined = texts.join(added, "text_hash", "left")
    total = F.col("partial") + F.coalesce("added", F.lit(0.0))
    return alone.unionByName(joined).select(
        "id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability")
    )
