"""Quality score by a byte-level convolutional network in numpy.

Every byte enters as a learned vector and a flag that tells whether the four bytes that end here
already stood in the `REACH` bytes before. Learned filters of 8 bytes run over the whole text; their
means over 64 bytes go through a second learned layer, are max-pooled over overlapping chunks of 512
bytes, and the largest and mean chunk values give one probability.

The network is fitted on the driver with the whole texts of a bounded number of labelled rows and sent to the
tasks; its size is fixed (a few thousand numbers). Long texts pass through the filters range by range, in the fit
as in scoring, so that memory for numbers does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ebbline.llm.shared import fresh, stored, text_batches
from ebbline.llm.text_arrays import BLOCK, utf8

#: Labelled rows of each class in the fit at most, unless `rows_per_class` says otherwise.
SAMPLE_ROWS = 2_000
#: Rows whose crc32(id) modulo 4 is this are held out of the fit.
HELD_OUT = 2
#: A text counts as good from this score on.
KEPT_FROM = 0.7

PAD, DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 255, 8, 8, 4, 16, 16
#: Bytes of half a mean window, of a pooling unit, and units of a chunk and between chunk starts.
HALF, UNIT, CHUNK_UNITS, HOP_UNITS = 32, 128, 4, 3
REACH = 32
#: Units that pass through the filters at a time.
RANGE_UNITS = 16_384
EPOCHS, LEAST_STEPS, BATCH_DOCS, STEP, DECAY = 12, 400, 32, 0.01, 1e-4


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each filled with PAD to whole chunks and at least 64 bytes; first unit of each."""
    sizes = np.diff(offsets)
    units = np.maximum(-(-(sizes + 2 * HALF) // UNIT), CHUNK_UNITS)
    units = CHUNK_UNITS + -(-(units - CHUNK_UNITS) // HOP_UNITS) * HOP_UNITS
    first = np.r_[0, np.cumsum(units)]
    out = np.full(first[-1] * UNIT, PAD, np.uint8)
    shift = np.repeat(first[:-1] * UNIT - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, first


def recurrence(stream: np.ndarray) -> np.ndarray:
    """1 where the last four bytes are also found up to REACH bytes earlier; PAD has 0."""
    found = np.zeros(len(stream), bool)
    for lag in range(1, REACH + 1):
        same = stream[lag:] == stream[:-lag]
        found[lag + 3 :] |= same[3:] & same[2:-1] & same[1:-2] & same[:-3]
    return found & (stream != PAD)


class Network:
    """Weights, forward pass and gradients. `flat` maps names to arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        fresh = {
            "bytes": rng.normal(0, 0.3, (256, DIM - 1)),
            "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)),
            "filter_bias": np.zeros(FILTERS),
            "hidden": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
            "hidden_bias": np.full(HIDDEN, 0.1),
            "out": np.zeros(2 * HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.weights = {k: np.asarray(v, np.float32) for k, v in (weights or fresh).items()}

    def _filtered(self, stream: np.ndarray, flags: np.ndarray, ends: np.ndarray, u0: int, u1: int) -> tuple[np.ndarray, tuple]:
        """Values of the units u0 to u1 of a layout whose texts end before the units `ends`, and what gradients need."""
        w = self.weights
        # The last filter positions and mean windows of a range reach into the unit behind it.
        last = min(u1 + 1, len(stream) // UNIT)
        own = stream[u0 * UNIT : last * UNIT]
        table = np.zeros((256, DIM), w["bytes"].dtype)
        table[:, :-1] = w["bytes"]
        table[PAD] = 0
        x = table[own]
        x[:, -1] = flags[u0 * UNIT : last * UNIT]
        x = x.reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        conv = x @ w["filters"][:half]
        conv[:-1] += x[1:] @ w["filters"][half:]
        conv += w["filter_bias"]
        np.maximum(conv, 0, out=conv)
        # The last filter position and mean window of a text reach into the next text: they are left out.
        own_ends = ends[(ends > u0) & (ends <= last)] - u0
        conv[own_ends * (UNIT // STRIDE) - 1] = 0
        means = conv.reshape(-1, HALF // STRIDE, FILTERS).mean(1)
        windows = means.copy()
        windows[:-1] += means[1:]
        windows *= 0.5
        hidden = windows @ w["hidden"] + w["hidden_bias"]
        np.maximum(hidden, 0, out=hidden)
        hidden[own_ends * (UNIT // HALF) - 1] = 0
        units = hidden.reshape(-1, UNIT // HALF, HIDDEN).max(1)[: u1 - u0]
        return units, (own, x, conv, windows, hidden)

    def forward(self, stream: np.ndarray, first: np.ndarray, flags: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Logits of the texts of a layout(), and what the gradients need."""
        w = self.weights
        flags = recurrence(stream) if flags is None else flags
        bounds = [*range(0, first[-1], RANGE_UNITS), first[-1]]
        ranges = list(zip(bounds[:-1], bounds[1:]))
        filtered = []
        for r in ranges:
            values, inner = self._filtered(stream, flags, first[1:], *r)
            # The state of one range is kept, that of several would grow with the texts.
            filtered.append((values, inner if len(ranges) == 1 else None))
        units = np.concatenate([values for values, _ in filtered])
        chunks = (np.diff(first) - CHUNK_UNITS) // HOP_UNITS + 1
        starts = np.r_[0, np.cumsum(chunks)]
        at = np.repeat(first[:-1], chunks) + HOP_UNITS * (np.arange(starts[-1]) - np.repeat(starts[:-1], chunks))
        pooled = units[at]
        for k in range(1, CHUNK_UNITS):
            pooled = np.maximum(pooled, units[at + k])
        most = np.maximum.reduceat(pooled, starts[:-1])
        mean = np.add.reduceat(pooled, starts[:-1]) / chunks[:, None]
        logits = np.concatenate([most, mean], 1) @ w["out"] + w["out_bias"]
        return logits, (stream, flags, first[1:], ranges, filtered, units, at, pooled, starts, chunks, most, mean)

    def gradients(self, state: tuple, d_logits: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        stream, flags, ends, ranges, filtered, units, at, pooled, starts, chunks, most, mean = state
        grads = {"out": np.concatenate([most, mean], 1).T @ d_logits, "out_bias": d_logits.sum(keepdims=True)}
        of = np.repeat(np.arange(len(chunks)), chunks)
        d_pooled = (d_logits / chunks)[of, None] * w["out"][HIDDEN:]
        # Where several places tie for a maximum, each gets its share.
        top = pooled == most[of]
        ties = np.add.reduceat(top, starts[:-1], dtype=np.float32)
        d_pooled = d_pooled + np.where(top, (d_logits[:, None] * w["out"][:HIDDEN] / ties)[of], 0)
        d_units = np.zeros_like(units)
        open_ = np.ones_like(pooled, bool)
        for k in range(CHUNK_UNITS):
            here = open_ & (units[at + k] == pooled)
            np.add.at(d_units, at + k, np.where(here, d_pooled, 0))
            open_ &= ~here
        for (u0, u1), (_, inner) in zip(ranges, filtered):
            inner = inner or self._filtered(stream, flags, ends, u0, u1)[1]
            for name, grad in self._filter_gradients(inner, d_units[u0:u1]).items():
                grads[name] = grads[name] + grad if name in grads else grad
        return grads

    def _filter_gradients(self, inner: tuple, d_units: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights below the units, for the units of one range."""
        w = self.weights
        own, x, conv, windows, hidden = inner
        by_unit = hidden.reshape(-1, UNIT // HALF, HIDDEN)
        behind = len(by_unit) - len(d_units)
        d_units = np.concatenate([d_units, np.zeros((behind, HIDDEN), d_units.dtype)])
        top = (by_unit == by_unit.max(1, keepdims=True)) & (by_unit > 0)
        d_hidden = np.where(top, (d_units / np.maximum(top.sum(1), 1))[:, None], 0).reshape(-1, HIDDEN)
        grads = {"hidden": windows.T @ d_hidden, "hidden_bias": d_hidden.sum(0)}
        d_windows = d_hidden @ w["hidden"].T * 0.5
        d_means = d_windows.copy()
        d_means[1:] += d_windows[:-1]
        d_conv = np.repeat(d_means * (STRIDE / HALF), HALF // STRIDE, 0) * (conv > 0)
        half = STRIDE * DIM
        grads["filters"] = np.concatenate([x.T @ d_conv, x[1:].T @ d_conv[:-1]])
        grads["filter_bias"] = d_conv.sum(0)
        d_x = d_conv @ w["filters"][:half].T
        d_x[1:] += d_conv[:-1] @ w["filters"][half:].T
        d_x = d_x.reshape(-1, DIM)
        grads["bytes"] = np.stack([np.bincount(own, d_x[:, i], 256) for i in range(DIM - 1)], 1)
        grads["bytes"][PAD] = 0
        return grads


def fit(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Network:
    """Adam on the weighted log loss; the order of the texts is drawn with a fixed seed."""
    network, rng = Network(seed=seed), np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.weights.items()}
    data, offsets = utf8(texts)
    each = max(1, -(-len(labels) // BATCH_DOCS))
    epochs = max(EPOCHS, -(-LEAST_STEPS // each)) if len(labels) else 0
    steps, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH_DOCS):
            own = order[i : i + BATCH_DOCS]
            # Filters start at every fourth byte: a text is cut by up to three bytes at random.
            parts = [data[min(offsets[j] + rng.integers(0, STRIDE), offsets[j + 1]) : offsets[j + 1]] for j in own]
            stream, first = layout(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
            logits, state = network.forward(stream, first)
            error = (1 / (1 + np.exp(-logits)) - labels[own]) * weights[own] / len(own)
            steps += 1
            rate = STEP * (1 - steps / (total + 1))
            for k, g in network.gradients(state, error.astype(np.float32)).items():
                m, v = moments[k]
                g = g + DECAY * network.weights[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.weights[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return network


def held_out(id_col: str) -> Column:
    """Whether a row is kept from the fit; a null id is never in the fit either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", rows_per_class: int | None = None) -> pa.Table:
    """`text` (whole), `label`, `weight`: up to rows_per_class rows of each class, first by a hash of the id.

    rows_per_class bounds the labelled rows of the fit; without it it is SAMPLE_ROWS. Labels of one id are combined to the largest. Weights give both classes their share of all labels of docs.
    Held-out rows, null labels, null texts and ids that docs lack are no part of it and take no place in it.
    """
    most = SAMPLE_ROWS if rows_per_class is None else rows_per_class
    marked = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(label_col).alias("label"))
    marked = marked.where(F.col("label").isNotNull() & F.col("labelled").isNotNull() & ~held_out("labelled"))
    marked = marked.withColumn("label", (F.col("label") >= 1).cast("int"))
    present = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("labelled"))
    marked = stored(marked.join(present, "labelled", "left_semi"), "labelled")
    shares = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("labelled"), F.col("labelled")]
    chosen = [marked.where(F.col("label") == x).orderBy(*order).limit(most) for x in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.join(chosen, "labelled").select("labelled", "text", "label")
    # Repeated ids could bring more rows than were chosen.
    sample = rows.orderBy(*order, F.xxhash64("text")).limit(2 * most).toArrow()
    label = np.asarray(sample["label"].to_numpy(), np.float32)
    weight = np.ones(len(label), np.float32)
    for x in (0, 1):
        if (label == x).any():
            weight[label == x] = shares[x] / sum(shares.values()) / (label == x).mean()
    return pa.table({"text": sample["text"], "label": label, "weight": weight})


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int | None = None) -> Network:
    """A network for the labels of up to rows_per_class rows a class. Without any label every text scores 0.5."""
    return _fitted(labelled_sample(docs, labels, id_col, text_col, label_col, rows_per_class))


def _fitted(sample: pa.Table) -> Network:
    return fit(sample["text"], sample["label"].to_numpy(), sample["weight"].to_numpy())


def score(network: Network, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each whole text; null counts as empty.

    Sums of floats depend on the place of a row in a matrix product. So every text is a product of its
    own, and equal texts score alike to the last bit, whatever stands beside them.
    """
    data, offsets = utf8(texts)
    out, first, n = np.zeros(len(offsets) - 1), 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK // 4, "right")) - 1)
        stream, units = layout(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        flags = recurrence(stream)
        for i in range(last - first):
            u0, u1 = units[i], units[i + 1]
            own = slice(u0 * UNIT, u1 * UNIT)
            logit = network.forward(stream[own], np.array([0, u1 - u0]), flags[own])[0].astype(np.float64)
            out[first + i] = 1 / (1 + np.exp(-logit[0]))
        first = last
    return out


def score_quality(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with all their columns and the score (0 to 1) of the whole text in `score_col`.

    Null and empty texts get the score of an empty text. Equal texts score alike. A column already
    called like `score_col` is replaced.
    """
    docs = docs.drop(score_col)
    # Stages in Python look columns up by name, so they get names without special characters.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own_text = plain.columns[docs.columns.index(text_col)]
    sent = docs.sparkSession.sparkContext.broadcast(network.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(sent.value)
        for batch in batches:
            yield batch.append_column("score", pa.array(score(own, batch[own_text])))

    scored = text_batches(plain).mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return scored.toDF(*docs.columns, score_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int | None = None) -> DataFrame:
    """The rows of docs whose text scores `KEPT_FROM` or more, with all their columns.

    All rows if no text of docs has a label to learn from.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, rows_per_class=rows_per_class)
    if not len(sample):
        return docs
    network = _fitted(sample)
    score_col = fresh(docs, "quality_score")
    return score_quality(docs, network, text_col, score_col).where(F.col(score_col) >= KEPT_FROM).drop(score_col)
