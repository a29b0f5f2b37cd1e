"""Quality classifier: a convolutional network over the bytes of a text, trained and run in numpy.

Learned filters of six bytes slide over the whole document; a filter's answer in a chunk of 256 positions is the mean of its
rectified outputs there, chunks overlap by half, and the document's feature is the filter's highest chunk. A logistic
layer combines the features into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out, of_bytes, text_of

FILTERS, WIDTH, HALF = 16, 6, 128
#: Training: most labelled rows, most bytes of their texts together, passes, rows of a step, step size.
SAMPLE, BYTES, PASSES, STEP_ROWS, RATE = 3000, 32 << 20, 8, 24, 0.02
#: A document is good from this score on.
GOOD = 0.7
SLICE = 1 << 19


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    out_bias: float

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Rectified outputs at each position that has WIDTH bytes from it on."""
        n = len(codes) - WIDTH + 1
        total = self.filters[0][codes[:n]]
        for k in range(1, WIDTH):
            total += self.filters[k][codes[k : n + k]]
        total += self.bias
        return np.maximum(total, 0.0, out=total)


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of so many bytes, each followed by WIDTH - 1 zeros: first position of each half chunk, its length, and half chunks a row."""
    halves = -(-sizes // HALF)
    row = np.repeat(np.arange(len(sizes)), halves)
    number = np.arange(len(row)) - np.repeat(np.cumsum(halves) - halves, halves)
    begins = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
    return begins[row] + number * HALF, np.minimum(HALF, sizes[row] - number * HALF), halves


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each followed by WIDTH - 1 zeros, and their sizes; an empty text is one zero."""
    gap = bytes(WIDTH - 1)
    texts = [x or b"\0" for x in texts]
    return np.frombuffer(gap.join([*texts, b""]) or gap, dtype=np.uint8), np.array([len(x) for x in texts])


def chunk_means(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean answers of each chunk, its first position, its length, chunks of each row); texts in memory are a slice of a batch."""
    codes, sizes = _padded(texts)
    first, length, halves = _layout(sizes)
    sums = np.empty((len(first), FILTERS), dtype=np.float32)
    at = 0
    while at < len(first):  # some half chunks at a time, to stay in the cache
        to = min(at + 256, len(first))
        low, high = first[at], first[to - 1] + length[to - 1]
        answers = network.answers(codes[low : high + WIDTH - 1])
        # between two rows stand WIDTH - 1 positions that belong to neither
        edges = np.stack([first[at:to], first[at:to] + length[at:to]], 1).ravel() - low
        sums[at:to] = np.add.reduceat(np.vstack([answers, np.zeros((1, FILTERS), np.float32)]), edges, axis=0)[::2]
        at = to
    last = np.cumsum(halves) - 1
    is_last = np.zeros(len(first), dtype=bool)
    is_last[last] = True
    only = halves == 1
    use = ~is_last
    use[last[only]] = True  # a row of one half chunk has that chunk alone
    nxt = np.minimum(np.arange(len(first)) + 1, len(first) - 1)
    total = np.where(is_last[:, None], sums, sums + sums[nxt])
    span = np.where(is_last, length, length + length[nxt])
    return (total / span[:, None])[use], first[use], span[use], np.maximum(halves - 1, 1)


def features(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's highest chunk by filter, with that chunk's first position and length."""
    means, first, span, chunks = chunk_means(network, texts)
    begins = np.cumsum(chunks) - chunks
    best = np.maximum.reduceat(means, begins, axis=0)
    hit = means == np.repeat(best, chunks, axis=0)
    where = np.where(hit, np.arange(len(means))[:, None], len(means))
    arg = np.minimum.reduceat(where, begins, axis=0)
    return best, first[arg], span[arg]


def probability(network: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    best, _, _ = features(network, texts)
    return 1.0 / (1.0 + np.exp(-(best.astype(np.float64) @ network.out + network.out_bias)))


def train(texts: list[bytes], labels: np.ndarray, passes: int = PASSES, seed: int = 0) -> Network:
    """A network fitted by Adam to the cross-entropy. Without both labels among the rows it is a constant, the share of ones."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.5, FILTERS), float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    values = [net.filters, net.bias, net.out]
    first = [np.zeros_like(v) for v in values] + [0.0]
    second = [np.zeros_like(v) for v in values] + [0.0]
    t, steps = 0, passes * -(-len(texts) // STEP_ROWS)
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            some = [texts[i] for i in rows]
            best, begin, span = features(net, some)
            p = 1.0 / (1.0 + np.exp(-(best @ net.out + net.out_bias)))
            error = (p - labels[rows]) / len(rows)
            grads = _gradients(net, some, error, begin, span) + [best.T @ error + 1e-4 * net.out, float(error.sum())]
            t += 1
            rate = RATE * min(1.0, 2.0 * (1 - t / (steps + 1)))
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                move = rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-6)
                if i < 3:
                    values[i] -= move.astype(values[i].dtype)
                else:
                    net.out_bias -= float(move)
    return net


def _gradients(net: Network, texts: list[bytes], error: np.ndarray, begin: np.ndarray, span: np.ndarray) -> list[np.ndarray]:
    """Of filters and bias: only a filter's highest chunk of each row answers for it."""
    codes, _ = _padded(texts)
    filters, bias = np.zeros_like(net.filters), np.zeros_like(net.bias)
    for f in range(FILTERS):
        n = span[:, f]
        at = np.repeat(begin[:, f] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        value = net.bias[f] + sum(net.filters[k, codes[at + k], f] for k in range(WIDTH))
        g = np.where(value > 0, np.repeat(error * net.out[f] / n, n), 0.0)
        for k in range(WIDTH):
            filters[k, :, f] = np.bincount(codes[at + k], g, 256)
        bias[f] = g.sum()
    return [filters, bias]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = BYTES) -> DataFrame:
    """text, label of labelled documents that are not held out, in the order of a hash of their ids: the first `most` rows, as far as their texts have
    `most_bytes` together; the text that reaches the bound is the last.

    Texts of any length are taken whole. Rows with a null label or id are not taken; a document labelled twice is taken twice; one with a null text takes its
    place and teaches nothing."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label"))
    there = docs.select(F.col("doc_id").alias("__id"))
    order = (F.xxhash64("__id"), F.col("__id"), F.col("__label"))
    chosen = ids.join(there, "__id", "left_semi").orderBy(*order).limit(most)  # so many small rows: broadcast
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).orderBy(*order, "text").limit(most)
    before = F.sum(F.octet_length("text")).over(Window.orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1))  # of `most` rows at most
    return texts.withColumn("__before", before).where(F.coalesce("__before", F.lit(0)) < most_bytes).select("text", F.col("__label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    rows = training_rows(docs, labels, most).toArrow()
    return train([x.as_py().encode() for x in rows["text"]], rows["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """docs with score. Whole texts are read, in slices of a batch; a null text scores as an empty one. A column score of docs is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_bytes(batches, "text", SLICE):
            texts = pc.fill_null(text_of(batch), "").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(network, texts))], [*batch.schema.names, "score"])

    plain = docs.drop("score")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs; only texts reach the network. Empty tables give empty results."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs of which the network thinks that they are good, with docs' columns (an own column score is kept)."""
    renamed = docs.withColumnsRenamed({"score": "__own_score"})
    kept = score(renamed, fit(docs, labels)).where(F.col("score") >= GOOD).drop("score")
    return kept.withColumnsRenamed({"__own_score": "score"}).select(*docs.columns)
