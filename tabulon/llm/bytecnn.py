"""Language of texts by a convolutional network over bytes.

A text is cut in windows of `window` bytes that overlap by the widest filter less one, so every run of bytes
under a filter is seen once or twice; the last one is filled up with zeros. In a window each byte has a learned vector;
filters of several widths slide over them, each filter's greatest response is kept (max pooling), goes
through a rectifier, and a linear layer with softmax gives log-probabilities. A text's language is that
of the greatest mean over its windows, weighted by their bytes; its score is the softmax of these means.

The network is trained in numpy on the driver by Adam: on at most `per_label` texts of each of the
`most_labels` most frequent languages (chosen by a hash of their ids), of each at most `crops` pieces of up to
`window` bytes, which executors cut. Pieces have various lengths, so short texts are known too. Windows of all
whole texts are scored in tasks, a block of windows at a time.

Defined results: a null text, one without a letter, or any text if nothing could be learned is `und` with score 0.
Rows of null id are scored but never learned from, and aren't held out. Repeated rows are scored each; ties
between languages go to the lesser name. An empty table gives an empty result. Only doc_id, text and lang are
read, lang only of rows to learn from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices, utf8


@dataclass(frozen=True)
class Net:
    window: int = 512
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    vector: int = 8
    per_label: int = 300
    most_labels: int = 200
    crops: int = 3
    least_crop: int = 12
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    block: int = 64
    seed: int = 5


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Parameters: `e` vectors of bytes, for each width `w{k}` filters and `b{k}` biases, `out` and `bias` of the last layer."""

    def __init__(self, labels: list[str], p: Net):
        rng = np.random.default_rng(p.seed)
        self.labels, self.p = labels, p
        self.v: dict[str, np.ndarray] = {"e": rng.normal(0, 0.5, (256, p.vector))}
        for k in p.widths:
            self.v[f"w{k}"] = rng.normal(0, (k * p.vector) ** -0.5, (k * p.vector, p.filters))
            self.v[f"b{k}"] = np.zeros(p.filters)
        self.v["out"] = rng.normal(0, 0.1, (len(p.widths) * p.filters, len(labels)))
        self.v["bias"] = np.zeros(len(labels))
        self.v = {k: x.astype(np.float32) for k, x in self.v.items()}
        self.v["e"][0] = 0  # fills up windows

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest response of each filter over windows of bytes (n, window), before the rectifier, and where it is."""
        vectors = self.v["e"][x]
        n, length, size = vectors.shape
        best, where = [], []
        for k in self.p.widths:
            runs = np.lib.stride_tricks.as_strided(vectors, (n, length - k + 1, k * size), vectors.strides, writeable=False)  # a run of k vectors is contiguous
            y = (runs.reshape(-1, k * size) @ self.v[f"w{k}"]).reshape(n, length - k + 1, -1)
            if places:
                where.append(y.argmax(axis=1))
            best.append(y.max(axis=1) + self.v[f"b{k}"])
        return np.concatenate(best, axis=1), where

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x)[0], 0) @ self.v["out"] + self.v["bias"]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows x with labels y, and its gradients."""
        pooled, where = self.pooled(x, places=True)
        h = np.maximum(pooled, 0)
        z = h @ self.v["out"] + self.v["bias"]
        z = z - z.max(axis=1, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        n, rows = len(x), np.arange(len(x))
        loss = float(-np.log(q[rows, y] + 1e-12).mean())
        q[rows, y] -= 1
        q /= n
        g = {"out": h.T @ q, "bias": q.sum(axis=0), "e": np.zeros_like(self.v["e"])}
        down = (q @ self.v["out"].T) * (pooled > 0)
        for i, k in enumerate(self.p.widths):
            d = down[:, i * self.p.filters : (i + 1) * self.p.filters]
            run = x[rows[:, None, None], where[i][:, :, None] + np.arange(k)]  # bytes under each filter's best place
            g[f"w{k}"] = np.einsum("nf,nfi->if", d, self.v["e"][run].reshape(n, self.p.filters, -1))
            g[f"b{k}"] = d.sum(axis=0)
            back = np.einsum("nf,jcf->nfjc", d, self.v[f"w{k}"].reshape(k, self.p.vector, self.p.filters))
            np.add.at(g["e"], run, back)
        g["e"][0] = 0
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Adam over all epochs; the order of rows and the seed settle the result."""
        p, rng, t = self.p, np.random.default_rng(self.p.seed), 0
        m = {k: np.zeros_like(v) for k, v in self.v.items()}
        s = {k: np.zeros_like(v) for k, v in self.v.items()}
        for epoch in range(p.epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), p.batch):
                part, t = order[a : a + p.batch], t + 1
                rate = p.rate * (1 - 0.9 * epoch / max(1, p.epochs - 1))
                for k, g in self.gradients(x[part], y[part])[1].items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.v[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


# --- windows ---


def window_starts(offs: np.ndarray, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and first byte of all windows of texts that lie between offsets; an empty text has one window."""
    size, step = np.diff(offs), window - overlap
    n = np.maximum(1, -(-(size - overlap) // step))
    text = np.repeat(np.arange(len(size)), n)
    return text, offs[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step


def windows(data: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int) -> np.ndarray:
    """Bytes from each start, zeros from each stop on."""
    at = start[:, None] + np.arange(window)
    return np.where(at < stop[:, None], data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)


def text_scores(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean log-probabilities of each text's windows, weighted by their bytes."""
    p = model.p
    text, start = window_starts(offs, p.window, max(p.widths) - 1)
    stop = np.minimum(start + p.window, offs[1:][text])
    total, weight = np.zeros((len(offs) - 1, len(model.labels))), np.zeros(len(offs) - 1)
    for a in range(0, len(text), p.block):
        b = slice(a, a + p.block)
        w = np.maximum(stop[b] - start[b], 1)
        np.add.at(total, text[b], model.log_probabilities(windows(data, start[b], stop[b], p.window)) * w[:, None])
        np.add.at(weight, text[b], w)
    return total / weight[:, None]


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    labels = np.array(model.labels, object)
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            z = text_scores(model, *utf8(batch.column("text")))
            best = z.argmax(axis=1)
            score = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


# --- training ---


def crops(text: bytes, p: Net) -> list[bytes]:
    """Pieces of a text to learn from: spread over it, of various lengths, the same for equal texts."""
    rng = np.random.default_rng(zlib.crc32(text))
    out = []
    for k in range(min(p.crops, -(-len(text) // p.window))):
        n = p.window if k == 0 else int(rng.integers(min(p.least_crop, p.window), p.window + 1))
        start = int(rng.integers(0, max(1, len(text) - n + 1)))
        out.append(text[start : start + n])
    return out


def _cropped(batches: Iterator[pa.RecordBatch], p: Net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(x, y, piece) for x, y, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True) for piece in crops(t.encode(), p)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "h", "piece"])


def train(docs: DataFrame, learn_from: Column, p: Net = Net()) -> Model | None:
    """A network fitted on rows where `learn_from` holds and lang isn't null; None if there is nothing to learn."""
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(p.most_labels).collect()
    if not counts:
        return None
    # about twice the rows that are needed, by hash; of these the first ones of each language
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * p.per_label / r["n"] + 1e-3))))
    h = F.xxhash64("doc_id")
    few = known.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * float(1 << 30))
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= p.per_label)
    rows = first.select("lang", "h", "text").mapInArrow(lambda it: _cropped(it, p), "lang string, h long, piece binary").orderBy("lang", "h", "piece").collect()
    labels = sorted({r["lang"] for r in rows})
    x = np.zeros((len(rows), p.window), np.uint8)
    for i, r in enumerate(rows):
        x[i, : len(r["piece"])] = np.frombuffer(r["piece"], np.uint8)
    return Model(labels, p).fit(x, np.array([labels.index(r["lang"]) for r in rows]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    none = lambda df: df.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return none(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.where(letters).mapInArrow(lean(lambda it: _predict(it, model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
    return scored.unionByName(none(rows.where(~letters)))


def languages(docs: DataFrame, p: Net = Net()) -> DataFrame:
    """Learn from documents that aren't held out, and predict all."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, train(docs, ~held_out(), p))


def accuracy(predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """(lang, n, correct) of held-out documents with a language and a letter."""
    truth = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang")
    both = predicted.where("held_out").join(truth, "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("long")).alias("correct"))
