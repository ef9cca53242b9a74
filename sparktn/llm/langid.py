"""Language ID by a byte convolutional network: filters of several widths, max pooling and softmax, in numpy.

A convolution over one-hot bytes is a sum of table rows, one for each place of the filter; tables for pairs of
bytes halve the lookups when texts are scored. Texts are scored whole, as windows of a fixed length of which
those of many texts make one batch; a text's answer is the mean of its windows' log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER, fold

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 192
#: Training windows of each language at most, one a text, from the rows with the smallest hashes of key and text.
SAMPLE = 600
#: Languages that are learned at most, those with the most rows; of equally frequent ones the first by name.
LANGUAGES = 1000
BATCH = 256


class ByteCnn:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.out, self.out_bias = rng.normal(0, 1 / np.sqrt(n), (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values, places = [], []
        for t, b in zip(self.tables, self.bias):
            p = x.shape[1] - len(t) + 1
            s = sum(t[k][x[:, k : k + p]] for k in range(len(t)))
            at = s.argmax(axis=1)
            values.append(np.take_along_axis(s, at[:, None], 1)[:, 0] + b)
            places.append(at)
        return np.concatenate(values, axis=1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.05, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        seen = [np.full_like(p, 1e-6) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 64):
                rows = order[lo : lo + 64]
                v, places = self.pooled(x[rows])
                h = np.maximum(v, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (v > 0)
                grads = []
                for i, (t, at) in enumerate(zip(self.tables, places)):
                    g, own = np.zeros_like(t), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(len(t)):
                        np.add.at(g[k], (np.take_along_axis(x[rows], at + k, 1), np.arange(FILTERS)[None, :].repeat(len(rows), 0)), own)
                    grads.append(g)
                grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))] + [h.T @ p, p.sum(axis=0)]
                for w, g, s in zip(params, grads, seen):
                    s += g * g
                    w -= rate * g / np.sqrt(s)
        return self

    def paired(self) -> ByteCnn:
        """For scoring: tables of two bytes where a filter has two places."""
        self.pairs = [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)] for t in self.tables]
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        values = []
        for w, tables, b in zip(WIDTHS, self.pairs, self.bias):
            p = x.shape[1] - w + 1
            s = None
            for i, t in enumerate(tables):
                part = t.take((two if 2 * i + 1 < w else x)[:, 2 * i : 2 * i + p], axis=0)
                s = part if s is None else np.add(s, part, out=s)
            values.append(s.max(axis=1) + b)
        z = np.maximum(np.concatenate(values, axis=1), 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that together cover every text, padded by zero bytes, and the number of windows of each."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    data = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), counts


def train(docs: DataFrame, n_folds: int = 5, held_out: int = 0, column: str = "text", sample: int = SAMPLE) -> ByteCnn | None:
    """Fitted on at most `sample` windows of each of at most LANGUAGES languages; None if no row is labelled.

    Rows are counted by language first, so that a second pass takes only those whose hash is below a bound that
    some four samples of each language pass.
    """
    rows = docs.select("doc_id", F.col(column).alias("text"), "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), n_folds) != held_out))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not found:
        return None
    top = (1 << 63) - 1
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(top, int(-top + 2 * top * min(1.0, 4 * sample / r["n"])))) for r in found], "lang string, bound bigint")
    at = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    near = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(bounds), "lang").where((F.col("h") <= F.col("bound")) & (F.length("text") > 0))
    cut = near.select("doc_id", "lang", "h", F.substr("text", at.cast("int"), F.lit(WINDOW)).alias("w"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "w"))
    got = cut.withColumn("r", first).where(F.col("r") <= sample).orderBy("lang", "r").collect()
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x, _ = windows([r["w"].encode()[:WINDOW] for r in got])
    y = np.array([langs.index(r["lang"]) for r in got])
    return ByteCnn(langs).fit(x, y).paired()


def languages(docs: DataFrame, column: str = "text", n_folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Texts that are null or have no letter are `und` with score 1, and so is every row where no label is
    known. Null keys hash as empty text; repeated rows get the same answer. Long texts are read whole, window by
    window; of equally likely languages the first by name is given. An empty table gives no rows.
    """
    model = train(docs, n_folds, held_out, column, sample)
    net = docs.sparkSession.sparkContext.broadcast(model)  # a bounded model, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = net.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, score = ["und"] * len(texts), [1.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if t and any(x[0].isalpha() for x in LETTER.finditer(t))] if m else []
            for part in parts(lettered, texts):
                x, counts = windows([texts[i].encode() for i in part])
                lp = np.concatenate([m.log_probs(x[at : at + BATCH]) for at in range(0, len(x), BATCH)])
                mean = np.add.reduceat(lp, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, k, s in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    pred[i], score[i] = m.langs[k], float(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold(F.col("doc_id"), n_folds) == held_out).alias("held_out"), F.col(column).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def parts(rows: list[int], texts: list[str], chars: int = 2 << 20) -> Iterator[list[int]]:
    """The rows in lists of bounded text."""
    part, size = [], 0
    for i in rows:
        part.append(i)
        size += len(texts[i])
        if size > chars:
            yield part
            part, size = [], 0
    if part:
        yield part
