"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank, so that a text is scored in time linear in its features:
half the sum over factors of (sum v x)^2 - sum (v x)^2.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, platt, sigmoid

#: Buckets for hashed words, factors, and training texts of each class and their characters at most.
BUCKETS, FACTORS, SAMPLE, CHARS = 1 << 13, 8, 2500, 20_000
#: Features of texts that are scored together.
PART = 1 << 20
#: A structure statistic falls in one of so many bins, each a feature.
BINS = 8
MARK = re.compile(r"[^\w\s]")
STATS = ("chars", "words", "word_length", "distinct", "marks", "doubled_marks", "upper", "digits", "pipes", "lines", "repeated_lines", "short_line", "stops", "top_word")
DOUBLED = re.compile(r"([^\w\s])\1")


def statistics(text: str, words: list[str], counts: dict[str, int]) -> list[float]:
    """Each from 0 to 1. chars is the one piece of metadata that isn't barred."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    letters = sum(map(len, words))
    return [
        min(1.0, np.log1p(len(text)) / 12), min(1.0, np.log1p(len(words)) / 10), min(1.0, letters / w / 20), len(counts) / w,
        min(1.0, 2 * len(MARK.findall(text)) / n), min(1.0, len(DOUBLED.findall(text)) / w), min(1.0, sum(x.isupper() for x in words) / w),
        min(1.0, sum(x.isdigit() for x in words) / w * 5), min(1.0, text.count("|") / w), min(1.0, np.log1p(len(lines)) / 7), 1 - len(set(lines)) / len(lines),
        min(1.0, min(map(len, lines)) / 200), min(1.0, text.count(". ") / w * 5), max(counts.values(), default=0) / w,
    ]


class Features:
    """Feature numbers and values of a text: hashed words by the root of their share, statistics by bin and value."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        counts = Counter(words)
        if len(self.known) > 300_000:
            self.known = {}
        known, ids = self.known, []
        for x in counts:
            if (i := known.get(x)) is None:
                i = known[x] = crc32(x.lower().encode()) % BUCKETS
            ids.append(i)
        values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / max(1, len(words)))
        stats = statistics(text or "", words, counts)
        bins = [BUCKETS + k * (BINS + 1) + min(BINS - 1, int(s * BINS)) for k, s in enumerate(stats)]
        plain = [BUCKETS + k * (BINS + 1) + BINS for k in range(len(stats))]
        return np.array(ids + bins + plain, np.int64), np.concatenate([values, np.ones(len(bins), np.float32), np.array(stats, np.float32)])


class FactorisationMachine:
    def __init__(self, n: int, factors: int = FACTORS):
        self.w0, self.w, self.v = 0.0, np.zeros(n, np.float32), np.zeros((n, factors), np.float32)
        self.a, self.b = 1.0, 0.0

    def raws(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of many texts at once, each of which has features."""
        out = np.zeros(len(rows))
        lo = 0
        while lo < len(rows):  # a part of bounded size at a time
            hi, size = lo, 0
            while hi < len(rows) and (hi == lo or size < PART):
                size += len(rows[hi][0])
                hi += 1
            ids, x = (np.concatenate(c) for c in zip(*rows[lo:hi]))
            starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows[lo:hi]])[:-1]])
            vx = self.v[ids] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            out[lo:hi] = self.w0 + np.add.reduceat(self.w[ids] * x + -0.5 * (vx * vx).sum(axis=1), starts) + 0.5 * (s * s).sum(axis=1)
            lo = hi
        return out

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.a * self.raws(rows) + self.b)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> FactorisationMachine:
        """By AdaGrad on the logistic loss, each class with equal weight."""
        rng = np.random.default_rng(seed)
        self.v = rng.normal(0, 0.02, self.v.shape).astype(np.float32)
        gw, gv, g0 = np.full_like(self.w, 1e-4), np.full_like(self.v, 1e-4), 1e-4
        share = max(1e-3, min(1 - 1e-3, y.mean()))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, x = rows[i]
                vx = self.v[ids] * x[:, None]
                s = vx.sum(axis=0)
                p = 1 / (1 + np.exp(-np.clip(self.w0 + self.w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()), -30, 30)))
                g = (p - y[i]) * (0.5 / share if y[i] else 0.5 / (1 - share))
                dw, dv = g * x + decay * self.w[ids], g * x[:, None] * (s - vx) + decay * self.v[ids]
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                g0 += g * g
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
                self.w0 -= rate * g / np.sqrt(g0)
        self.a, self.b = platt(self.raws(rows), y)
        return self


def train(docs: DataFrame, labels: DataFrame, n_folds: int = 3, held_out: int = 1, column: str = "text", sample: int = SAMPLE, chars: int = CHARS) -> FactorisationMachine:
    got = labelled_sample(docs.withColumn("text", F.col(column)), labels, "quality", n_folds, held_out, sample, chars)
    make, model = Features(), FactorisationMachine(BUCKETS + len(STATS) * (BINS + 1))
    y = np.array([r[1] for r in got], np.float64)
    return model.fit([make(r[0]) for r in got], y) if 0 < y.sum() < len(y) else model


def quality(docs: DataFrame, labels: DataFrame, n_folds: int = 3, held_out: int = 1, threshold: float = 0.5, column: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null counts as empty text, which has statistics and so a score; long texts are scored whole. Without labels
    of both classes nothing is learned and every score is 0.5. Null keys hash as empty text; repeated rows get the same score. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, n_folds, held_out, column, sample))  # bounded by BUCKETS and FACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, m = Features(), model.value
        for batch in batches:
            score = m.scores([make(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold(F.col("doc_id"), n_folds) == held_out).alias("held_out"), F.col(column).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
