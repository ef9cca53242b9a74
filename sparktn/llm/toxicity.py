"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel counts common subsequences of letters, each weighted by the decay to the power of the length it
spans, so an insult with gaps or inserted characters still resembles itself. The Nyström map turns a token's
similarities to some landmarks into features of a linear machine, trained on sentences, of which each counts by its
worst token: all sentences of clean texts, and of each toxic text the one that the machine finds worst, as only
the text is labelled. A text's score is a logistic function of its worst tokens and its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_batches, kept, labelled_sample, sigmoid, spare

#: The kernel's subsequences have three letters that span at most SPAN places, each place with this decay.
SPAN, DECAY = 6, 0.5
THRESHOLD = 0.3
#: Power of the normalised kernel, itself a kernel that falls off more sharply.
SHARPEN = 3
#: Landmarks from words that toxic texts favour and from clean words that a first machine takes for them, and how alike two landmarks may be.
TOXIC, OTHER, ALIKE = 40, 20, 0.6
#: Least deviation of a word's count in toxic texts from the expected one, in its standard deviations.
DEVIATION = 2.5
#: Worst tokens of a text that its score is made of.
WORST = 5
#: Training texts of each class and their characters at most.
SAMPLE, CHARS = 2000, 6000
#: Characters of a piece of a long token; pieces overlap by half.
PIECE = 24
#: Tokens of a generation of a worker's cache, which has two.
CACHE = 100_000
SENTENCE = re.compile(r"[.!?]\s|\n")
SINGLES = re.compile(r"(?:(?<=\s)|^)(?:\S[ \t]){3,}\S(?=\s|$)")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def places(n: int) -> np.ndarray:
    """Places i < j < k of a word of n letters that span at most SPAN."""
    return np.array([(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN - 1)) for k in range(j + 1, min(n, i + SPAN))], np.int64).reshape(-1, 3)


def weights(p: np.ndarray) -> np.ndarray:
    return (DECAY ** (p[:, 2] - p[:, 0] + 1)).astype(np.float32)


def subsequences(word: str) -> dict[tuple[str, str, str], float]:
    """The kernel's features of a word of letters."""
    out: dict[tuple[str, str, str], float] = {}
    p = places(len(word))
    for (i, j, k), w in zip(p.tolist(), weights(p).tolist()):
        u = (word[i], word[j], word[k])
        out[u] = out.get(u, 0.0) + w
    return out


def letters(token: str) -> str:
    """What the kernel sees of a token: where it begins and its letters, so marks inserted in a word don't count."""
    return "^" + (NOT_LETTERS.sub("", token) if not token.isalpha() else token)


def tokens(text: str) -> list[str]:
    """The tokens of a lower-cased text; a run of single characters also counts as the word that it spells."""
    out = text.split()
    if list(map(len, out)).count(1) > 3:
        out += ["".join(x.split()) for x in SINGLES.findall(text)]
    return out


def sentences(text: str) -> list[list[str]]:
    return [t for s in SENTENCE.split(text.lower()) if (t := tokens(s))]


class Similar:
    """Sharpened normalised similarities of tokens to the landmarks, kept for tokens seen before."""

    def __init__(self, landmarks: list[str]):
        features = [subsequences(w) for w in landmarks]
        alphabet = sorted({c for f in features for u in f for c in u})
        self.letter = {ord(c): i + 1 for i, c in enumerate(alphabet)}  # 0: in no landmark
        n = len(alphabet) + 1
        self.table = np.zeros((n, n, n, len(landmarks)), np.float32)
        for m, f in enumerate(features):
            norm = np.sqrt(sum(x * x for x in f.values())) or 1.0
            for (a, b, c), x in f.items():
                self.table[self.letter[ord(a)], self.letter[ord(b)], self.letter[ord(c)], m] = x / norm
        self.table = self.table.reshape(n**3, len(landmarks))
        self.size, self.width = n, len(landmarks)

    def of(self, words: list[str]) -> np.ndarray:
        """Of words of letters, 0 for those with fewer than three."""
        out = np.zeros((len(words), self.width), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= 3:
                by.setdefault(len(w) if len(w) <= PIECE else 0, []).append(i)
        for n, rows in by.items():
            if n == 0:
                for i in rows:
                    w = words[i]
                    pieces = [w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]
                    out[i] = np.max([self.of(pieces[k : k + 1000]).max(axis=0) for k in range(0, len(pieces), 1000)], axis=0)
                continue
            p = places(n)
            weight = weights(p)
            for lo in range(0, len(rows), 256):
                own = rows[lo : lo + 256]
                s = np.array([list(map(ord, words[i])) for i in own], np.int64)
                c = np.array([[self.letter.get(x, 0) for x in row] for row in s.tolist()], np.int64)
                at = (c[:, p[:, 0]] * self.size + c[:, p[:, 1]]) * self.size + c[:, p[:, 2]]
                k = np.einsum("bpm,p->bm", self.table[at], weight)
                out[own] = (k / np.sqrt(self_kernel(s, p, weight))[:, None]) ** SHARPEN
        return out


def scorer_of(machine: Machine) -> Scorer:
    return kept(machine.weights.tobytes(), lambda: Scorer(machine))


def self_kernel(s: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each row of character codes with itself."""
    u = (s[:, p[:, 0]] * 0x110000 + s[:, p[:, 1]]) * 0x110000 + s[:, p[:, 2]]
    order = np.argsort(u, axis=1)
    u, w = np.take_along_axis(u, order, 1), weight[order]
    first = np.ones(u.shape, bool)
    first[:, 1:] = u[:, 1:] != u[:, :-1]
    first[:, 0] = True
    group = np.cumsum(first.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    return np.add.reduceat(sums * sums, group.reshape(u.shape)[:, 0])


def favoured(texts: list[str], y: np.ndarray) -> list[str]:
    """Words that are in more toxic texts than chance explains, the most telling first."""
    seen = [Counter(), Counter()]
    for text, label in zip(texts, y):
        seen[int(label)].update({w for t in set(tokens(text.lower())) if 3 < len(w := letters(t)) <= PIECE})
    share = float(y.mean())
    z = {w: (c - e) / (e + 1) ** 0.5 for w, c in seen[1].items() if c > 1 for e in [share * (c + seen[0][w])]}
    ranked = sorted(z, key=lambda w: (-z[w], w))[:1000]
    return [w for i, w in enumerate(ranked) if z[w] >= DEVIATION or i < 5] or ["^none"]


def unlike(ranked: list[str], most: int) -> list[str]:
    """The first words of a ranking of which none is too like one before."""
    like, picked = Similar(ranked[:1000]).of(ranked[:1000]), []
    for i in range(len(like)):
        if len(picked) < most and (not picked or like[i, picked].max() < ALIKE):
            picked.append(i)
    return [ranked[i] for i in picked]


class Machine:
    """Weights on similarities to landmarks: the linear machine's weights through the Nyström map."""

    def __init__(self, texts: list[str], y: np.ndarray, rounds: int = 3):
        bad_words = favoured(texts, y)
        words: dict[str, int] = {}

        def numbers(some: Iterable[str]) -> np.ndarray:
            return np.array([words.setdefault(w, len(words)) for w in some], np.int32)

        clean, bad, whole = [], [], []
        for text, label in zip(texts, y):
            parts = [numbers({letters(t) for t in s}) for s in sentences(text)] or [numbers({"^"})]
            if label:
                bad.append(np.concatenate(parts))
            else:
                clean += parts
            whole.append(numbers(letters(t) for t in set(tokens(text.lower()))))
        known = np.array([words[w] for w in bad_words if w in words], np.int64)
        toxic = unlike(bad_words, TOXIC)
        self.landmarks = toxic
        names, negative = list(words), np.empty(0, np.int64)
        f = Similar(toxic).of(names).max(axis=1)
        for k in range(rounds):  # at first, what is nearest to a toxic landmark is taken for the worst
            positive = np.unique(np.concatenate([[s[f[s].argmax()] for s in bad], known]).astype(np.int64))
            negative = np.setdiff1d(np.unique(np.concatenate([negative, [s[f[s].argmax()] for s in clean]]).astype(np.int64)), known)
            if k == 0:
                hard = [names[i] for i in negative[np.argsort(-f[negative], kind="stable")][:600]]
                self.landmarks = toxic + unlike(hard, OTHER)
                values, vectors = np.linalg.eigh(Similar(self.landmarks).of(self.landmarks).astype(np.float64))
                root = vectors / np.sqrt(np.maximum(values, 0.05)) @ vectors.T
                phi = Similar(self.landmarks).of(names) @ root.astype(np.float32)
            positive = positive if k else known
            rows = np.concatenate([positive, negative])
            w, b = svm(phi[rows].astype(np.float64), np.concatenate([np.ones(len(positive)), -np.ones(len(negative))]))
            f = phi @ w.astype(np.float32) + np.float32(b)
        self.weights, self.offset = root @ w, b
        g = np.array([self.features(len(t), f[t] if len(t) else np.array([-2.0])) for t in whole])
        self.mean, spread = g.mean(axis=0), g.std(axis=0)
        self.scale = np.where(spread < 1e-3, 1.0, spread)  # what doesn't vary in the sample has no say
        z = (g - self.mean) / self.scale
        self.v, self.b = logistic(z, y)
        d = z @ self.v + self.b
        self.b += float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(d, y)

    def features(self, n: int, f: np.ndarray) -> np.ndarray:
        """Of a text of n different words with these decisions: the worst ones, how many are bad, the length."""
        f = np.clip(f, -2, 2)
        worst = -np.sort(-np.partition(f, len(f) - WORST)[len(f) - WORST :]) if len(f) > WORST else np.concatenate([-np.sort(-f), np.full(WORST - len(f), -2.0)])
        return np.array([*worst, np.log1p(np.maximum(f, 0).sum()), np.log1p(n)])

    def decision(self, n: int, f: np.ndarray) -> float:
        return float((self.features(n, f) - self.mean) / self.scale @ self.v + self.b)

    def score(self, f: np.ndarray) -> np.ndarray:
        return sigmoid(f)


class Scorer:
    """Decisions of texts, with those of tokens seen before kept."""

    def __init__(self, machine: Machine):
        self.machine, self.similar, self.known, self.old = machine, Similar(machine.landmarks), {}, {}

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        parts = [set(tokens(t.lower())) if t else set() for t in texts]
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        known, old, new = self.known, self.old, []
        for t in set().union(*parts):
            if t not in known:
                if (f := old.get(t)) is None:
                    new.append(t)
                else:
                    known[t] = f
        if new:
            words = [letters(t) for t in new]
            distinct = list(set(words))
            f = dict(zip(distinct, (self.similar.of(distinct) @ self.machine.weights + self.machine.offset).tolist()))
            known.update((t, f[w]) for t, w in zip(new, words))
        return np.array([self.machine.decision(len(p), np.array(list(map(known.__getitem__, p)) or [-2.0])) for p in parts])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A logistic regression by Newton's method, each class with equal weight."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        w -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + penalty * np.eye(len(w)), z.T @ (weight * (p - y)) + penalty * w)
    return w[:-1], float(w[-1])


def best_cut(d: np.ndarray, y: np.ndarray) -> float:
    """The cut of the decisions with the best F-measure, in the middle between two of them."""
    order = np.argsort(-d, kind="stable")
    hit = np.cumsum(y[order] == 1)
    f = 2 * hit / (np.arange(1, len(d) + 1) + (y == 1).sum())
    k = int(f.argmax())
    s = d[order]
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def svm(x: np.ndarray, y: np.ndarray, steps: int = 1500, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine by the squared hinge loss, each class with equal weight, and accelerated gradients."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    rate = 1 / (2 * np.linalg.norm(z.T * weight @ z, 2) + penalty)
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (z @ v))
        new = v - rate * (-2 * z.T @ (weight * y * gap) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, n_folds: int = 4, held_out: int = 2, column: str = "text", sample: int = SAMPLE, chars: int = CHARS) -> Machine | None:
    got = labelled_sample(docs.withColumn("text", F.col(column)), labels, "toxic", n_folds, held_out, sample, chars)
    y = np.array([r[1] for r in got], np.float64)
    return Machine([r[0] for r in got], y) if 0 < y.sum() < len(y) else None


def toxicity(docs: DataFrame, labels: DataFrame, n_folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, column: str = "text", sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; with keep, the columns of docs, and score and predicted under names that docs doesn't have.

    Null and empty texts have no token and get the score of a sentence unlike any landmark. Without labels of
    both classes every score is 0. Null keys hash as empty text; repeated rows get the same score. Long texts are
    scored whole, a long token by overlapping pieces. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, n_folds, held_out, column, sample))  # some dozen words and weights
    own = docs.columns if keep else ["doc_id"]
    rows = docs if keep else docs.select("doc_id", (fold(F.col("doc_id"), n_folds) == held_out).alias("held_out"), F.col(column).alias("__text"))
    read = column if keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scorer = scorer_of(m) if m else None
        for batch in batches:
            texts = batch.column(read).to_pylist()
            score = np.zeros(len(texts))
            lo = 0
            while m and lo < len(texts):  # a part of bounded text at a time
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 1 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                score[lo:hi] = m.score(scorer.decisions(texts[lo:hi]))
                lo = hi
            predicted = pa.array((score >= threshold).astype(np.int32))
            first = [batch.column(c) for c in own] + ([] if keep else [batch.column("held_out")])
            yield pa.RecordBatch.from_arrays([*first, pa.array(score), predicted], [*own, *([] if keep else ["held_out"]), score_name, predicted_name])

    score_name, predicted_name = spare(docs.columns if keep else [], "score", "predicted")
    schema = (docs if keep else rows.select("doc_id", "held_out")).select("*", F.lit(0.0).alias(score_name), F.lit(0).alias(predicted_name)).schema
    return in_batches(rows, run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows predicted to be toxic; columns as they are, whatever their names.

    Null and empty texts are scored as texts without tokens; rows that repeat a text stay or go together; without
    labels of both classes all rows stay. An empty table stays empty.
    """
    scored = toxicity(docs, labels, threshold=threshold, keep=True)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)
