"""A quality classifier: a factorisation machine over hashed words, statistics of structure, and metadata.

The score of a text is sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). With factors of low rank the sum over pairs
is half of sum over f of (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2, so a text is scored in time linear in its features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import WordHashes, kept, map_rows

SCORE = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}
BUCKETS = 1 << 14
TOKEN = re.compile(r"\S+")
UPPER, LOWER, DIGIT, SPACE, LINE, MARK, SYMBOL, WIDE = range(8)


def byte_classes() -> np.ndarray:
    """The class of each byte of UTF-8 text; bytes of characters beyond ASCII are one class."""
    classes = np.full(256, WIDE, np.uint8)
    for byte in range(128):
        c = chr(byte)
        classes[byte] = (UPPER if c.isupper() else LOWER if c.islower() else DIGIT if c.isdigit() else
                         LINE if c == "\n" else SPACE if c.isspace() else MARK if c in ".,;:!?'\"-()" else SYMBOL)
    return classes


CLASSES = byte_classes()


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Statistics of a whole text, and its length as the table states it. All are 0 for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(CLASSES[raw], minlength=8) / max(1, len(raw))
    tokens, lines = max(1, len(words)), text.split("\n")
    pairs = sum(a == b for a, b in zip(words, words[1:])) / tokens
    commonest = counts.most_common(1)[0][1] / tokens if counts else 0.0
    shouted = text.count("!") / max(1, len(text))
    return [*kinds, np.log1p(len(text)), np.log1p(len(words)), len(text) / tokens / 10, len(counts) / tokens, pairs,
            commonest, len(set(lines)) / len(lines), len(lines) / tokens, shouted * 10,
            text.count("|") / max(1, len(text)) * 10, np.log1p(max(0, n_chars or 0))]


N_STRUCTURE = len(structure("", [], Counter(), 0))
SIZE = BUCKETS + N_STRUCTURE


class Features:
    """The sparse features of a text: (index, value)."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = TOKEN.findall(text.lower())
        counts = Counter(words)
        where = (self.hashes.of(list(counts)) >> np.uint64(20)).astype(np.int64) % BUCKETS
        weight = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        weight /= np.sqrt((weight ** 2).sum()) or 1.0
        stats = np.array(structure(text, words, counts, n_chars))
        return np.concatenate([where, np.arange(BUCKETS, SIZE)]), np.concatenate([weight, stats])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def scaled(self, values: np.ndarray) -> np.ndarray:
        """The statistics with mean 0 and deviation 1 in the sample, within 5 deviations; word weights as they are."""
        values = values.copy()
        values[-N_STRUCTURE:] = np.clip((values[-N_STRUCTURE:] - self.mean) / self.deviation, -5, 5)
        return values

    def score(self, where: np.ndarray, values: np.ndarray) -> float:
        values = self.scaled(values)
        held = self.factors[where] * values[:, None]
        total = self.bias + self.linear[where] @ values + 0.5 * ((held.sum(0) ** 2).sum() - (held ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 12, rate: float = 0.02,
        decay: float = 1e-4, batch: int = 64, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, Adam on mini-batches. Without samples of both labels the score is the share of label 1, or 0.5."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, _, y in samples], np.float64)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
    stats = np.array([v[-N_STRUCTURE:] for _, v, _ in samples]) if samples else np.zeros((1, N_STRUCTURE))
    machine = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, rank)),
                                   stats.mean(0), np.maximum(stats.std(0), 1e-6))
    if len(set(labels)) < 2:
        machine.factors[:] = 0
        return machine
    rows = [(w, machine.scaled(v)) for w, v, _ in samples]
    table = np.concatenate([machine.linear[:, None], machine.factors], axis=1)
    first, second = np.zeros_like(table), np.zeros_like(table)
    steps = 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            steps += 1
            where = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen])[:, None]
            sizes = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            held = table[where]
            sums = np.add.reduceat(held[:, 1:] * x, starts)
            squares = np.add.reduceat((held[:, 1:] * x) ** 2, starts)
            total = machine.bias + np.add.reduceat(held[:, 0] * x[:, 0], starts) + 0.5 * (sums ** 2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(total, -35, 35))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes)[:, None]
            slope = np.concatenate([each * x, each * x * (np.repeat(sums, sizes, axis=0) - held[:, 1:] * x)], axis=1)
            touched, back = np.unique(where, return_inverse=True)
            order = np.argsort(back, kind="stable")
            edges = np.searchsorted(back[order], np.arange(len(touched)))
            slope = np.add.reduceat(slope[order], edges) + decay * table[touched]
            first[touched] = 0.9 * first[touched] + 0.1 * slope
            second[touched] = 0.999 * second[touched] + 0.001 * slope ** 2
            step = rate * np.sqrt(1 - 0.999 ** steps) / (1 - 0.9 ** steps)
            table[touched] -= step * first[touched] / (np.sqrt(second[touched]) + 1e-8)
            machine.bias -= rate * error.sum()
    machine.linear, machine.factors = table[:, 0].copy(), table[:, 1:].copy()
    return machine


def train(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = 4000) -> FactorisationMachine:
    """A machine fitted on a bounded sample: about `max_rows` labelled rows, drawn by a hash of the id.

    `labels` are (doc_id, quality), `learnable` selects the rows that may be learnt from. Only the sample's ids are joined to
    the texts (so that side has a proven bound and is broadcast), and only its features reach the driver.
    """
    usable = labels.filter(learnable & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    share = min(1.0, max_rows / max(1, usable.count()))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    chosen = docs.select("doc_id", "text", "n_chars").join(F.broadcast(usable.filter(draw)), "doc_id")
    out = {"where": pa.list_(pa.int64()), "values": pa.list_(pa.float64()), "quality": pa.int32(), "doc_id": pa.int64()}

    def start():
        features = kept("features", None, Features)

        def one(row: tuple) -> Iterator[tuple]:
            text, n_chars, quality, doc_id = row
            where, values = features(text, n_chars)
            yield where.tolist(), values.tolist(), quality, doc_id
        return one

    rows = map_rows(chosen, ["text", "n_chars", "quality", "doc_id"], start, out)
    samples = sorted(((r.doc_id, r.quality, r.where, r.values) for r in rows.toLocalIterator()))
    return fit([(np.array(w), np.array(v), y) for _, y, w, v in samples])


def score(docs: DataFrame, machine: FactorisationMachine, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: the score of its whole text, and whether it reaches `threshold`.

    A null text counts as empty, a null n_chars as 0. Equal texts with equal n_chars have equal scores.
    """
    def start():
        features = kept("features", None, Features)

        def one(row: tuple) -> Iterator[tuple]:
            doc_id, text, n_chars, held = row
            value = machine.score(*features(text, n_chars))
            yield doc_id, held, value, int(value >= threshold)
        return one

    named = docs.select("doc_id", "text", "n_chars", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return map_rows(named, ["doc_id", "text", "n_chars", "held_out"], start, SCORE)
