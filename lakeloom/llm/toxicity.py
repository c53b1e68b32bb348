"""Toxicity: a support vector machine on a subsequence string kernel, approximated with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share, each weighted by DECAY to the power of the letters it
spans, so that `i.d.i.o.t`, `idxiot` and `idiot` are alike: gaps only make a subsequence lighter. Words are compared with their
ends marked; the kernel is normalised and raised to the third power (which is a kernel again), as words of one language share many
subsequences by chance. The kernel of two sentences is the sum over pairs of their different words, so a sentence is the sum of its words
in the feature space. Words that often stand in toxic texts and words drawn from others are the landmarks;
the Nyström map gives a sentence one coordinate for each, and a linear machine is fitted there.

A label belongs to a whole text, not to a sentence. Sentences of a toxic text that have a word which marks such texts start as toxic
(all of them if none has), and its others do not count at first; then those that the machine puts on the other side are taken for clean, but for the worst one of
each text, and the machine is fitted again.

The decision of a sentence is a sum over its words, so a task computes the part of each different word once, and a whole text is
looked up word by word. A text is as toxic as its most toxic sentence.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import ByteBound, arrow_schema, batched, bounded_batches, kept, map_rows, mixed, portions, rows_of

SCORE = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}
DECAY, SPAN = 0.6, 6  # a subsequence of three letters spans SPAN + 1 letters at most
STEPS = [(i, j) for i in range(1, SPAN) for j in range(i + 1, SPAN + 1)]
WEIGHTS = np.array([DECAY ** (j + 1) for j in range(8)])
SENTENCE_WORDS = 24  # sentences without an end are cut after so many words
ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
LEANING, MARKED = 2.0, 4.0  # deviations by which a word is more frequent in toxic texts, to be a landmark and to mark them
CACHE = 144 << 20  # bytes of words that a task keeps
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
START, END = 2, 3


BLOCK = 512  # words that are compared together; their number fits in the high bits of a key
CODE_BITS = 51


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of the different subsequences of up to BLOCK words, by word and code; the weights of each word have
    length 1. A code is a hash of three code points. Where a subsequence occurs more than once in a word its weights add up.
    """
    marked = "".join([f"{chr(START)}{EDGE.sub('', word) or word}{chr(END)}" for word in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(points == START) - 1
    found = []
    for i, j in STEPS:
        if len(owner) > j:
            at = np.flatnonzero(owner[j:] == owner[:len(owner) - j])
            code = (points[at] << np.uint64(42)) | (points[at + i] << np.uint64(21)) | points[at + j]
            # One number holds the word, the code, and the letters spanned: sorting it brings equal codes of a word together.
            found.append((owner[at].astype(np.uint64) << np.uint64(CODE_BITS + 3)) | (
                mixed(code) >> np.uint64(64 - CODE_BITS) << np.uint64(3)) | np.uint64(j))
    key = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0)
    both = key >> np.uint64(3)
    edges = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    weight = np.add.reduceat(WEIGHTS[(key & np.uint64(7)).astype(np.int64)], edges)
    both = both[edges]
    owner = (both >> np.uint64(CODE_BITS)).astype(np.int64)
    length = np.sqrt(np.bincount(owner, weight ** 2, minlength=len(words)))
    return owner, both & np.uint64((1 << CODE_BITS) - 1), weight / length[owner]


class Landmarks:
    """Landmark words, ready to be compared with any others: of each subsequence, the landmarks that have it."""

    def __init__(self, words: list[str]):
        parts = [subsequences(words[low:low + BLOCK]) for low in range(0, len(words), BLOCK)]
        owner = np.concatenate([part[0] + n * BLOCK for n, part in enumerate(parts)])
        code, weight = (np.concatenate([part[at] for part in parts]) for at in (1, 2))
        order = np.argsort(code, kind="stable")
        self.count, self.landmark, self.weight = len(words), owner[order], weight[order]
        self.codes, self.first, self.times = np.unique(code[order], return_index=True, return_counts=True)
        # Most subsequences are in no landmark, which their last bits often show.
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.codes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark."""
        out = np.zeros((len(words), self.count), np.float32)
        for low in range(0, len(words), BLOCK):
            some = words[low:low + BLOCK]
            owner, code, weight = subsequences(some)
            known = np.flatnonzero(self.maybe[(code & np.uint64((1 << 18) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.codes, code[known]), len(self.codes) - 1)
            same = self.codes[place] == code[known]
            known, place = known[same], place[same]
            times = self.times[place]
            ends = np.cumsum(times)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[place] - ends + times, times)
            met = np.repeat(owner[known] * self.count, times) + self.landmark[at]
            both = np.bincount(met, np.repeat(weight[known], times) * self.weight[at], minlength=len(some) * self.count)
            both = both.astype(np.float32).reshape(len(some), self.count)
            out[low:low + len(some)] = both * both * both
        return out


def sentences(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a text, and where its sentences start. Three or more single letters in a row are added as one word."""
    words = text.lower().split() if text else []
    if not words:
        return [], np.zeros(0, np.int64)
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    last = "".join([word[-1] for word in words]).encode("utf-32-le", "surrogatepass")
    ends = np.isin(np.frombuffer(last, np.uint32), ENDS)
    if single.any():
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        for low, high in zip(bounds[-2::-2].tolist(), bounds[::-2].tolist()):
            if high - low >= 3:
                words.insert(high, "".join(words[low:high]))
                ends = np.insert(ends, high, ends[high - 1])
                ends[high - 1] = False
    start = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    since = np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))
    return words, np.flatnonzero(since % SENTENCE_WORDS == 0)


@dataclass
class Machine:
    """The fitted machine: landmarks with a weight each, the bias, and the slope and offset that turn the decision of a text into
    a score."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def prepared(self) -> Machine:
        self.ready = Landmarks(self.landmarks)
        return self

    def parts(self, words: list[str]) -> np.ndarray:
        """What each word adds to the decision of its sentence."""
        return self.ready.kernel(words) @ self.weights

    def score(self, decision: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -35, 35))))


class Scorer:
    """A machine with the parts of the words it has met; they are forgotten when they take too much room."""

    def __init__(self, machine: Machine):
        self.machine, self.bound = machine.prepared(), ByteBound(CACHE)
        self.place, self.values = {}, np.zeros(1024)

    def __call__(self, texts: list[str | None]) -> list[float]:
        """The score of each text. New words of all of them are compared with the landmarks together."""
        split = [sentences(text) for text in texts]
        new = list({word for words, _ in split for word in words if word not in self.place})
        if not self.bound.holds(new):
            self.place.clear()
            self.bound.restart()
            new = list({word for words, _ in split for word in words})
            self.bound.holds(new)
        self._learn(new)
        return [self.machine.score(self._decision(words, starts) + self.machine.bias) for words, starts in split]

    def _decision(self, words: list[str], starts: np.ndarray) -> float:
        if not words:
            return 0.0
        places = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        # Of each sentence, each different word once.
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        once = np.sort(sentence << 32 | places)
        once = once[np.concatenate([[True], once[1:] != once[:-1]])]
        return float(np.bincount(once >> 32, self.values[once & 0xFFFFFFFF], minlength=len(starts)).max())

    def _learn(self, new: list[str]) -> None:
        for low in range(0, len(new), 2048):
            some = new[low:low + 2048]
            known = len(self.place)
            if known + len(some) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros(len(self.values) + len(some))])
            self.values[known:known + len(some)] = self.machine.parts(some)
            self.place.update(zip(some, range(known, known + len(some))))


def decisions(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    return x @ held[:-1].astype(x.dtype) + held[-1].astype(x.dtype)


def support_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float, steps: int = 12) -> np.ndarray:
    """Newton's method on the squared hinge loss of (x, 1); y is 1 or -1. The last weight is the bias, which is hardly decayed."""
    size = x.shape[1] + 1
    held, ridge = np.zeros(size), np.full(size, decay)
    ridge[-1] *= 1e-3
    for _ in range(steps):
        square, side = np.diag(ridge), np.zeros(size)
        for low in range(0, len(x), 4096):
            part, goal = x[low:low + 4096], y[low:low + 4096]
            inside = goal * decisions(part, held) < 1
            rows = np.concatenate([part[inside], np.ones((int(inside.sum()), 1), x.dtype)], axis=1)
            scaled = rows * weight[low:low + 4096][inside, None]
            square += scaled.T @ rows
            side += scaled.T @ goal[inside]
        new = np.linalg.solve(square, side)
        if np.allclose(new, held, rtol=1e-4, atol=1e-6):
            break
        held = new
    return held


def landmarks_of(words: list[str], split: list[tuple[int, list[tuple[int, ...]]]], count: int) -> tuple[list[str], set[int]]:
    """Up to half of them words that mark sentences of toxic texts, the others drawn by a hash from the rest; and the numbers of all
    words that mark such sentences. A sentence that several texts of a label have counts once."""
    share, size = np.zeros((len(words), 2)), []
    for label in (0, 1):
        different = {sentence for y, held in split if y == label for sentence in held}
        size.append(max(1, len(different)))
        for sentence in different:
            share[list(sentence), label] += 1
    mean = np.clip(share.sum(1) / sum(size), 1e-9, 1 - 1e-9)
    share /= size
    marks = (share[:, 1] - share[:, 0]) / np.sqrt(mean * (1 - mean) * (1 / size[0] + 1 / size[1]))
    toxic = [words[i] for i in np.argsort(-marks, kind="stable")[:count // 2] if marks[i] > LEANING]
    rest = sorted(set(words) - set(toxic), key=lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
    return toxic + rest[:count - len(toxic)], set(np.flatnonzero(marks > MARKED).tolist())


def fit(docs: Iterable[tuple[int, list[str]]], landmarks: int = 256, decay: float = 1.0, rounds: int = 14,
        share: float | None = None, miss_cost: float = 4.0) -> Machine:
    """The machine of labelled texts (label 0 or 1, sentences as text), of which `share` are toxic where the texts come from.
    A toxic text missed costs `miss_cost` times what a clean one taken for toxic does. Texts that repeat count once.
    Without texts of both labels each score is the share of label 1, or 0.5 without any."""
    number: dict[str, int] = {}
    texts = {(y, tuple(tuple(sorted({number.setdefault(w, len(number)) for w in sentence.split(" ")})) for sentence in held))
             for y, held in docs}
    words = list(number)
    split = sorted(((y, held) for y, held in texts if held), key=lambda row: (row[0], [[words[i] for i in s] for s in row[1][:2]]))
    labels = np.array([y for y, _ in split])
    if len(set(labels)) < 2:
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return Machine([""], np.zeros(1), 0.0, 0.0, float(np.log(share / (1 - share))))
    chosen, marking = landmarks_of(words, split, landmarks)
    ready = Landmarks(chosen)
    among = ready.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = ready.kernel(words) @ root.astype(np.float32)
    x = np.zeros((sum(len(held) for _, held in split), mapped.shape[1]), np.float32)
    for row, sentence in enumerate(s for _, held in split for s in held):
        x[row] = mapped[list(sentence)].sum(0)
    del mapped
    text = np.repeat(np.arange(len(split)), [len(held) for _, held in split])
    first = np.concatenate([[0], np.cumsum([len(held) for _, held in split])[:-1]])
    marked = np.array([not marking.isdisjoint(sentence) for _, held in split for sentence in held])
    none = ~np.logical_or.reduceat(marked, first)[text]
    y = np.where(labels[text] == 1, 1.0, -1.0).astype(np.float32)
    known = (labels[text] == 0) | marked | none
    held = np.zeros(x.shape[1] + 1)
    for turn in range(rounds):
        if turn:
            decision = decisions(x, held)
            worst = decision >= np.maximum.reduceat(decision, first)[text]
            y = np.where((labels[text] == 1) & ((decision > 0) | worst), 1.0, -1.0).astype(np.float32)
            known = np.ones(len(y), bool)
        toxic = max(1, int(((y > 0) & known).sum()))
        weight = np.where(y > 0, np.sqrt(len(y) / toxic), 1.0) * known
        held = support_machine(x, y, weight.astype(np.float32), decay)
    decision = np.maximum.reduceat(decisions(x, held), first)
    slope, offset = calibrated(decision, labels, float(labels.mean()) if share is None else share, miss_cost)
    return Machine(chosen, (root @ held[:-1]).astype(np.float32), float(held[-1]), slope, offset)


def calibrated(decision: np.ndarray, labels: np.ndarray, share: float, miss_cost: float, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the decisions of texts of which `share` are toxic, with smoothed labels, as
    the decisions may split them cleanly."""
    ones = int(labels.sum())
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    weight = np.where(labels == 1, share / ones, (1 - share) / (len(labels) - ones))
    weight[labels == 1] *= miss_cost
    rows = np.stack([decision, np.ones(len(decision))], axis=1)
    held = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ held, -35, 35)))
        slope = rows.T @ (weight * (p - goal)) + 1e-6 * held
        held = held - np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-6 * np.eye(2), slope).clip(-2, 2)
    return float(max(held[0], 1e-3)), float(held[1])


def train(docs: DataFrame, labels: DataFrame, learnable: Column, rows_per_label: int = 1000,
          sentences_per_row: int = 64) -> Machine:
    """A machine fitted on a bounded sample: about `rows_per_label` labelled rows of each label, drawn by a hash of the id, and of
    a very long row as many sentences, spread evenly.

    `labels` are (doc_id, toxic), `learnable` selects the rows that may be learnt from. Ids with both labels are not used. Only
    the sample's ids are joined to the texts, and only its sentences reach the task that fits the machine.
    """
    usable = labels.filter(learnable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).filter("toxic = _other").select("doc_id", "toxic")
    sizes = {row.toxic: row["count"] for row in usable.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for label, size in sizes.items():
        wanted = wanted | ((F.col("toxic") == label) & (draw < int(min(1.0, rows_per_label / size) * (1 << 30))))
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable.filter(wanted)), "doc_id")

    def start():
        def one(row: tuple) -> Iterator[tuple]:
            doc_id, text, toxic = row
            words, starts = sentences(text)
            edges = np.append(starts, len(words))
            step = max(1, -(-len(starts) // sentences_per_row))
            yield doc_id, toxic, [" ".join(words[edges[i]:edges[i + 1]]) for i in range(0, len(starts), step)]
        return one

    share = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row for batch in batches for row in rows_of(batch, "doc_id", "toxic", "held")))
        machine = fit(((toxic, held) for _, toxic, held in found), share=share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)])], names=["machine"])

    out = {"doc_id": pa.int64(), "toxic": pa.int32(), "held": pa.list_(pa.string())}
    # The sample is small whatever the tables hold, so one task fits the machine.
    rows = map_rows(chosen, ["doc_id", "text", "toxic"], start, out).repartition(1)
    made = rows.mapInArrow(fitted, "machine binary").first()
    return fit([], share=share) if made is None else pickle.loads(made.machine)


def score(docs: DataFrame, machine: Machine, held_out: Column, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: the score of its whole text, and whether it reaches `threshold`.

    A null text and one without words get the score of an empty sentence. Equal texts have equal scores, and rows that repeat
    are each scored. A null doc_id is scored too; it is not held out. Columns other than doc_id and text are not read.
    """
    key = machine.landmarks, machine.weights.tobytes(), machine.bias, machine.slope, machine.offset

    schema = arrow_schema(SCORE)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept("toxicity", key, lambda: Scorer(machine))
        return batched(((doc_id, held, value, int(value >= threshold)) for batch in batches
                        for rows in portions(rows_of(batch, "doc_id", "text", "held_out"), chars=1 << 20)
                        for (doc_id, _, held), value in zip(rows, scorer([text for _, text, _ in rows]))), schema)

    bounded_batches(docs.sparkSession)
    named = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return named.mapInArrow(apply, "doc_id bigint, held_out boolean, score double, predicted int")
