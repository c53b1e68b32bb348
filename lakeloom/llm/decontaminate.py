"""Benchmark decontamination: rare n-grams seed alignments of documents with test items.

Every n-gram of an item is a seed, so that an edited copy is met wherever n words in a row are left of it. The words around
the seeds of an item are aligned with it (Smith-Waterman, in words), which scores exact, edited and paraphrased copies
alike. A common phrase starts no alignment by itself: as many words of the item as a copy must have are needed near it.

Documents are only scanned, once for each block of the benchmark, and never shuffled. A block is of bounded size.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import carried, map_rows, may_hold, mixed, restored, text_key, words_of
from lakeloom.sources.lake import committed

HIT = {"doc_id": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "start_word": pa.int64(), "end_word": pa.int64()}
KEYED_HIT = {"doc_id": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), **HIT}
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Items:
    """A block of benchmark items: their words numbered, and the words of each item. Other words have number -1."""

    ids: list[int]
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    n: int

    @classmethod
    def of(cls, ids: list[int], texts: list[str], n: int) -> Items:
        split = [words_of(text) for text in texts]
        vocabulary = {word: i for i, word in enumerate(dict.fromkeys(w for words in split for w in words))}
        return cls(ids, vocabulary, [np.array([vocabulary[w] for w in words], np.int64) for words in split], n)

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, item, position) of the n-grams of the items; an item of fewer than n words is one."""
        found = [runs(words, min(self.n, len(words))) for words in self.words]
        item = np.repeat(np.arange(len(found)), [len(at) for _, at in found])
        return (np.concatenate([gram for gram, _ in found]), item, np.concatenate([at for _, at in found]))

    def sizes(self) -> list[int]:
        return sorted({min(self.n, len(words)) for words in self.words})


def runs(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the runs of n words that are all known."""
    known = words >= 0
    count = max(0, len(words) - n + 1)
    whole = known[:count].copy()
    for k in range(1, n):
        whole &= known[k:k + count]
    at = np.flatnonzero(whole)
    gram = np.full(len(at), n, np.uint64)
    for k in range(n):
        gram = mixed(gram ^ words[at + k].astype(np.uint64))
    return gram, at


@dataclass
class Seeds:
    """The n-grams of the items, sorted by hash, with the item and the position each starts at."""

    grams: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, items: Items) -> Seeds:
        grams, item, at = items.grams()
        order = np.argsort(grams, kind="stable")
        return cls(grams[order], item[order], at[order])


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of the words of an item in those of a text; rows of the table are
    computed at once, gaps along a row by a running maximum."""
    size = len(text) + 1
    above, best, where = np.zeros(size, np.int64), 0, (0, 0)
    origin = np.arange(size)
    step = -GAP * np.arange(size)
    for word in item:
        diagonal = np.where(text == word, MATCH, MISMATCH) + above[:-1]
        row = np.zeros(size, np.int64)
        start = np.arange(size)
        from_above = above + GAP
        better = from_above > 0
        row[better], start[better] = from_above[better], origin[better]
        better = np.concatenate([[False], diagonal >= np.maximum(row[1:], 1)])
        row[better], start[better] = diagonal[better[1:]], origin[:-1][better[1:]]
        # A gap in the item: the best of row[j] - (i - j) over j <= i.
        lifted = row + step
        running = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == running, np.arange(size), 0))
        row, start = running - step, start[came]
        above, origin = row, start
        top = int(row.argmax())
        if row[top] > best:
            best, where = int(row[top]), (int(start[top]), top)
    return best, *where


def shared_words(text: np.ndarray, item: np.ndarray) -> int:
    """How many words a text has of an item, each as often as both hold it; no alignment matches more."""
    held, times = np.unique(text, return_counts=True)
    own, most = np.unique(item, return_counts=True)
    _, i, j = np.intersect1d(held, own, assume_unique=True, return_indices=True)
    return int(np.minimum(times[i], most[j]).sum())


def matches(words: np.ndarray, items: Items, seeds: Seeds, threshold: float) -> Iterator[tuple]:
    """(item, score, start, end) of the items that a document holds a copy of; the best place of each."""
    found_item, found_begin = [], []
    for n in items.sizes():
        grams, position = runs(words, n)
        left = np.searchsorted(seeds.grams, grams, "left")
        count = np.searchsorted(seeds.grams, grams, "right") - left
        seed = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found_item.append(seeds.item[seed])
        found_begin.append(np.repeat(position, count) - seeds.at[seed])
    item, begin = np.concatenate(found_item), np.concatenate(found_begin)
    if not len(item):
        return
    order = np.lexsort((begin, item))
    item, begin = item[order], begin[order]
    best: dict[int, tuple] = {}
    # Seeds of an item that lie within its length of each other share a window of the text.
    lengths = np.array([len(w) for w in items.words])
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > lengths[item[1:]])])
    edges = np.append(np.flatnonzero(new), len(item))
    for i, j in zip(edges[:-1], edges[1:]):
        which = int(item[i])
        own = items.words[which]
        # A copy with more words between its own than this scores less than the threshold.
        between = max(0, math.ceil(MATCH * len(own) * (1 - threshold) / -GAP))
        low = max(0, int(begin[i]) - between)
        window = words[low:int(begin[j - 1]) + len(own) + between]
        if shared_words(window, own) / len(own) < threshold:
            continue
        score, start, end = align(window, own)
        share = score / (MATCH * len(own))
        if share >= threshold and (which not in best or share > best[which][0]):
            best[which] = share, low + start, low + end
    for which in sorted(best):
        yield which, *best[which]


def blocks_of(benchmark: DataFrame, block_items: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks, in order of their ids; null texts and texts without words can't be copied and are left out."""
    ids, texts = [], []
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if re.search(r"\w", row.text):
            ids.append(row.item_id), texts.append(row.text)
        if len(ids) == block_items:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = 3, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each document and item of which it holds a copy, exact or edited.

    The score is the alignment's, as a share of an exact copy's; copies reach `threshold` and have n words in a row. The words from start_word
    to before end_word of the document, counted from 0, are the best copy. Null and empty texts hold none, and columns other than
    (doc_id, text) and (item_id, text) are not read. Rows that repeat are each reported. An item shorter than n words is a
    seed as a whole. Without items the result is empty.
    """
    return hits(docs, benchmark, threshold, n, block_items).drop("t1", "t2")


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float, n: int, block_items: int) -> DataFrame:
    """`contaminated`, with the hashes of the text that is meant."""
    keyed = docs.select("doc_id", *text_key(), "text")
    found = None
    for ids, texts in blocks_of(benchmark, block_items):
        items = Items.of(ids, texts, n)
        part = map_rows(keyed, ["doc_id", "t1", "t2", "text"], aligner(items, Seeds.of(items), threshold), KEYED_HIT)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, t1 bigint, t2 bigint, item_id bigint, score double, start_word bigint, end_word bigint")
    return found


def aligner(items: Items, seeds: Seeds, threshold: float):
    def start():
        def one(row: tuple) -> Iterator[tuple]:
            *key, text = row
            for which, *rest in matches(items.numbers(text), items, seeds, threshold):
                yield *key, items.ids[which], *rest
        return one
    return start


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = 3, block_items: int = 20_000) -> DataFrame:
    """The rows of `docs` that hold no copy of an item; the columns stay as they are.

    Rows are told apart by doc_id and text, so a row stays whatever another one with its id, or also without one, holds.
    """
    bad = committed(hits(docs, benchmark, threshold, n, block_items).select(
        F.col("doc_id").alias("_doc"), F.col("t1").alias("_bad1"), F.col("t2").alias("_bad2")).distinct(), "contaminated")
    touched, same = may_hold(carried(docs), bad.select(F.col("_doc").alias("doc_id")))
    t1, t2 = text_key()
    named = touched.withColumns({"_t1": t1, "_t2": t2})
    left = named.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_t1") == F.col("_bad1")) & (
        F.col("_t2") == F.col("_bad2")), "left_anti")
    return restored(left, docs.columns).unionByName(restored(same, docs.columns))
