"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed greedily into the longest phrases that occur in that
text; a language that resembles it gives long, so few, phrases. A phrase costs about log2(size of the model) bits, so the
entropy estimate is phrases * log2(size) / characters, and the language with the least wins.

Phrases end at word ends: the automaton is built from the words of the labelled text, commonest first, with the spaces around
them, and the parse starts anew at each word. A word then has the same number of phrases wherever it stands, so a task parses
each different word once and sums over all words of each whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import ByteBound, bounded_batches, carried, kept, map_rows, restored

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
PREDICTION = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}


class SuffixAutomaton:
    """All substrings of a text: `step[(state << 21) | code point]` is the state after one more character."""

    def __init__(self, text: str):
        self.step: dict[int, int] = {}
        link, longest, out = [-1], [0], [{}]
        last = 0
        for character in text:
            new = len(out)
            link.append(0), longest.append(longest[last] + 1), out.append({})
            at = last
            while at >= 0 and character not in out[at]:
                out[at][character] = new
                at = link[at]
            if at >= 0:
                next_ = out[at][character]
                if longest[next_] == longest[at] + 1:
                    link[new] = next_
                else:
                    twin = len(out)
                    link.append(link[next_]), longest.append(longest[at] + 1), out.append(dict(out[next_]))
                    while at >= 0 and out[at].get(character) == next_:
                        out[at][character] = twin
                        at = link[at]
                    link[next_] = link[new] = twin
            last = new
        for state, steps in enumerate(out):
            for character, to in steps.items():
                self.step[state << 21 | ord(character)] = to

    def phrases(self, text: str) -> int:
        """The number of phrases of the greedy longest-match parse; an unknown character is a phrase of its own."""
        step, state, count = self.step, 0, 0
        for character in text:
            code = ord(character)
            to = step.get(state << 21 | code)
            if to is None:
                count += state != 0
                to = step.get(code)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state != 0)


class Model:
    """The automata of all languages, and the phrase counts of the words met so far."""

    def __init__(self, texts: dict[str, list[str]], chars: int):
        self.languages = sorted(texts)
        self.words = {lang: common_words(texts[lang], chars) for lang in self.languages}

    def prepared(self) -> Model:
        held = {lang: " " + " ".join(self.words[lang]) + " " for lang in self.languages}
        self.automata = [SuffixAutomaton(held[lang]) for lang in self.languages]
        self.bits = np.array([math.log2(len(held[lang]) + 1) for lang in self.languages])
        self.bound = ByteBound()
        self.index: dict[str, int] = {}
        self.counts = np.zeros((1024, len(self.languages)), np.int64)
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not self.languages or not words or not any(map(has_letter, words)):
            return UNDETERMINED, 0.0
        self._learn(words)
        rows = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        phrases = np.zeros(len(self.languages))
        for at in range(0, len(rows), 65_536):
            phrases += self.counts[rows[at:at + 65_536]].sum(axis=0, dtype=np.int64)
        cost = phrases * self.bits
        order = np.argsort(cost, kind="stable")
        best = float(cost[order[0]])
        score = 1.0 if len(order) == 1 else 1.0 - best / float(cost[order[1]])
        return self.languages[order[0]], score

    def _learn(self, words: list[str]) -> None:
        new = {word for word in words if word not in self.index}
        if not self.bound.holds(list(new)):
            self.index.clear()
            self.bound.restart()
            new = set(words)
            self.bound.holds(list(new))
        while len(self.index) + len(new) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        for word in new:
            row = len(self.index)
            spaced = f" {word} "
            self.counts[row] = [a.phrases(spaced) for a in self.automata]
            self.index[word] = row


def common_words(texts: list[str], chars: int) -> list[str]:
    """The commonest words of the texts, ties by the alphabet, up to `chars` characters together."""
    counts = Counter(word for text in texts for word in LETTERS.findall(text.lower()))
    taken, size = [], 0
    for word, _ in sorted(counts.items(), key=lambda item: (-item[1], item[0])):
        if size + len(word) + 1 > chars:
            break
        taken.append(word)
        size += len(word) + 1
    return taken


def train(labelled: DataFrame, rows_per_language: int = 400, chars: int = 60_000) -> Model:
    """The model of the labelled rows (doc_id, text, lang).

    It is fitted on a bounded sample: about `rows_per_language` rows of each language, drawn by a hash of the id (all of them
    where there are fewer), of which the commonest words up to `chars` characters a language are kept. Only that sample
    reaches the driver; it does not grow with the table. Rows without a text or a language are not used.
    """
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share: Column = F.lit(False)
    for row in sizes:
        limit = min(1.0, rows_per_language / row.n)
        draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.lit(int(limit * (1 << 30)))
        share = share | ((F.col("lang") == F.lit(row.lang)) & draw)
    texts: dict[str, list[str]] = {row.lang: [] for row in sizes}
    for row in usable.filter(share).select("lang", "text").toLocalIterator():
        texts[row.lang].append(row.text)
    return Model(texts, chars)


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    `und` with score 0 for a null text or one without a letter, or if the model has no language. The score is the margin
    to the second best language, 1 - cost / second cost: 0 for a tie, which goes to the first language of the alphabet.
    """
    def start():
        ready = kept("langid", model.words, model.prepared)

        def one(row: tuple) -> Iterator[tuple]:
            doc_id, text, held = row
            yield doc_id, held, *ready.predict(text)
        return one

    named = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return map_rows(named, ["doc_id", "text", "held_out"], start, PREDICTION)


def accepted(docs: DataFrame, model: Model, sure: float = 0.2) -> DataFrame:
    """The rows of `docs`, in their columns, whose language is determined and is the one they state, if they state one.

    A row goes if its language is `und`, or if it differs from a stated one with a score of `sure` or more. A row without
    a stated language, or where the model knows no language at all, goes only without a letter in its text.
    """
    def languages(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = kept("langid", model.words, model.prepared)
        for part in texts:
            found = [ready.predict(text) if model.languages else (UNDETERMINED if not has_letter(text) else "", 0.0)
                     for text in part]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    named = carried(docs).withColumn("_found", F.pandas_udf(languages, "lang_pred string, score double")(F.col("text")))
    found, stated = F.col("_found.lang_pred"), F.col("_row.lang")
    other = F.coalesce((found != "") & (found != stated) & (F.col("_found.score") >= sure), F.lit(False))
    return restored(named.filter((found != UNDETERMINED) & ~other), docs.columns)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))
