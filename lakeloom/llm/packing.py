"""Packing of documents into token sequences of fixed length.

Texts are tokenised where they are scanned. A document longer than a sequence is cut into whole sequences and a rest. The
pieces (not their tokens) are dealt to groups at random, and each group is packed by itself with first-fit decreasing: the
longest piece first, each into the first sequence that has room. A tournament tree over the free room of the sequences
finds that one in logarithmic time. Groups have a bounded number of pieces, so the number of tasks grows with the input, and
a group of some thousand pieces wastes almost nothing: the many short pieces fill what the long ones leave.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.shared import ByteBound, arrow_schema, batched, bounded_batches, kept, rows_of
from lakeloom.sources.lake import committed

PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
         "doc_tokens": pa.int64()}
PACKED = T.StructType([*[T.StructField(name, T.LongType()) for name in PIECE],
                       T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

# The pre-tokens of the public word vocabulary, for lower-case Latin-1 text: contractions, runs of letters, single numbers,
# runs of anything else but white space. Other texts go to the tokenizer whole.
PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")


class TextIds:
    """Token ids of texts, equal to those of `tokenizers` on the whole text.

    A vocabulary that splits texts into words first gives each word its ids whatever stands around it, so ids are looked up by
    word and only new words are tokenised. That holds for the `word_bpe` files; `by_word=False` sends whole texts instead,
    as do texts outside Latin-1, with control characters, or with a special token's text.
    """

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that are normalised and split already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = by_word
        self._empty()

    def _empty(self) -> None:
        """Forget all words. Word w has the ids flat[starts[w]:starts[w + 1]]."""
        self.bound = ByteBound()
        self.index: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, "<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. New words of all of them are tokenised together."""
        split = [PRE_TOKEN.findall(text.lower()) if self.by_word and self._plain(text) else None for text in texts]
        rows = [None if words is None else self._rows(words) for words in split]
        unknown = [np.flatnonzero(row < 0).tolist() if row is not None else () for row in rows]
        if new := {words[i] for words, missing in zip(split, unknown) for i in missing}:
            if not self.bound.holds(list(new)):
                self._empty()
                new = {word for words in split if words for word in words}
                self.bound.holds(list(new))
                unknown = [range(len(words)) if words else () for words in split]
            new = list(new)
            for at in range(0, len(new), 4096):
                self._learn(new[at:at + 4096])
            for words, row, missing in zip(split, rows, unknown):
                for i in missing:
                    row[i] = self.index[words[i]]
        return [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4") if row is None
                else self._ids(row) for text, row in zip(texts, rows)]

    def _rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))

    def _ids(self, rows: np.ndarray) -> np.ndarray:
        first = self.starts[rows]
        sizes = self.starts[rows + 1] - first
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]

    def _learn(self, words: list[str]) -> None:
        """Tokenise new words, all at once: white space between them keeps them apart."""
        encoded = self.of_words.encode(" ".join(words), add_special_tokens=False)
        sizes = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(words))
        if len(sizes) != len(words) or not sizes.all():
            raise ValueError("this vocabulary does not keep words apart; tokenise whole texts with by_word=False")
        known = len(self.index)
        used = int(self.starts[known])
        while known + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while used + len(encoded.ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used:used + len(encoded.ids)] = encoded.ids
        self.starts[known + 1:known + 1 + len(words)] = used + np.cumsum(sizes)
        self.index.update(zip(words, range(known, known + len(words))))

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return CONTROL.search(text) is None and not any(t in text for t in self.special)


def tokenise(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, by_word: bool = True,
             with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids followed by `end_id`, cut every `length` ids.

    (doc_id, start, length, ids_crc32, doc_tokens), with `with_ids` also the ids themselves. A null text is an empty one,
    whose only id is `end_id`.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = kept("tokenizer", (tokenizer, by_word), lambda: TextIds(tokenizer, by_word))
        return batched((piece for batch in batches for rows in portions(rows_of(batch, "doc_id", "text"))
                        for (doc_id, _), ids in zip(rows, ids_of([text or "" for _, text in rows]))
                        for piece in pieces(doc_id, ids)), schema)

    def pieces(doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
        for at in range(0, len(ids), length):
            part = ids[at:at + length]
            piece = doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)
            yield (*piece, part.tolist()) if with_ids else piece

    schema = arrow_schema(PIECE | {"ids": pa.list_(pa.int64())} if with_ids else PIECE)
    bounded_batches(docs.sparkSession)
    ddl = ", ".join(f"{name} bigint" for name in PIECE) + (", ids array<bigint>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(apply, ddl)


def portions(rows: Iterator[tuple], chars: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows together up to about `chars` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class Bins:
    """Bins of equal capacity under a tournament tree: each inner node holds the most free room below it."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for `size`, which is taken from it. There must be one."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece."""
    bins, where, offset = Bins(capacity, len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: dict[int, int] = {}
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = bins.first_fit(size)
        where[i], offset[i] = found, used.get(found, 0)
        used[found] = offset[i] + size
    return where, offset


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, group_pieces: int = 8192, seed: int = 42,
         by_word: bool = True) -> DataFrame:
    """Each piece of each document with its sequence and its offset there.

    `docs` needs doc_id and text; other columns are not read. Sequences are numbered by group and place, so the numbers are
    unique but not dense. Rows that repeat are packed as often as they occur. An empty table packs to no rows.

    The pieces are written before they are dealt to groups: a task that is run again after a lost executor then reads the
    same groups, and no piece is lost or doubled.
    """
    pieces = tokenise(docs, tokenizer, length, end_id, by_word).withColumn("_draw", F.rand(seed))
    pieces = committed(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack_group(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                               ("_draw", "ascending")])
        where, offset = first_fit_decreasing(group["length"].to_numpy(), length)
        first = group["_group"][0].as_py() << 32
        return group.select(list(PIECE)).append_column("sequence_id", pa.array(where + first)).append_column(
            "offset", pa.array(offset))

    dealt = pieces.withColumn("_group", F.floor(F.col("_draw") * groups).cast("bigint"))
    return dealt.groupBy("_group").applyInArrow(pack_group, PACKED)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1,
              by_word: bool = True) -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence, pieces in order of their offsets, without padding.

    Identical pieces of one document that repeats are interchangeable, so they are matched by their number.
    """
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    keys = [F.coalesce(F.col(c), F.lit(-1)).alias(f"_{c}") for c in same]
    names = [f"_{c}" for c in same]
    ids = tokenise(docs, tokenizer, length, end_id, by_word, with_ids=True).select(*keys, "ids").groupBy(names).agg(
        F.first("ids").alias("ids"))
    joined = packed.select(*keys, "sequence_id", "offset").join(ids, names)
    held = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return held.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"))
