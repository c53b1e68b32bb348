"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which ids that links how often.

Each text is encoded twice, by a byte-level vocabulary (A) and by one of pieces (B). The cumulative byte ends of either side go to
a dictionary from end to index; the ends that both have, sorted, slice the two id lists into groups. Tokens whose ranges end
together are linked: the last ones of each slice. A pair of ids is counted over all texts, and each text is then described by how
common its links are.

Two tokens can end together only if the bytes of one end with those of the other. So the vocabularies alone bound the pairs that
can ever be linked, whatever the texts; they are numbered, counted in arrays of that size, and broadcast by their number.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import arrow_schema, batched, bounded_batches, kept, portions, rows_of
from lakeloom.sources.lake import committed

FIRST = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(),
         "links": pa.binary()}
LAST = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
        "n_best": pa.int64(), "count_sum": pa.int64(), "groups_sha256": pa.string()}
# Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICES = 1 << 12  # groups that are written out together


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters for themselves, and the other
    bytes, in order, for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Encodes by a vocabulary file of byte-level BPE; special tokens in a text are plain text.

    Ids of such a vocabulary follow the order of its merges, so the merge to do next is the one that makes the smallest id. That is how
    the faster library works, on the same entries; a vocabulary without that order goes to the one that reads the file itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        entries = self.entries(path)
        special = {token["id"] for token in held.get("added_tokens", ())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        vocabulary = held["model"]["vocab"]
        made = [vocabulary.get("".join(merge), -1) for merge in merges]
        singles = [i for i, entry in enumerate(entries) if len(entry) == 1 and i not in special]
        self.encoding = None
        if made == sorted(set(made)) and made[0] > max(singles) and held["pre_tokenizer"].get("type") == "ByteLevel":
            from tiktoken import Encoding

            ranks = {entry: i for i, entry in enumerate(entries) if entry and i not in special}
            self.encoding = Encoding("links", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True

    @staticmethod
    def entries(path: str) -> list[bytes]:
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters, out = byte_letters(), [b""] * (max(vocabulary.values()) + 1)
        for entry, token in vocabulary.items():
            out[token] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        return out

    def __call__(self, texts: list[str]) -> list[Sequence[int]]:
        if self.encoding is not None:
            return [self.encoding.encode_to_numpy(f" {text}", disallowed_special=()) for text in texts]
        return [found.ids for found in self.tokenizer.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """Encodes by a sentencepiece model, which puts a space before the text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    @staticmethod
    def entries(path: str) -> list[bytes]:
        model = Pieces(path).model
        return [bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
                for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of ids that can end together, as sorted numbers a << 32 | b: one token's bytes end with the other's."""
    def by_bytes(entries: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, entry in enumerate(entries):
            if entry:
                out.setdefault(entry, []).append(i)
        return out

    ids_a, ids_b = by_bytes(a), by_bytes(b)
    pairs = [x << 32 | y for entry, ys in ids_b.items() for k in range(len(entry)) for x in ids_a.get(entry[k:], ()) for y in ys]
    pairs += [x << 32 | y for entry, xs in ids_a.items() for k in range(1, len(entry)) for y in ids_b.get(entry[k:], ())
              for x in xs]
    return np.unique(np.array(pairs, np.int64))


@dataclass
class Aligned:
    """A text without tokens has no ids and no groups."""

    a: np.ndarray
    b: np.ndarray
    cuts_a: list[int]  # past the last A token of each group
    cuts_b: list[int]


class Aligner:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.bytes_a, self.bytes_b = ByteLevel.entries(path_a), Pieces.entries(path_b)
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.pairs = linkable(self.bytes_a, self.bytes_b)
        self.names = np.array(list(map(str, range(max(len(self.bytes_a), len(self.bytes_b))))), object)

    def align(self, texts: list[str]) -> list[Aligned]:
        return [self._aligned(*row) for row in zip(texts, self.a(texts), self.b(texts))]

    def _aligned(self, text: str, a: Sequence[int], b: Sequence[int]) -> Aligned:
        whole = f" {text}".encode()
        ids_a, ids_b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        # The faster library only cuts bytes apart, so A's bytes are the text's if they are as many.
        if (not text or not len(ids_a) or not len(ids_b) or ends_a[-1] != len(whole) or ends_b[-1] != len(whole)
                or b"".join(map(self.bytes_b.__getitem__, b)) != whole
                or self.a.encoding is None and b"".join(map(self.bytes_a.__getitem__, a)) != whole):
            return Aligned(ids_a[:0], ids_b[:0], [], [])
        at_a = dict(zip(ends_a.tolist(), range(1, len(ids_a) + 1)))
        at_b = dict(zip(ends_b.tolist(), range(1, len(ids_b) + 1)))
        shared = sorted(at_a.keys() & at_b.keys())
        return Aligned(ids_a, ids_b, list(map(at_a.__getitem__, shared)), list(map(at_b.__getitem__, shared)))

    def links(self, found: Aligned) -> np.ndarray:
        """The numbers of the linked pairs of a text: of each slice the A and B token that end with it."""
        if not found.cuts_a:
            return np.zeros(0, "<i4")
        pairs = found.a[np.array(found.cuts_a) - 1] << 32 | found.b[np.array(found.cuts_b) - 1]
        return np.searchsorted(self.pairs, pairs).astype("<i4")

    def digest(self, found: Aligned) -> str:
        """The SHA-256 of the groups, written as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        if not found.cuts_a:
            return ""
        hashed, low_a, low_b = hashlib.sha256(), 0, 0
        a, b = self.names[found.a].tolist(), self.names[found.b].tolist()
        for at in range(0, len(found.cuts_a), SLICES):
            groups = []
            for high_a, high_b in zip(found.cuts_a[at:at + SLICES], found.cuts_b[at:at + SLICES]):
                left = a[low_a] if high_a == low_a + 1 else ",".join(a[low_a:high_a])
                right = b[low_b] if high_b == low_b + 1 else ",".join(b[low_b:high_b])
                groups.append(f"{left}|{right}")
                low_a, low_b = high_a, high_b
            hashed.update((";" * (at > 0) + ";".join(groups)).encode())
        return hashed.hexdigest()


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of each row; links are pair numbers, as little-endian 32-bit bytes."""
    schema = arrow_schema(FIRST)

    def described(rows: list[tuple], aligner: Aligner) -> Iterator[tuple]:
        for (doc_id, _), found in zip(rows, aligner.align([text or "" for _, text in rows])):
            yield (doc_id, len(found.a), len(found.b), len(found.cuts_a), aligner.digest(found), aligner.links(found).tobytes())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept("aligner", (path_a, path_b), lambda: Aligner(path_a, path_b))
        return batched((out for batch in batches for rows in portions(rows_of(batch, "doc_id", "text"))
                        for out in described(rows, aligner)), schema)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        apply, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary")


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(pair, n): how many links hold each pair that occurs. A task adds its texts up in one array of all `size` pairs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = b"".join(batch.column("links").to_pylist())
            if held:
                total += np.bincount(np.frombuffer(held, "<i4"), minlength=size)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def described(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    `docs` needs doc_id and text; other columns are not read. A null or empty text, or one that a vocabulary does not give back byte
    by byte, has no tokens: zeros and ''. Rows that repeat are each described, and count each. An empty table gives no rows.
    A link is best if no other pair of its B id is linked more often in all texts.
    """
    spark = docs.sparkSession
    aligned = committed(align(docs, path_a, path_b), "aligned")
    pairs = linkable(ByteLevel.entries(path_a), Pieces.entries(path_b))
    # At most one row for each pair of the vocabularies.
    counts = np.zeros(len(pairs), np.int64)
    for row in pair_counts(aligned, len(pairs)).collect():
        counts[row.pair] = row.n
    of_b = pairs & 0xFFFFFFFF
    best = np.zeros(int(of_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, of_b, counts)
    held = spark.sparkContext.broadcast((counts, counts == best[of_b]))
    schema = arrow_schema(LAST)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, is_best = held.value

        def one(doc_id, n_a, n_b, n_groups, digest, links) -> tuple:
            link = np.frombuffer(links, "<i4")
            return doc_id, n_a, n_b, n_groups, len(link), int(is_best[link].sum()), int(counts[link].sum()), digest
        return batched((one(*row) for batch in batches for row in rows_of(batch, *FIRST)), schema)

    return aligned.mapInArrow(apply, ", ".join(f"{name} {'string' if kind == pa.string() else 'bigint'}"
                                               for name, kind in LAST.items())).select(*LAST)
