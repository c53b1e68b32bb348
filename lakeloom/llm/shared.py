"""Small helpers the operators share: typed column access, hashing of word sequences, batches, connected components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.lake import committed

WORD = re.compile(r"\w+")

# Bytes that a Python worker keeps of words it has met. A full cache is emptied and filled anew.
CACHED_BYTES = 48 << 20
ENTRY_BYTES = 160  # of one word in a dictionary, beside its letters

# Bytes of rows that go to Spark in one batch, about.
BATCH_BYTES = 16 << 20

# Values of a hash that a filter may broadcast: the proven bound of its size.
FILTER_VALUES = 1 << 20


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo `divisor`; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_key() -> list[Column]:
    """128 bits that stand for a text, as t1 and t2: with doc_id they name a row, also where ids repeat or are missing."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row) of each row, `_row` all its columns: whatever others are called, they meet no name used on the way."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"))


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that `carried` took along, in their columns."""
    return rows.select(*[F.col(f"_row.`{name}`").alias(name) for name in columns])


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text, punctuation left out."""
    return WORD.findall(text.lower()) if text else []


class ByteBound:
    """Whether the words a cache keeps fit in `limit` bytes. Those of one text are always let in."""

    def __init__(self, limit: int | None = None):
        self.limit = CACHED_BYTES if limit is None else limit
        self.restart()

    def restart(self) -> None:
        self.used = 0

    def holds(self, new: list[str]) -> bool:
        size = ENTRY_BYTES * len(new) + 4 * sum(map(len, new))
        if self.used and self.used + size > self.limit:
            return False
        self.used += size
        return True


class WordHashes(dict):
    """word -> 64-bit hash; the same in every process, unlike Python's own. What is kept is bounded by bytes."""

    used = 0

    def __missing__(self, word: str) -> int:
        self.used += ENTRY_BYTES + 4 * len(word)
        if self.used > CACHED_BYTES:
            self.clear()
            self.used = 0
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        values = values + np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words; of all the words, if there are fewer than n; none for no words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mixed(out ^ hashes[k:k + size]) + np.uint64(k + 1)
    return out


_kept: list[tuple[tuple[str, object], object]] = []


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """What `make` gives, kept by this Python worker for its next tasks. Only the last one asked for is kept: a worker serves
    many stages, and what earlier ones needed must not add up."""
    if not _kept or _kept[0][0] != (kind, key):
        _kept.clear()
        _kept.append(((kind, key), make()))
    return _kept[0][1]


def rows_of(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(name).to_pylist() for name in columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `size` rows, and of few long ones."""
    held: list[tuple] = []
    taken = 0
    for row in rows:
        held.append(row)
        taken += sum(8 * len(value) if isinstance(value, list) else len(value) for value in row if hasattr(value, "__len__"))
        if len(held) == size or taken > BATCH_BYTES:
            yield _batch(held, schema)
            held, taken = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def portions(rows: Iterator[tuple], text: int = 1, chars: int = 1 << 18) -> Iterator[list[tuple]]:
    """Rows together up to about `chars` characters of the text at index `text`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def arrow_schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))


_SPARK_NAMES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double",
                pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>",
                pa.list_(pa.int32()): "array<int>",
                pa.list_(pa.float64()): "array<double>", pa.list_(pa.string()): "array<string>"}


def map_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[[tuple], Iterator[tuple]]],
             out: dict[str, pa.DataType], size: int = 2000) -> DataFrame:
    """Apply a Python function to each row and get any number of rows for it.

    `start` runs once in each task and returns the function; the named columns are the tuple it gets. Only those columns
    reach Python, in Arrow batches of bounded size, and no row waits for another.
    """
    schema = arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        rows = (made for batch in batches for row in rows_of(batch, *columns) for made in function(row))
        return batched(rows, schema, size)

    bounded_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(apply, ", ".join(f"`{k}` {_SPARK_NAMES[v]}" for k, v in out.items()))


def bounded_batches(spark: SparkSession) -> None:
    """Few rows and few bytes a batch between the JVM and Python, as one text can have any length. These are settings of the
    session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def may_hold(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id may be among `ids`, and the rest.

    What is broadcast are hash values of the ids, of which there are `FILTER_VALUES` at most. It saves shuffling texts that
    nothing is joined to; with very many ids it lets more through, and at worst all.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_VALUES))
    slots = F.broadcast(ids.select(slot.alias("_slot")).distinct())
    marked = docs.withColumn("_slot", slot)
    return (marked.join(slots, "_slot", "left_semi").drop("_slot"), marked.join(slots, "_slot", "left_anti").drop("_slot"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); the component is its smallest node.

    Alternates large-star and small-star steps: each links the larger neighbours, then the smaller ones, of every node to
    the smallest node it knows, until nothing changes. The number of rounds grows with the logarithm of the longest path.
    Every round is a written table, so that lost executors cost one round at most. The neighbours of a node are only
    ever aggregated or joined, never gathered, so that a hub with any number of links is split like any hot join key.
    """
    current = committed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), label)
    size = state(current)
    while size[0]:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")).distinct()
        large = committed(large.filter("a <> b"), label)
        # Now each b has smaller neighbours a only: link them, and b, to the smallest.
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(smallest, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b"))
        current = committed(small.filter("a <> b").distinct(), label)
        before, size = size, state(current)
        if before == size:
            break
    members = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def state(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal for equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
