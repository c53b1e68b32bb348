"""Exact top-k search by inner product over norm buckets.

Vectors are dealt to buckets by length, longest first. A query with k results of score t or more so far needs no vector that is
shorter than t / |q|, and in a bucket of vectors no longer than l only those whose cosine with the query reaches
t / (|q| l). Each bucket chooses, query by query: nothing at all where that local threshold is over 1; pruning by coordinates
where it is high (a vector within the angle of the query has every coordinate within that angle too, so the query's largest
coordinates select ranges of sorted columns); and otherwise pruning by length. What is left is verified with exact products.

Queries are taken in blocks of bounded size, each against all buckets at once; a task keeps only the k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import arrow_schema, batched, bounded_batches
from lakeloom.sources.lake import committed

HIT = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
EXACT = float(1 << 53)
SLACK = 1e-9


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, values, norm): floor(scale * x) of each component, as doubles that are whole numbers, and the length.

    Rows without an id, and vectors that are null or hold a null or a component that is not finite, take no part.
    """
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    held = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("values"))
    return held.withColumn("norm", F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)))


def matrix(rows: list, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers. Products beyond those raise an error."""
    limit = np.sqrt((queries ** 2).sum(1).max(initial=0) * (vectors ** 2).sum(1).max(initial=0))
    if limit < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(q, v)) for v in vectors] for q in queries]
    return np.array(whole, dtype=np.int64).reshape(len(queries), len(vectors))


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[query]
        if keep.sum() > self.k:
            # Only scores that reach the k-th best can enter; all ties of it are looked at.
            bound = np.partition(scores[keep], -self.k)[-self.k]
            keep &= scores >= bound
        if keep.any():
            merged = self.held[query] + [(-int(s), int(i)) for s, i in zip(scores[keep], ids[keep])]
            self.held[query] = sorted(merged)[:self.k]
            if len(self.held[query]) == self.k:
                self.floor[query] = max(self.floor[query], -self.held[query][-1][0])


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, norms: np.ndarray):
        self.ids, self.values, self.norms = ids, values, norms
        self.units = values / np.where(norms > 0, norms, 1.0)[:, None]
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted coordinate and the rows in its order, made when first asked for."""
        if at not in self.orders:
            order = np.argsort(self.units[:, at])
            self.orders[at] = order, self.units[order, at]
        return self.orders[at]

    def by_coordinates(self, unit: np.ndarray, cosine: float, focus: int) -> np.ndarray:
        """The rows whose coordinates lie within the angle of `cosine` around the unit query, on its largest coordinates."""
        angle = np.arccos(min(1.0, cosine))
        chosen = np.argsort(-np.abs(unit))[:focus]
        ranges = []
        for at in chosen:
            own = np.arccos(np.clip(unit[at], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - SLACK, np.cos(max(0.0, own - angle)) + SLACK
            order, column = self.column(int(at))
            start, stop = np.searchsorted(column, low, "left"), np.searchsorted(column, high, "right")
            ranges.append((stop - start, at, low, high, order[start:stop]))
        _, first, _, _, rows = min(ranges, key=lambda r: r[0])
        for _, at, low, high, _ in ranges:
            if at != first:
                column = self.units[rows, at]
                rows = rows[(column >= low) & (column <= high)]
        return rows


def search_bucket(bucket: Bucket, ids: np.ndarray, values: np.ndarray, norms: np.ndarray, best: Best,
                  high: float, focus: int) -> None:
    """Bring the block of queries (ids, values, norms) up to date with one bucket."""
    longest = bucket.norms[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(best.floor > 0, best.floor / (norms * longest), -1.0)
    local = np.where(np.isnan(local), np.inf, local)
    by_length = []
    for q in np.flatnonzero(local <= 1 + SLACK):
        if local[q] >= high:
            rows = bucket.by_coordinates(values[q] / norms[q], local[q] - SLACK, focus)
            rows = rows[bucket.norms[rows] * norms[q] >= best.floor[q] - SLACK * abs(best.floor[q])]
            rows = rows[bucket.ids[rows] != ids[q]]
            if len(rows):
                best.add(q, products(values[q:q + 1], bucket.values[rows])[0], bucket.ids[rows])
        else:
            by_length.append(q)
    for start in range(0, len(by_length), 256):
        chunk = np.array(by_length[start:start + 256])
        need = np.where(best.floor[chunk] > 0, best.floor[chunk] * (1 - SLACK) / np.maximum(norms[chunk], SLACK), -1.0)
        # Lengths fall along the bucket, so each query needs a prefix of it; the chunk takes the longest of these.
        ends = np.searchsorted(-bucket.norms, -need, "right")
        scores = products(values[chunk], bucket.values[:ends.max(initial=0)])
        for row, q in enumerate(chunk):
            own = bucket.ids[:ends[row]] != ids[q]
            best.add(q, scores[row, :ends[row]][own], bucket.ids[:ends[row]][own])


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bucket_rows: int = 4096,
           block_bytes: int = 16 << 20, seed_rows: int = 2048, high: float = 0.5, focus: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with the other rows.

    `vectors` are (vec_id, embedding); other columns are not read. Ties go to the smaller vec_id. A query has fewer results only if there
    are fewer other rows; vectors of unequal size are compared as if filled with zeros. Rows whose vec_id repeats are
    each candidates of other queries, but one query and no candidate of their own. Scores beyond 64 bits raise an error.

    `block_bytes` bounds the queries handled at a time, `seed_rows` the longest vectors whose products with the queries
    give the thresholds to start from; both reach the driver.
    """
    spark = vectors.sparkSession
    held = quantised(vectors, scale)
    total = held.count()
    parts = max(1, -(-total // bucket_rows))
    ranged = held.repartitionByRange(parts, F.col("norm").desc(), F.col("vec_id"))
    ranged = committed(ranged.sortWithinPartitions(F.col("norm").desc(), "vec_id"), "norm-buckets")
    dims = ranged.agg(F.max(F.size("values"))).first()[0] or 0
    asked = committed(ranged.filter(is_query).dropDuplicates(["vec_id"]).withColumn(
        "_order", F.xxhash64("vec_id")), "queries")
    count = asked.count()
    block_rows = max(1, block_bytes // (8 * max(1, dims)))
    blocks = max(1, -(-count // block_rows))
    seeds = ranged.orderBy(F.col("norm").desc(), "vec_id").limit(seed_rows).select("vec_id", "values").collect()
    seed_ids, seed_values = np.array([r.vec_id for r in seeds], np.int64), matrix([r["values"] for r in seeds], dims)
    bounded_batches(spark)
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.col("_order"), F.lit(blocks)) == block).select("vec_id", "values", "norm").collect()
        ids = np.array([r.vec_id for r in rows], np.int64)
        values, norms = matrix([r["values"] for r in rows], dims), np.array([r.norm for r in rows], np.float64)
        start = thresholds(ids, values, seed_ids, seed_values, k)
        sent = spark.sparkContext.broadcast((ids, values, norms, start))
        hits = ranged.select("vec_id", "values", "norm").mapInArrow(
            searcher(sent, k, bucket_rows, high, focus), "query_id bigint, vec_id bigint, score bigint")
        found = hits if found is None else found.union(hits)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def thresholds(ids: np.ndarray, values: np.ndarray, seed_ids: np.ndarray, seed_values: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best result reaches at least, from the seeds; the least number if unknown."""
    best = Best(len(ids), k, np.full(len(ids), -np.inf))
    for at in range(0, len(ids), 256):
        scores = products(values[at:at + 256], seed_values)
        for row, q in enumerate(range(at, min(at + 256, len(ids)))):
            own = seed_ids != ids[q]
            best.add(q, scores[row][own], seed_ids[own])
    return best.floor


def searcher(sent, k: int, bucket_rows: int, high: float, focus: int):
    schema = arrow_schema(HIT)

    def search_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, norms, start = sent.value
        best = Best(len(ids), k, start.copy())
        held: list[tuple] = []

        def flush() -> None:
            if held and len(ids):
                held.sort(key=lambda r: -r[2])
                bucket = Bucket(np.array([r[0] for r in held], np.int64), matrix([r[1] for r in held], values.shape[1]),
                                np.array([r[2] for r in held], np.float64))
                search_bucket(bucket, ids, values, norms, best, high, focus)
            held.clear()

        for batch in batches:
            held.extend(zip(batch.column("vec_id").to_pylist(), batch.column("values").to_pylist(),
                            batch.column("norm").to_pylist()))
            if len(held) >= bucket_rows:
                flush()
        flush()
        rows = ((int(ids[q]), i, -s) for q, kept in enumerate(best.held) for s, i in kept)
        return batched(rows, schema, 10_000)

    return search_part


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM usable),
queries AS (SELECT DISTINCT ON (vec_id) rid, vec_id FROM usable WHERE vec_id % 50 = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.rid, sum(a.x * b.x)::BIGINT AS score
  FROM queries q JOIN parts a ON a.rid = q.rid JOIN parts b ON a.d = b.d JOIN usable c ON c.rid = b.rid
  WHERE c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id, c.rid),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
           FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
