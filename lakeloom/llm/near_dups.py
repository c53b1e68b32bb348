"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set of shingles of five words. Each shingle owns a region as wide as its weight; darts with hashed positions fall on
that region at random ranks, the same for every document that holds it. Of the darts below a rank that leaves few
coordinates empty, the earliest of each coordinate makes the signature. Two signatures agree on a coordinate with the probability
of the (weighted) Jaccard similarity, and a signature costs about k log k darts whatever the document's size.

Documents that agree on all rows of a band meet in a bucket. Equal texts are one node first. A bucket links each of its nodes
to its first one only, and only links that reach the similarity exactly count. Where that leaves a bucket with several
components, its remaining pairs across components are checked, so that no component lacks a link between different texts;
large buckets do that block by block inside tasks, which give only links that join components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import (
    WordHashes, carried, components, kept, map_rows, may_hold, mixed, ngrams, restored, text_key, words_of)
from lakeloom.operators.dedupe import keep_first
from lakeloom.sources.lake import committed

SHINGLE = 5
BANDS, ROWS = 30, 6
SLOTS = BANDS * ROWS
# Nodes of a bucket whose pairs are listed outright; larger buckets are compared by blocks of so many.
SMALL, BLOCK = 48, 1024
SIGNED = {"doc_id": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "node": pa.int64(), "size": pa.int64(), "bands": pa.list_(pa.int64())}


def cells(words: np.ndarray, weights: str) -> np.ndarray:
    """The unit cells of a document's regions: its different shingles (`set`), or each as wide as its count (`count`)."""
    distinct, counts = np.unique(ngrams(words, SHINGLE), return_counts=True)
    if weights == "set":
        return distinct
    repeated = np.repeat(distinct, counts)
    nth = np.arange(len(repeated)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(nth == 0, repeated, mixed(repeated + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def signature(own: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The earliest dart of each coordinate, as its hash.

    The darts on a cell arrive in order of rank with exponential gaps, hashed from the cell and the dart's number. Darts up to rank
    `limit` are thrown; if a coordinate got none, the limit is doubled, which never changes an earlier dart.
    """
    limit = slots * (math.log(slots) + 2) / len(own)
    while True:
        number = max(2, math.ceil(limit + 5 * math.sqrt(limit) + 4))
        values, ranks, thrown = [], [], own
        base = np.zeros(len(own))
        start = 0
        while len(thrown):
            dart = np.arange(start, start + number, dtype=np.uint64)
            hashed = mixed(thrown[:, None] + mixed(dart)[None, :])
            gaps = -np.log(((hashed >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53)
            rank = base[:, None] + np.cumsum(gaps, axis=1)
            below = rank <= limit
            values.append(hashed[below]), ranks.append(rank[below])
            more = below[:, -1]
            thrown, base, start = thrown[more], rank[more, -1], start + number
        value, rank = mixed(np.concatenate(values)), np.concatenate(ranks)
        slot = ((value >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        order = np.lexsort((rank, slot))
        filled, first = np.unique(slot[order], return_index=True)
        if len(filled) == slots:
            return value[order][first]
        limit *= 2


def bands_of(signed: np.ndarray) -> list[int]:
    """A hash of each band's rows, with the band's number."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in signed.reshape(BANDS, ROWS).T:
        key = mixed(key ^ row)
    return key.view(np.int64).tolist()


def sign(docs: DataFrame, weights: str) -> DataFrame:
    """(doc_id, t1, t2, node, size, bands) of each row; t1 and t2 are hashes of its text, node of its words, null if it has none."""
    def start():
        hashes = kept("hashes", None, WordHashes)

        def one(row: tuple) -> Iterator[tuple]:
            *key, text = row
            words = hashes.of(words_of(text))
            if not len(words):
                yield *key, None, 0, []
                return
            own = cells(words, weights)
            yield *key, node_of(words), len(own), bands_of(signature(own))
        return one

    return map_rows(docs.select("doc_id", *text_key(), "text"), ["doc_id", "t1", "t2", "text"], start, SIGNED)


def node_of(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def contents(docs: DataFrame, nodes: DataFrame, weights: str) -> DataFrame:
    """(node, cells) of the nodes (node, doc_id): the sorted cells of each, as bytes."""
    def start():
        hashes = kept("hashes", None, WordHashes)

        def one(row: tuple) -> Iterator[tuple]:
            words = hashes.of(words_of(row[0]))
            if len(words):
                yield node_of(words), np.sort(cells(words, weights) >> np.uint64(24)).astype("<u8").view("u1").reshape(
                    -1, 8)[:, :5].tobytes()
        return one

    held, _ = may_hold(docs.select("doc_id", "text"), nodes.select("doc_id"))
    found = map_rows(held, ["text"], start, {"node": pa.int64(), "cells": pa.binary()}, size=500)
    return committed(found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")


def similar(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is `threshold` or more, exactly."""
    def start():
        def one(row: tuple) -> Iterator[tuple]:
            a, b, left, right = row
            if similarity(left, right) >= threshold:
                yield a, b
        return one

    joined = pairs.join(held.select(F.col("node").alias("b"), F.col("cells").alias("right")), "b").join(
        held.select(F.col("node").alias("a"), F.col("cells").alias("left")), "a")
    # Sizes alone rule out many pairs before any of them reaches Python.
    short, long = F.least(F.length("left"), F.length("right")), F.greatest(F.length("left"), F.length("right"))
    return map_rows(joined.filter(short >= threshold * long), ["a", "b", "left", "right"], start,
                    {"a": pa.int64(), "b": pa.int64()})


def similarity(left: bytes, right: bytes) -> float:
    """Jaccard similarity of two sets of 5-byte hashes."""
    def numbers(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        return out.view("<u8")[:, 0]

    both = np.sort(np.concatenate([numbers(left), numbers(right)]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def listed(unlinked: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of a small bucket (key, node, component, n) that are not in a component."""
    few = unlinked.filter(F.col("n") <= SMALL).select("key", "node", "component")
    other = few.select("key", F.col("node").alias("b"), F.col("component").alias("c"))
    return few.join(other, "key").filter("node < b AND component <> c").select(F.col("node").alias("a"), "b").distinct()


def across(unlinked: DataFrame, signed: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of large buckets (key, band, node, component, n).

    Every node goes to the blocks of its bucket, and pairs of blocks are compared inside tasks, a pair of nodes in the first band it shares
    only: it is in one bucket there, and in another one of each later band it shares. Such a pair is checked exactly, unless
    sizes rule it out or links found already connect it; so a task gives no more links than it has nodes.
    """
    many = unlinked.filter(F.col("n") > SMALL)
    nodes = many.select("node").distinct()
    facts = signed.select("node", "bands").join(nodes, "node", "left_semi").dropDuplicates(["node"]).join(held, "node")
    many = many.join(facts, "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "band", "node",
                       "component", "bands", "cells")

    def compare(table: pa.Table) -> pa.Table:
        own, low = table["own"].to_numpy(), table["low"][0].as_py()
        node, component, band = table["node"].to_numpy(), table["component"].to_pylist(), table["band"][0].as_py()
        bands = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), BANDS)
        contents_of = table["cells"].to_pylist()
        size = np.array([len(c) for c in contents_of])
        first = np.flatnonzero(own == low)
        second = first if table["high"][0].as_py() == low else np.flatnonzero(own != low)
        root = {c: c for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out_a, out_b = [], []
        for i in first:
            others = second[node[second] > node[i]] if second is first else second
            same = bands[others] == bands[i]
            near = same.argmax(axis=1) == band
            near &= np.minimum(size[others], size[i]) >= threshold * np.maximum(size[others], size[i])
            for j in others[near][np.argsort(-same[near].sum(axis=1), kind="stable")]:
                x, y = find(component[i]), find(component[j])
                if x != y and similarity(contents_of[i], contents_of[j]) >= threshold:
                    root[x] = y
                    out_a.append(min(node[i], node[j])), out_b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return many.groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def linked(docs: DataFrame, threshold: float, weights: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (node, doc_id, component) of each different text, doc_id the smallest that has it."""
    signed = committed(sign(docs, weights), "signatures")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    bands = signed.select("node", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    buckets = committed(bands.join(shared, "key").select("key", "band", "node", "low").distinct(), "buckets")
    held = contents(docs, nodes.join(buckets.select("node").distinct(), "node", "left_semi"), weights)
    edges = committed(similar(centred(buckets, "low"), held, threshold), "links")
    member = components(edges, "components")
    named = buckets.join(member, "node", "left").select(
        "key", "band", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    unlinked = committed(named.join(sizes.filter("x <> y").select("key", "n"), "key"), "unlinked")
    edges = committed(edges.union(similar(listed(unlinked), held, threshold)).union(
        across(unlinked, signed.filter("node IS NOT NULL"), held, threshold)), "links")
    member = components(edges, "components")
    return signed, nodes.join(member, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))


def classes(docs: DataFrame, threshold: float = 0.8, weights: str = "set") -> DataFrame:
    """(doc_id, class_id) of each row: the smallest doc_id of all documents that links of at least `threshold` connect.

    Similarity is that of the sets of five-word shingles, in lower case and without punctuation; with `weights="count"` a
    shingle weighs as often as it occurs. A text of fewer than five words is one shingle; one without words, so also a null
    or empty one, is a class by itself. Rows that repeat are in one class. Classes are of texts: rows with one doc_id, or none, but
    different texts are in the classes of their texts, whose id is null if no text of it has an id. A link
    of similarity 0.8 is found with probability 0.9999.
    """
    signed, placed = linked(docs, threshold, weights)
    heads = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    class_of = placed.join(heads, "component").select("node", "class_id")
    return signed.select("doc_id", "node").join(class_of, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def centred(buckets: DataFrame, centre: str) -> DataFrame:
    """The pairs of each node and the centre of its bucket."""
    return buckets.filter(F.col("node") != F.col(centre)).select(
        F.least("node", centre).alias("a"), F.greatest("node", centre).alias("b")).distinct()


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, in their columns, that are the first of their class: the smallest doc_id, rows without one last.

    Rows are told apart by doc_id and text, so no row goes because another shares its id, or has none either. Of rows equal in both
    the first by their other columns stays. Rows without words, also null and empty texts, are no copies of each other.
    """
    signed, placed = linked(docs, threshold, "set")
    key = ["doc_id", "t1", "t2"]
    order = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    rows = signed.filter("node IS NOT NULL").join(placed.select("node", "component"), "node").select("component", *key)
    heads = rows.groupBy("component").agg(F.min(order).alias("head"))
    gone = committed(rows.join(heads, "component").filter(order != F.col("head")).select(*key).distinct(), "copies")
    repeated = signed.groupBy(*key).count().filter("count > 1").select("doc_id")
    touched, same = may_hold(carried(docs), gone.select("doc_id").union(repeated))
    named = touched.withColumns({f"_{name}": F.col(name) if name == "doc_id" else value
                                 for name, value in zip(key, (F.col("doc_id"), *text_key()))})
    others = gone.select(*[F.col(name).alias(f"_gone_{name}") for name in key])
    is_gone = F.lit(True)
    for name in key:
        is_gone = is_gone & F.col(f"_{name}").eqNullSafe(F.col(f"_gone_{name}"))
    rest = [F.col(f"_row.`{name}`").cast("string") for name in docs.columns if name not in ("doc_id", "text")]
    left = keep_first(named.join(others, is_gone, "left_anti"), [f"_{name}" for name in key], rest or [F.lit(0)])
    return restored(left, docs.columns).unionByName(restored(same, docs.columns))
