"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Two texts link when the Jaccard similarity of their shingle sets is at least
num / den. Tokens (shingle hashes) stand in one global order, rare ones first;
texts that link share a token among the first n - ceil(n * num / den) + 1 of
either (the prefix). Documents with equal sets are one node. Nodes with equal
prefixes and size are one group; groups meet in the posting lists of their
prefix tokens, pairs that size and positions rule out are dropped, and the
members of the remaining group pairs are verified on their whole sets.

Posting lists are compared as in panelforge.llm.posting: with central groups
first, then across components only, by token and size class. The result has all
links between different components, so components are exact.

The order of tokens uses document frequencies, counted over all texts in
COUNT_BUCKETS hashed counters; any order gives the same links, this one keeps
posting lists short.

Edge cases: null and empty texts, and texts of white space, have no shingle and
link with nothing; fewer words than a shingle make one shingle of all; ties are
broken by hash, so reruns agree; repeated rows are copies of one another (rows
with one id and different texts are told apart by their texts); null ids count
as smaller than any other; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table
from .posting import list_components, size_passes
from .shingles import overlap, shingle_set

COUNT_BUCKETS = 1 << 20
_SLICE = 1 << 16
CELLS = 64
NULL_ID = -(2**63)


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)  # 20 bits


def bucket_counts(rows: DataFrame, tokens_of: Callable[[Any], np.ndarray]) -> np.ndarray:
    """How many values of the only column of rows have a token of each bucket; COUNT_BUCKETS numbers, whatever the input."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        some = False
        for batch in batches:
            some = True
            for value in batch.column(0).to_pylist():
                np.add.at(total, bucket_of(tokens_of(value)), 1)
        if some:
            yield from _slices(total)

    def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(COUNT_BUCKETS // _SLICE):
            part = np.minimum(total[k * _SLICE : (k + 1) * _SLICE], 2**32 - 1).astype(np.uint32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, dtype=np.uint32).astype(np.int64)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(part, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["slice", "counts"])

    parts = rows.mapInArrow(count, "slice int, counts binary")
    sums = parts.repartition(min(COUNT_BUCKETS // _SLICE, partitions(spark)), "slice").mapInArrow(add, "slice int, counts binary").collect()
    counts = np.zeros(COUNT_BUCKETS, dtype=np.uint32)
    for row in sums:
        counts[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], dtype=np.uint32)
    return counts


def _cells(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of CELLS cells: a bound of overlaps (255 stands for 255 or more)."""
    return np.minimum(np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart (128 bits)."""
    a = int(np.bitwise_xor.reduce(tokens * np.uint64(0xD6E8FEB86659FD93) ^ (tokens >> np.uint64(29))))
    b = int(np.add.reduce(tokens ^ (tokens >> np.uint64(17))))
    return tuple(v - 2**64 if v >= 2**63 else v for v in (a, b))


def profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, hash, size, k1, k2, prefix, cells) of every row of docs; hash is that of the text, the keys are null without shingles."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(bucket_counts(docs.select("text").where("text is not null"), lambda text: shingle_set(text, n)))  # COUNT_BUCKETS * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for batch in batches:
            sizes, first, second, prefixes, cells = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, n)
                size = len(tokens)
                sizes.append(size)
                if not size:
                    first.append(None)
                    second.append(None)
                    prefixes.append(None)
                    cells.append(None)
                    continue
                k1, k2 = set_keys(tokens)
                length = size - -(-num * size // den) + 1
                order = np.lexsort((tokens, frequency[bucket_of(tokens)]))[:length]
                first.append(k1)
                second.append(k2)
                prefixes.append(_signed(tokens[order]))
                cells.append(_cells(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
                names=["id", "hash", "size", "k1", "k2", "prefix", "cells"],
            )

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    return stored(docs.select(ids, "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "id long, hash long, size long, k1 long, k2 long, prefix array<long>, cells binary"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: first by their cells, then by their whole sets."""
    cells = nodes.select("node", "size", "cells")
    left = cells.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("cells").alias("cells_a"))
    right = cells.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("cells").alias("cells_b"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, CELLS) for k in (4, 5))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            # 255 in a cell of both is no bound
            keep = ((num + den) * most >= num * total) | ((x == 255) & (y == 255)).any(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    near = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "cells_a", "cells_b")
    return confirmed(stored(near.mapInArrow(bounded, "a long, b long")), nodes, docs, n, num, den)


def confirmed(near: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link; the sets are made anew from the text of one document of each node that is left."""
    left_over = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    owners = left_over.join(nodes.select("node", F.col("owner").alias("_id"), F.col("owner_hash").alias("_hash")), "node")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_hash"), "text").where("text is not null")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_, found = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingle_set(text, n)
                if len(tokens) and set_keys(tokens)[0] == node:
                    nodes_.append(node)
                    found.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array(found, pa.binary())], names=["node", "tokens"])

    made = stored(texts.join(owners, ["_id", "_hash"]).select("node", "text").mapInArrow(sets, "node long, tokens binary").dropDuplicates(["node"]))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = overlap(a, b)
                keep.append(den * common >= num * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    both = near.join(made.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = both.join(made.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    return stored(both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(linked, "a long, b long"))


def _passes(x: str, y: str, num: int, den: int) -> Column:
    """Size and position filter for posting rows x and y at a token that both have (exact at their first one)."""
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
    return size_passes(x, y, num, den) & ((num + den) * rest >= num * (F.col(f"{x}.size") + F.col(f"{y}.size")))


def node_components(profile: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (distinct sets), and (node, label) of those that link with another."""
    nodes = stored(
        profile.where("size > 0")
        .groupBy("k1", "k2", "size")
        .agg(F.min(F.struct("id", "hash")).alias("owner"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells"))
        .select(F.col("k1").alias("node"), "size", F.col("owner.id").alias("owner"), F.col("owner.hash").alias("owner_hash"), "prefix", "cells")
    )
    # Groups: nodes with equal prefix and size.
    grouped = nodes.groupBy("size", "prefix").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("_members"))
    groups = stored(grouped)
    crowded = groups.where("_members > 1").select("size", "prefix", "group")
    members = stored(nodes.join(crowded, ["size", "prefix"]).select("node", "group"))

    posting = groups.select("group", "size", F.posexplode("prefix").alias("pos", "token"))
    shared = posting.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("token")
    lists = stored(posting.join(shared, "token"))
    labels = list_components(lists, members, lambda pairs: verified(pairs, nodes, docs, n, num, den), lambda x, y: _passes(x, y, num, den), num, den)
    return nodes, labels


def document_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: links are Jaccard similarities of n-word shingle sets of num / den or more."""
    profile = profiles(docs, n, num, den)
    nodes, labels = node_components(profile, docs, n, num, den)
    named = nodes.join(labels, "node", "left").select("node", "owner", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("owner").alias("component_id"))
    of_node = stored(named.join(smallest, "label").select("node", "component_id"))
    rows = profile.select("id", "size", F.col("k1").alias("node"))
    joined = rows.join(of_node, "node", "left").select("id", "size", F.coalesce("component_id", "id").alias("component_id"))
    as_null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return joined.select(as_null("id").alias("doc_id"), F.col("size").alias("n_shingles"), as_null("component_id").alias("component_id"))


def without_near_copies(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, and of its texts one.

    Rows are told apart by id and text, so different texts with null or equal ids
    stay; texts without shingles link with nothing; repeated rows (id and text)
    are one.
    """
    profile = profiles(docs, n, num, den)
    nodes, labels = node_components(profile, docs, n, num, den)
    named = nodes.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), F.struct(F.col("owner").alias("_id"), F.col("node"), F.col("owner_hash").alias("_hash")).alias("row"))
    chosen = named.groupBy("label").agg(F.min("row").alias("row")).select("row._id", "row._hash")
    bare = profile.where("size = 0").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    kept = chosen.unionByName(bare).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_hash"))
    once = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row"))
    return keyed.join(kept, ["_id", "_hash"]).withColumn("_number", F.row_number().over(once)).where("_number = 1").select("_row.*")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_components(table(spark, sf_dir, "documents"), 3, 90, 100)
