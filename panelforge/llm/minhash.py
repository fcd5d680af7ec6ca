"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

A text's signature has COORDINATES minima of hash functions over its shingles.
Two texts of Jaccard similarity J agree in a coordinate with probability J; those
that agree in at least MATCHES coordinates are compared on their whole sets. At
J = 0.8 and the defaults (64 and 34) a pair is missed with probability 3.3e-7.

A text is posted under its coordinate-value pairs. Of two signatures that agree in
MATCHES coordinates, any COORDINATES - MATCHES + 1 in one global order have one
in common (prefix). Pairs stand in that order by their frequency, rare ones
first, so long lists are merged only for texts that have little else. The other
coordinates are never merged (skip): for pairs that a prefix list leads to, the
collisions are counted on both signatures.

Texts with equal sets are one node. Posting lists are compared as in
panelforge.llm.posting: with central texts first, then across components only.
Lists that are still long after that (edited copies that are near one another, but
below the threshold) are compared in blocks of BLOCK_ROWS: a pair counts its
collisions in one list only, that of its smallest common prefix token, and leaves the
task if its sets, hashed to 32 bits, have the similarity.

Edge cases: null and empty texts, and texts of white space, have no shingle and
link with nothing; fewer words than a shingle make one shingle of all; ties are
broken by hash; repeated rows are copies of one another; null ids count as smaller
than any other (a component with one is named null, and rows of null id are kept);
an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .jaccard import NULL_ID, bucket_counts, bucket_of, confirmed, set_keys
from .posting import list_components, size_passes
from .shingles import mix, shingle_set

COORDINATES, MATCHES = 64, 34
#: Rows of a long list that a task compares with as many others.
BLOCK_ROWS = 2048
#: Tokens that are hashed at once, so that temporary arrays stay in the cache.
_CHUNK = 1 << 15


def _functions(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions, from the coordinate's number."""
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:coordinates] | np.uint64(1), seeds[coordinates:]


def signature(tokens: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The smallest value of each hash function over a set that is not empty."""
    return signatures([tokens], coordinates)[0]


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of coordinates for each set; sets are not empty."""
    factors, summands = _functions(coordinates)
    out = np.full((len(sets), coordinates), np.uint32(2**32 - 1), dtype=np.uint32)
    # pieces of at most _CHUNK tokens, many small sets or a part of a long one
    pieces: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal pieces, held
        if pieces:
            rows = np.array([row for row, _ in pieces])
            flat = np.concatenate([part for _, part in pieces])
            starts = np.concatenate(([0], np.cumsum([len(part) for _, part in pieces])[:-1]))
            for c in range(coordinates):
                low = np.minimum.reduceat((flat * factors[c] + summands[c]) >> np.uint64(32), starts)
                out[rows, c] = np.minimum(out[rows, c], low.astype(np.uint32))
        pieces, held = [], 0

    for row, tokens in enumerate(sets):
        for at in range(0, len(tokens), _CHUNK):
            part = tokens[at : at + _CHUNK]
            if held + len(part) > _CHUNK or pieces and pieces[-1][0] == row:
                flush()
            pieces.append((row, part))
            held += len(part)
    flush()
    return out


def posted(signature_: np.ndarray) -> np.ndarray:
    """One token for each coordinate-value pair of a signature, or of several."""
    return mix((signature_.astype(np.uint64) << np.uint64(16)) + np.arange(signature_.shape[-1], dtype=np.uint64))


def _of_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint32)


def _signed_rows(docs: DataFrame, n: int, coordinates: int) -> DataFrame:
    """(id, hash, size, k1, k2, signature) of every row of docs; hash is that of the text, the last three are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, n) for text in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full, coordinates)) if full else iter(())
            keys = [set_keys(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["id", "hash", "size", "k1", "k2", "signature"],
            )

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    return stored(docs.select(ids, "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "id long, hash long, size long, k1 long, k2 long, signature binary"))


def _prefixes(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """nodes with tokens, the rarest coordinates - matches + 1 of every node, and prefix, the bits of their coordinates."""
    counts = nodes.sparkSession.sparkContext.broadcast(bucket_counts(nodes.select("signature"), lambda raw: posted(_of_bytes(raw))))  # a table of fixed size
    length = coordinates - matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for batch in batches:
            rows, bits = [], []
            for raw in batch.column("signature").to_pylist():
                tokens = posted(_of_bytes(raw))
                first = np.lexsort((tokens, frequency[bucket_of(tokens)]))[:length]
                rows.append(tokens[first].view(np.int64))
                bits.append(np.bitwise_or.reduce(np.uint64(1) << first.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64())), pa.array(np.array(bits, dtype=np.uint64).view(np.int64))], names=[*batch.schema.names, "tokens", "prefix"])

    return stored(nodes.mapInArrow(run, "node long, size long, owner long, owner_hash long, signature binary, tokens array<long>, prefix long"))


def collisions(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures agree in at least matches coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).sum(1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _sets32(groups: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(group, tokens): the sets of nodes, hashed to 32 bits, from the texts of their owners."""
    owners = groups.join(nodes.select(F.col("node").alias("group"), F.col("owner").alias("_id"), F.col("owner_hash").alias("_hash")), "group")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_hash"), "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingle_set(text, n) >> np.uint64(32)).astype(np.uint32)).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["group", "tokens"])

    return stored(texts.join(owners, ["_id", "_hash"]).select("group", "text").mapInArrow(run, "group long, tokens binary").dropDuplicates(["group"]))


def _long_lists(rows: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int, matches: int) -> DataFrame:
    """(a, b): pairs of different labels in the long lists rows(token, group, size, label, rows, ...) whose sets seem to link."""
    rows = stored(rows.select("token", "group", "size", "label", "rows"))
    groups = rows.select("group").distinct()
    full = rows.join(nodes.select(F.col("node").alias("group"), "signature", "prefix"), "group").join(_sets32(groups, nodes, docs, n), "group")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    of = full.withColumn("part", F.pmod(F.xxhash64("group"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    of = of.select("token", F.least("part", "_other").alias("first"), F.greatest("part", "_other").alias("second"), "part", "group", "size", "label", "signature", "prefix", "tokens")

    def run(table: pa.Table) -> pa.Table:
        token, first, second = (table.column(c)[0].as_py() for c in ("token", "first", "second"))
        part, group, size, label = (table.column(c).to_numpy() for c in ("part", "group", "size", "label"))
        sign = np.stack([_of_bytes(raw) for raw in table.column("signature").to_pylist()])
        inside = (table.column("prefix").to_numpy().astype(np.uint64)[:, None] >> np.arange(sign.shape[1], dtype=np.uint64)) & np.uint64(1) == 1
        at = posted(sign).view(np.int64)
        sets = [_of_bytes(raw) for raw in table.column("tokens").to_pylist()]
        values, index = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        starts = ends - [len(s) for s in sets]
        marked, found = np.zeros(len(values), dtype=bool), []
        large = np.bincount(np.unique(label, return_inverse=True)[1]).max() == np.unique(label, return_counts=True)[1]
        common = np.isin(label, np.unique(label)[large][:1])  # pairs within the most frequent label need no look
        for i in np.flatnonzero((part == first) | (part == second)):
            if common[i]:
                continue
            other = (label != label[i]) & (common | (group > group[i]))
            if first != second:
                other &= part != part[i]
            js = np.flatnonzero(other & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])))
            same = sign[js] == sign[i]
            keep = same.sum(1) >= matches
            js, same = js[keep], same[keep]
            # in the list of the smallest prefix token that both have
            js = js[np.where(same & inside[js] & inside[i], at[i], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == token]
            if not len(js):
                continue
            marked[index[starts[i] : ends[i]]] = True
            lengths = ends[js] - starts[js]
            flat = np.repeat(starts[js] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            both = np.add.reduceat(marked[index[flat]].astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
            marked[index[starts[i] : ends[i]]] = False
            # two values of a set may have become one: as many are granted
            both = both + (size[js] - lengths) + (size[i] - (ends[i] - starts[i]))
            for j in js[den * both >= num * (size[js] + size[i] - both)]:
                found.append((group[i], group[j]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(of.groupBy("token", "first", "second").applyInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs: links are Jaccard similarities of n-word shingle sets of num / den or more.

    matches must be low enough for num / den (see the module's docstring), and there are at most 64 coordinates.
    """
    signed = _signed_rows(docs, n, coordinates)
    nodes = stored(
        signed.where("size > 0")
        .groupBy("k1", "k2", "size")
        .agg(F.min(F.struct("id", "hash")).alias("owner"), F.first("signature").alias("signature"))
        .select(F.col("k1").alias("node"), "size", F.col("owner.id").alias("owner"), F.col("owner.hash").alias("owner_hash"), "signature")
    )
    nodes = _prefixes(nodes, coordinates, matches)
    posting = nodes.select(F.col("node").alias("group"), "size", F.explode("tokens").alias("token"))
    shared = posting.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("token")
    lists = stored(posting.join(shared, "token"))
    alone = nodes.select("node", F.col("node").alias("group")).where("false")
    labels = list_components(lists, alone, lambda pairs: confirmed(collisions(pairs, nodes, matches), nodes, docs, n, num, den), lambda x, y: size_passes(x, y, num, den), num, den, lambda rows: _long_lists(rows, nodes, docs, n, num, den, matches))
    named = nodes.join(labels, "node", "left").select("node", "owner", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("owner").alias("component_id"))
    of_node = stored(named.join(smallest, "label").select("node", "component_id"))
    rows = signed.select("id", "size", F.col("k1").alias("node")).join(of_node, "node", "left").select("id", "size", F.coalesce("component_id", "id").alias("component_id"))
    as_null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return rows.select(as_null("id").alias("doc_id"), F.col("size").alias("n_shingles"), as_null("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 80, 100)


def component_sql(n: int, num: int, den: int, kept: str = "") -> str:
    """Brute force over shared shingles: links of num / den or more between sets of n-word shingles, and what they reach."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) END AS s FROM words),
tokens AS (SELECT r, len(s) AS size, unnest(s) AS t FROM sets),
links AS (
  SELECT a.r AS a, b.r AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.r <> b.r AND {den} * least(a.size, b.size) >= {num} * greatest(a.size, b.size)
  GROUP BY a.r, b.r, a.size, b.size HAVING {den} * count(*) >= {num} * (a.size + b.size - count(*))),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT x.a, y.b FROM reach x JOIN links y ON x.b = y.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id{kept}
FROM sets s JOIN reach x ON s.r = x.a JOIN sets o ON x.b = o.r GROUP BY s.r, s.doc_id, s.s
"""


ORACLE = component_sql(4, 80, 100, ", s.doc_id = min(o.doc_id) AS kept")
