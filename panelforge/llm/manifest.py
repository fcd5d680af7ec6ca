r"""Merkle manifest of a dataset with nested-interval labels, and proofs of its rows.

Every document is a leaf, H (lowercase hex SHA-256) of its fields. The leaves of a
source, by rising doc_id, and the roots of the sources, by source, are trees in
which FANOUT consecutive nodes become one until a single node remains. A node is
labelled with the interval [lo, hi) of leaf ranks that it covers. Intervals nest:
the ancestors of a node are the nodes of higher levels whose intervals contain its
own, and its siblings are what is left of its parent's interval without its own.

Levels lie in bands of BAND. The nodes of a band below one node of the next band
are a bucket (lo div FANOUT^BAND), at most FANOUT^BAND of them however large the
tree is. Trees grow from bucket to bucket, and proofs come down again: joins on
the tree and the bucket attach what contains it to a bucket, and containment
within the bucket gives every node its siblings. Ranks come from slices of a range
partitioning and their counts, so no task sees a whole source.

Edge cases: nulls in a field are `-`, apart from any value; null ids come first in
their source, and a null source is a source of its own, the first; rows with one id
stand by their leaf, and repeated rows are leaves of their own; a lone leaf is its
subroot, a lone subroot the root; texts are hashed whole in the JVM; an empty table
gives an empty result. Only doc_id, source, lang, n_chars and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

FANOUT, BAND = 3, 6
SPAN = FANOUT**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "struct<level:int,lo:long,hi:long,digest:string>"
_PATH = "array<struct<left:string,right:string>>"


def leaf(fields: dict[str, Column]) -> Column:
    """H of the fields, each `-` if null, else its UTF-8 byte count, `:` and value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(source, doc_id, leaf, altered): altered is the leaf of the row with its text replaced by tampered, null where that is null."""
    own = {c: F.col(c) for c in FIELDS}
    return docs.select("source", "doc_id", leaf(own).alias("leaf"), F.when(tampered.isNotNull(), leaf(own | {"text": tampered})).alias("altered"))


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with _rank (from 0) within their tree, and _n, the rows of the tree."""
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    sliced = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys)
    sliced = stored(sliced.withColumn("_slice", F.spark_partition_id()))
    counts = sliced.groupBy(tree, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    of_tree = Window.partitionBy(tree)
    before = F.sum("_rows").over(of_tree.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(tree).alias("_of"), F.col("_slice").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(of_tree).alias("_n"))
    placed = sliced.join(counts, F.col(tree).eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at")))
    inside = F.row_number().over(Window.partitionBy(tree, "_slice").orderBy(*keys[1:])) - 1
    return placed.withColumn("_rank", F.col("_before") + inside).drop("_of", "_at", "_before", "_slice", "_tie")


Node = tuple[int, int, str]


def _merge(nodes: list[Node]) -> list[Node]:
    runs = (nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT))
    return [(run[0][0], run[-1][1], hashlib.sha256("".join(digest for _, _, digest in run).encode()).hexdigest()) for run in runs]


def _levels(bottom: list[Node], whole: bool) -> list[list[Node]]:
    """The levels of a bucket from its bottom on: to the root of a whole tree, else BAND of them."""
    levels = [bottom]
    while len(levels[-1]) > 1 if whole else len(levels) <= BAND:
        levels.append(_merge(levels[-1]))
    return levels


def _descend(levels: list[list[Node]], path: list[dict[str, str]]) -> list[list[dict[str, str]]]:
    """Paths of the nodes at the bottom, from below: for each level what stands left and right of a node in its parent's interval."""
    paths = [path]
    for upper, lower in zip(levels[:0:-1], levels[-2::-1], strict=True):
        found, at = [], 0
        for (_, end, _), above in zip(upper, paths, strict=True):
            children = []
            while at < len(lower) and lower[at][1] <= end:
                children.append(lower[at])
                at += 1
            for lo, hi, _ in children:
                left = "".join(digest for _, h, digest in children if h <= lo)
                right = "".join(digest for low, _, digest in children if low >= hi)
                found.append([{"left": left, "right": right}, *above])
        paths = found
    return paths


def _bottoms(batch: pa.RecordBatch) -> Iterator[tuple[list[Node], bool]]:
    for whole, nodes in zip(batch.column("whole").to_pylist(), batch.column("nodes"), strict=True):
        at = nodes.values
        yield list(zip(*(at.field(k).to_pylist() for k in ("lo", "hi", "digest")), strict=True)), whole


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.string())]))
    for batch in batches:
        above, tops = [], []
        for bottom, whole in _bottoms(batch):
            levels = _levels(bottom, whole)
            above.append([{"level": k, "lo": lo, "hi": hi, "digest": digest} for k, level in enumerate(levels) if k for lo, hi, digest in level])
            tops.append(levels[-1][0][2])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "bucket", "n")), pa.array(above, kind), pa.array(tops, pa.string())], names=["tree", "bucket", "n", "above", "top"])


def _bucket(span: int) -> Column:
    return F.floor(F.col("lo") / (span * SPAN)).alias("bucket")


def _collected(level: DataFrame, span: int, *payload: str) -> DataFrame:
    """(tree, bucket, n, whole, nodes): SPAN nodes at most in a bucket."""
    nodes = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *payload))).alias("nodes")
    return level.groupBy("tree", _bucket(span), "n").agg(nodes).withColumn("whole", F.col("n") <= span * SPAN)


def grow(bottom: DataFrame) -> list[DataFrame]:
    """The bands of the trees of bottom(tree, n, lo, hi, digest), the lowest first.

    A band has a row (tree, bucket, n, above, top) for each bucket: the nodes of the
    levels of the band above the bottom of the bucket, and the digest at its top.
    Trees of one bucket end there; the others go on in the next band.
    """
    span, level, bands = 1, bottom, []
    while True:
        bands.append(stored(_collected(level, span).mapInArrow(_grow, f"tree string, bucket long, n long, above array<{_NODE}>, top string")))
        level = _tops(bands[-1], span)
        span *= SPAN
        if level.isEmpty():
            return bands


def _tops(band: DataFrame, span: int) -> DataFrame:
    """The bottom of the next band: the tops of the buckets of the trees that go on."""
    lo = F.col("bucket") * (span * SPAN)
    return band.where(F.col("n") > span * SPAN).select("tree", "n", lo.alias("lo"), F.least(lo + span * SPAN, "n").alias("hi"), F.col("top").alias("digest"))


def roots(bands: list[DataFrame]) -> DataFrame:
    """(tree, root)"""
    ends = [band.where(F.col("n") <= SPAN ** (k + 1)).select("tree", F.col("top").alias("root")) for k, band in enumerate(bands)]
    return reduce(DataFrame.unionByName, ends)


def nodes_of(bottom: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """(tree, level, lo, hi, digest) of all nodes."""
    every = [bottom.select("tree", F.lit(0).alias("level"), "lo", "hi", "digest")]
    for k, band in enumerate(bands):
        node = band.select("tree", F.explode("above").alias("node"))
        every.append(node.select("tree", (F.col("node.level") + k * BAND).alias("level"), "node.lo", "node.hi", "node.digest"))
    return reduce(DataFrame.unionByName, every)


def paths(bottom: DataFrame, bands: list[DataFrame], start: DataFrame, *payload: str) -> DataFrame:
    """(tree, lo, digest, payload, path, and what start has): the siblings of every node at the bottom, from below.

    start(tree, path, ...) has for each tree the path of its root in what stands above it.
    """
    kept = [c for c in start.columns if c not in ("tree", "path")]
    found = None
    for k in reversed(range(len(bands))):
        span = SPAN**k
        level, extra = (bottom, payload) if not k else (_tops(bands[k - 1], SPAN ** (k - 1)), ())
        # what contains the bucket: the path of the node of the next band, or that of the root of a whole tree
        heads = bands[k].select("tree", "bucket", "n").alias("h").join(start.alias("s"), F.col("h.tree").eqNullSafe(F.col("s.tree"))).select("h.*", "s.path", *[f"s.{c}" for c in kept])
        if found is not None:
            containing = found.select("tree", _bucket(span), F.col("path").alias("_path")).alias("c")
            on = F.col("h.tree").eqNullSafe(F.col("c.tree")) & (F.col("h.bucket") == F.col("c.bucket"))
            heads = heads.alias("h").join(containing, on, "left").select("h.tree", "h.bucket", F.coalesce("c._path", "h.path").alias("path"), *kept)
        heads = heads.select("tree", "bucket", F.struct("path", *kept).alias("head"))
        buckets = _collected(level, span, *extra).alias("b")
        on = F.col("b.tree").eqNullSafe(F.col("h.tree")) & (F.col("b.bucket") == F.col("h.bucket"))
        found = _attached(buckets.join(heads.alias("h"), on).select("b.tree", "b.whole", "b.nodes", "h.head"), kept, extra)
        if k:
            found = stored(found)
    return found


def _attached(buckets: DataFrame, kept: list[str], payload: tuple[str, ...]) -> DataFrame:
    nodes, head = buckets.schema["nodes"].dataType.elementType, buckets.schema["head"].dataType
    names = ["tree", "lo", "digest", *payload, *kept, "path"]
    types = ["string", "long", "string", *[nodes[c].dataType.simpleString() for c in payload], *[head[c].dataType.simpleString() for c in kept], _PATH]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, found = batch.column("head"), []
            for (bottom, whole), above in zip(_bottoms(batch), heads.field("path").to_pylist(), strict=True):
                found += _descend(_levels(bottom, whole), above)
            owner, flat = pc.list_parent_indices(batch.column("nodes")), batch.column("nodes").flatten()
            own = [batch.column("tree").take(owner), *(flat.field(c) for c in ("lo", "digest", *payload))]
            yield pa.RecordBatch.from_arrays([*own, *(heads.field(c).take(owner) for c in kept), pa.array(found, kind)], names=names)

    return buckets.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)))


def _bottom(rows: DataFrame, tree: Column, digest: str, *payload: str) -> DataFrame:
    return rows.select(tree.cast("string").alias("tree"), F.col("_n").alias("n"), F.col("_rank").alias("lo"), (F.col("_rank") + 1).alias("hi"), F.col(digest).alias("digest"), *payload)


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trees of all sources, and the proofs of all rows of docs.

    nodes has (tree, level, lo, hi, digest), the tree being the source. proofs has
    (tree, lo, digest, doc_id, altered, subroot, root, path): the leaf's rank and
    digest, the digest of the row with the text tampered (null without one), and for
    each level from the leaf to the root what stands left and right of the node there.
    """
    altered = F.lit(None).cast("string") if tampered is None else tampered
    rows = ranked(leaves(docs, altered), "source", "doc_id", "leaf", "altered")
    bottom = stored(_bottom(rows, F.col("source"), "leaf", "doc_id", "altered"))
    bands = grow(bottom)
    # the roots of the sources are the leaves of one more tree
    ends = roots(bands).select(F.lit("").alias("all"), F.col("tree").alias("source"), F.col("root").alias("subroot"))
    top = stored(_bottom(ranked(ends, "all", "source"), F.col("all"), "subroot", "source"))
    over = grow(top)
    whole = roots(over).select("tree", "root", F.array().cast(_PATH).alias("path"))
    start = stored(paths(top, over, whole, "source").select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    return nodes_of(bottom, bands), paths(bottom, bands, start, "doc_id", "altered")


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_, lambda state, s: F.sha2(F.concat(s["left"], state, s["right"]), 256))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    _, proofs = manifest(table(spark, sf_dir, "documents"), text)
    found = proofs.withColumn("folded_root", folded(F.coalesce("altered", "digest"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(name: str, value: str = "") -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf_sql(text: str = "") -> str:
    return f"sha256({' || '.join(_field(c, text if c == 'text' else '') for c in FIELDS)})"


#: CRC-32 of the decimal id, bit by bit; its last bit decides.
_EVEN = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) & 1 = 1"""


def _tree_sql(name: str, tree: str, rows: str) -> str:
    """Recursive tables: the levels of trees of rows(tree, n, i, digest), and the nodes with what stands left and right of them."""
    return f"""
{name}_nodes AS (
  SELECT {tree} AS tree, 0 AS level, n, i, digest FROM {rows}
  UNION ALL SELECT tree, level + 1, (n + 2) // 3, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, n, i // 3),
{name}_paths AS (
  SELECT x.tree, x.level, x.i, coalesce(string_agg(y.digest, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.digest, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {name}_nodes x JOIN {name}_nodes y ON x.tree IS NOT DISTINCT FROM y.tree AND x.level = y.level AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY x.tree, x.level, x.i)"""


ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, leaf, altered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf_sql()} AS leaf, CASE WHEN {_EVEN} THEN {_leaf_sql("replace(text, chr(10), '')")} END AS altered FROM documents)),
first_ AS (SELECT source, n, i, leaf AS digest FROM rows_),
{_tree_sql("low", "source", "first_")},
sub AS (SELECT tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low_nodes WHERE n = 1),
{_tree_sql("top", "''", "sub")},
climb AS (
  SELECT doc_id, leaf, source, i, 0 AS level, i AS at, '' AS proof, coalesce(altered, leaf) AS folded FROM rows_
  UNION ALL SELECT c.doc_id, c.leaf, c.source, c.i, c.level + 1, c.at // 3, c.proof || p.l || p.r, sha256(p.l || c.folded || p.r)
  FROM climb c JOIN low_paths p ON c.source IS NOT DISTINCT FROM p.tree AND c.level = p.level AND c.at = p.i),
peak AS (
  SELECT c.doc_id, c.leaf, s.digest AS subroot, 0 AS level, s.i AS at, c.proof, c.folded
  FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY source, i ORDER BY level DESC) = 1) c JOIN sub s ON c.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT k.doc_id, k.leaf, k.subroot, k.level + 1, k.at // 3, k.proof || p.l || p.r, sha256(p.l || k.folded || p.r) FROM peak k JOIN top_paths p ON k.level = p.level AND k.at = p.i),
root AS (SELECT digest FROM top_nodes WHERE n = 1),
height AS (SELECT max(level) AS h FROM top_nodes)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM peak, root, height WHERE level = h
"""
