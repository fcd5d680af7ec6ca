"""Hard negatives from vectors in Hilbert-ordered blocks with zone maps.

Components are integers, floor(SCALE * x). Rows are laid out by label and by
their place on a Hilbert curve through the components, and cut into blocks of
BLOCK_ROWS, one Parquet row each, with the least and greatest value of every
dimension (zone map). Interval arithmetic bounds the inner products of an anchor
with all rows of a block, and an anchor reads a block only if the bounds allow a
row that counts:

* Positives, the TOP_POSITIVES best rows of the anchor's label: first the block
  of the greatest bound, then those whose bound reaches the worst score so found.
* Negatives, for each positive the TOP_NEGATIVES best rows of other labels whose
  score lies in the positive's window: first the block of the greatest bound,
  then those whose bounds meet what is open of a window, which is the part from
  the worst negative so found to its upper end (from its lower end if fewer are
  found).

Results are exact at any shape of the data; how many blocks are read depends on
how well boxes fit it. Anchors are dealt into slices, zone maps into pages, both
of bounded size; slices meet pages, and blocks are then joined with the slices
that need them, so no anchor meets all rows in one task and no block is sent to
all tasks. Tasks keep the best rows of each anchor before anything is shuffled.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; repeated rows (id, label and vector) count once; rows that
share an id with an anchor are none of its positives; of vectors of different
lengths the missing components are 0; scores must fit in a long; a positive whose
score is negative has no negatives; ties go to smaller ids; an empty table gives an
empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

SCALE = 256
TOP_POSITIVES, TOP_NEGATIVES = 5, 3
#: A negative has LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 50, 95
BLOCK_ROWS = 2048
#: Anchors of a slice and zone maps of a page: bounds of the size of a row.
SLICE_ANCHORS, PAGE_ZONES = 256, 512
#: Bits of the curve's grid in each dimension, and how many dimensions it goes through.
CURVE_BITS, CURVE_DIMENSIONS = 4, 64
#: Anchors whose best rows a task holds before it hands them on.
_HELD = 20_000

_BLOCK = "block long, label long, n int, d int, ids binary, matrix binary, lo binary, hi binary"
_BEST = "anchor long, positive long, positive_score long, id long, score long"


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Places of points (rows of numbers below 2**bits) on the Hilbert curve, as bytes that sort like them."""
    x = points.astype(np.int64).T.copy()
    d, n = x.shape
    # Each axis is turned by what the higher bits of the others say, then the bits are Gray coded.
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(d):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8), axis=0)
    return [row.tobytes() for row in np.ascontiguousarray(packed.T)]


def vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, each once."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "embedding", "label").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vec.alias("vec")).distinct()


def _matrix(vecs: list[np.ndarray], d: int) -> np.ndarray:
    out = np.zeros((len(vecs), d), dtype=np.int64)
    for row, v in zip(out, vecs, strict=True):
        row[: len(v)] = v
    return out


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def blocks(rows: DataFrame) -> DataFrame:
    """The stored blocks of rows(vec_id, label, vec)."""
    spark = rows.sparkSession
    # the grid spans the range of each dimension: one row of numbers for each
    ranges = rows.select(F.posexplode("vec").alias("at", "x")).where(F.col("at") < CURVE_DIMENSIONS).groupBy("at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.variance("x").alias("spread")).collect()
    ranges.sort(key=lambda r: (-(r["spread"] or 0), r["at"]))  # the curve's first bits tell the widest dimensions apart
    at = np.array([r["at"] for r in ranges], dtype=np.int64)
    lo, width = np.array([r["lo"] for r in ranges], dtype=np.float64), np.array([r["hi"] - r["lo"] + 1 for r in ranges], dtype=np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _lists(batch.column(2))
            keys = [b""] * len(vecs)
            if vecs and len(at):
                points = _matrix([v[: at.max() + 1] for v in vecs], int(at.max()) + 1)[:, at]
                grid = np.clip((points - lo) / width * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
                keys = hilbert_keys(grid, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "label", "vec", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vecs: list[np.ndarray] = []
        of = None

        def block() -> pa.RecordBatch:
            nonlocal number, ids, vecs
            m = _matrix(vecs, max(map(len, vecs)))
            row = [number, of, len(ids), m.shape[1], np.array(ids, dtype=np.int64).tobytes(), m.tobytes(), m.min(0).tobytes(), m.max(0).tobytes()]
            number, ids, vecs = number + 1, [], []
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", "label", "n", "d", "ids", "matrix", "lo", "hi"])

        for batch in batches:
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
                if ids and (label != of or len(ids) == BLOCK_ROWS):
                    yield block()
                of = label
                ids.append(i)
                vecs.append(v)
        if ids:
            yield block()

    keyed = stored(rows.mapInArrow(place, "vec_id long, label long, vec array<long>, key binary"))
    order = ["label", "key", "vec_id"]
    laid = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return stored(laid.select("vec_id", "label", "vec").mapInArrow(cut, _BLOCK))


def _packed(rows: list[dict], d: int) -> np.ndarray:
    return _matrix([np.array(r["vec"], dtype=np.int64) for r in rows], d)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def interval_bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of every anchor with any point of every box."""
    positive, negative = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _products(positive, lo) + _products(negative, hi), _products(positive, hi) + _products(negative, lo)


#: (anchors of a slice, blocks and labels of the zone maps, least and greatest products) -> which blocks each anchor needs, as a boolean matrix
Needs = Callable[[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _candidates(slices: DataFrame, pages: DataFrame, n_pages: int, needs: Needs) -> DataFrame:
    """(slice, block, rows, bounds): which anchors of the slice need the block, and their greatest products with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, anchors, zones in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                d = max([*(z["d"] for z in zones), *(len(a["vec"]) for a in anchors)])  # missing components are 0
                lo, hi = (_matrix([np.frombuffer(z[k], dtype=np.int64) for z in zones], d) for k in ("lo", "hi"))
                least, most = interval_bounds(_packed(anchors, d), lo, hi)
                need = needs(anchors, np.array([z["block"] for z in zones]), np.array([z["label"] for z in zones]), least, most)
                at = [(np.flatnonzero(column), j) for j, column in enumerate(need.T)]
                at = [(rows, j) for rows, j in at if len(rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(at), pa.int64()), pa.array([zones[j]["block"] for _, j in at], pa.int64()), pa.array([rows.tolist() for rows, _ in at], pa.list_(pa.int32())), pa.array([most[rows, j].tolist() for rows, j in at], pa.list_(pa.int64()))],
                    names=["slice", "block", "rows", "bounds"],
                )

    met = slices.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page")
    return met.select("slice", "anchors", "zones").mapInArrow(run, "slice long, block long, rows array<int>, bounds array<long>")


class _Best:
    """The best rows of each key, by falling score, then by id."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.rows: dict[tuple, list[tuple[int, int]]] = {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            held = self.rows.get(key, [])
            self.rows[key] = sorted(held + list(zip((-scores).tolist(), ids.tolist(), strict=True)))[: self.top]

    def batch(self) -> pa.RecordBatch:
        flat = [(*key, i, -s) for key, rows in self.rows.items() for s, i in rows]
        self.rows = {}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(5)], names=["anchor", "positive", "positive_score", "id", "score"])


def _evaluated(read: DataFrame, slices: DataFrame, blocks_: DataFrame, same: bool) -> DataFrame:
    """The best rows that the blocks of read(slice, block, rows) have for their anchors (same) or for each of their positives."""
    top = TOP_POSITIVES if same else TOP_NEGATIVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(top)
        for batch in batches:
            for anchors, wanted, n, d, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chosen = [anchors[k] for k in wanted]
                at, m = np.frombuffer(ids, dtype=np.int64), np.frombuffer(raw, dtype=np.int64).reshape(n, d)
                wide = max([d, *(len(a["vec"]) for a in chosen)])
                for a, scores in zip(chosen, _products(_packed(chosen, wide)[:, :d], m), strict=True):
                    if same:
                        near = np.flatnonzero(at != a["vec_id"])
                        if len(near) > top:
                            near = near[scores[near] >= np.partition(scores[near], -top)[-top]]
                        keep = near[np.lexsort((at[near], -scores[near]))[:top]]
                        best.add((a["anchor"], None, None), scores[keep], at[keep])
                        continue
                    order = np.lexsort((at, -scores))
                    falling = -scores[order]
                    for p in a["positives"]:
                        low, high = _window(p["score"])
                        first, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                        keep = order[first : min(end, first + top)]
                        best.add((a["anchor"], p["id"], p["score"]), scores[keep], at[keep])
                if len(best.rows) > _HELD:
                    yield best.batch()
        if best.rows:
            yield best.batch()

    met = read.select("slice", "block", "rows").join(slices, "slice").join(blocks_.select("block", "n", "d", "ids", "matrix"), "block")
    return stored(met.select("anchors", "rows", "n", "d", "ids", "matrix").mapInArrow(run, _BEST))


def _window(score: int) -> tuple[int, int]:
    """Least and greatest score of a positive's negatives; empty (the least above the greatest) for negative scores."""
    return -(-LOW * score // 100), HIGH * score // 100


def _floor_div(x: Column) -> Column:
    """x div 100, rounded down, in whole numbers."""
    return ((x - F.pmod(x, F.lit(100))) / 100).cast("long")


def _topmost(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "positive", "positive_score").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def _home(candidates: DataFrame) -> DataFrame:
    """(slice, row, block): for every anchor the one block of the greatest bound."""
    flat = candidates.select("slice", "block", F.explode(F.arrays_zip("rows", "bounds")).alias("x"))
    return stored(flat.groupBy("slice", F.col("x.rows").alias("row")).agg(F.max_by("block", F.struct(F.col("x.bounds"), -F.col("block"))).alias("block")))


def _by_block(home: DataFrame) -> DataFrame:
    return home.groupBy("slice", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # a slice's anchors at most


def _sliced(anchors: DataFrame, n_slices: int, *columns: str) -> DataFrame:
    """(slice, anchors): about SLICE_ANCHORS of them in a row, in one order."""
    part = F.pmod(F.xxhash64("anchor"), F.lit(n_slices)).alias("slice")
    return stored(anchors.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("vec_id", "anchor", "label", "vec", *columns))).alias("anchors")))


def _read_home(home: DataFrame, slices: DataFrame) -> DataFrame:
    """(anchor, home): the block that each anchor has read."""
    named = slices.select("slice", F.posexplode("anchors.anchor").alias("row", "anchor"))
    return home.join(named, ["slice", "row"]).select("anchor", F.col("block").alias("home"))


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(vec_id, label, vec)."""
    rows = stored(rows)
    blocks_ = blocks(rows)
    zones = blocks_.select("block", "label", "d", "lo", "hi")
    n_pages = max(1, -(-zones.count() // PAGE_ZONES))
    pages = stored(zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page")).agg(F.collect_list(F.struct("block", "label", "d", "lo", "hi")).alias("zones")))
    anchors = stored(rows.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "vec")))
    n_slices = max(1, -(-anchors.count() // SLICE_ANCHORS))

    def alike(at: list[dict], labels: np.ndarray) -> np.ndarray:
        return np.array([a["label"] for a in at], dtype=np.int64)[:, None] == labels

    def unread(at: list[dict], numbers: np.ndarray) -> np.ndarray:
        return np.array([-1 if a["home"] is None else a["home"] for a in at], dtype=np.int64)[:, None] != numbers

    def open_windows(at: list[dict], least: np.ndarray, most: np.ndarray) -> np.ndarray:
        need = np.zeros(most.shape, dtype=bool)
        for row, a in enumerate(at):
            for p in a["positives"]:
                need[row] |= (most[row] >= p["low"]) & (least[row] <= p["high"]) & (p["low"] <= p["high"])
        return need

    # Positives: the block of the greatest bound, then all whose bound reaches the worst score found there.
    slices = _sliced(anchors, n_slices)
    home = _home(_candidates(slices, pages, n_pages, lambda at, _, labels, *__: alike(at, labels)))
    first = _evaluated(_by_block(home), slices, blocks_, True)
    worst = first.groupBy("anchor").agg(F.min("score").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    bounded = anchors.join(worst, "anchor", "left").join(_read_home(home, slices), "anchor", "left")
    bounded = _sliced(bounded.withColumn("worst", F.when(F.col("_n") >= TOP_POSITIVES, F.col("_worst"))), n_slices, "worst", "home")

    def reaching(at: list[dict], numbers: np.ndarray, labels: np.ndarray, _: np.ndarray, most: np.ndarray) -> np.ndarray:
        enough = [np.ones(most.shape[1], dtype=bool) if a["worst"] is None else m >= a["worst"] for a, m in zip(at, most, strict=True)]
        return alike(at, labels) & unread(at, numbers) & np.array(enough)

    second = _evaluated(_candidates(bounded, pages, n_pages, reaching), bounded, blocks_, True)
    positives = stored(_topmost(first.unionByName(second), TOP_POSITIVES))

    # Negatives: the block of the greatest bound that meets a window, then all that meet what is open of one.
    low, high = -_floor_div(-LOW * F.col("score")), _floor_div(HIGH * F.col("score"))
    windows = positives.select("anchor", F.struct("id", "score", low.alias("low"), high.alias("high")).alias("p"))
    listed = windows.groupBy("anchor").agg(F.sort_array(F.collect_set("p")).alias("positives"))
    slices = _sliced(anchors.join(listed, "anchor"), n_slices, "positives")
    home = _home(_candidates(slices, pages, n_pages, lambda at, _, labels, least, most: ~alike(at, labels) & open_windows(at, least, most)))
    third = _evaluated(_by_block(home), slices, blocks_, False)
    found = third.groupBy("anchor", F.col("positive").alias("_id"), F.col("positive_score").alias("_score")).agg(F.min("score").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    raised = windows.join(found, (windows["anchor"] == found["anchor"]) & (F.col("p.id") == F.col("_id")) & (F.col("p.score") == F.col("_score")), "left").select(
        windows["anchor"], F.struct("p.id", "p.score", F.when(F.col("_n") >= TOP_NEGATIVES, F.col("_worst")).otherwise(F.col("p.low")).alias("low"), "p.high").alias("p")
    )
    listed = raised.groupBy("anchor").agg(F.sort_array(F.collect_set("p")).alias("positives"))
    slices = _sliced(anchors.join(listed, "anchor").join(_read_home(home, slices), "anchor", "left"), n_slices, "positives", "home")
    fourth = _evaluated(_candidates(slices, pages, n_pages, lambda at, numbers, labels, least, most: ~alike(at, labels) & unread(at, numbers) & open_windows(at, least, most)), slices, blocks_, False)
    best = _topmost(third.unionByName(fourth), TOP_NEGATIVES)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return best.join(names, "anchor").select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(table(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) <= 3
"""
