"""MinHash near duplicates, dataset manifests and hard negatives against plain loops, and their edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, decontam, manifest, minhash, negatives
from panelforge.llm.shingles import shingle_set
from tests.llm.test_llm import DOCS, ODD, chain_of_edits, documents, prose

# MinHash near duplicates


def plain_components(rows, n, num, den):
    """(doc_id, size, component) by comparing all pairs; null ids are smaller than any other."""
    sets = [set(shingle_set(text, n).tolist()) for _, text in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            label[find(j)] = find(i)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), (1, 0)), (0, 0) if doc is None else (1, doc), key=lambda x: (x[0], x[1])) if find(i) in low else ((0, 0) if doc is None else (1, doc))
    return sorted(((doc is not None, doc or 0), len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows))


def got_components(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, (0, 0) if r.component_id is None else (1, r.component_id)) for r in df.collect())


@pytest.mark.parametrize(("n", "num", "den"), [(4, 80, 100), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(spark, n, num, den):
    rng = random.Random(11)
    rows = list(ODD)
    for g in range(6):
        rows += [(100 + g * 20 + i, t) for i, t in enumerate(chain_of_edits(g, 8, 1 + g))]
    common = prose(77, 60)  # a passage that many texts share, and which alone links none of them
    rows += [(500 + i, common + " " + prose(1000 + i, 60 + i)) for i in range(60)]
    # one large group of near copies
    base = prose(5000, 120).split()
    for i in range(80):
        words = list(base)
        words[rng.randrange(120)] = f"edit{i}"
        rows.append((700 + i, " ".join(words)))
    got = got_components(minhash.near_duplicates(documents(spark, rows), n, num, den))
    assert got == plain_components(rows, n, num, den)


@pytest.mark.parametrize("block", [2048, 24])
def test_long_lists_of_texts_near_the_threshold(spark, monkeypatch, block):
    """Copies of one text with so many edits that some link with some others only."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng = random.Random(8)
    base = prose(81, 150).split()
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    seen = []
    long_lists = minhash._long_lists
    monkeypatch.setattr(minhash, "_long_lists", lambda rows, *a: seen.append(rows.count()) or long_lists(rows, *a))
    got = got_components(minhash.near_duplicates(documents(spark, rows), 4, 80, 100))
    assert got == plain_components(rows, 4, 80, 100) and seen[0] > 0
    assert 2 < len({c for *_, c in got}) < 100


def test_kept_rows_and_odd_tables(spark):
    docs = documents(spark, ODD).withColumn("component_id", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("signature", F.lit("x"))
    out = minhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = {(r.doc_id, r.kept) for r in out.collect()}
    assert {(6, True), (8, False), (None, True), (1, True), (5, True)} <= kept and out.count() == len(ODD)
    assert minhash.near_duplicates(documents(spark, ODD).limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 70_000, dtype=np.uint64)
    b = np.concatenate((a[:56_000], rng.integers(0, 2**63, 14_000, dtype=np.uint64)))
    x, y = minhash.signatures([np.unique(a), np.unique(b)], 512)
    assert abs((x == y).mean() - 56 / 84) < 0.08
    together = minhash.signatures([np.unique(a), a[:5], np.unique(b), a[7:9]], 64)
    assert (together[1] == minhash.signature(a[:5])).all() and (together[2] == minhash.signature(np.unique(b))).all()


# dataset manifest


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    parts = []
    for v in (row[0], row[3], row[2], row[4], text):
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return plain_hash(*parts)


def plain_tree(digests):
    """The root, and for each leaf what stands left and right of it at each level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([plain_hash(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    found = []
    for i in range(len(digests)):
        path, at = [], i
        for level in levels[:-1]:
            first = at - at % 3
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
            at //= 3
        found.append(path)
    return levels[-1][0], found


def plain_manifest(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees.append((own, *plain_tree([plain_leaf(r, r[1]) for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper, strict=True):
        for row, path in zip(own, paths, strict=True):
            at = plain_leaf(row, row[1])
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                at = plain_leaf(row, row[1].replace("\n", ""))
            for left, right in path + above:
                at = plain_hash(left, at, right)
            proof = plain_hash(*[left + right for left, right in path + above])
            out.append((str(row[0]), plain_leaf(row, row[1]), subroot, root, proof, at, at == root))
    return sorted(out)


def manifest_rows(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    _, proofs = manifest.manifest(docs, text)
    found = proofs.withColumn("folded", manifest.folded(F.coalesce("altered", "digest"), F.col("path"))).collect()
    digest = {id(r): plain_hash(*[s.left + s.right for s in r.path]) for r in found}
    return sorted((str(r.doc_id), r.digest, r.subroot, r.root, digest[id(r)], r.folded, r.folded == r.root) for r in found)


def full_rows(rows):
    """(doc_id, text, source) -> rows of documents."""
    return [(i, t, None if i == 3 else "en", s, None if t is None else len(t)) for i, t, s in rows]


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 1), (9, 10, 28, 1, 2), (1500, 730, 729, 3)])
def test_manifest_equals_plain_trees(spark, sizes):
    rng = random.Random(sum(sizes))
    rows, i = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, rng.choice(["", "a\nb", "x", "zwei\nZeilen ä 日", None]) if i % 5 else f"t{i}\n", [None, "b", "B", "ä", ""][k]))
    rng.shuffle(rows)
    rows = full_rows(rows)
    assert manifest_rows(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    rows = full_rows([(None, "a\n", "s"), (None, "b", "s"), (None, "b", "s"), (5, "x" * 200_000 + "\n", "s"), (5, "x", "s"), (5, "x", None), (-7, None, None), (2**62, "\n", "t")])
    docs = spark.createDataFrame(rows, DOCS)
    assert manifest_rows(docs) == plain_manifest(rows)
    clashing = docs.withColumns({c: F.lit("mine") for c in ("tree", "lo", "hi", "leaf", "digest", "path", "root", "_rank", "_n", "bucket", "level", "altered")})
    assert manifest_rows(clashing) == plain_manifest(rows)
    assert manifest_rows(docs.limit(0)) == []


def test_nodes_are_nested_intervals(spark):
    rows = full_rows([(i, f"t{i}", "s") for i in range(1000)] + [(1, "u", "t")])
    nodes, _ = manifest.manifest(spark.createDataFrame(rows, DOCS))
    found = nodes.collect()
    at = {(r.tree, r.level, r.lo): r for r in found}
    assert sum(r.level == 0 for r in found) == 1001 and [r.level for r in found if r.tree == "t"] == [0]
    for r in found:
        assert r.level == 0 or r.digest == plain_hash(*[at["s", r.level - 1, lo].digest for lo in range(r.lo, r.hi, 3 ** (r.level - 1))])
    assert max((r.hi - r.lo, r.level) for r in found) == (1000, 7)


# hard negatives


def plain_negatives(rows, anchors):
    """rows: (id, label, vector of whole numbers)"""
    out = []
    for a in (r for r in rows if anchors(r[0])):
        score = [(sum(x * y for x, y in zip(a[2], r[2], strict=False)), r) for r in rows]
        positives = sorted((-s, r[0]) for s, r in score if r[1] == a[1] and r[0] != a[0])[:5]
        for p, i in positives:
            fit = sorted((-s, r[0]) for s, r in score if r[1] != a[1] and 50 * -p <= 100 * s <= 95 * -p)[:3]
            out += [(a[0], i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, anchors):
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchors).collect())


@pytest.mark.parametrize("shape", ["clusters", "noise", "ties", "lengths", "one vector"])
def test_hard_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    d, rows = 12, []
    centres = rng.integers(-200, 200, (6, d))
    for i in range(600):
        v = rng.integers(-120, 120, d)
        if shape == "clusters":
            v = centres[rng.integers(6)] + rng.integers(-9, 9, d)
        if shape == "ties":
            v = rng.integers(-1, 2, d)
        if shape == "lengths":
            v = v[: rng.integers(0, d + 1)]
        if shape == "one vector" and i % 3:
            v = centres[0]
        rows.append((i * 3 - 50, int(rng.integers(3)), v.tolist()))
    assert mined(spark, rows, F.col("vec_id") % 25 == 0) == plain_negatives(rows, lambda i: i % 25 == 0)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25], 1), (2, [0.5, None], 1), (3, None, 1), (4, [nan, 0.1], 1), (5, [inf, 0.1], 1), (6, [0.1, -inf], 1), (7, [-0.001, 0.999], None), (None, [0.1, 0.1], 1), (1, [0.5, 0.25], 1), (8, [-0.001, 0.999], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vec", F.lit("mine")).withColumn("anchor", F.lit(1))
    found = negatives.vectors(df, F.col("label"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, [128, 64]), (8, 2, [-1, 255])]
    assert negatives.hard_negatives(found.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(found, F.col("vec_id") % 50 == 0).count() == 0  # no anchor
    assert negatives.hard_negatives(found, F.col("vec_id") == 1).count() == 0  # no positive


def test_curve_visits_every_cell_once_and_neighbours_in_turn():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = negatives.hilbert_keys(points, bits)
        assert len(set(keys)) == len(points)
        order = sorted(range(len(points)), key=lambda i: keys[i])
        assert all(np.abs(points[a] - points[b]).sum() == 1 for a, b in itertools.pairwise(order))


def test_bounds_hold_and_rule_out_far_blocks():
    rng = np.random.default_rng(5)
    anchors, block = rng.integers(-300, 300, (20, 8)), rng.integers(-300, 300, (50, 8))
    least, most = negatives.interval_bounds(anchors, block.min(0)[None], block.max(0)[None])
    products = anchors @ block.T
    assert (least[:, 0] <= products.min(1)).all() and (most[:, 0] >= products.max(1)).all()
    far = block + 10_000
    least, _ = negatives.interval_bounds(np.abs(anchors) + 1, far.min(0)[None], far.max(0)[None])
    assert (least > products.max()).all()


# templates and batches


def test_templates_are_cut_from_one_list(spark):
    rows = [(1, "we met John Smith, then Ann-Marie 5 Meters and 3 km away"), (2, "by \U00010400\U00010428 Bob's car"), (3, "")]
    found = decontam.forms_of(documents(spark, rows).select("doc_id", "text"), "plain", "named", "written")
    got = {r.doc_id: (r.plain, r.named, r.written) for r in found.collect()}
    num, name, unit = decontam.NUM, decontam.NAME, decontam.UNIT
    assert got == {
        1: (["we", "met", "john", "smith", "then", "ann", "marie", num, unit, "and", num, unit, "away"], ["we", "met", name, name, "then", name, "marie", num, name, "and", num, unit, "away"], ["we", "met", "john", "smith", "then", "ann", "marie", "5", "meters", "and", "3", "km", "away"]),
        2: (["by", "\U00010428\U00010428", "bob", "s", "car"], ["by", name, "bob", "s", "car"], []),
        3: ([], [], []),
    }
    # one cut for both templates, one for texts as written
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2


def test_texts_go_to_python_in_small_batches(spark, sf):
    before = spark.conf.get(common.BATCH)
    try:
        spark.conf.set(common.BATCH, "10000")
        docs = common.table(spark, sf, "documents").select("doc_id")
        many = docs.crossJoin(spark.range(20)).coalesce(1).select("doc_id")
        sizes = [r.n for r in many.mapInArrow(batch_sizes, "n long").collect()]
        assert sum(sizes) == 20 * docs.count() and max(sizes) <= common.BATCH_ROWS
        spark.conf.set(common.BATCH, "10")
        common.table(spark, sf, "documents")
        assert spark.conf.get(common.BATCH) == "10"
    finally:
        spark.conf.set(common.BATCH, before)


def batch_sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
