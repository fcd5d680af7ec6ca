"""Graphs, regressions, range evaluation, quantiles and shards against plain loops."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import book, detect, graphs, select, stats
from panelforge.sources import files

START = dt.date(2020, 1, 1)


def returns(codes=9, days=150, seed=1):
    """(code, date, r) with gaps, one constant code and two pairs that move together."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(days):
        common = rng.normal(size=2)
        for c in range(codes):
            if rng.random() < 0.2:
                continue
            r = 0.0 if c == 8 else float(rng.normal() + (1.5 * common[c % 2] if c < 4 else 0))
            rows.append((c, START + dt.timedelta(days=t + t // 5 * 2), r))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "code long, date date, r double")


@pytest.mark.parametrize("block", [256, 4])
def test_rolling_degrees_equal_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(graphs, "BLOCK", block)
    monkeypatch.setattr(graphs, "CHUNK", 366)
    rows = returns()
    got = {(r.date, r.code): (r.degree, r.mean_abs, r.max_abs) for r in graphs.rolling_degrees(frame(spark, rows), 60, 20, 0.3).collect()}
    by_code = {}
    for c, d, r in rows:
        by_code.setdefault(c, {})[d] = r
    expected = {}
    for day in sorted({d for _, d, _ in rows}):
        own = {c: {d: r for d, r in s.items() if 0 <= (day - d).days <= 60} for c, s in by_code.items()}
        fit = {c: s for c, s in own.items() if len(s) >= 20 and np.std(list(s.values()), ddof=1) > 1e-6}
        strong = {c: [] for c in fit}
        for a, b in itertools.combinations(sorted(fit), 2):
            both = sorted(set(fit[a]) & set(fit[b]))
            if len(both) < 20:
                continue
            (x, mx, sx), (y, my, sy) = (([fit[c][d] for d in both], np.mean(list(fit[c].values())), np.std(list(fit[c].values()), ddof=1)) for c in (a, b))
            w = abs(sum((u - mx) * (v - my) for u, v in zip(x, y, strict=True)) / ((len(both) - 1) * sx * sy))
            if w >= 0.3:
                strong[a].append(w)
                strong[b].append(w)
        expected.update({(day, c): (len(w), sum(w) / len(w) if w else 0.0, max(w, default=0.0)) for c, w in strong.items()})
    assert got.keys() == expected.keys() and sum(v[0] for v in expected.values()) > 100
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_weighted_and_shrunk_correlations(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 3)
    rows = returns(6, 80)
    end = max(d for _, d, _ in rows)
    x = graphs.windows(frame(spark, rows), spark.createDataFrame([(end,)], "win date"), 60)
    got = {(r.src, r.dst): (r.n, r.w) for r in graphs.correlation_edges(x, 20, 0.2, 20.0, 0.1).collect()}
    expected = {}
    for a, b in itertools.combinations(range(6), 2):
        u, v = ({d: r for c, d, r in rows if c == k and 0 <= (end - d).days <= 60} for k in (a, b))
        both = sorted(set(u) & set(v))
        w = np.array([2.0 ** (-(end - d).days / 20) for d in both])
        p, q = np.array([u[d] for d in both]), np.array([v[d] for d in both])
        p, q = p - (w * p).sum() / w.sum(), q - (w * q).sum() / w.sum()
        c = 0.9 * (w * p * q).sum() / math.sqrt((w * p * p).sum() * (w * q * q).sum())
        if len(both) >= 20 and abs(c) >= 0.2:
            expected[a, b] = (len(both), c)
    assert got.keys() == expected.keys() and expected and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def large_graph(seed=2, nodes=120, edges=1300):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(edges)} | {(1000, 1001), (1001, 1002)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return sorted(pairs), near


def test_cores_and_closeness_of_a_large_graph(spark):
    pairs, near = large_graph()
    e = spark.createDataFrame([(1, a, b, 9, 0.5) for a, b in pairs], "win int, src long, dst long, n long, w double")
    left, core, k = {v: set(n) for v, n in near.items()}, {}, 1
    while left:
        low = [v for v, n in left.items() if len(n) <= k]
        for v in low:
            core[v] = k
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
        k += not low
    assert len(pairs) > 1000 and {r.code: r.core for r in graphs.core_numbers(e).collect()} == core
    got = {r.code: (r.reached, r.closeness) for r in graphs.closeness(e, 3).collect()}
    for v in near:
        dist, frontier = {v: 0}, [v]
        for step in (1, 2, 3):
            frontier = [u for u in {u for w in frontier for u in near[w]} if u not in dist]
            dist.update(dict.fromkeys(frontier, step))
        n = len(dist) - 1
        assert got[v] == pytest.approx((n, n / sum(dist.values()) * n / (len(near) - 1)))


def test_risk_neutral_scores_equal_a_plain_ridge(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(6):
        for c in range(5 if day == 5 else 40):
            a, b = rng.normal(size=2)
            group = int(rng.integers(0, 4)) if day else 2
            score = float(rng.normal() + (0 if day == 1 else 2 * a + group))
            rows.append((day, c, score if day != 2 else 1.0, None if c == 3 else float(a), float(b), group))
    df = spark.createDataFrame(rows, "date int, code long, score double, a double, b double, g int")
    got = {(r.date, r.code): (r.neutral, r.used) for r in book.risk_neutral(df, ["date"], "score", ["a", "b"], "g", [F.lit(k) for k in (1, 2, 3)], 10.0, 0.3, 0.25).collect()}
    for day in range(6):
        of = [r for r in rows if r[0] == day]
        y = np.array([r[2] for r in of])
        raw = [np.array([np.nan if r[k] is None else r[k] for r in of]) for k in (3, 4)]
        low = min(r[5] for r in of)
        raw += [np.array([float(r[5] == g) for r in of]) for g in sorted({r[5] for r in of}) if g > low]
        x = np.array([np.nan_to_num((v - np.nanmean(v)) / (np.nanstd(v, ddof=1) or 1)) for v in raw]).T
        new, used = y, False
        if y.std() > 1e-6:
            z = (y - y.mean()) / y.std()
            beta = np.linalg.solve(x.T @ x + 10 * np.eye(x.shape[1]), x.T @ z)
            fit = x @ beta
            rss, free = ((z - fit) ** 2).sum(), len(z) - x.shape[1] - 1
            t = np.abs(beta / np.sqrt(rss / max(free, 1) / ((x**2).sum(0) + 1e-10))).max()
            used = bool(1 - rss / (z**2).sum() >= 0.05 and (free <= 0 or t >= 2))
            if used:
                rest = z - 0.3 * fit
                rest = (rest - rest.mean()) * y.std() / rest.std() + y.mean()
                new = y + np.clip(rest - y, -0.25 * y.std(), 0.25 * y.std())
        assert all(got[day, r[1]] == (pytest.approx(v, abs=1e-9), used) for r, v in zip(of, new, strict=True)), day
    assert {got[d, 0][1] for d in range(6)} == {True, False}


def test_range_sweep_equals_plain_matching(spark):
    rng = random.Random(4)

    def ranges(n):
        out, at = [], 0
        for _ in range(n):
            at += rng.randrange(1, 5)
            out.append((at, at + rng.randrange(0, 6)))
            at = out[-1][1] + 1
        return out

    actual = [(i, a, b) for i in range(4) for a, b in ranges(20)]
    predicted = [(i, a, b, round(rng.random(), 3)) for i in range(5) for a, b in ranges(20)]
    predicted += [(0, a, b + 3, round(rng.random(), 3)) for a, b in ranges(6)]  # overlapping predictions
    out = detect.sweep(spark.createDataFrame(predicted, "id long, a long, b long, score double"), spark.createDataFrame(actual, "id long, a long, b long"), 19)
    got = {(r.kind, r.step): (r.selected, r.matched, r.precision, r.recall, r.area) for r in out.collect()}
    for kind in ("overlap", "iou"):
        curve = []
        for step in range(1, 20):
            chosen = sorted((p for p in predicted if round(p[3] - (0.95 - (step - 1) * 0.05), 9) >= 0), key=lambda p: (p[0], -p[3], p[1], p[2]))
            free, hits = sorted(actual), 0
            for i, a, b, _ in chosen:
                best = max(((min(b, d) - max(a, c) + 1) / (1 if kind == "overlap" else b - a + d - c + 2 - (min(b, d) - max(a, c) + 1)), -k) for k, (j, c, d) in enumerate(free) if j == i) if any(j == i for j, *_ in free) else (0, 0)
                if best[0] > 0 and (kind == "overlap" or best[0] >= 0.25):
                    free.pop(-best[1])
                    hits += 1
            curve.append((len(chosen), hits, hits / len(chosen) if chosen else 1.0, hits / len(actual)))
        area, last = 0.0, (0.0, curve[0][2])
        for *_, p, r in curve:
            area, last = area + (r - last[0]) * (p + last[1]) / 2, (r, p)
        assert all(got[kind, k + 1] == pytest.approx((*c, area)) for k, c in enumerate(curve)), kind
        assert curve[-1][1] > 10


def test_one_good_range_scores_well(spark):
    out = detect.sweep(spark.createDataFrame([(1, 5, 10, 0.9)], "id long, a long, b long, score double"), spark.createDataFrame([(1, 7, 12)], "id long, a long, b long"), 3)
    assert all(0.3 <= r.area <= 1 for r in out.collect() if r.kind == "iou")


def test_overfitting_of_noise_and_of_a_real_edge(spark):
    rng = np.random.default_rng(5)
    noise = [(f"s{k}", START + dt.timedelta(days=i), float(rng.normal())) for k in range(6) for i in range(240)]
    edge = [(s, d, x + (0.5 if s == "s3" else 0)) for s, d, x in noise]
    share = {}
    for name, rows in (("noise", noise), ("edge", edge)):
        out = stats.overfitting(spark.createDataFrame(rows, "strategy string, date date, x double"), 8).collect()
        assert len(out) == 70
        share[name] = sum(r.logit < 0 for r in out) / 70
    assert share["edge"] == 0 and share["noise"] > 0.2


def test_granger_equals_plain_regressions(spark):
    rng = np.random.default_rng(6)
    rows, expected = [], {}
    for code in (1, 2):
        x = rng.normal(size=120)
        y = rng.normal(size=120)
        y[2:] += 0.8 * x[:-2] * (code == 1)
        rows += [(code, i, float(y[i]), *[float(v[i - k]) if i >= k else None for v in (y, x) for k in (1, 2, 3)]) for i in range(120)]
        for lag in (1, 2, 3):
            target = y[lag:]
            own = np.column_stack([np.ones(len(target)), *[y[lag - k : -k] for k in range(1, lag + 1)]])
            both = np.column_stack([own, *[x[lag - k : -k] for k in range(1, lag + 1)]])
            r0, r1 = (((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum() for m in (own, both))
            expected[code, lag] = (len(target), (r0 - r1) / lag / (r1 / (len(target) - 2 * lag - 1)))
    df = spark.createDataFrame(rows, "code long, i int, y double, y1 double, y2 double, y3 double, x1 double, x2 double, x3 double")
    got = {(r.code, r.lag): r for r in stats.granger(df, "code", 3).collect()}
    assert got.keys() == expected.keys() and all((got[k].n, got[k].f) == pytest.approx(v) for k, v in expected.items())
    assert got[1, 2].p < 1e-6 and got[1, 1].p > 1e-4 and got[2, 2].p > 0.01


def test_tail_of_f_at_known_points():
    # two degrees of freedom have a closed form
    for f, d in ((0.5, 10.0), (3.0, 40.0), (25.0, 7.0), (0.0, 5.0)):
        assert stats.f_tail(np.array([f]), np.array([2.0]), np.array([d]))[0] == pytest.approx((1 + 2 * f / d) ** (-d / 2))
    # 5 % points of F(1, 10) and F(3, 20)
    assert stats.f_tail(np.array([4.9646, 3.0984]), np.array([1.0, 3.0]), np.array([10.0, 20.0])) == pytest.approx([0.05, 0.05], abs=1e-5)


@pytest.mark.parametrize("by", [None, "g"])
def test_quantiles_equal_sorted_ones(spark, by):
    rng = np.random.default_rng(7)
    rows = [("a", float(v)) for v in rng.normal(size=900)] + [("b", 3.0)] * 500 + [("b", float(v)) for v in rng.integers(0, 9, 30)] + [("c", 1.5), ("d", None), (None, 2.0), (None, 4.0)]
    shares = [0.0, 0.01, 0.5, 0.973, 1.0]
    out = select.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", shares, by, slices=16).collect()
    groups = {None: [x for _, x in rows if x is not None]} if by is None else {g: [x for h, x in rows if h == g and x is not None] for g in ("a", "b", "c", None)}
    assert {(None if by is None else r.g): r.q for r in out} == {g: pytest.approx(np.quantile(v, shares).tolist()) for g, v in groups.items()}


def test_shards_merge_and_changed_ones_are_refused(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = [(c, dt.date(2020, m, 3), float(c * m)) for c in (1, 2) for m in (1, 2, 3)]
    df = lambda r: spark.createDataFrame(r, "code long, date date, close double")
    files.append_months(df(rows), path, ["code", "date"])
    before = {r.yyyymm: r.checksum for r in files.read_index(spark, path).collect()}
    files.append_months(df([(1, dt.date(2020, 2, 3), 99.0), (3, dt.date(2020, 2, 4), 7.0)]), path, ["code", "date"])
    after = {r.yyyymm: r.checksum for r in files.read_index(spark, path).collect()}
    assert {k for k in before if before[k] != after[k]} == {202002}
    got = sorted(tuple(r) for r in files.collect_months(spark, path, "2020-02-01", "2020-03-31").collect())
    assert got == [(1, dt.date(2020, 2, 3), 99.0), (1, dt.date(2020, 3, 3), 3.0), (2, dt.date(2020, 2, 3), 4.0), (2, dt.date(2020, 3, 3), 6.0), (3, dt.date(2020, 2, 4), 7.0)]
    # another schema: the month is written anew
    spark.createDataFrame([(5, dt.date(2020, 1, 9), 1.0)], "code int, date date, close double").coalesce(1).write.mode("overwrite").parquet(f"{path}/shards/yyyymm=202003")
    with pytest.raises(ValueError, match="202003"):
        files.collect_months(spark, path, "2020-02-01", "2020-03-31")
    assert files.collect_months(spark, path, "2020-01-01", "2020-02-28").count() == 5


def test_adjusted_quotes_come_first(spark):
    raw = spark.createDataFrame([("7", "2020-01-02", "10", " 5 ", "8", "x"), ("8", "2020-01-02", "10", "-", "---", None)], "Code string, Date string, Close string, AdjustmentClose string, High string, Volume string")
    got = [(r.code, r.close, r.high, r.volume, r.open, r.factor) for r in files.parse_quotes(raw).orderBy("code").collect()]
    assert got == [(7, 5.0, 8.0, None, None, None), (8, 10.0, None, None, None, None)]
