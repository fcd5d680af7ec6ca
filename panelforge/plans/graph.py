"""Correlation graphs and neighbours (G rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs
from ..sources.tables import Data
from .registry import query
from .sql import average_rank as saverage_rank

# Windows are SPAN days before a date and the date; a code and a pair need LEAST dates, an edge an absolute correlation of EDGE.
SPAN, LEAST, EDGE = 60, 20, 0.3


@query("g1_correlation_graph", "date code degree", "mean_abs max_abs",
       f"""x AS MATERIALIZED (SELECT * FROM dense),
own AS MATERIALIZED (SELECT code, date, count(*) OVER w AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM x WINDOW w AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL {SPAN} DAYS PRECEDING AND CURRENT ROW)),
fit AS MATERIALIZED (SELECT * FROM own WHERE n >= {LEAST} AND s > {graphs.FLAT!r}),
pr AS (SELECT a.code AS src, b.code AS dst, a.date, count(*) OVER w AS n, sum(a.r * b.r) OVER w AS xy, sum(a.r) OVER w AS sx, sum(b.r) OVER w AS sy FROM x a JOIN x b ON a.date = b.date AND a.code < b.code WINDOW w AS (PARTITION BY a.code, b.code ORDER BY a.date RANGE BETWEEN INTERVAL {SPAN} DAYS PRECEDING AND CURRENT ROW)),
ed AS (SELECT src, dst, p.date, abs((xy - a.m * sy - b.m * sx + p.n * a.m * b.m) / ((p.n - 1) * a.s * b.s)) AS w FROM pr p JOIN fit a ON a.code = src AND a.date = p.date JOIN fit b ON b.code = dst AND b.date = p.date WHERE p.n >= {LEAST}),
st AS MATERIALIZED (SELECT src, dst, date, w FROM ed WHERE round(w, 9) >= {EDGE}),
dg AS (SELECT date, code, count(*) AS degree, avg(w) AS mean_abs, max(w) AS max_abs FROM (SELECT date, src AS code, w FROM st UNION ALL SELECT date, dst, w FROM st) GROUP BY date, code) ;;
SELECT c.next_date AS date, f.code, coalesce(degree, 0) AS degree, coalesce(mean_abs, 0) AS mean_abs, coalesce(max_abs, 0) AS max_abs FROM fit f JOIN calendar c ON c.date = f.date LEFT JOIN dg ON dg.date = f.date AND dg.code = f.code WHERE c.next_date IS NOT NULL""", "dense calendar")  # fmt: skip
def g1(d: Data):
    """Degrees of every date, visible on the next one."""
    following = d.calendar.where("next_date is not null").select("date", "next_date")
    return graphs.rolling_degrees(d.dense, SPAN, LEAST, EDGE).join(following, "date").drop("date").withColumnRenamed("next_date", "date")


# The other rows work on the graphs of the last date of each month.
WINDOWS = f"""me AS (SELECT max(date) AS win FROM calendar GROUP BY year(date), month(date)), x AS MATERIALIZED (SELECT win, code, date, r FROM dense JOIN me ON date <= win AND date >= win - {SPAN})"""
FLAT = f"stddev_pop(a.r) > {graphs.FLAT!r} AND stddev_pop(b.r) > {graphs.FLAT!r}"
MOMENTS = WINDOWS + f""", pr AS (SELECT a.win, a.code AS src, b.code AS dst, count(*) AS n, corr(a.r, b.r) AS w FROM x a JOIN x b ON a.win = b.win AND a.date = b.date AND a.code < b.code GROUP BY a.win, a.code, b.code HAVING count(*) >= {LEAST} AND {FLAT}),
ed AS MATERIALIZED (SELECT win, src, dst, n, w FROM pr WHERE round(abs(w), 9) >= {EDGE}), sy AS MATERIALIZED (SELECT win, src, dst, n, w FROM ed UNION ALL SELECT win, dst, src, n, w FROM ed)"""
USES = "dense calendar"


def returns_by_window(d: Data):
    ends = d.calendar.groupBy(F.year("date"), F.month("date")).agg(F.max("date").alias("win"))
    return graphs.windows(graphs.stored(d.dense), ends.select("win"), SPAN)


def graph(d: Data):
    return graphs.Returns(returns_by_window(d), LEAST, EDGE)


HALF_LIFE, SHRINK = 20, 0.1


@query("g2_spearman_graph", "win src dst n kind", "w",
       WINDOWS + f""", k AS (SELECT win, code, date, {saverage_rank('r', 'win, code')} AS r FROM x),
sp AS (SELECT a.win, a.code AS src, b.code AS dst, count(*) AS n, 'spearman' AS kind, corr(a.r, b.r) AS w FROM k a JOIN k b ON a.win = b.win AND a.date = b.date AND a.code < b.code GROUP BY a.win, a.code, b.code HAVING count(*) >= {LEAST} AND {FLAT}),
ws AS (SELECT a.win, a.code AS src, b.code AS dst, count(*) AS n, sum(f) AS s, sum(f * a.r) / sum(f) AS mx, sum(f * b.r) / sum(f) AS my, sum(f * a.r * b.r) / sum(f) AS xy, sum(f * a.r * a.r) / sum(f) AS xx, sum(f * b.r * b.r) / sum(f) AS yy
  FROM (SELECT *, pow(2::DOUBLE, (date - win) / {HALF_LIFE}::DOUBLE) AS f FROM x) a JOIN x b ON a.win = b.win AND a.date = b.date AND a.code < b.code GROUP BY a.win, a.code, b.code HAVING count(*) >= {LEAST}),
ew AS (SELECT win, src, dst, n, 'weighted' AS kind, {1 - SHRINK!r}::DOUBLE * (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS w FROM ws WHERE xx - mx * mx > {graphs.FLAT**2!r} AND yy - my * my > {graphs.FLAT**2!r}) ;;
SELECT * FROM (SELECT * FROM sp UNION ALL SELECT * FROM ew) WHERE round(abs(w), 9) >= {EDGE}""", USES)  # fmt: skip
def g2(d: Data):
    """Edges by rank correlation, and by exponentially weighted correlation drawn towards zero."""
    return graphs.rank_and_weighted_edges(returns_by_window(d), LEAST, EDGE, HALF_LIFE, SHRINK)


@query("g3_top_k_edges", "win src dst same_sector same_market", "attr",
       MOMENTS + """, t AS (SELECT *, row_number() OVER (PARTITION BY win, src ORDER BY round(abs(w), 9) DESC, dst) AS k FROM sy), u AS (SELECT DISTINCT win, least(src, dst) AS src, greatest(src, dst) AS dst, round(w, 9) AS w FROM t WHERE k <= 3) ;;
SELECT win, src, dst, (w + 1) / 2 AS attr, a.sector = b.sector AS same_sector, a.market = b.market AS same_market FROM u JOIN dim a ON a.code = src JOIN dim b ON b.code = dst""", USES + " dim")  # fmt: skip
def g3(d: Data):
    best = graphs.strongest(returns_by_window(d), LEAST, EDGE, 3)
    kept = best.select("win", F.least("code", "peer").alias("src"), F.greatest("code", "peer").alias("dst"), "w").distinct()
    of = d.dim.select("code", "sector", "market")
    both = kept.join(of.toDF("src", "sa", "ma"), "src").join(of.toDF("dst", "sb", "mb"), "dst")
    return both.select("win", "src", "dst", ((F.col("w") + 1) / 2).alias("attr"), (F.col("sa") == F.col("sb")).alias("same_sector"), (F.col("ma") == F.col("mb")).alias("same_market"))


MEANS = ", mr AS MATERIALIZED (SELECT win, code, avg(r) AS r FROM x GROUP BY win, code)"


def means(x):
    return x.groupBy("win", "code").agg(F.avg("r").alias("r"))


@query("g4_peer_returns", "win code n", "mean var strength",
       MOMENTS + MEANS + ", s AS (SELECT sy.win, src, count(*) AS n, avg(r) AS mean, var_samp(r) AS var, avg(abs(w)) AS strength FROM sy JOIN mr ON mr.win = sy.win AND mr.code = dst GROUP BY sy.win, src) ;; SELECT mr.win, mr.code, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(var, 1) AS var, coalesce(strength, 0) AS strength FROM mr LEFT JOIN s ON s.win = mr.win AND s.src = mr.code", USES)
def g4(d: Data):
    x = returns_by_window(d)
    n, total = F.col("n"), F.col("total")
    spread = F.greatest(F.col("squares") - total * total / n, F.lit(0.0))
    s = graphs.neighbour_sums(x, LEAST, EDGE).select("win", "code", "n", (total / n).alias("mean"), F.try_divide(spread, n - 1).alias("var"), (F.col("strength") / n).alias("strength"))
    return x.select("win", "code").distinct().join(s, ["win", "code"], "left").fillna({"n": 0, "mean": 0.0, "var": 1.0, "strength": 0.0})


@query("g5_degrees", "win code degree isolated", "z centrality neighbour_degree",
       MOMENTS + MEANS + """, dg AS (SELECT mr.win, mr.code, count(sy.dst) AS degree FROM mr LEFT JOIN sy ON sy.win = mr.win AND sy.src = mr.code GROUP BY mr.win, mr.code), nd AS (SELECT sy.win, src, avg(degree) AS nd FROM sy JOIN dg ON dg.win = sy.win AND dg.code = dst GROUP BY sy.win, src) ;;
SELECT dg.win, dg.code, degree, degree = 0 AS isolated, (degree - avg(degree) OVER (PARTITION BY dg.win)) / (stddev_samp(degree) OVER (PARTITION BY dg.win) + 1e-8) AS z, degree / nullif(count(*) OVER (PARTITION BY dg.win) - 1, 0)::DOUBLE AS centrality, nd AS neighbour_degree FROM dg LEFT JOIN nd ON nd.win = dg.win AND nd.src = dg.code""", USES)  # fmt: skip
def g5(d: Data):
    x = returns_by_window(d)
    around = graphs.neighbour_degrees(graphs.Returns(x, LEAST, EDGE))
    degree = x.select("win", "code").distinct().join(around, ["win", "code"], "left").fillna(0, ["degree"])
    w = Window.partitionBy("win")
    return degree.withColumns({"isolated": F.col("degree") == 0, "z": (F.col("degree") - F.avg("degree").over(w)) / (F.stddev_samp("degree").over(w) + 1e-8), "centrality": F.try_divide(F.col("degree"), F.count(F.lit(1)).over(w) - 1)})


@query("g6_clustering", "win code triangles", "clustering density",
       MOMENTS + ", dg AS (SELECT win, src AS code, count(*) AS k FROM sy GROUP BY win, src), tr AS (SELECT a.win, a.src AS code, count(*) AS t FROM sy a JOIN sy b ON a.win = b.win AND a.src = b.src AND a.dst < b.dst JOIN ed e ON e.win = a.win AND e.src = a.dst AND e.dst = b.dst GROUP BY a.win, a.src) ;; SELECT dg.win, dg.code, coalesce(t, 0) AS triangles, coalesce(t, 0) / nullif(k * (k - 1) / 2, 0) AS clustering, 2 * (k + coalesce(t, 0)) / ((k + 1) * k)::DOUBLE AS density FROM dg LEFT JOIN tr ON tr.win = dg.win AND tr.code = dg.code", USES)
def g6(d: Data):
    """Triangles, their share of the pairs of neighbours, and the density of the graph of a code and its neighbours."""
    c, k = graphs.clustering(graph(d)), F.col("k")
    return c.withColumn("density", 2 * (k + F.col("triangles")) / ((k + 1) * k))


LABELS = ", nd AS (SELECT DISTINCT win, src AS code FROM sy), rc AS (SELECT win, code, code AS seen FROM nd UNION SELECT rc.win, rc.code, sy.dst FROM rc JOIN sy ON sy.win = rc.win AND sy.src = rc.seen), lb AS MATERIALIZED (SELECT win, code, min(seen) AS label FROM rc GROUP BY win, code)"


def _within(value: str) -> str:
    return f"{value} / nullif(sum({value}) OVER c, 0) AS share, CASE WHEN stddev_pop({value}) OVER c > 1e-12 THEN ({value} - avg({value}) OVER c) / stddev_pop({value}) OVER c ELSE 0 END AS z"


@query("g7_components", "win code size", "part share z",
       MOMENTS + LABELS + f", dg AS (SELECT win, src AS code, count(*) AS degree FROM sy GROUP BY win, src) ;; SELECT lb.win, lb.code, count(*) OVER c AS size, count(*) OVER c / (count(*) OVER (PARTITION BY lb.win))::DOUBLE AS part, {_within('degree')} FROM lb JOIN dg ON dg.win = lb.win AND dg.code = lb.code WINDOW c AS (PARTITION BY lb.win, label)", USES)
def g7(d: Data):
    """Size of the component, its part of the graph, and the degree within it."""
    links = graphs.stored(graphs.spanning_links(returns_by_window(d), LEAST, EDGE))
    degree = links.groupBy("win", "code").agg(F.sum("degree").alias("degree"))
    return graphs.within(degree, graphs.components(graphs.links_as_edges(links)), "degree").withColumn("part", F.col("size") / F.count(F.lit(1)).over(Window.partitionBy("win")))


ROUNDS = 20
RANKS = ", nn AS MATERIALIZED (SELECT win, src AS code, count(*) AS o, count(*) OVER (PARTITION BY win) AS n FROM sy GROUP BY win, src), ln AS MATERIALIZED (SELECT win, src, dst FROM sy), r0 AS (SELECT *, 1.0::DOUBLE / n AS rank FROM nn)" + "".join(
    f", r{i} AS MATERIALIZED (SELECT nn.*, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM nn LEFT JOIN (SELECT ln.win, dst AS code, sum(r.rank / r.o) AS s FROM ln JOIN r{i - 1} r ON r.win = ln.win AND r.code = ln.src GROUP BY ln.win, dst) g ON g.win = nn.win AND g.code = nn.code)"
    for i in range(1, ROUNDS + 1)
)


@query("g8_pagerank", "win code", "rank share z", MOMENTS + LABELS + RANKS + f" ;; SELECT lb.win, lb.code, rank, {_within('rank')} FROM lb JOIN r{ROUNDS} q ON q.win = lb.win AND q.code = lb.code WINDOW c AS (PARTITION BY lb.win, label)", USES)
def g8(d: Data):
    """PageRank, its share of the component's and its deviations within it."""
    x = returns_by_window(d)
    ranks = graphs.pagerank(graphs.Returns(x, LEAST, EDGE), rounds=ROUNDS)
    return graphs.within(ranks, graphs.components(graphs.links_as_edges(graphs.stored(graphs.spanning_links(x, LEAST, EDGE)))), "rank")


DEPTH = 3
STEPS = ", d1 AS MATERIALIZED (SELECT win, src, dst, 1 AS dist FROM sy)" + "".join(
    f", d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT DISTINCT f.win, f.src, sy.dst, {i} FROM d{i - 1} f JOIN sy ON sy.win = f.win AND sy.src = f.dst WHERE f.dist = {i - 1} AND sy.dst <> f.src AND NOT EXISTS (SELECT 1 FROM d{i - 1} k WHERE k.win = f.win AND k.src = f.src AND k.dst = sy.dst))"
    for i in range(2, DEPTH + 1)
)


@query("g9_core_number", "win code core", "", None, USES)
def g9(d: Data):
    return graphs.core_numbers(graph(d))


@query("g9_closeness", "win code reached", "closeness",
       MOMENTS + STEPS + f", n AS (SELECT win, count(DISTINCT src) AS n FROM sy GROUP BY win), g AS (SELECT win, src AS code, count(*) AS reached, sum(dist) AS far FROM d{DEPTH} GROUP BY win, src) ;; SELECT g.win, code, reached, reached / far::DOUBLE * reached / nullif(n - 1, 0) AS closeness FROM g JOIN n ON n.win = g.win", USES)
def g9_closeness(d: Data):
    """Closeness from a search in breadth of DEPTH steps."""
    return graphs.closeness(graph(d), DEPTH)


NEAR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v), s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])), 9) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS k FROM s)"""


def nearest(d: Data):
    return graphs.nearest(d.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), F.col("vec_id") % 100 == 0, 5)


@query("g10_knn", "vec_id neighbour k", "sim", NEAR + " ;; SELECT vec_id, neighbour, k, sim FROM r WHERE k <= 5", "")
def g10(d: Data):
    return nearest(d)


@query("g10_knn_graph", "src dst", "", NEAR + ", o AS (SELECT vec_id AS src, neighbour AS dst FROM r WHERE k <= 5), e AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o) ;; SELECT src, dst FROM e UNION ALL SELECT vec_id, vec_id FROM v WHERE vec_id NOT IN (SELECT src FROM e)", "")
def g10_graph(d: Data):
    """The graph of the nearest neighbours of the queries: symmetric, and every vector has a degree of one at least."""
    return graphs.symmetric_graph(nearest(d), d.table("embeddings"))


K, SHARE = 5, 0.6
PEERS = f""", sp AS (SELECT a.win, a.code, b.code AS peer, row_number() OVER (PARTITION BY a.win, a.code ORDER BY abs(b.code - a.code), b.code) AS k FROM mr a JOIN dim da ON da.code = a.code JOIN dim db ON db.sector = da.sector AND db.code <> da.code JOIN mr b ON b.win = a.win AND b.code = db.code),
cp AS (SELECT win, src AS code, dst AS peer, row_number() OVER (PARTITION BY win, src ORDER BY round(abs(w), 9) DESC, dst) AS k FROM sy),
f AS (SELECT win, code, peer, k FROM sp WHERE k <= {int(K * SHARE)}), hy AS (SELECT win, code, peer, row_number() OVER (PARTITION BY win, code ORDER BY k) AS k FROM (SELECT * FROM f UNION ALL SELECT cp.win, cp.code, cp.peer, cp.k + {K} FROM cp ANTI JOIN f ON f.win = cp.win AND f.code = cp.code AND f.peer = cp.peer)),
pe AS (SELECT win, code, peer, 'sector' AS kind FROM sp WHERE k <= {K} UNION ALL SELECT win, code, peer, 'correlation' FROM cp WHERE k <= {K} UNION ALL SELECT win, code, peer, 'hybrid' FROM hy WHERE k <= {K}),
g AS (SELECT pe.kind, pe.win, pe.code, o.r, count(*) AS n, avg(t.r) AS peer_mean, stddev_pop(t.r) AS peer_std, avg(CASE WHEN t.r < o.r THEN 1.0 ELSE 0.0 END) AS rank FROM pe JOIN mr t ON t.win = pe.win AND t.code = pe.peer JOIN mr o ON o.win = pe.win AND o.code = pe.code GROUP BY pe.kind, pe.win, pe.code, o.r)"""


@query("g11_peer_sets", "win code kind n", "peer_mean peer_std diff rank",
       MOMENTS + MEANS + PEERS + " ;; SELECT win, code, kind, n, peer_mean, peer_std, rank, CASE WHEN peer_std > 1e-12 THEN (r - peer_mean) / peer_std ELSE 0 END AS diff FROM g", USES + " dim")
def g11(d: Data):
    """Peers by sector (the nearest numbers), by correlation, and both; their statistics beside the code's own return."""
    x = returns_by_window(d)
    of = graphs.stored(means(x))
    named = of.join(d.dim.select("code", "sector"), "code").select("win", "sector", "code")
    sector = graphs.stored(graphs.nearest_numbers(named, ["win", "sector"], K).select("win", "code", "peer", "k"))
    correlated = graphs.stored(graphs.strongest(x, LEAST, EDGE, 2 * K).select("win", "code", "peer", "k"))
    sets = {"sector": sector, "correlation": correlated.where(F.col("k") <= K), "hybrid": graphs.hybrid_peers(sector, correlated, K, SHARE)}
    parts = [peers.select("win", "code", "peer", F.lit(kind).alias("kind")) for kind, peers in sets.items()]
    return graphs.peer_statistics(parts[0].unionByName(parts[1]).unionByName(parts[2]), of)


@query("g12_beta_neighbours", "code neighbour", "weight",
       """b AS (SELECT code, any_value(sector) AS sector, round(median(close) / 1000, 9) AS beta FROM panel GROUP BY code), o AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY beta, code) AS pos FROM b), c AS (SELECT a.code, n.code AS neighbour, abs(a.beta - n.beta) AS dist FROM o a JOIN o n ON a.sector = n.sector AND a.pos <> n.pos AND abs(a.pos - n.pos) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dist, neighbour) AS k FROM c) ;; SELECT code, neighbour, exp(-dist / 0.5) AS weight FROM r WHERE k <= 3""", "panel")  # fmt: skip
def g12(d: Data):
    b = d.panel.groupBy("code").agg(F.max("sector").alias("sector"), F.round(F.percentile("close", 0.5) / 1000, 9).alias("beta"))
    return graphs.rank_neighbours(b, "sector", "beta", 3, 0.5)
