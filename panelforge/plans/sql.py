"""SQL texts of the frames that the oracles read, and of rolling expressions."""

from __future__ import annotations

import re

#: Added before numbers are rounded to six places, so that no value stands on a decimal tie.
SHIFT = 1.7e-9

FRAMES = {
    "trades": ("""SELECT l_suppkey AS code, l_partkey AS part, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
  l_quantity AS quantity, l_extendedprice AS amount, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""", ()),
    "bars": ("""SELECT code, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
  sum(quantity) AS volume, sum(amount) AS turnover FROM trades GROUP BY code, date""", ("trades",)),
    "dim": ("SELECT s_suppkey AS code, s_nationkey AS sector, s_acctbal AS balance, n_regionkey AS market FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey", ()),
    "panel": ("SELECT bars.*, dim.sector, dim.balance, dim.market FROM bars LEFT JOIN dim USING (code)", ("bars", "dim")),
    "market": ("SELECT date, avg(price) AS m_close FROM trades GROUP BY date", ("trades",)),
    "calendar": ("SELECT date, row_number() OVER (ORDER BY date) AS idx, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM trades)", ("trades",)),
    "dense": ("""SELECT code, calendar.date, CASE WHEN h.i = h.idx THEN ln(close / before) ELSE 0 END AS r FROM (
  SELECT code, close, before, idx, unnest(range(idx, upto + 1)) AS i FROM (
    SELECT code, close, lag(close) OVER w AS before, idx, coalesce(lead(idx) OVER w - 1, (SELECT max(idx) FROM calendar)) AS upto
    FROM bars JOIN calendar USING (date) WINDOW w AS (PARTITION BY code ORDER BY date)) WHERE before IS NOT NULL) h JOIN calendar ON calendar.idx = h.i""", ("bars", "calendar")),
    "snapshots": ("""SELECT (o_custkey - 1) % (SELECT count(*) FROM supplier) + 1 AS code, CAST(o_orderdate AS DATE) AS published, o_orderkey AS rec,
  o_totalprice AS amount, o_orderstatus AS status, o_orderpriority AS priority FROM orders""", ()),
    "ev": ("SELECT event_id AS eid, user_id AS id, ts, event_type AS type, value, props FROM events", ()),
    "pred": ("""SELECT code, date, sector, market, close, volume, turnover, label, ret, set, level, step,
  ((code * 37 + date_diff('day', DATE '1995-01-01', date) * 11 * set) % 101) / 101.0::DOUBLE + 0.1::DOUBLE * coalesce(sign(label), 0) AS score
  FROM (SELECT *, lead(close) OVER w / close - 1 AS label, close / lag(close) OVER w - 1 AS ret, lead(level) OVER w / level - 1 AS step
  FROM (SELECT *, CASE WHEN count(*) OVER r = 60 THEN sum(turnover) OVER r / sum(volume) OVER r END AS level FROM panel WINDOW r AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY code ORDER BY date)), (VALUES (1), (2), (3)) s(set)
  WHERE label IS NOT NULL""", ("panel",)),
}


def frames(names: list[str]) -> str:
    found: dict[str, str] = {}

    def add(name: str) -> None:
        text, needs = FRAMES[name]
        for n in needs:
            add(n)
        found[name] = text

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({t})" for n, t in found.items())


def whole(body: str, keys: list[str], values: list[str], uses: list[str]) -> str:
    """The oracle of a body: a SELECT, or further frames before it, each 'name AS (...),'. Numbers are rounded to six places."""
    picked = ", ".join([*keys, *[f"round(CAST({v} AS DOUBLE) + {SHIFT!r}, 6) + 0.0 AS {v}" for v in values]])
    body = re.sub(r";;\s*,", ",", body.strip())
    before, _, last = body.rpartition(";;")
    parts = [p for p in (frames([u for u in uses if u in FRAMES]), before.strip().rstrip(",")) if p]
    return f"WITH RECURSIVE {', '.join(parts) + ', ' if parts else ''}result AS ({last.strip()})\nSELECT {picked} FROM result"


def over(first: int | str, last: int | str, by: str = "code", order: str = "date") -> str:
    def edge(n) -> str:
        if n == "all":
            return "UNBOUNDED PRECEDING"
        if n == "end":
            return "UNBOUNDED FOLLOWING"
        return "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"

    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {edge(first)} AND {edge(last)})"


def roll(f: str, x: str, n: int, least: int | None = None, by: str = "code", order: str = "date", left: bool = False) -> str:
    """f with {} for x, or the name of an aggregate, over the last n rows (left: the n before), null with fewer than least values."""
    o = over(-n, -1, by, order) if left else over(-(n - 1), 0, by, order)
    call = f.replace("{}", x) if "{}" in f else f"{f}({x})"
    return f"CASE WHEN count({x}) OVER {o} >= {n if least is None else least} THEN {call} OVER {o} END"


def lroll(f: str, x: str, n: int, least: int | None = None, by: str = "code", order: str = "date") -> str:
    return roll(f, x, n, least, by, order, left=True)


def lag(x: str, n: int = 1, by: str = "code", order: str = "date") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def lead(x: str, n: int = 1, by: str = "code", order: str = "date") -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def z(x: str, n: int, least: int, eps: str = "1e-8", left: bool = False) -> str:
    return f"({x} - {roll('avg', x, n, least, left=left)}) / ({roll('stddev_samp', x, n, least, left=left)} + {eps})"


def average_rank(x: str, keys: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE END"


def rank01(x: str, keys: str) -> str:
    n = f"count({x}) OVER (PARTITION BY {keys})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = 1 THEN 0.5 ELSE ({average_rank(x, keys)} - 1) / nullif({n} - 1, 0) END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({low}, least({high}, {x})) END"


def smooth(source: str, specs: dict[str, tuple[str, float]], name: str = "sm") -> str:
    """Frames that end in name: source with exponential means out = (x, alpha), from the first value on; nulls keep the last one."""
    start = ", ".join(f"CAST({x} AS DOUBLE) AS {o}" for o, (x, _) in specs.items())
    step = ", ".join(f"CASE WHEN s.{x} IS NULL THEN r.{o} WHEN r.{o} IS NULL THEN s.{x} ELSE {a} * s.{x} + (1 - {a}) * r.{o} END" for o, (x, a) in specs.items())
    return (
        f"{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM {source}), "
        f"{name}_r AS (SELECT code, rn, {start} FROM {name}_n WHERE rn = 1 UNION ALL SELECT s.code, s.rn, {step} FROM {name}_r r JOIN {name}_n s ON s.code = r.code AND s.rn = r.rn + 1), "
        f"{name} AS (SELECT n.* EXCLUDE (rn), r.* EXCLUDE (code, rn), n.rn AS rn FROM {name}_n n JOIN {name}_r r ON n.code = r.code AND n.rn = r.rn)"
    )


def solved(name: str, source: str, keys: str, n: int) -> str:
    """Recursive frames that end in name: the rows of source(keys, m), m being n rows of n + 1 numbers, with the solution b of that system of equations."""
    step = "list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)"
    return f"{name}_g AS (SELECT {keys}, 1 AS k, m FROM {source} UNION ALL SELECT {keys}, k + 1, {step} FROM {name}_g WHERE k <= {n}), {name} AS (SELECT {keys}, list_transform(m, lambda r: r[{n + 1}]) AS b FROM {name}_g WHERE k = {n + 1})"
