"""DuckDB SQL for the registered queries, written apart from the DataFrame plans."""

from __future__ import annotations

import math

DECAY = 0.5
W = 1 - math.exp(-DECAY)

G1 = """p AS (SELECT user_id, lag(user_id) OVER (ORDER BY ts, event_id) AS prev FROM events WHERE event_type = 'purchase'),
A AS (SELECT DISTINCT prev AS i, user_id AS j FROM p WHERE prev IS NOT NULL AND prev <> user_id),
ec AS (SELECT user_id AS v, event_type AS t, count(*) AS c FROM events GROUP BY 1, 2),
V AS (SELECT v, kind, n_events, mean_value FROM (SELECT v, t AS kind, row_number() OVER (PARTITION BY v ORDER BY c DESC, t) AS k FROM ec) JOIN
  (SELECT user_id AS v, count(*) AS n_events, avg(value) AS mean_value FROM events GROUP BY 1) USING (v) WHERE k = 1),
E AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM A),
"""
DIR = G1 + """adj AS (SELECT i, j FROM A), U AS (SELECT i, j FROM A UNION SELECT j, i FROM A),
deg AS (SELECT v, coalesce(o, 0) AS dout, coalesce(k, 0) AS din, coalesce(o, 0) + coalesce(k, 0) AS d FROM V LEFT JOIN (SELECT i AS v, count(*) AS o FROM A GROUP BY 1) USING (v) LEFT JOIN (SELECT j AS v, count(*) AS k FROM A GROUP BY 1) USING (v)),
arcs AS (SELECT i, j FROM A),
dy AS (SELECT x.v AS i, z.v AS j, (a.i IS NOT NULL)::BIGINT AS y, (b.i IS NOT NULL)::BIGINT AS r FROM V x JOIN V z ON x.v <> z.v LEFT JOIN A a ON a.i = x.v AND a.j = z.v LEFT JOIN A b ON b.i = z.v AND b.j = x.v)"""
UND = G1 + """adj AS (SELECT i, j FROM E UNION ALL SELECT j, i FROM E), U AS (SELECT i, j FROM adj),
deg AS (SELECT v, coalesce(o, 0) AS dout, coalesce(o, 0) AS din, coalesce(o, 0) AS d FROM V LEFT JOIN (SELECT i AS v, count(*) AS o FROM adj GROUP BY 1) USING (v)),
arcs AS (SELECT i, j FROM E),
dy AS (SELECT x.v AS i, z.v AS j, (a.i IS NOT NULL)::BIGINT AS y, (a.i IS NOT NULL)::BIGINT AS r FROM V x JOIN V z ON x.v < z.v LEFT JOIN E a ON a.i = x.v AND a.j = z.v)"""
SP = {
    "OTP": "SELECT x.i AS a, y.j AS b, count(*) AS s FROM adj x JOIN adj y ON x.j = y.i WHERE x.i <> y.j GROUP BY 1, 2",
    "ITP": "SELECT y.j AS a, x.i AS b, count(*) AS s FROM adj x JOIN adj y ON x.j = y.i WHERE x.i <> y.j GROUP BY 1, 2",
    "OSP": "SELECT x.i AS a, y.i AS b, count(*) AS s FROM adj x JOIN adj y ON x.j = y.j WHERE x.i <> y.i GROUP BY 1, 2",
    "ISP": "SELECT x.j AS a, y.j AS b, count(*) AS s FROM adj x JOIN adj y ON x.i = y.i WHERE x.j <> y.j GROUP BY 1, 2",
    "union": "SELECT x.i AS a, y.j AS b, count(*) AS s FROM U x JOIN U y ON x.j = y.i WHERE x.i <> y.j GROUP BY 1, 2",
}
SP["und"] = SP["union"]
WS = f"{math.exp(DECAY)!r} * (1 - pow({W!r}, {{s}}))"
#: Pairs that gain a partner by a tie from i to j, as (near relation, pair).
GAIN = {
    "OTP": [("t.i = dy.j", "dy.i", "t.j"), ("t.j = dy.i", "t.i", "dy.j")],
    "ITP": [("t.i = dy.j", "t.j", "dy.i"), ("t.j = dy.i", "dy.j", "t.i")],
    "OSP": [("t.j = dy.j", "dy.i", "t.i")],
    "ISP": [("t.i = dy.i", "dy.j", "t.j")],
    "union": [("t.i = dy.j", "dy.i", "t.j"), ("t.i = dy.i", "dy.j", "t.j")],
}
GAIN["und"] = GAIN["union"]


def weight(s: str) -> str:
    return WS.format(s=s)


def partner_stat(kind: str, tied: bool) -> str:
    base = UND if kind == "und" else DIR
    if tied:
        return f"WITH {base}, sp AS ({SP[kind]}) SELECT round(coalesce(sum({weight('coalesce(s, 0)')}), 0), 6) AS value FROM arcs LEFT JOIN sp ON a = i AND b = j"
    where = "" if kind in ("OTP", "ITP") else "WHERE a < b"
    return f"WITH {base}, sp AS ({SP[kind]}) SELECT round(coalesce(sum({weight('s')}), 0), 6) AS value FROM sp {where}"


def partner_change(kind: str, tied: bool) -> str:
    base = UND if kind == "und" else DIR
    rel = "U" if kind in ("union", "und") else "adj"
    skip = " AND dy.r = 0" if kind == "union" else ""
    parts = " UNION ALL ".join(f"SELECT dy.i, dy.j, y, {a} AS a, {b} AS b FROM dy JOIN {rel} t ON {on} WHERE {a} <> {b}{skip}" for on, a, b in GAIN[kind])
    parts = f"SELECT * FROM ({parts}) WHERE NOT (a = i AND b = j) AND NOT (a = j AND b = i)"
    if not tied:
        m = "g.*, 1 AS m"
        tie = ""
    elif kind in ("OTP", "ITP", "und"):
        m, tie = "g.*, 1 AS m", "JOIN adj ON adj.i = g.a AND adj.j = g.b"
    else:
        m, tie = "g.*, q.m", "JOIN (SELECT i, j, count(*) AS m FROM (SELECT i, j FROM adj UNION ALL SELECT j, i FROM adj) GROUP BY 1, 2) q ON q.i = g.a AND q.j = g.b"
    own = f"{weight('coalesce(o.s, 0)')} + " if tied else ""
    return f"""WITH {base}, sp AS ({SP[kind]}), g AS ({parts}), x AS (SELECT {m} FROM g {tie}),
gain AS (SELECT x.i, x.j, sum(m * pow({W!r}, coalesce(s, 0) - y)) AS v FROM x LEFT JOIN sp ON sp.a = x.a AND sp.b = x.b GROUP BY 1, 2)
SELECT dy.i, dy.j, round({own}coalesce(gain.v, 0), 6) AS delta FROM dy LEFT JOIN gain ON gain.i = dy.i AND gain.j = dy.j LEFT JOIN sp o ON o.a = dy.i AND o.b = dy.j"""


def stat(base: str, expression: str, source: str) -> str:
    return f"WITH {base} SELECT round(CAST({expression} AS DOUBLE), 6) AS value FROM {source}"


def change(base: str, expression: str, joins: str = "") -> str:
    return f"WITH {base} SELECT dy.i, dy.j, round(CAST({expression} AS DOUBLE), 6) AS delta FROM dy {joins}"


ENDS = "JOIN V vi ON vi.v = {t}.i JOIN V vj ON vj.v = {t}.j"
DEGS = "JOIN deg di ON di.v = dy.i JOIN deg dj ON dj.v = dy.j"
G2 = """buys AS (SELECT c.c_nationkey::BIGINT AS i, s.s_nationkey::BIGINT AS j, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2),
B AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY q DESC, j) AS k FROM buys) WHERE k <= 5),
N AS (SELECT n_nationkey::BIGINT AS v, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"""
G3 = """up AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'),
P3 AS (SELECT DISTINCT x.l_partkey AS i, z.l_partkey AS j FROM up x JOIN up z USING (l_orderkey) WHERE x.l_partkey < z.l_partkey),
S3 AS (SELECT i, j FROM P3 UNION ALL SELECT j, i FROM P3)"""
TRACE = "tr AS (SELECT event_type AS stat, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS draw, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS m FROM events)"
