"""Networks used by several tests, and statistics by brute force over a Python edge set."""

from __future__ import annotations

import itertools
import math

from arcweave.network import Network

# Two published seven-vertex networks and their attributes, for which statistics are pinned.
UND = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (2, 5), (5, 6), (1, 5)]
DIR = [(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (1, 5), (5, 6), (6, 2)]
GROUP = ["A", "A", "B", "B", "A", "B", "A"]
AGE = [20.0, 35.0, 28.0, 51.0, 42.0, 33.0, 60.0]


def small(spark, directed, **more):
    return Network.from_edges(spark, 7, DIR if directed else UND, directed, {"group": GROUP, "age": AGE}, **more)


def geo(s, a=0.5):
    return math.exp(a) * (1 - (1 - math.exp(-a)) ** s)


def brute(name, edges, n, directed, group=None, age=None):
    """Statistics straight from their definitions."""
    v = range(1, n + 1)
    e = set(edges) if directed else {(min(x), max(x)) for x in edges}
    tie = (lambda i, j: (i, j) in e) if directed else (lambda i, j: (min(i, j), max(i, j)) in e)
    out = {i: sum(tie(i, j) for j in v if j != i) for i in v}
    into = {j: sum(tie(i, j) for i in v if j != i) for j in v}
    either = lambda i, j: tie(i, j) or tie(j, i)
    sp = {
        "OTP": lambda a, b: sum(tie(a, k) and tie(k, b) for k in v if k not in (a, b)),
        "ITP": lambda a, b: sum(tie(b, k) and tie(k, a) for k in v if k not in (a, b)),
        "OSP": lambda a, b: sum(tie(a, k) and tie(b, k) for k in v if k not in (a, b)),
        "ISP": lambda a, b: sum(tie(k, a) and tie(k, b) for k in v if k not in (a, b)),
        "union": lambda a, b: sum(either(a, k) and either(k, b) for k in v if k not in (a, b)),
    }
    kind, _, t = name.partition(":")
    if kind == "edges":
        return len(e)
    if kind == "mutual":
        return sum((j, i) in e for i, j in e) / 2
    if kind == "triangle":
        if not directed:
            return sum(tie(i, j) and tie(j, k) and tie(i, k) for i, j, k in itertools.combinations(v, 3))
        trans = sum(tie(i, j) and tie(i, k) and tie(j, k) for i, j, k in itertools.permutations(v, 3))
        return trans + sum(tie(i, j) and tie(j, k) and tie(k, i) for i, j, k in itertools.permutations(v, 3)) / 3
    if kind == "kstar":
        return sum(math.comb(out[i], int(t)) for i in v)
    if kind == "twopath":
        return sum(tie(i, k) and tie(k, j) for i, k, j in itertools.permutations(v, 3)) / (1 if directed else 2)
    if kind == "gwdegree" or kind == "gwodeg":
        return sum(geo(out[i]) for i in v)
    if kind == "gwideg":
        return sum(geo(into[i]) for i in v)
    if kind in ("degree", "odegree"):
        return sum(out[i] == int(t) for i in v)
    if kind == "idegree":
        return sum(into[i] == int(t) for i in v)
    if kind == "gwesp":
        return sum(geo(sp[t if directed else "union"](i, j)) for i, j in e)
    if kind == "gwdsp":
        pairs = itertools.permutations(v, 2) if directed and t in ("OTP", "ITP") else itertools.combinations(v, 2)
        return sum(geo(sp[t if directed else "union"](i, j)) for i, j in pairs)
    g, a = (lambda i: group[i - 1]), (lambda i: age[i - 1])
    each = {
        "nodefactor": lambda i, j: (g(i) == t) + (g(j) == t),
        "nodecov": lambda i, j: a(i) + a(j),
        "nodecovlog": lambda i, j: math.log1p(a(i)) + math.log1p(a(j)),
        "nodecovsqrt": lambda i, j: math.sqrt(a(i)) + math.sqrt(a(j)),
        "nodematch": lambda i, j: g(i) is not None and g(i) == g(j) and (not t or g(i) == t),
        "nodemismatch": lambda i, j: g(i) is not None and g(j) is not None and g(i) != g(j),
        "absdiff": lambda i, j: abs(a(i) - a(j)) ** float(t or 1),
        "mix": lambda i, j: (g(i), g(j)) == tuple(t.split(".")) or not directed and (g(j), g(i)) == tuple(t.split(".")),
        "edgecov": lambda i, j: i * j % 7,
    }
    return sum(each[kind](i, j) for i, j in e)
