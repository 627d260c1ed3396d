"""Brute-force reference implementations on small fixtures (pure Python)."""

from collections import Counter


def smoten_brute(rows, features, k=5):
    """rows: list of (features tuple of 0/1 floats, label).  Returns a
    Counter of synthetic patterns (as tuples) with their draw counts."""
    n1 = sum(1 for _, y in rows if y == 1)
    n0 = len(rows) - n1
    mino = 1 if n1 <= n0 else 0
    n_min, n_new = min(n0, n1), abs(n0 - n1)
    # P(1 | f = v) over all rows
    p1 = {}
    for i in range(len(features)):
        for v in (0.0, 1.0):
            ys = [y for x, y in rows if x[i] == v]
            if ys:
                p1[(i, v)] = sum(ys) / len(ys)
    cost = []
    for i in range(len(features)):
        a, b = p1.get((i, 0.0)), p1.get((i, 1.0))
        cost.append(0.0 if a is None or b is None else (2 * abs(a - b)) ** 2)
    mins = Counter(x for x, y in rows if y == mino)
    code = lambda x: sum(int(v) << i for i, v in enumerate(x))

    def dist(a, b):
        return sum(c for c, u, v in zip(cost, a, b) if u != v)
    keff = min(k, n_min - 1)
    syn = {}
    for a, m in mins.items():
        cands = []
        for b, mb in mins.items():
            avail = mb - 1 if b == a else mb
            if avail > 0:
                cands.append((dist(a, b), code(b), b, avail))
        cands.sort()
        need, ones = keff, [0.0] * len(features)
        got = 0
        for _d, _c, b, avail in cands:
            take = min(avail, need - got)
            if take <= 0:
                break
            got += take
            for i, v in enumerate(b):
                ones[i] += take * v
        syn[a] = tuple(1.0 if ones[i] > got - ones[i] else 0.0 for i in range(len(features)))
    # largest remainder allocation
    quota = {a: n_new * m / n_min for a, m in mins.items()}
    base = {a: int(q // 1) for a, q in quota.items()}
    left = n_new - sum(base.values())
    order = sorted(mins, key=lambda a: (-(quota[a] - base[a]), code(a)))
    for a in order[:left]:
        base[a] += 1
    out = Counter()
    for a, d in base.items():
        if d > 0:
            out[syn[a]] += d
    return out, mino


def cart_brute(rows, features, criterion="gini", max_depth=None, min_split=2, min_leaf=1):
    """rows: list of (dict features, label).  Heap-numbered node dict:
    node_id -> (feature or None, threshold, n0, n1)."""
    import math

    def imp(n0, n1):
        n = n0 + n1
        if n == 0:
            return 0.0
        p0, p1 = n0 / n, n1 / n
        if criterion == "gini":
            return 1.0 - p0 * p0 - p1 * p1
        return -sum(p * math.log2(p) for p in (p0, p1) if p > 0)
    out = {}

    def grow(node, sub, depth):
        n0 = sum(1 for _, y in sub if y == 0)
        n1 = len(sub) - n0
        parent = imp(n0, n1)
        best = None
        if (parent > 1e-12 and len(sub) >= min_split
                and (max_depth is None or depth < max_depth)):
            for fi, f in enumerate(features):
                vals = sorted({x[f] for x, _ in sub})
                for a, b in zip(vals, vals[1:]):
                    t = (a + b) / 2.0
                    left = [(x, y) for x, y in sub if x[f] <= t]
                    right = [(x, y) for x, y in sub if x[f] > t]
                    if len(left) < min_leaf or len(right) < min_leaf:
                        continue
                    l0 = sum(1 for _, y in left if y == 0)
                    r0 = sum(1 for _, y in right if y == 0)
                    g = (parent - len(left) / len(sub) * imp(l0, len(left) - l0)
                         - len(right) / len(sub) * imp(r0, len(right) - r0))
                    key = (-round(g, 12), fi, t)
                    if best is None or key < best[0]:
                        best = (key, f, t, left, right)
        if best is None:
            out[node] = (None, None, n0, n1)
            return
        _k, f, t, left, right = best
        out[node] = (f, t, n0, n1)
        grow(2 * node + 1, left, depth + 1)
        grow(2 * node + 2, right, depth + 1)
    grow(0, rows, 0)
    return out
