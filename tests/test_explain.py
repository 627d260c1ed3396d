from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from papersieve.operators import explain as X
from papersieve.operators.tree import fixture_nodes

FE = ["I01", "I10", "I13", "I16", "I17", "I04", "I05", "I07"]


def test_critical_nodes_fixture(spark):
    got = {r["node_id"]: r for r in X.critical_nodes(fixture_nodes(spark)).collect()}
    assert set(got) == {0, 1, 2, 6}
    assert got[0]["risk_if_0"] == 1.0 and round(got[0]["risk_if_1"], 4) == 0.3571
    assert got[1]["risk_if_0"] == 1.0 and got[1]["risk_if_1"] == 1.0
    assert got[2]["risk_if_0"] == 1.0 and got[2]["risk_if_1"] == 0.25
    assert got[6]["risk_if_0"] == 0.0 and got[6]["risk_if_1"] == 1.0
    assert all(r["is_critical"] for r in got.values())


def test_leaf_depth_fixture(spark):
    d = sorted(r["depth"] for r in X.leaf_depth(fixture_nodes(spark)).collect())
    assert d == [2, 2, 2, 3, 3] and sum(d) / len(d) == 2.4


def _v_brute(nodes, x, S):
    by = {n["node_id"]: n for n in nodes}

    def go(i):
        n = by[i]
        if n["feature"] is None:
            return n["n1"] / (n["n0"] + n["n1"])
        f = n["feature"]
        if f in S:
            return go(n["left_id"] if x[f] <= n["threshold"] else n["right_id"])
        l, r = by[n["left_id"]], by[n["right_id"]]
        c = n["n0"] + n["n1"]
        return ((l["n0"] + l["n1"]) / c) * go(n["left_id"]) + ((r["n0"] + r["n1"]) / c) * go(n["right_id"])
    return go(0)


def test_shap_matches_brute_force_and_sums(spark):
    nodes_df = fixture_nodes(spark)
    nodes = [r.asDict() for r in nodes_df.collect()]
    rows = [dict(zip(FE, v)) for v in ([1, 0, 1, 1, 0, 0, 0, 0], [0, 1, 0, 0, 1, 1, 0, 1],
                                       [1, 1, 1, 0, 0, 0, 1, 0])]
    df = spark.createDataFrame([tuple(float(r[f]) for f in FE) for r in rows], ", ".join(f"{f} double" for f in FE))
    got = {tuple(r[f] for f in FE): r for r in X.shap_values(df, nodes_df, FE).collect()}
    used = ["I01", "I13", "I16", "I04"]
    m = len(used)
    for x in rows:
        key = tuple(float(x[f]) for f in FE)
        r = got[key]
        for f in used:
            others = [g for g in used if g != f]
            phi = 0.0
            for s in range(m):
                for S in combinations(others, s):
                    w = factorial(s) * factorial(m - s - 1) / factorial(m)
                    phi += w * (_v_brute(nodes, x, set(S) | {f}) - _v_brute(nodes, x, set(S)))
            assert abs(r["phi_" + f] - phi) < 1e-12
        total = r["base_value"] + sum(r["phi_" + f] for f in FE)
        assert abs(total - r["prediction"]) < 1e-12


def test_heap_ancestors_equal_join_loop(spark):
    """Heap-numbered copy of the fixture tree: the arithmetic ancestors equal
    the join loop's, and critical nodes are unchanged by the renumbering."""
    fx = fixture_nodes(spark)
    heap = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 13, 8: 14}
    m = F.create_map(*[F.lit(x) for kv in heap.items() for x in kv])
    h = fx.select(*[(F.when(F.col(c) >= 0, F.element_at(m, F.col(c))).otherwise(F.col(c)).alias(c)
                     if c in ("node_id", "left_id", "right_id") else F.col(c)) for c in fx.columns])
    if "depth" not in h.columns:
        depth = F.create_map(*[F.lit(x) for kv in {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2,
                                                   13: 3, 14: 3}.items() for x in kv])
        h = h.withColumn("depth", F.element_at(depth, F.col("node_id")))
    assert X.is_heap(h) and not X.is_heap(fx)
    fast = {tuple(r.asDict().items()) for r in X.heap_ancestors(h).collect()}
    loop_src = h.drop("depth")  # no depth column: the join loop runs
    loop = {tuple(r.asDict().items()) for r in X.ancestors(loop_src, max_depth=3).collect()}
    assert fast == loop and len(fast) == 16
    a = {r["node_id"]: (r["risk_if_0"], r["risk_if_1"]) for r in X.critical_nodes(fx).collect()}
    b = {r["node_id"]: (r["risk_if_0"], r["risk_if_1"]) for r in X.critical_nodes(h).collect()}
    assert a == b


def test_shap_over_many_features_and_trees(spark):
    """29 columns, two trees: values add up to the mean prediction, and equal
    a sum over all coalitions of the few features in use."""
    from itertools import combinations
    from math import factorial

    from papersieve.operators.tree import NODE_SCHEMA
    cols = [f"Q{i:02d}" for i in range(29)]
    rows = [("m", 0, 0, 0, "Q00", 0.5, 1, 2, 60.0, 40.0, 0.0), ("m", 0, 1, 1, "Q07", 0.5, 3, 4, 45.0, 15.0, 0.0),
            ("m", 0, 2, 1, None, None, -1, -1, 15.0, 25.0, 0.0), ("m", 0, 3, 2, None, None, -1, -1, 40.0, 2.0, 0.0),
            ("m", 0, 4, 2, "Q00", -0.5, 5, 6, 5.0, 13.0, 0.0), ("m", 0, 5, 3, None, None, -1, -1, 1.0, 3.0, 0.0),
            ("m", 0, 6, 3, None, None, -1, -1, 4.0, 10.0, 0.0),
            ("m", 1, 0, 0, "Q28", 0.5, 1, 2, 50.0, 50.0, 0.0), ("m", 1, 1, 1, None, None, -1, -1, 45.0, 10.0, 0.0),
            ("m", 1, 2, 1, None, None, -1, -1, 5.0, 40.0, 0.0)]
    nodes = spark.createDataFrame(rows, NODE_SCHEMA)
    pats = spark.createDataFrame([tuple(float((i >> (j % 3)) & 1) for j in range(29)) for i in range(8)], cols)
    table = {(r[1], r[2]): r for r in rows}

    def value(tree, node, x, known):
        _, _, _, _, f, thr, left, right, n0, n1, _ = table[tree, node]
        if f is None:
            return n1 / (n0 + n1)
        if f in known:
            return value(tree, left if x[f] <= thr else right, x, known)
        cover = {c: table[tree, c][8] + table[tree, c][9] for c in (left, right)}
        return sum(cover[c] / (n0 + n1) * value(tree, c, x, known) for c in (left, right))

    used = ["Q00", "Q07", "Q28"]
    for r in X.shap_values(pats, nodes, cols).collect():
        assert abs(r["base_value"] + sum(r["phi_" + c] for c in cols) - r["prediction"]) < 1e-9
        for i in cols:
            want = 0.0
            if i in used:
                rest = [u for u in used if u != i]
                for k in range(3):
                    for s in combinations(rest, k):
                        w = factorial(k) * factorial(2 - k) / factorial(3)
                        want += w * sum(value(t, 0, r, {*s, i}) - value(t, 0, r, set(s)) for t in (0, 1)) / 2
            assert abs(r["phi_" + i] - want) < 1e-9
