"""Model tables from elsewhere, and ablation in one fit."""

import random

import pytest
from pyspark.sql import functions as F

from papersieve.constants import FIXTURE_TREE
from papersieve.operators import explain as XP
from papersieve.operators.tree import fixture_nodes
from papersieve.plans import training as TRN
from papersieve.sources.models import adopt, nodes_from_arrays

from .brute import cart_brute

NAMES = ["I01", "I04", "I13", "I16"]


def facts(nodes):
    """Leaf depths by class counts and critical nodes by feature."""
    key = nodes.select("node_id", F.struct("n0", "n1").alias("k"))
    depth = {tuple(r.k): r.depth for r in XP.leaf_depth(nodes).join(key, "node_id").collect()}
    critical = {tuple(r.k): (r.feature, r.risk_if_0, r.risk_if_1, r.is_critical)
                for r in XP.critical_nodes(nodes).join(key, "node_id").collect()}
    return depth, critical


def permuted(nodes, seed=1):
    ids = [r.node_id for r in nodes.select("node_id").collect()]
    new = random.Random(seed).sample(range(500, 900), len(ids))
    table = F.create_map(*[x for a, b in zip(ids, new) for x in (F.lit(a), F.lit(b))])
    return nodes.drop("depth").withColumns({c: F.when(F.col(c) >= 0, table[F.col(c)]).otherwise(-1)
                                            for c in ("node_id", "left_id", "right_id")})


def test_permuted_table_gives_the_same_facts(spark):
    nodes = fixture_nodes(spark)
    own = adopt(permuted(nodes))
    assert facts(own) == facts(nodes)
    root = own.where("depth = 0").collect()
    assert len(root) == 1 and root[0].node_id == 0 and root[0].feature == "I16"
    two = permuted(nodes).unionByName(permuted(nodes.withColumn("tree_id", F.lit(1)), 2))
    assert adopt(two).where("depth = 0").count() == 2


def test_arrays_of_children(spark):
    rows = {n: r for n, *r in FIXTURE_TREE}
    order = sorted(rows)
    inner = [rows[n][0] is not None for n in order]
    tree = spark.createDataFrame([(
        "r", 0, [rows[n][1] for n in order], [rows[n][2] for n in order],
        [NAMES.index(rows[n][0]) if i else -2 for n, i in zip(order, inner)],
        [0.5 if i else -2.0 for i in inner], [float(rows[n][3]) for n in order],
        [float(rows[n][4]) for n in order])],
        "run_id string, tree_id int, children_left array<int>, children_right array<int>, "
        "feature array<int>, threshold array<double>, n0 array<double>, n1 array<double>")
    nodes = nodes_from_arrays(tree, NAMES)
    assert {(r.node_id, r.feature, r.left_id, r.right_id) for r in nodes.collect()} == {
        (n, f, l, r) for n, f, l, r, _a, _b in FIXTURE_TREE}
    assert facts(adopt(nodes)) == facts(fixture_nodes(spark))


@pytest.mark.parametrize("broken", ["shared", "missing", "loop", "two_roots", "repeated"])
def test_what_is_no_tree_raises(spark, broken):
    kind = "run_id string, tree_id int, node_id long, left_id long, right_id long"
    rows = {"shared": [(0, 1, 2), (1, 3, 3), (2, -1, -1), (3, -1, -1)],
            "missing": [(0, 1, 9), (1, -1, -1)],
            "loop": [(0, 1, 2), (1, -1, -1), (2, -1, -1), (7, 8, 8), (8, 7, 7)],
            "two_roots": [(0, 1, 2), (1, -1, -1), (2, -1, -1), (5, -1, -1)],
            "repeated": [(0, 1, 2), (1, -1, -1), (1, -1, -1), (2, -1, -1)]}[broken]
    with pytest.raises(ValueError, match="not trees"):
        adopt(spark.createDataFrame([("r", 0, *r) for r in rows], kind))


def test_ablation_equals_separate_fits(spark):
    draw = random.Random(4)
    names = ["a", "b", "c"]
    rows = []
    for i in range(200):
        x = [float(draw.random() < .4) for _ in names]
        rows.append((i, int(x[0] and (x[1] or draw.random() < .3)), i % 5, *x))
    df = spark.createDataFrame(rows, ["paper_id", "label", "fold", *names])
    got = {r.removed: r for r in TRN.ablation(df, names, {"criterion": "gini"}).collect()}
    for removed in [None, *names]:
        use = [n for n in names if n != removed]
        recalls = []
        for fold in range(5):
            tree = cart_brute([({n: r[3 + names.index(n)] for n in use}, r[1]) for r in rows
                               if r[2] != fold], use, "gini", None, 2, 1)
            tp = pos = 0
            for r in rows:
                if r[2] == fold and r[1] == 1:
                    node = 0
                    while tree[node][0] is not None:
                        x = r[3 + names.index(tree[node][0])]
                        node = 2 * node + (1 if x <= tree[node][1] else 2)
                    pos += 1
                    tp += tree[node][3] / (tree[node][2] + tree[node][3]) >= .5
            recalls.append(tp / pos)
        assert abs(got[removed].mean_recall - sum(recalls) / 5) < 1e-12
    ranked = sorted((r for r in got.values() if r.removed), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == [1, 2, 3] and ranked[0].recall_lost >= ranked[-1].recall_lost
