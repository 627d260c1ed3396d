import pytest
from pyspark.sql import functions as F

from papersieve.constants import FEATURE_ORDER as FE
from papersieve.operators.train import configs_df, fit_trees, patterns
from papersieve.plans.catalog import training

from .brute import cart_brute
from .conftest import SF01

CONFIGS = [
    {"criterion": "gini"},
    {"criterion": "entropy", "min_samples_leaf": 5, "min_samples_split": 20},
    {"criterion": "gini", "max_depth": 3, "min_samples_leaf": 2},
]


def test_fit_equals_brute_force_cart(spark):
    t = training(spark, SF01).cache()
    rows = [({f: float(r[f]) for f in FE}, r["label"]) for r in t.collect()]
    runs = [{"run_id": f"r{i}", **c} for i, c in enumerate(CONFIGS)]
    pats = patterns(t, FE)
    allp = None
    for r in runs:  # all configurations grow together, keyed by run_id
        p = pats.withColumn("run_id", F.lit(r["run_id"]))
        allp = p if allp is None else allp.unionByName(p)
    nodes = fit_trees(allp, configs_df(spark, runs), FE).collect()
    for i, c in enumerate(CONFIGS):
        want = cart_brute(rows, FE, c["criterion"], c.get("max_depth"),
                          c.get("min_samples_split", 2), c.get("min_samples_leaf", 1))
        got = {r["node_id"]: (r["feature"], r["threshold"], r["n0"], r["n1"])
               for r in nodes if r["run_id"] == f"r{i}"}
        assert got == want, c


def test_trees_deeper_than_heap_ids(spark, monkeypatch):
    """No depth limit: every child that a node names exists, also past the
    levels numbered as a heap."""
    from papersieve.operators import train as TR
    monkeypatch.setattr(TR, "HEAP_LEVELS", 2)
    rows = [(float(i), i % 2, 1) for i in range(14)]
    df = spark.createDataFrame(rows, "x double, label int, one int")
    cfg = TR.configs_df(spark, [{"run_id": "deep"}])
    nodes = TR.fit_trees(TR.patterns(df, ["x"]).withColumn("run_id", F.lit("deep")), cfg, ["x"])
    table = {r["node_id"]: r for r in nodes.collect()}
    assert max(r["depth"] for r in table.values()) > 3
    for r in table.values():
        if r["feature"] is not None:
            left, right = table[r["left_id"]], table[r["right_id"]]
            assert left["n_samples"] + right["n_samples"] == r["n_samples"]
        else:
            assert r["n0"] == 0 or r["n1"] == 0
    pats = TR.patterns(df, ["x"]).withColumn("run_id", F.lit("deep")).withColumn("tree_id", F.lit(0))
    for r in TR.predict_patterns(pats, nodes, ["x"]).collect():
        assert r["probability"] == r["x"] % 2
