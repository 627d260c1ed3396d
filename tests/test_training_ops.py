from collections import Counter

from pyspark.sql import functions as F

from papersieve.constants import FEATURE_ORDER as FE
from papersieve.operators import conflicts as CF
from papersieve.operators import split as SP
from papersieve.operators.resample import smoten
from papersieve.operators.train import patterns
from papersieve.plans.catalog import training

from .brute import smoten_brute
from .conftest import SF001, SF01


def test_conflict_report_golden(spark):
    for sf, expect in [(SF001, (16, 2, 0, 3, 63)), (SF01, (27, 5, 1, 17, 282))]:
        r = CF.conflict_report(training(spark, sf), FE).first()
        assert (r["patterns"], r["patterns_in_conflict"], r["ties"], r["dropped_majority"],
                r["dropped_remove"]) == expect


def test_majority_tie_goes_to_one(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 1.0, 1), (3, 0.0, 0), (4, 0.0, 0), (5, 0.0, 1),
                                (6, 2.0, 1)], "paper_id long, I01 double, label int")
    kept = sorted(r["paper_id"] for r in CF.conflicts_majority(df, ["I01"]).collect())
    assert kept == [2, 3, 4, 6]


def test_split_shares_and_folds(spark):
    t = training(spark, SF01)
    sp = SP.stratified_split(t).cache()
    rows = sp.collect()
    by = Counter((r["label"], r["split"]) for r in rows)
    for y in (0, 1):
        n = sum(v for (lab, _), v in by.items() if lab == y)
        assert abs(by[(y, "test")] - 0.2 * n) < 1
        assert abs(by[(y, "val")] - 0.2 * n) < 1.5
    folds = Counter((r["label"], r["fold"]) for r in rows if r["split"] == "train")
    for y in (0, 1):
        counts = [folds[(y, f)] for f in range(5)]
        assert max(counts) - min(counts) <= 1
    # partitioning does not change the split
    again = {r["paper_id"]: r["split"] for r in SP.stratified_split(t.repartition(7)).collect()}
    assert again == {r["paper_id"]: r["split"] for r in rows}


def test_smoten_equals_brute_force(spark):
    t = training(spark, SF001)
    rows = [(tuple(float(r[f]) for f in FE), r["label"]) for r in t.collect()]
    got = {tuple(r[f] for f in FE): r["n"] for r in smoten(patterns(t, FE), FE).collect()}
    want, _ = smoten_brute(rows, FE)
    assert got == dict(want)
    n1 = sum(y for _, y in rows)
    assert sum(got.values()) == len(rows) - 2 * n1   # classes become equal


def test_tree_batches_bound_trees_per_job():
    """Forest-search groups keep every configuration, in order, and hold at
    most the bound of trees over all folds (a larger one stands alone)."""
    from papersieve.plans.training import random_search_configs, tree_batches
    cfgs = random_search_configs()
    groups = tree_batches(cfgs, 5, 4_000)
    assert [c["config_id"] for g in groups for c in g] == [c["config_id"] for c in cfgs]
    for g in groups:
        trees = sum(c["n_estimators"] * 5 for c in g)
        assert trees <= 4_000 or len(g) == 1
    assert tree_batches(cfgs, 5, 1) == [[c] for c in cfgs]
