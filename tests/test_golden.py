"""Golden values of FIXTURES.md computed on the driver's tables."""

from collections import Counter

from pyspark.sql import functions as F

from papersieve.operators import metrics as M
from papersieve.operators.rules import RuleProvider
from papersieve.plans.catalog import scored_labelled, screened
from papersieve.plans.screen import prepare, tree_walk
from papersieve.operators.tree import fixture_nodes
from papersieve.sources import tables as S

from .conftest import SF001, SF01


def test_rule_counts_sf001(spark):
    d = RuleProvider().answer_long(prepare(S.papers(spark, SF001)), F.col("text"))
    c = Counter((r["question_id"], r["answer"]) for r in d.collect())
    expect = {"I01": (8, 0, 192), "I04": (8, 8, 184), "I05": (11, 4, 185),
              "I07": (3, 0, 197), "I10": (4, 4, 192), "I13": (120, 63, 17),
              "I16": (8, 1, 191), "I17": (140, 34, 26), "E01": (5, 0, 195),
              "E02": (8, 0, 192), "E03": (5, 2, 193)}
    for q, (y, u, n) in expect.items():
        assert (c[(q, "YES")], c[(q, "UNSURE")], c[(q, "NO")]) == (y, u, n), q


def test_walk_leaves_and_paths(spark):
    for sf, leaves, paths in [(SF001, {3: 175, 4: 16, 7: 8, 8: 1}, {2: 191, 3: 9}),
                              (SF01, {3: 834, 4: 96, 7: 68, 8: 2}, {2: 930, 3: 70})]:
        w = tree_walk(S.papers(spark, sf), fixture_nodes(spark), trace=False).collect()
        assert dict(Counter(r["leaf_id"] for r in w)) == leaves
        assert dict(Counter(r["path_len"] for r in w)) == paths


def test_exclusion_counts(spark):
    s = screened(spark, SF01).collect()
    c = Counter(r["excluded_by"] for r in s)
    assert c == {"E01": 11, "E02": 43, "E03": 10, None: 936}


def test_screen_metrics(spark):
    sweep = {r["i"]: r for r in M.threshold_sweep(scored_labelled(spark, SF01)).collect()}
    for i, expect in [(0, (34, 17, 22, 326)), (4, (34, 17, 22, 326)), (9, (32, 19, 0, 348))]:
        r = sweep[i]
        assert (r["tp"], r["fn"], r["fp"], r["tn"]) == expect
    assert sweep[2]["threshold"] == 0.15000000000000002
    assert sweep[5]["threshold"] == 0.3
