"""Fits grown and walked inside tasks: the rows of the level loop, without its jobs."""

import random

from pyspark.sql import functions as F

from papersieve.operators import train as TR

FE = ["a", "b", "c", "d"]


def fits(spark):
    draw = random.Random(4)
    rows = []
    for tree in range(6):
        for _ in range(40):
            x = [draw.choice([0.0, 0.5, 1.0, None]) if f == "d" else float(draw.random() < .5) for f in FE]
            rows.append((f"r{tree % 3}", tree, *x, draw.randint(1, 4), float(draw.randint(0, 3)),
                         float(draw.randint(1, 3))))
    pats = spark.createDataFrame(rows, "run_id string, tree_id int, a double, b double, c double, "
                                       "d double, n long, w0 double, w1 double")
    configs = [{"run_id": "r0", "max_features": "sqrt"},
               {"run_id": "r1", "criterion": "entropy", "min_samples_leaf": 4, "min_samples_split": 9},
               {"run_id": "r2", "max_depth": 3}]
    cfg = TR.configs_df(spark, configs).withColumn("masked", F.when(
        F.col("run_id") == "r2", F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")))
    return pats, cfg


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                   for r in df.collect()), key=repr)


def test_fits_in_tasks_equal_the_level_loop(spark, monkeypatch):
    pats, cfg = fits(spark)
    jobs = []
    cut = TR.cut_lineage
    monkeypatch.setattr(TR, "cut_lineage", lambda df: jobs.append(1) or cut(df))
    nodes = TR.fit_trees(pats, cfg, FE)
    assert len(jobs) == 1  # not one a level
    mine, seen = rounded(nodes), rounded(TR.predict_patterns(pats, nodes, FE))
    monkeypatch.setattr(TR, "GROUP_ROWS", 0)
    loop = TR.fit_trees(pats, cfg, FE)
    assert nodes.schema.simpleString() == loop.schema.simpleString()
    assert max(r[3] for r in mine) > 2 and mine == rounded(loop)
    by_level = TR.predict_patterns(pats, nodes, FE).select(*pats.columns, "leaf_id", "probability")
    assert seen == rounded(by_level)


def test_large_fits_take_levels_first(spark, monkeypatch):
    pats, cfg = fits(spark)
    whole = rounded(TR.fit_trees(pats, cfg, FE))
    monkeypatch.setattr(TR, "GROUP_ROWS", 30)  # a fit has 40 rows
    assert rounded(TR.fit_trees(pats, cfg, FE)) == whole


def test_patterns_of_unknown_fits_and_no_patterns(spark):
    pats, cfg = fits(spark)
    nodes = TR.fit_trees(pats, cfg, FE)
    other = pats.withColumn("tree_id", F.lit(99))
    assert {(r.leaf_id, r.probability) for r in TR.predict_patterns(other, nodes, FE).collect()} == {(0, None)}
    none = pats.limit(0)
    assert TR.fit_trees(none, cfg, FE).count() == 0
    assert TR.predict_patterns(none, nodes, FE).count() == 0
