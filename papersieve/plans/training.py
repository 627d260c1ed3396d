"""Training flows: grid search with fold-safe oversampling (M8, M9, M11,
W6), random search over forests (M7, M6, A14), and the final fit + sweep.

Everything is keyed, not looped: folds are a key of the pattern table, a
grid configuration x fold is a ``run_id``, a forest tree is a ``tree_id``,
and all of them grow together in ``train.fit_trees``.  Held-out folds are
scored on their patterns (weighted by class counts), so the cost of a
search does not depend on the number of papers once patterns exist.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import bounded_broadcast, cut_lineage
from ..constants import (FOREST_GRID, FOREST_SEARCH_ITERATIONS, N_FOLDS, RANDOM_STATE,
                         SMOTE_K, SMOTEN_K, TREE_GRID)
from ..operators import metrics as M
from ..operators.conflicts import conflicts_majority
from ..operators.histogram import N_BINS, bin_lists, bin_table, binned, binned_patterns
from ..operators.neighbours import BINARY
from ..operators.resample import smote_rows, smoten
from ..operators.train import configs_df, cv_scores, fit_trees, patterns, predict_patterns

GRID_SCHEMA = T.StructType([
    T.StructField("config_id", T.IntegerType()),
    T.StructField("criterion", T.StringType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("max_features", T.StringType()),
    T.StructField("min_samples_leaf", T.IntegerType()),
    T.StructField("min_samples_split", T.IntegerType()),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("bootstrap", T.BooleanType()),
])


def expand_grid(grid: dict) -> list[dict]:
    """Parameter grid in ParameterGrid order: keys sorted, last fastest."""
    keys = sorted(grid)
    out = []
    for i, vals in enumerate(itertools.product(*[grid[k] for k in keys])):
        d = dict(zip(keys, vals))
        d["config_id"] = i
        out.append(d)
    return out


def grid_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    def norm(r):
        crit = r.get("criterion", "gini")
        crit = "entropy" if crit == "log_loss" else crit  # identical impurity
        return (r["config_id"], crit, r.get("max_depth"), r.get("max_features") or "all",
                int(r.get("min_samples_leaf", 1)), int(r.get("min_samples_split", 2)),
                int(r.get("n_estimators", 1)), bool(r.get("bootstrap", False)))
    return spark.createDataFrame([norm(r) for r in rows], GRID_SCHEMA)


def fold_patterns(rows: DataFrame, features: list[str], label: str = "label",
                  n_folds: int = N_FOLDS, weight: str | None = None):
    """(train side, held-out side) pattern tables keyed by ``cv_fold``.

    The train side of fold f is every other fold: per-fold pattern counts
    expanded over the folds they train (a generator over n_folds values)."""
    # computed once: both sides and the class totals read it
    per = cut_lineage(patterns(rows, features, label, keys=["fold"], weight=weight))
    train = (per.select("*", F.explode(F.array(*[F.lit(i) for i in range(n_folds)]))
                        .alias("cv_fold"))
             .where(F.col("fold") != F.col("cv_fold"))
             .groupBy("cv_fold", *features)
             .agg(F.sum("n").alias("n"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1")))
    held = per.withColumnRenamed("fold", "cv_fold")
    return train, held


#: What of a result row is a tree's configuration.
CONFIG_KEYS = ("criterion", "max_depth", "min_samples_split", "min_samples_leaf", "max_features")


def grid_search(rows: DataFrame, features: list[str], grid: dict = TREE_GRID,
                label: str = "label", oversample: bool = True, k: int = SMOTEN_K,
                seed: int = RANDOM_STATE) -> DataFrame:
    """M8 + M9 + M11 + W6: every configuration on every fold in one job per
    tree level.  ``rows`` carry a ``fold`` column (W2).  SMOTEN runs inside
    each fold's training side only, never on its held-out fold.

    Returns one row per configuration with mean fold metrics and its rank
    by mean recall (ties: lower configuration index)."""
    spark = rows.sparkSession
    configs = expand_grid(grid)
    g = grid_df(spark, configs)
    train, held = fold_patterns(rows, features, label)
    if oversample:
        syn = smoten(train, features, keys=["cv_fold"], k=k)
        train = train.unionByName(syn.drop("is_synthetic"))
        train = train.groupBy("cv_fold", *features).agg(
            F.sum("n").alias("n"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    train = cut_lineage(train)
    folds = F.explode(F.array(*[F.lit(i) for i in range(N_FOLDS)])).alias("cv_fold")
    runs = g.select("*", folds).withColumn(
        "run_id", F.concat(F.lit("c"), F.col("config_id").cast("string"), F.lit("-f"),
                           F.col("cv_fold").cast("string")))
    runs = cut_lineage(runs)
    cfg = runs.select("run_id", "criterion", "max_depth", "min_samples_split",
                      "min_samples_leaf", "max_features", F.lit(seed).alias("seed"))
    # runs: one row per (configuration, fold), bounded by the grid
    pats = train.join(F.broadcast(runs.select("run_id", "cv_fold")), "cv_fold").drop("cv_fold")
    nodes = cut_lineage(fit_trees(pats, cfg, features))
    hp = held.join(F.broadcast(runs.select("run_id", "cv_fold")), "cv_fold") \
             .withColumn("tree_id", F.lit(0))
    pred = predict_patterns(hp, nodes, features)
    sc = cv_scores(pred, ["run_id"]).join(runs.select("run_id", "config_id"), "run_id")
    agg = sc.groupBy("config_id").agg(
        F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"),
        F.avg("accuracy").alias("mean_accuracy"), F.avg("specificity").alias("mean_specificity"),
        F.count(F.lit(1)).alias("n_folds"))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("mean_recall").desc(), F.col("config_id"))  # one row per config
    return (g.join(agg, "config_id")
            .withColumn("rank", F.row_number().over(w)))


def ablation(rows: DataFrame, features: list[str], config: dict, label: str = "label",
             seed: int = RANDOM_STATE) -> DataFrame:
    """What the removal of each question does to the fold recall, in one
    level loop: a run a (question, fold) with that question masked, and one a
    fold with all.  One row a question (null: none removed) with the mean fold
    metrics, the recall lost and the rank by it."""
    train, held = fold_patterns(rows, features, label)
    runs = rows.sparkSession.createDataFrame(
        [(f"{q or 'all'}-f{f}", q, f, [q] if q else [], seed) for q in [None, *features]
         for f in range(N_FOLDS)],
        "run_id string, removed string, cv_fold int, masked array<string>, seed int")
    settings = configs_df(rows.sparkSession, [{**{k: config[k] for k in CONFIG_KEYS if config.get(k)
                                                  is not None}, "run_id": "x"}]).drop("run_id", "seed")
    cfg = runs.select("run_id", "masked", "seed").join(F.broadcast(settings))  # one row of settings
    side = F.broadcast(runs.select("run_id", "cv_fold"))  # questions x folds
    nodes = cut_lineage(fit_trees(train.join(side, "cv_fold").drop("cv_fold"), cfg, features))
    pred = predict_patterns(held.join(side, "cv_fold").withColumn("tree_id", F.lit(0)), nodes, features)
    scores = cv_scores(pred, ["run_id"]).join(runs, "run_id")
    agg = cut_lineage(scores.groupBy("removed").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in ("recall", "precision", "accuracy", "specificity")],
        F.count(F.lit(1)).alias("n_folds")))
    base = agg.where("removed IS NULL").select(F.col("mean_recall").alias("_all"))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("removed").isNull(), F.col("recall_lost").desc(), "removed")  # one row a question
    return (agg.join(F.broadcast(base)).withColumn("recall_lost", F.round(F.col("_all") - F.col("mean_recall"), 12))
            .drop("_all").withColumn("rank", F.when(F.col("removed").isNotNull(), F.row_number().over(w))))


def best_config(results: DataFrame) -> dict:
    """The refit configuration (rank 1)."""
    return results.where("rank = 1").first().asDict()


def fit_final(rows: DataFrame, features: list[str], config: dict, label: str = "label",
              oversample: bool = True, run_id: str = "final", k: int = SMOTEN_K) -> DataFrame:
    """Fit one tree on all given rows (SMOTEN first when asked): node table."""
    spark = rows.sparkSession
    pats = cut_lineage(patterns(rows, features, label))
    if oversample:
        pats = pats.unionByName(smoten(pats, features, k=k).drop("is_synthetic"))
        pats = pats.groupBy(*features).agg(F.sum("n").alias("n"), F.sum("w0").alias("w0"),
                                           F.sum("w1").alias("w1"))
    cfg = configs_df(spark, [{**config, "run_id": run_id}])
    return fit_trees(pats.withColumn("run_id", F.lit(run_id)), cfg, features)


def search_and_fit(rows: DataFrame, features: list[str], grid: dict = TREE_GRID,
                   label: str = "label") -> tuple[dict, DataFrame]:
    """Search, refit, final fit: the grid on the training folds of ``rows`` (with
    ``split`` and ``fold``), then one tree of the best configuration on train
    and validation together.  (configuration, node table)."""
    rows = cut_lineage(rows)  # the texts behind the answers are read once
    results = grid_search(rows.where("split = 'train'"), features, grid, label)
    config = best_config(results)
    final = fit_final(rows.where("split IN ('train', 'val')"), features,
                      {k: v for k, v in config.items() if k in CONFIG_KEYS}, label)
    return config, final


def score_rows(rows: DataFrame, nodes: DataFrame, features: list[str],
               keys=("paper_id",)) -> DataFrame:
    """M10 for rows: predict distinct patterns, join back (broadcast of a
    pattern table bounded by the feature space)."""
    pats = rows.select(*features).distinct().withColumn("run_id", F.lit(None).cast("string"))
    run = nodes.select("run_id").first()["run_id"]
    pats = pats.withColumn("run_id", F.lit(run)).withColumn("tree_id", F.lit(0))
    pred = predict_patterns(pats, nodes, features).select(*features, "leaf_id", "probability")
    return rows.join(bounded_broadcast(pred), features)


# ------------------------------------------------------------------ forests

def _poisson_batch(lam, u):
    """Vectorised Poisson(lam) from uniforms, one method for every size: per
    distinct lam the law's ratios outward from its mode (all values within 12
    standard deviations; what lies outside weighs less than a double can
    hold), then the inverse."""
    import numpy as np
    out = np.zeros(len(lam))
    for rate in np.unique(lam):
        if rate <= 0:
            continue
        mode, reach = int(rate), int(12 * np.sqrt(rate)) + 40
        low = max(0, mode - reach)
        up = np.cumprod(rate / np.arange(mode + 1, mode + reach + 1, dtype=float))
        down = np.cumprod(np.arange(mode, low, -1, dtype=float) / rate)
        weight = np.concatenate([down[::-1], [1.0], up]).cumsum()
        own = lam == rate
        out[own] = low + np.searchsorted(weight, u[own] * weight[-1], "right")
    return out


def poisson_weights(pats: DataFrame, n_trees: int | str, seed: int = RANDOM_STATE,
                    bootstrap: bool | str = True, pattern_cols: list[str] | None = None) -> DataFrame:
    """Bootstrap per (tree, pattern): the rows of a pattern drawn for a tree
    number Poisson(n) (a sum of n Poisson(1) row draws, as in bagging), for
    each class.  Uniforms come from md5 of (seed, tree, pattern, class), so
    draws are reproducible on any partitioning; the inverse CDF runs
    vectorised over Arrow batches.  ``n_trees``/``bootstrap`` may name
    columns (per-run values)."""
    nt = F.col(n_trees) if isinstance(n_trees, str) else F.lit(n_trees)
    x = pats.select("*", F.explode(F.sequence(F.lit(0), nt - 1)).alias("tree_id"))
    # patterns fill few partitions: their copies, one a tree, are dealt to all tasks
    x = x.repartition(*[c for c in ("run_id", "tree_id") if c in x.columns])
    bs = F.col(bootstrap) if isinstance(bootstrap, str) else F.lit(bool(bootstrap))
    pcols = pattern_cols or [c for c in pats.columns if c not in ("n", "w0", "w1")]
    key = F.concat_ws("|", F.lit(str(seed)), F.col("tree_id").cast("string"),
                      *[F.col(c).cast("string") for c in pcols])

    def unif(salt):
        return ((F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 13), 16, 10)
                 .cast("double") + 0.5) / F.lit(float(16 ** 13)))
    x = x.select("*", bs.alias("_bs"), unif("a0").alias("_a0"), unif("a1").alias("_a1"))
    cols = x.columns
    schema = x.schema

    def draw(batches):
        import numpy as np
        for pdf in batches:
            bsv = pdf["_bs"].to_numpy(dtype=bool)
            for c, a in (("w0", "_a0"), ("w1", "_a1")):
                lam = pdf[c].to_numpy(dtype=float)
                drawn = _poisson_batch(lam, pdf[a].to_numpy(dtype=float))
                pdf[c] = np.where(bsv, drawn, lam)
            pdf["n"] = (pdf["w0"] + pdf["w1"]).astype("int64")
            yield pdf[cols]
    return (x.mapInPandas(draw, schema).drop("_bs", "_a0", "_a1")
            .where(F.col("n") > 0))


# State rows (tree x pattern) grown by one level job of a forest search.
# The state is independent of the paper count but proportional to the
# number of trees (a 40 x 5-fold search holds ~57,000); configurations are
# grouped so that trees x (patterns of a fold) stays under this bound.
MAX_STATE_ROWS_PER_JOB = 1_000_000


def tree_batches(configs: list[dict], n_folds: int, max_trees: int) -> list[list[dict]]:
    """Consecutive groups of configurations holding at most ``max_trees``
    trees over all folds (a single larger configuration forms its own group)."""
    out, cur, size = [], [], 0
    for c in configs:
        t = int(c.get("n_estimators", 1)) * n_folds
        if cur and size + t > max_trees:
            out.append(cur)
            cur, size = [], 0
        cur.append(c)
        size += t
    if cur:
        out.append(cur)
    return out


def _forest_fold_scores(train: DataFrame, held: DataFrame, g: DataFrame,
                        features: list[str], seed: int) -> DataFrame:
    """M6 + A14 + M11 for the configurations in ``g``: grow every
    (configuration, fold, tree) together, score each held-out fold by the
    soft vote of its configuration's trees.  One row per (run, fold)."""
    folds = F.explode(F.array(*[F.lit(i) for i in range(N_FOLDS)])).alias("cv_fold")
    runs = cut_lineage(g.select("*", folds).withColumn(
        "run_id", F.concat(F.lit("c"), F.col("config_id").cast("string"), F.lit("-f"),
                           F.col("cv_fold").cast("string"))))
    pats = train.join(F.broadcast(runs.select("run_id", "cv_fold", "n_estimators", "bootstrap")),
                      "cv_fold").drop("cv_fold")
    # bootstrap draws of the unweighted rows (sample counts for min_samples_*),
    # then the fold's balanced class weights on the drawn counts
    pats = poisson_weights(pats, "n_estimators", seed, "bootstrap",
                           pattern_cols=["run_id", *features]).drop("n_estimators", "bootstrap")
    pats = (pats.withColumn("w0", F.col("w0") * F.col("cw0"))
            .withColumn("w1", F.col("w1") * F.col("cw1")).drop("cw0", "cw1"))
    cfg = runs.select("run_id", "criterion", "max_depth", "min_samples_split",
                      "min_samples_leaf", "max_features", F.lit(seed).alias("seed"))
    nodes = cut_lineage(fit_trees(pats, cfg, features))
    trees = nodes.select("run_id", "tree_id").distinct()
    hp = held.join(F.broadcast(runs.select("run_id", "cv_fold")), "cv_fold").join(trees, "run_id")
    pred = predict_patterns(hp, nodes, features)
    vote = pred.groupBy("run_id", *features).agg(
        F.avg("probability").alias("probability"), F.first("w0").alias("w0"),
        F.first("w1").alias("w1"))
    return cut_lineage(cv_scores(vote, ["run_id"]).join(runs.select("run_id", "config_id"),
                                                         "run_id"))


def forest_search(rows: DataFrame, features: list[str], configs: list[dict],
                  label: str = "label", seed: int = RANDOM_STATE,
                  class_weight: bool = True, max_trees: int | None = None) -> DataFrame:
    """M7 + M6 + M3 + A14 + M11: configurations are grown in groups of at
    most ``max_trees`` trees (default: MAX_STATE_ROWS_PER_JOB over the
    largest fold's pattern count), every configuration, fold and tree of a
    group in one level loop; held-out folds are scored by the soft vote of
    each configuration's trees.  Returns per-configuration mean fold metrics
    and rank by mean recall."""
    spark = rows.sparkSession
    train, held = fold_patterns(rows, features, label)
    # 'balanced' class weights of each fold's training side (one row per fold)
    cw = train.groupBy("cv_fold").agg(F.sum("w0").alias("N0"), F.sum("w1").alias("N1"))
    one = F.lit(1.0)
    train = (train.join(F.broadcast(cw), "cv_fold")
             .withColumn("cw0", (F.col("N0") + F.col("N1")) / (2.0 * F.col("N0"))
                         if class_weight else one)
             .withColumn("cw1", (F.col("N0") + F.col("N1")) / (2.0 * F.col("N1"))
                         if class_weight else one)
             .drop("N0", "N1"))
    train, held = cut_lineage(train), cut_lineage(held)
    if max_trees is None:
        pat_rows = train.groupBy("cv_fold").count().agg(F.max("count")).first()[0] or 1
        max_trees = max(1, MAX_STATE_ROWS_PER_JOB // pat_rows)
    # a forest's default max_features is sqrt (a configuration may override it)
    configs = [{"max_features": "sqrt", **c} for c in configs]
    sc = None
    for batch in tree_batches(configs, N_FOLDS, max_trees):
        part = _forest_fold_scores(train, held, grid_df(spark, batch), features, seed)
        sc = part if sc is None else sc.unionByName(part)
    g = grid_df(spark, configs)
    agg = sc.groupBy("config_id").agg(
        F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"),
        F.avg("accuracy").alias("mean_accuracy"), F.avg("specificity").alias("mean_specificity"),
        F.count(F.lit(1)).alias("n_folds"))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("mean_recall").desc(), F.col("config_id"))  # one row per config
    return g.join(agg, "config_id").withColumn("rank", F.row_number().over(w))


def forest_proba(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Soft vote, the mean of the trees' leaf shares."""
    return pred.groupBy(*keys).agg(F.avg("probability").alias("probability"))


def balanced(pats: DataFrame, n0: float, n1: float) -> DataFrame:
    """'Balanced' class weights of n0 and n1 rows on drawn class counts."""
    return (pats.withColumn("w0", F.col("w0") * F.lit((n0 + n1) / (2.0 * n0) if n0 else 0.0))
            .withColumn("w1", F.col("w1") * F.lit((n0 + n1) / (2.0 * n1) if n1 else 0.0)))


def fit_smote_forest(rows: DataFrame, features: list[str], config: dict, label: str = "label",
                     k: int = SMOTE_K, n_bins: int = N_BINS, seed: int = RANDOM_STATE,
                     values=BINARY, run_id: str = "forest") -> tuple[DataFrame, dict]:
    """M6 after M1: majority cleaning (A3), SMOTE rows added (M1, U2), balanced
    class weights, a forest on histogram splits.  (node table, bin lists)."""
    clean = cut_lineage(conflicts_majority(rows, features, label))
    syn = smote_rows(clean, features, label, k=k, seed=seed, values=values)
    both = cut_lineage(clean.select(*[F.col(f).cast("double").alias(f) for f in features], label)
                       .unionByName(syn.select(*features, F.col(label).cast(
                           clean.schema[label].dataType).alias(label))))
    bins = bin_lists(bin_table(both, features, n_bins))
    pats = cut_lineage(binned_patterns(both, features, bins, label))
    totals = pats.agg(F.sum("w0").alias("n0"), F.sum("w1").alias("n1")).first()
    drawn = poisson_weights(pats.withColumn("run_id", F.lit(run_id)), int(config.get("n_estimators", 100)),
                            seed, bool(config.get("bootstrap", True)), pattern_cols=features)
    cfg = configs_df(rows.sparkSession, [{"max_features": "sqrt", "seed": seed, **{
        x: config[x] for x in CONFIG_KEYS if config.get(x) is not None}, "run_id": run_id}])
    weighted = balanced(drawn, totals["n0"] or 0.0, totals["n1"] or 0.0)
    return cut_lineage(fit_trees(weighted, cfg, features)), bins


def forest_scores(rows: DataFrame, nodes: DataFrame, bins: dict, features: list[str]) -> DataFrame:
    """A14 for rows: ``rows`` and the forest's ``probability``; distinct binned
    patterns are walked down each tree, rows meet the votes of theirs."""
    names = [f"_b_{f}" for f in features]
    own = rows.withColumns({n: binned(F.col(f).cast("double"), bins[f])
                            for n, f in zip(names, features, strict=True)})
    pats = own.select(*[F.col(n).alias(f) for n, f in zip(names, features, strict=True)]).distinct()
    trees = nodes.select("run_id", "tree_id").distinct()
    pred = predict_patterns(pats.crossJoin(F.broadcast(trees)), nodes, features)  # trees: the model
    votes = forest_proba(pred, features)
    for n, f in zip(names, features, strict=True):
        votes = votes.withColumnRenamed(f, n)
    return own.join(bounded_broadcast(votes), names).drop(*names)


def smote_forest_sweep(rows: DataFrame, features: list[str], configs: list[dict],
                       label: str = "label", n_bins: int = N_BINS) -> DataFrame:
    """The forest's training flow: random search on the training folds of
    ``rows`` (with ``split`` and ``fold``), the best configuration refitted on
    cleaned and oversampled train and validation rows, and the threshold sweep
    of the test rows, contradictions and all.  One row a threshold; ``chosen``
    marks the highest that reaches the target recall (else the last)."""
    rows = cut_lineage(rows)  # the texts behind the answers are read once
    results = forest_search(rows.where("split = 'train'"), features, configs, label)
    config = best_config(results)
    nodes, bins = fit_smote_forest(rows.where("split IN ('train', 'val')"), features, config, label,
                                   n_bins=n_bins)
    scored = forest_scores(rows.where("split = 'test'"), nodes, bins, features)
    sweep = cut_lineage(M.threshold_sweep(scored, label=label))
    best = M.best_threshold(sweep, fallback="last").select(F.col("i").alias("_best"))
    return sweep.join(F.broadcast(best), sweep["i"] == best["_best"], "left").select(
        *sweep.columns, F.col("_best").isNotNull().alias("chosen"),
        F.lit(config["config_id"]).alias("config_id"))


def random_search_configs(n_iter: int = FOREST_SEARCH_ITERATIONS, seed: int = RANDOM_STATE,
                          grid: dict = FOREST_GRID) -> list[dict]:
    """M7: n_iter configurations of the grid, chosen by md5(seed-index) order."""
    rows = expand_grid(grid)
    rows.sort(key=lambda r: hashlib.md5(f"{seed}-{r['config_id']}".encode()).hexdigest())
    return sorted(rows[:n_iter], key=lambda r: r["config_id"])
