"""Fits grown and walked inside tasks.

A fit (a tree of a run) has few patterns: Spark deals fits over groups of about
``GROUP_ROWS`` rows, and a task grows or walks all fits of a group together, one
vectorised step a level.  The rules are those of :func:`train.fit_trees`, whose
level loop grows fits of more rows than that; nothing larger reaches one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group of fits, and the most of one fit.
GROUP_ROWS = 50_000

NODE_DDL = ("run_id string, tree_id int, node_id long, depth int, feature string, threshold double, "
            "left_id long, right_id long, n0 double, n1 double, impurity double, n_samples long")
SETTINGS = ("_entropy", "_k", "_most", "min_samples_split", "min_samples_leaf", "seed", "_masked")


def fit_sizes(rows: DataFrame) -> tuple[int, int]:
    """(rows of the largest fit, all rows)."""
    got = rows.groupBy("run_id", "tree_id").count().agg(F.max("count"), F.sum("count")).first()
    return got[0] or 0, got[1] or 0


def group_of(rows: int) -> Column:
    """The group of a fit among enough for ``rows`` rows."""
    return F.pmod(F.xxhash64("run_id", "tree_id"), F.lit(1 + rows // GROUP_ROWS)).cast("int")


def _floats(table: pa.Table, names) -> np.ndarray:
    """Columns as one matrix; null is NaN."""
    return np.column_stack([table[c].to_numpy().astype(float) for c in names])


def _fits(table: pa.Table, run: str = "run_id", tree: str = "tree_id"):
    """Names of the runs; each row's (run, tree) as two arrays."""
    runs = table[run].combine_chunks().dictionary_encode()
    return runs.dictionary.to_pylist(), runs.indices.to_numpy().astype(np.int64), table[tree].to_numpy()


def _impurity(w0, w1, entropy):
    n = w0 + w1
    p0, p1 = (np.where(n > 0, w / n, 0.0) for w in (w0, w1))
    logs = [np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0) for p in (p0, p1)]
    return np.where(entropy, -(logs[0] + logs[1]), 1.0 - p0 * p0 - p1 * p1)


def _running(place: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Running sums of the columns along each stretch of rows, added one after
    the other; ``place``: a row's place in its stretch."""
    out = sums.copy()
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    for j in range(1, len(ends)):
        at = order[ends[j - 1]:ends[j]]
        out[at] += out[at - 1]
    return out


def _candidates(x, node, weights, total):
    """Cuts of one feature: (node, threshold, (n, w0, w1) left of it)."""
    values, code = np.unique(x, return_inverse=True)  # NaN (null) last and once
    null = np.isnan(x)
    code = np.where(null, 0, code.reshape(-1) + 1)  # null lies first
    values = np.concatenate([[np.nan], values])
    key, place = np.unique(node * len(values) + code, return_inverse=True)
    place = place.reshape(-1)
    sums = np.column_stack([np.bincount(place, w, len(key)) for w in weights.T])
    own, value = key // len(values), values[key % len(values)]
    first = np.searchsorted(own, own)
    left = _running(np.arange(len(own)) - first, sums)
    cut = np.flatnonzero((own[1:] == own[:-1]) & ~np.isnan(value[:-1]))
    return own[cut], (value[cut] + value[cut + 1]) / 2.0, left[cut]


def _drawn(node, fi, k, name) -> np.ndarray:
    """Which candidates are of the k features drawn for their node, by md5 among
    those that can split it; ``name(node)``: what the draw is seeded by."""
    n_features = int(fi.max()) + 1
    pairs, place = np.unique(node * n_features + fi, return_inverse=True)
    at, which = pairs // n_features, pairs % n_features
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    keep = np.ones(len(pairs), bool)
    for a, b in zip(starts, np.r_[starts[1:], len(pairs)], strict=True):
        if b - a > k[at[a]]:
            seed = name(at[a])
            ranked = sorted(range(a, b), key=lambda i: hashlib.md5(seed(which[i])).hexdigest())  # noqa: B023
            keep[ranked[k[at[a]]:]] = False
    return keep[place.reshape(-1)]


def grower(features: list[str], heap_levels: int, deep_id: int, deep_step: int, level: int):
    """Task function: the node rows of every fit of a group, whose rows all stand
    at level ``level`` of theirs."""

    def grow(table: pa.Table) -> pa.Table:
        runs, run, tree = _fits(table)
        x, weights = _floats(table, features), _floats(table, ("n", "w0", "w1"))
        settings = _floats(table, SETTINGS)
        # nodes: (run, tree, node id) in order, a number each
        ids = np.column_stack([run, tree, table["node_id"].to_numpy()])
        ids, first, node = np.unique(ids, axis=0, return_index=True, return_inverse=True)
        node, settings, depth = node.reshape(-1), settings[first], table["depth"].to_numpy()[first]
        at, out = level, []
        while len(node):
            entropy, k, most, split, leaf, seed, masked = settings.T
            total = np.column_stack([np.bincount(node, w, len(ids)) for w in weights.T])
            imp = _impurity(total[:, 1], total[:, 2], entropy > 0)
            found = []
            for f in range(len(features)):
                own, cut, left = _candidates(x[:, f], node, weights, total)
                right = total[own] - left
                ok = ((left[:, 0] >= leaf[own]) & (right[:, 0] >= leaf[own]) & (total[own, 0] >= split[own])
                      & (imp[own] > 1e-12) & (depth[own] < most[own])
                      & (masked[own].astype(np.int64) & (1 << f) == 0))
                own, cut, left, right = own[ok], cut[ok], left[ok], right[ok]
                wl, wr = left[:, 1] + left[:, 2], right[:, 1] + right[:, 2]
                wt = total[own, 1] + total[own, 2]
                gain = (imp[own] - wl / wt * _impurity(left[:, 1], left[:, 2], entropy[own] > 0)
                        - wr / wt * _impurity(right[:, 1], right[:, 2], entropy[own] > 0))
                found.append((own, np.full(len(own), f), cut, np.round(gain, 12)))
            own, fi, cut, gain = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(own):
                def name(i):
                    text = f"{int(seed[i])}-{runs[ids[i, 0]]}-{ids[i, 1]}-{ids[i, 2]}-"  # noqa: B023
                    return lambda f: (text + features[f]).encode()
                keep = _drawn(own, fi, k.astype(int), name)
                own, fi, cut, gain = own[keep], fi[keep], cut[keep], gain[keep]
            order = np.lexsort((cut, fi, -gain, own))
            own, fi, cut = own[order], fi[order], cut[order]
            best = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
            by, threshold = np.full(len(ids), -1), np.full(len(ids), np.nan)
            by[own[best]], threshold[own[best]] = fi[best], cut[best]
            has = by >= 0
            if at < heap_levels:
                left_id = 2 * ids[:, 2] + 1
            else:  # nodes that split, ranked in their fit: ``ids`` are in order
                rank = np.cumsum(has) - has
                start = np.flatnonzero(np.r_[True, (ids[1:, :2] != ids[:-1, :2]).any(axis=1)])
                rank -= np.repeat(rank[start], np.diff(np.r_[start, len(ids)]))
                left_id = deep_id + (at - heap_levels) * deep_step + 2 * rank
            out.append((ids, depth, by, threshold, np.where(has, left_id, -1), total, imp))
            # rows of nodes that split go on; null goes right
            on = has[node]
            x, weights, node = x[on], weights[on], node[on]
            side = ~(x[np.arange(len(node)), by[node]] <= threshold[node])
            key, node = np.unique(2 * node + side, return_inverse=True)
            node, up = node.reshape(-1), key // 2
            ids = np.column_stack([ids[up, :2], left_id[up] + key % 2])
            settings, depth, at = settings[up], depth[up] + 1, at + 1
        ids, depth, by, threshold, left_id, total, imp = (np.concatenate(c) for c in zip(*out, strict=True))
        none = by < 0
        names = pa.array([*features, None], pa.string())
        return pa.table({
            "run_id": pa.array(runs, pa.string()).take(pa.array(ids[:, 0])),
            "tree_id": pa.array(ids[:, 1].astype(np.int32)), "node_id": pa.array(ids[:, 2]),
            "depth": pa.array(depth.astype(np.int32)),
            "feature": names.take(pa.array(np.where(none, len(features), by))),
            "threshold": pa.array(threshold, mask=none), "left_id": pa.array(left_id),
            "right_id": pa.array(np.where(none, -1, left_id + 1)), "n0": pa.array(total[:, 1]),
            "n1": pa.array(total[:, 2]), "impurity": pa.array(imp),
            "n_samples": pa.array(total[:, 0].astype(np.int64))})

    def quiet(table: pa.Table) -> pa.Table:
        with np.errstate(divide="ignore", invalid="ignore"):
            return grow(table)
    return quiet


def grown(state: DataFrame, features: list[str], rows: int, n_features_of: Column, heap_levels: int,
          deep_id: int, deep_step: int, level: int) -> DataFrame:
    """Node rows of all fits in ``state`` (fit_trees' rows, those of a fit at most
    GROUP_ROWS): one shuffle of the rows, a group of fits a task."""
    masked = F.lit(0).cast("long")
    if "masked" in state.columns:
        for i, f in enumerate(features):
            masked = masked + F.when(F.array_contains("masked", f), F.lit(1 << i)).otherwise(F.lit(0))
    rows_of = state.select(
        group_of(rows).alias("_group"), "run_id", F.col("tree_id").cast("int").alias("tree_id"), "node_id",
        "depth", *[F.col(f).cast("double").alias(f) for f in features], "n", "w0", "w1",
        (F.col("criterion") != "gini").cast("int").alias("_entropy"),
        n_features_of.cast("int").alias("_k"),
        F.coalesce("max_depth", F.lit(2 ** 31 - 1)).alias("_most"), "min_samples_split",
        "min_samples_leaf", "seed", masked.alias("_masked"))
    return rows_of.groupBy("_group").applyInArrow(
        grower(features, heap_levels, deep_id, deep_step, level), NODE_DDL)


def walker(features: list[str]):
    """Task function: rows of a group of fits led down the nodes of theirs."""

    def walk(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        n = len(rows)
        leaf, share = np.zeros(n, np.int64), np.full(n, np.nan)
        if n and len(nodes):
            names, run, tree = _fits(nodes, "_n_run_id", "_n_tree_id")
            number = {x: i for i, x in enumerate(names)}
            theirs, mine, mytree = _fits(rows)
            mine = np.array([number.get(x, -1) for x in theirs], np.int64)[mine]
            node, left, right = (nodes[f"_n_{c}"].to_numpy() for c in ("node_id", "left_id", "right_id"))
            fits, fit = np.unique(np.column_stack([run, tree]), axis=0, return_inverse=True)
            place = {tuple(x): i for i, x in enumerate(fits.tolist())}
            pairs, pair = np.unique(np.column_stack([mine, mytree]), axis=0, return_inverse=True)
            own = np.array([place.get(tuple(x), -1) for x in pairs.tolist()], np.int64)[pair.reshape(-1)]
            ids = np.unique(node)

            def seat(fit, node):
                """The row of a node of a fit, -1 where there is none."""
                key = fit * len(ids) + np.searchsorted(ids, node)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                return np.where((keys[at] == key) & (fit >= 0), order[at], -1)
            keys = fit.reshape(-1) * len(ids) + np.searchsorted(ids, node)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            fit = fit.reshape(-1)
            which = {f: i for i, f in enumerate(features)}
            by = np.array([which.get(f, -1) for f in nodes["_n_feature"].to_pylist()])
            threshold, p1 = nodes["_n_threshold"].to_numpy(), nodes["_n_p1"].to_numpy()
            inner = by >= 0
            down = [np.where(inner, seat(fit, c), -1) for c in (left, right)]
            x, at = _floats(rows, features), seat(own, np.zeros(n, np.int64))
            going = np.flatnonzero((at >= 0) & inner[at])
            while len(going):
                here = at[going]
                goes = x[going, by[here]] <= threshold[here]
                at[going] = np.where(goes, down[0][here], down[1][here])
                going = going[(at[going] >= 0) & inner[at[going]]]
            seen = at >= 0
            leaf[seen], share[seen] = node[at[seen]], p1[at[seen]]
        return (rows.drop_columns(["_group"]).append_column("leaf_id", pa.array(leaf))
                .append_column("probability", pa.array(share, from_pandas=True)))
    return walk


def walked(pats: DataFrame, nodes: DataFrame, features: list[str], rows: int) -> DataFrame:
    """``pats`` and the leaf_id and probability of each: patterns and nodes of a
    fit meet in one task (at most GROUP_ROWS each of a fit)."""
    group = group_of(rows).alias("_group")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pats.schema.fields)
    # other names: patterns may be made from the nodes' own trees
    n = nodes.select(group_of(rows).alias("_n_group"), *[F.col(c).alias(f"_n_{c}") for c in (
        "run_id", "tree_id", "node_id", "feature", "threshold", "left_id", "right_id", "p1")])
    return pats.select("*", group).groupBy("_group").cogroup(n.groupBy("_n_group")).applyInArrow(
        walker(features), f"{kinds}, leaf_id long, probability double")
