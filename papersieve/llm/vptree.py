"""Operator 8, nearest neighbours by vantage-point trees, one per shard.

Largest inner product is turned into least distance: a vector x of a shard
gets one more coordinate sqrt(M^2 - |x|^2), M being the shard's longest norm,
and a query a zero; then distance^2 = |q|^2 + M^2 - 2 q.x.  Each shard of about
SHARD vectors (by hash of the id) has its own tree.  Queries come in blocks of
about QUERY_BLOCK; every block searches every tree, and the shards' best are
merged.  A subtree is passed over when the triangle inequality puts it farther
than ``factor`` times the k-th best distance so far: factor 1 is exact,
smaller factors prune more and may miss.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import cut_lineage
from .frames import read_table, take_columns

SHARD = 4096
QUERY_BLOCK = 1024
LEAF = 128
K = 20
EVERY = 20
#: Production setting: exact.  The README has the recall of smaller ones.
FACTOR = 1.0
#: What rounding may move a distance by.
SLACK = 1e-9


class Tree:
    """Vantage-point tree over the rows of ``x``; nodes are tuples (vantage
    row, radius, inner, outer), leaves are arrays of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.leaf = ids[order], x[order], leaf
        norm2 = (self.x ** 2).sum(1)
        self.top2 = float(norm2.max())
        self.extra = np.sqrt(np.maximum(self.top2 - norm2, 0.0))
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v = rows[len(rows) // 2]
        rest = rows[rows != v]
        d = np.sqrt(((self.x[rest] - self.x[v]) ** 2).sum(1)
                    + (self.extra[rest] - self.extra[v]) ** 2)
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2  # equal halves: ties never unbalance the tree
        inner, outer = order[:half], order[half:]
        return (int(v), float(d[inner[-1]]), float(d[outer[0]]),
                self._build(np.sort(rest[inner])), self._build(np.sort(rest[outer])))


class Search:
    """The ``k`` best rows of one tree for a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.t, self.qid, self.q, self.k, self.factor = tree, ids, q, k, factor
        self.base2 = (q ** 2).sum(1) + tree.top2
        self.rows = np.full((len(q), k), -1)
        self.dot = np.full((len(q), k), -np.inf)
        self.visited = 0
        self._visit(tree.root, np.arange(len(q)))

    def _radius(self, who: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far; infinite while fewer are known."""
        worst = self.dot[who, -1]
        return np.sqrt(np.maximum(self.base2[who] - 2 * np.where(np.isinf(worst), 0, worst), 0)) \
            + np.where(np.isinf(worst), np.inf, 0)

    def _offer(self, who: np.ndarray, rows: np.ndarray):
        """Keep each query's k largest products, ties to the smaller id (rows
        are in id order; the known ones carry their row number)."""
        self.visited += len(who) * len(rows)
        dot = self.q[who] @ self.t.x[rows].T
        dot[self.t.ids[rows][None, :] == self.qid[who][:, None]] = -np.inf
        hit = (dot >= self.dot[who, -1][:, None]).any(1) & ~np.isneginf(dot).all(1)
        who, dot = who[hit], dot[hit]
        if not len(who):
            return
        # products are compared as rounded sums; near ties are settled exactly
        # at the end, so a few more than k are kept here
        all_dot = np.concatenate([self.dot[who], dot], 1)
        all_row = np.concatenate([self.rows[who], np.broadcast_to(rows, dot.shape)], 1)
        order = np.lexsort((all_row, -all_dot), axis=1)[:, :self.k]
        self.dot[who] = np.take_along_axis(all_dot, order, 1)
        self.rows[who] = np.take_along_axis(all_row, order, 1)

    def _visit(self, node, who: np.ndarray):
        if not len(who):
            return
        if not isinstance(node, tuple):
            if len(node):
                self._offer(who, node)
            return
        v, inner_to, outer_from, inner, outer = node
        self._offer(who, np.array([v]))
        d = np.sqrt(np.maximum(self.base2[who] - 2 * (self.q[who] @ self.t.x[v]), 0))
        near = d <= (inner_to + outer_from) / 2
        for first, second, sign in ((inner, outer, 1), (outer, inner, -1)):
            own = who[near] if sign == 1 else who[~near]
            to = d[near] if sign == 1 else d[~near]
            self._visit(first, own)
            # least distance to the other side, by the triangle inequality
            gap = (outer_from - to) if sign == 1 else (to - inner_to)
            self._visit(second, own[gap <= self.factor * self._radius(own) + SLACK])


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise inner products summed from the first component to the last."""
    return np.cumsum(x * q, axis=1)[:, -1]


def search_block(tree: Tree, ids: np.ndarray, q: np.ndarray, k: int, factor: float):
    """(query_id, vec_id, score) of each query's k best in one shard.  Some
    more are searched, so near ties of rounded products are settled on the
    exact ones."""
    s = Search(tree, ids, q, min(k + 4, len(tree.ids)), factor)
    who, at = np.nonzero((s.rows >= 0) & ~np.isneginf(s.dot))
    rows = s.rows[who, at]
    score = exact_products(tree.x[rows], q[who])
    order = np.lexsort((tree.ids[rows], -score, who))
    who, rows, score = who[order], rows[order], score[order]
    first = np.searchsorted(who, who)
    best = np.arange(len(who)) - first < k
    return ids[who[best]], tree.ids[rows[best]], score[best]


def usable(vectors: DataFrame) -> DataFrame:
    """_id, _v, _dim of the rows that take part: an id, and a vector of finite
    numbers, not all zero."""
    v = F.col("_v")
    return (take_columns(vectors, "vec_id", "embedding")
            .select(F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("_v"))
            .filter(F.col("_id").isNotNull() & v.isNotNull()
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) < float("inf")))
                    & F.exists(v, lambda x: x != 0))
            .withColumn("_dim", F.size("_v")))


def _stack(block: pd.DataFrame):
    return block["_id"].to_numpy(np.int64), np.stack(block["_v"].to_numpy()).astype(float)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR,
            shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row whose id is divisible
    by ``every``, the ``k`` largest inner products among the other rows of its
    dimension (all of them, if fewer), ties to the smaller id.

    Rows that share an id are each candidates; a query's own id is none.  An
    empty table, or one without usable rows, gives no rows."""
    rows = cut_lineage(usable(vectors))
    n = rows.count()
    n_shards, n_blocks = -(-n // shard) or 1, -(-n // every // query_block) or 1
    place = F.xxhash64(F.lit(8), "_id", "_v")

    def plant(block: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(*_stack(block))
        return pd.DataFrame({"_dim": [block["_dim"].iloc[0]], "_shard": [block["_shard"].iloc[0]],
                             "tree": [pickle.dumps(tree)]})

    def gather(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_dim": [block["_dim"].iloc[0]], "_block": [block["_block"].iloc[0]],
                             "queries": [pickle.dumps(_stack(block.sort_values("_id")))]})

    def search(batches):
        for b in batches:
            for tree, queries in zip(b["tree"], b["queries"], strict=True):
                ids, q = pickle.loads(queries)
                one, index = np.unique(ids, return_index=True)
                q_id, v_id, score = search_block(pickle.loads(tree), one, q[index], k, factor)
                yield pd.DataFrame({"query_id": q_id, "vec_id": v_id, "score": score})

    trees = (rows.withColumn("_shard", F.pmod(place, F.lit(n_shards)))
             .groupBy("_dim", "_shard").applyInPandas(plant, "_dim int, _shard long, tree binary"))
    # the stated query set, in bounded blocks, goes to every shard
    blocks = (rows.filter(F.col("_id") % every == 0)
              .withColumn("_block", F.pmod(F.xxhash64(F.lit(8), "_id"), F.lit(n_blocks)))
              .groupBy("_dim", "_block").applyInPandas(gather, "_dim int, _block long, queries binary")
              .withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"),
                                                         F.lit(n_shards - 1).cast("long")))))
    pairs = trees.join(blocks, ["_dim", "_shard"]).select("tree", "queries")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """Contract query: 20 nearest of every 20th vector, exact setting."""
    return nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
