"""Exact nearest rows among answer patterns of any number of questions.

A pattern is a mixed-radix code: category c of feature i counts c * radix**i.
The distance of two patterns is the sum over features of a cost of their two
categories (value difference metric, or the squared difference).

Two patterns that differ in at most r features agree in one of r + 1 chunks of
the features.  Rounds of growing r bring together what agrees in a chunk; a
pattern is closed once k rows lie strictly nearer than any that differs in more
than r features can.  The last round compares the patterns still open with all,
in blocks.  Categories of cost 0 count as equal and features that cost nothing
are left out, so every difference that is counted costs something.

Within a chunk key a task keeps the k nearest rows of each open pattern only;
a key of more than BLOCK patterns is dealt over many tasks.  No pairs are
listed, and nothing grows with the number of possible answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import bounded_broadcast, cut_lineage

#: Patterns that a task compares the open ones with.
BLOCK = 65_536
#: Distances held at once in a task.
CELLS = 1 << 21
#: Most differing features looked at in each round before the last.
RADII = (0, 1, 3)
BINARY = (0.0, 1.0)
THREE_VALUED = (0.0, 0.5, 1.0)


def category(feature: str, values=BINARY) -> Column:
    """The place of a feature's value in ``values``; any other value raises."""
    out = F.raise_error(F.concat(F.lit(f"{feature}: no category for "),
                                 F.coalesce(F.col(feature).cast("string"), F.lit("null")))).cast("long")
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(feature).cast("double") == F.lit(float(v)), F.lit(i).cast("long")).otherwise(out)
    return out


def pattern_code(features, values=BINARY) -> Column:
    """The features as one number, feature i being the i-th digit."""
    if len(values) ** len(features) >= 2 ** 63:
        raise ValueError("more patterns than 63 bits can tell apart")
    out = F.lit(0).cast("long")
    for i, f in enumerate(features):
        out = out + category(f, values) * F.lit(len(values) ** i)
    return out


def digit(code: str, i: int, radix: int) -> Column:
    """The category of feature ``i`` of a code."""
    return F.expr(f"cast(({code} div {radix ** i}L) % {radix} as int)")


def value_of(code: str, i: int, values=BINARY) -> Column:
    """The value of feature ``i`` of a code."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), digit(code, i, len(values)) + 1)


def squared_costs(n_features: int, values=BINARY) -> list[list[float]]:
    """Costs of the squared difference: per feature, categories by categories."""
    one = [float((a - b) ** 2) for a in values for b in values]
    return [one] * n_features


class _Costs:
    """Cost tables of one key: (features, categories, categories)."""

    def __init__(self, costs, radix: int):
        self.table = np.array(costs, float).reshape(-1, radix, radix)
        same = self.table == 0
        #: The smallest category that a category does not differ from.
        self.symbol = same.argmax(axis=2)
        least = np.where(same, np.inf, self.table).min(axis=(1, 2))
        self.used = np.flatnonzero(np.isfinite(least))
        self.least = np.sort(least[self.used])

    def digits(self, codes: np.ndarray) -> np.ndarray:
        radix = self.table.shape[1]
        return (codes[:, None] // radix ** np.arange(len(self.table), dtype=np.int64)) % radix

    def bound(self, radius: int) -> float:
        """Patterns that differ in more than ``radius`` features are this far."""
        return self.least[:radius + 1].sum() if radius < len(self.used) else np.inf

    def chunks(self, codes: np.ndarray, radius: int | None) -> list[np.ndarray]:
        """Each code's key in each chunk (no chunk but an empty one: None)."""
        if radius is None or radius >= len(self.used):
            return [np.zeros(len(codes), np.int64)]
        symbols = self.symbol[np.arange(len(self.table)), self.digits(codes)]
        radix = self.table.shape[1]
        out = []
        for part in np.array_split(self.used, radius + 1):
            out.append(symbols[:, part] @ (radix ** np.arange(len(part), dtype=np.int64)))
        return out


def _tables(base: DataFrame, keys: list[str], radius: int | None, radix: int) -> DataFrame:
    """``base`` (keys, code, ..., costs) once a chunk: chunk, value added."""
    names = base.columns

    def rows(batches):
        for b in batches:
            pdf = b.to_pandas()
            for _, own in pdf.groupby(keys, dropna=False, sort=False) if len(pdf) else []:
                costs = _Costs(np.array([x.tolist() for x in own["costs"].iloc[0]]), radix)
                for chunk, value in enumerate(costs.chunks(own["code"].to_numpy(), radius)):
                    yield pa.RecordBatch.from_pandas(own.assign(chunk=np.int32(chunk), value=value),
                                                     preserve_index=False)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.select(*names).mapInArrow(rows, kinds + ", chunk int, value long")


def _nearest(radix: int, radius: int | None, keys: list[str]):
    """Task function: of a group's open patterns the nearest rows in it."""

    def find(table: pa.Table) -> pa.Table:
        costs = _Costs(table["costs"][0].as_py(), radix)
        code, m = table["code"].to_numpy(), table["m"].to_numpy()
        k, asks = table["k_eff"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        order = np.argsort(code[~asks])
        there, rows = code[~asks][order], m[~asks][order]
        here, wanted = code[asks], k[asks]
        cats, own = costs.digits(there), costs.digits(here)
        out = []
        step = max(1, CELLS // max(1, len(there)))
        for at in range(0, len(here), step):
            mine = own[at:at + step]
            dist = np.zeros((len(mine), len(there)))
            for f, cost in enumerate(costs.table):
                dist += cost[mine[:, f]][:, cats[:, f]]
            for i, d in enumerate(dist):
                a = here[at + i]
                avail = rows - (there == a)
                near = np.argsort(d, kind="stable")
                near = near[avail[near] > 0]
                upto = np.cumsum(avail[near])
                near = near[:int(np.searchsorted(upto, wanted[at + i])) + 1]
                out.append((np.full(len(near), a), there[near], d[near], avail[near],
                            np.full(len(near), wanted[at + i])))
        names = ["a_code", "b_code", "dist", "avail", "k_eff"]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        n = len(columns[0])
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        fixed = {x: pa.array([table[x][0].as_py()] * n, table.schema.field(x).type) for x in keys}
        return pa.table({**fixed, **{x: pa.array(c).cast(t) for x, c, t in zip(names, columns, kinds,
                                                                              strict=True)}})
    return find


def nearest_rows(minp: DataFrame, keys: list[str], k: int, costs: DataFrame | list,
                 values=BINARY, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of each pattern among the patterns of its key.

    ``minp``: keys, code, m (rows of the pattern), n_min (rows of the key).
    ``costs``: one table for all, or keys and ``costs`` (per feature, categories
    by categories).  Copies of the pattern itself come first; ties go to the
    smaller code.  Returns keys, a_code, b_code, dist, take."""
    radix = len(values)
    base = minp.select(*keys, "code", F.col("m").cast("long").alias("m"),
                       F.least(F.lit(k).cast("long"), F.col("n_min").cast("long") - 1).alias("k_eff"))
    if isinstance(costs, DataFrame):
        base = base.join(bounded_broadcast(costs.select(*keys, "costs")), keys)
    else:
        base = base.withColumn("costs", F.array(*[F.array(*map(F.lit, c)) for c in costs]))
    base = cut_lineage(base)
    key_types = ", ".join(f"`{x}` {base.schema[x].dataType.simpleString()}" for x in keys)
    open_, found = base.where("k_eff > 0"), None
    for radius in (*RADII, None):
        targets = _tables(base, keys, radius, radix)
        asked = _tables(open_, keys, radius, radix)
        group = [*keys, "chunk", "value"]
        # at most (chunks * patterns / block) rows
        large = bounded_broadcast(targets.groupBy(*group).count().where(F.col("count") > block).select(
            *group, F.ceil(F.col("count") / block).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        both = (targets.join(large, group, "left")
                .withColumn("part", F.pmod(F.xxhash64("code"), parts).cast("int"))
                .withColumn("asks", F.lit(False)).unionByName(
                    asked.join(large, group, "left").withColumn(
                        "part", F.explode(F.sequence(F.lit(0), parts - 1)))
                    .withColumn("asks", F.lit(True))).drop("parts"))
        hit = (both.groupBy(*group, "part").applyInArrow(
            _nearest(radix, radius, keys), f"{key_types}, a_code long, b_code long, dist double, "
                                           "avail long, k_eff long")
            .dropDuplicates([*keys, "a_code", "b_code"]))
        hit = hit if found is None else found.unionByName(hit).dropDuplicates([*keys, "a_code", "b_code"])
        found = cut_lineage(hit)
        if radius is None:
            break
        # the smallest costs of the features, each feature's least above 0
        least = F.array_sort(F.filter(F.transform("costs", lambda c: F.array_min(
            F.filter(c, lambda x: x > 0))), lambda x: x.isNotNull()))
        bound = F.when(F.size(least) <= radius, F.lit(float("inf"))).otherwise(
            F.aggregate(F.slice(least, 1, radius + 1), F.lit(0.0), lambda s, x: s + x))
        inside = (found.join(open_.select(*keys, F.col("code").alias("a_code"), bound.alias("_lb")),
                             [*keys, "a_code"])
                  .where(F.col("dist") < F.col("_lb")).groupBy(*keys, "a_code", "k_eff")
                  .agg(F.sum("avail").alias("_got")).where(F.col("_got") >= F.col("k_eff"))
                  .select(*keys, F.col("a_code").alias("code")))
        open_ = cut_lineage(open_.join(inside, [*keys, "code"], "left_anti"))
        if open_.isEmpty():
            break
    # at most k rows of each pattern and round: bounded windows
    w = Window.partitionBy(*keys, "a_code").orderBy("dist", "b_code")
    return (found.withColumn("_before", F.coalesce(F.sum("avail").over(
                w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("take", F.least(F.col("avail"), F.col("k_eff") - F.col("_before")))
            .where("take > 0").select(*keys, "a_code", "b_code", "dist", "take"))
